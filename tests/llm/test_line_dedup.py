import hashlib
from collections import defaultdict

from panelforge.llm.line_dedup import NO_ID, apply_bitmaps, keep_bitmaps


def key(line):
    return line.strip(" \t\n\v\f\r").encode().lower().decode()


def expected(rows):
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(NO_ID if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        own = NO_ID if doc_id is None else doc_id
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == own]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs):
    return sorted((tuple(r) for r in apply_bitmaps(docs, keep_bitmaps(docs)).collect()), key=str)


def test_odd_documents(odd, odd_rows, none):
    assert run(odd) == expected([r[:2] for r in odd_rows])
    assert run(none) == []


def test_a_line_in_all_documents_is_spread_over_partitions(spark):
    rows = [(i, "\n".join([f"This line is everywhere in it{' ' * (i % 3)}"] * (1 + i % 2) + [f"own {i}", f"a line of seven documents {i // 7}"])) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert run(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
