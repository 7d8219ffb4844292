import random
import zlib

from panelforge.llm.quality import Training, good_documents, score_documents

SMALL = Training(max_rows=600, shard_rows=300)


def corpus():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        good = i % 4 != 0
        text = " ".join(f"v{rng.randrange(500)}{'' if good else '!!'}" for _ in range(rng.randrange(20, 80)))
        rows.append((i, text, 0.0, 1))
        labels.append((i, int(good), 0, "x"))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = score_documents(docs, marks, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)
    kept = good_documents(docs, marks, SMALL)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)


def test_labels_of_held_out_documents_have_no_influence(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t, x) for i, q, t, x in labels]
    one, two = (
        {r.doc_id: r.score for r in score_documents(docs, spark.createDataFrame(m, "doc_id long, quality int, toxic int, text string"), SMALL).collect()}
        for m in (labels, turned)
    )
    assert one == two


def test_odd_documents_and_labels(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0), (3, 1), (999, 1)], "doc_id long, quality int")
    assert score_documents(odd, labels, SMALL).count() == len(odd_rows)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_documents(odd, empty, SMALL).collect()} == {0.5}
    assert score_documents(none, labels, SMALL).count() == 0
