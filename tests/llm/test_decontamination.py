import itertools
import random
import re

from panelforge.llm.decontamination import clean_documents, contaminated


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def expected(docs, items):
    """All windows of all alignments, one by one."""
    out = set()
    for doc_id, text in docs:
        d = plain(text)
        for item_id, passage in items:
            b = plain(passage)
            if len(b) < 7:
                continue
            width = min(13, len(b))
            need = -(-width * 8 // 10)
            for shift in range(-len(b) + 1, len(d)):
                same = [0 <= k + shift < len(d) and d[k + shift] == b[k] for k in range(len(b))]
                if any(sum(same[s : s + width]) >= need for s in range(len(b) - width + 1)):
                    out.add((doc_id, item_id))
    return out


def test_substituted_passages_are_found_and_others_left_alone(spark):
    rng = random.Random(6)
    word = lambda: f"z{rng.randrange(5000)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([8, 13, 30, 60])))) for k in range(20)] + [(50, "too short to tell"), (51, None), (52, "")]
    docs = []
    for i in range(80):
        body = [word() for _ in range(rng.randrange(10, 80))]
        if i % 2:
            passage = plain(items[i % 20][1])
            if len(passage) >= 13:
                for at in rng.sample(range(len(passage)), 2 if i % 4 == 1 else 0):
                    passage[at] = word()
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() + rng.choice(["", ",", " -"]) for w in passage]
        docs.append((i, " ".join(body), "x", 1))
    docs += [(None, docs[1][1], "y", 1), (300, None, "x", 1), (301, "", "x", 1), docs[1]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, seed string, place int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = expected([d[:2] for d in docs], items)
    got = {(r.doc_id, r.item_id) for r in contaminated(frame, bench).collect()}
    assert got == want and len(want) >= 40
    kept = clean_documents(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, *_ in docs if d is not None and d not in {w for w, _ in want})


def test_odd_documents(spark, odd, odd_rows, none):
    bench = spark.createDataFrame([(1, odd_rows[16][1]), (2, odd_rows[16][1])], "item_id long, text string")
    found = {r.doc_id for r in contaminated(odd, bench).collect()}
    assert {14, 15, 16} <= found
    assert {r.item_id for r in contaminated(odd, bench).collect()} == {1}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(odd, empty).count() == 0
    assert clean_documents(odd, empty).count() == len(odd_rows)
    assert contaminated(none, bench).count() == 0


def placements(lengths, least):
    """Items of words of their own, and a document for every set of so many substituted words."""
    items, docs = [], []
    for n in lengths:
        items.append((n, " ".join(f"n{n}w{k}" for k in range(n))))
        for count in range(n - least(n) + 1):
            for places in itertools.combinations(range(n), count):
                passage = [f"x{k}" if k in places else w for k, w in enumerate(items[-1][1].split())]
                docs.append((len(docs), " ".join(["before", "it", *passage, "after", "it"]), n))
    return items, docs


def test_every_placement_of_two_substitutions_is_found(spark):
    items, docs = placements([13, 14], lambda n: n - 2)
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, n) for d, _, n in docs}


def test_short_items_are_found_with_every_allowed_substitution(spark):
    least = lambda n: n if n < 7 else -(-n * 8 // 10)
    items, docs = placements(range(1, 13), least)
    want = {(d, n) for d, _, n in docs}
    for n, text in items:
        words = text.split()
        # cut by the ends of a document
        docs += [(len(docs) + k, " ".join(cut), n) for k, cut in enumerate([words, words[n - least(n) :], words[: least(n)]])]
        want |= {(d[0], n) for d in docs[-3:]}
        # one word short of the least; other words between
        docs += [(len(docs), " ".join(words[: least(n) - 1]), n), (len(docs) + 1, " it ".join(words[:6]), n)]
        if n == 1:
            want.add((len(docs) - 1, 1))
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    found = contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(r.first_place >= 0 and r.n_matched >= least(r.item_id) for r in found)
