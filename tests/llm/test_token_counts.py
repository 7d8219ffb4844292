import random

from panelforge.llm.token_counts import VOCABULARY, Tree, counter, edited_counts, ordered_edits, redactions


def applied(text, edits):
    out, at = "", 0
    for start, end, new in edits:
        out, at = out + text[at:start] + new, end
    return out + text[at:]


def test_edited_trees_count_like_whole_encodings():
    count, rng = counter(VOCABULARY), random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "1", "23", "é", "'s", "!", ".", "the ", "\t", "don't", " \n "]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 20, 200])))
        tree = Tree.build(text, count, rng.choice([2, 3, 8]))
        assert tree.total == len(count.encoding.encode_ordinary(text))
        spans = [(a, a + rng.choice([0, 0, 1, 3, 10])) for a in (rng.randint(0, len(text) + 2) for _ in range(4))]
        edits = ordered_edits([{"start": a, "end": b, "replacement": rng.choice([None, "", " ", "x", "  y", "\n", "1a "])} for a, b in spans], len(text))
        new, _ = tree.edit(text, edits, count)
        assert new == applied(text, edits)
        assert tree.total == len(count.encoding.encode_ordinary(new))
        size = len(tree.sums) // 2
        assert all(tree.sums[i] == tree.sums[2 * i] + tree.sums[2 * i + 1] for i in range(1, size))


def test_a_small_edit_encodes_a_small_part():
    count = counter(VOCABULARY)
    text = "some words and more of them " * 2_000
    tree = Tree.build(text, count)
    _, encoded = tree.edit(text, [(30_000, 30_004, "other")], count)
    assert 0 < encoded < 200


def test_documents_of_all_kinds(spark, odd, odd_rows, none):
    count = counter(VOCABULARY)
    mailed = odd.withColumn("text", odd["text"])
    got = edited_counts(mailed, redactions).collect()
    assert len(got) == len(odd_rows)
    want = sorted(len(count.encoding.encode_ordinary(r[1] or "")) for r in odd_rows)
    assert sorted(r.n_tokens for r in got) == want
    assert edited_counts(none, redactions).count() == 0
    rows = [(1, "write to a.b@c.example.com or 10.0.0.1 now"), (1, "write to a.b@c.example.com or 10.0.0.1 now"), (2, "nothing")]
    found = {r.doc_id: r for r in edited_counts(spark.createDataFrame(rows, "doc_id long, text string"), redactions).collect()}
    assert found[1].n_edits == 2 and found[2].n_edits == 0
    assert found[1].n_tokens_edited == len(count.encoding.encode_ordinary("write to <email> or <ip> now"))
