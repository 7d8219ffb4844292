import random
import re
import zlib
from collections import Counter

from panelforge.llm.spelling_variants import counted_words, near_words, spelling_variants
from panelforge.llm.word_acceptor import Acceptor


def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) < len(v):
        u, v = v, u
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if v != w and one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] < 2 * n:
            best = None
        out[w] = (best, n, len(near), words.get(best))
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w] = (row[0], root, *row[1:])
    return out


def as_dict(df):
    return {r["word"]: tuple(r[1:]) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_composition_accepts_the_pairs_one_edit_apart():
    rng = random.Random(1)
    for letters in ("ab", "abcé", "abcdefgh") * 15:
        words = sorted({"".join(rng.choices(letters, k=rng.randrange(7))) for _ in range(rng.randrange(1, 60))})
        pairs = [tuple(sorted((words[i], words[j]))) for i, j in zip(*Acceptor(words).near())]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {(u, v) for u in words for v in words if u < v and one_edit(u, v)}


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("un", "re", "de") for b in ("do", "make", "tie"))
    starts = {w[:k] for w in words for k in range(len(w) + 1)}
    rests = {frozenset(w[len(s) :] for w in words if w.startswith(s)) for s in starts}
    assert len(Acceptor(words).final) == len(rests)


def test_partitions_and_shuffled_states_agree_with_brute_force(spark):
    rng = random.Random(2)
    words = {}
    for _ in range(700):
        w = "".join(rng.choices("abé", k=rng.randrange(5, 9)))
        words[rng.choice(["", "zzzzzz"]) + w] = rng.choice([3, 4, 8, 16, 40])
    words |= {"zzzzz": 5, "zzzzzz": 50, "x" * 3000: 9, "x" * 2999: 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_variants(words)
    for most in (20, 10_000):  # some states are crowded, none
        assert as_dict(spelling_variants(df, most=most)) == want


def test_every_state_crowded(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(5, 7))): n for n in (3, 4, 8, 16, 40) for _ in range(6)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_dict(spelling_variants(df, most=1)) == plain_variants(words)


def test_roots_follow_long_chains(spark):
    words = {"a" * 5 + "bcdefghij"[:k]: 3 * 2**k for k in range(10)}
    got = as_dict(spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {row[1] for row in got.values()} == {"aaaaabcdefghij"}


def test_words_of_odd_rows(spark, odd, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    spelled = [(i, f"Colour colour colours coloür NAÏVE naïve naive {'é' * 40}") for i in range(300)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(spelled, "doc_id long, text string"))
    want = plain_words(rows + spelled)
    assert {r["word"]: r["n"] for r in counted_words(docs).collect()} == want
    assert as_dict(spelling_variants(counted_words(docs))) == plain_variants(want)


def test_empty_tables_and_repeated_words(spark, none):
    assert spelling_variants(counted_words(none)).count() == 0
    df = spark.createDataFrame([("house", 2), ("house", 3), ("mouse", 11), (None, 4)], "word string, n long")
    assert as_dict(spelling_variants(df)) == {"house": ("mouse", "mouse", 5, 1, 11), "mouse": (None, "mouse", 11, 1, None)}
    assert near_words(df.where("word = 'mouse'")).count() == 0
