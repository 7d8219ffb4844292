import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, row long, score double, h long, `count` long"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, shared lines; extra columns of clashing names."""
    rng = random.Random(5)
    shared = "A line that several of the documents have in common"
    passage = words(rng, 90)
    near = words(rng, 300).split()
    texts = [
        None, "", " \t\n ", "one", "one two three", "ONE  two three", words(rng, 20_000), "x" * 5_000, "is " * 900, "is " * 900,
        f"{shared}\nfirst\n{shared}", f"second\n  {shared.upper()}\t", f"{shared}", f"{shared}\nlast",
        f"{words(rng, 60)} {passage} {words(rng, 60)}", f"{words(rng, 40)} {passage} {words(rng, 80)}", f"{passage} {words(rng, 30)}",
        " ".join(near), " ".join([*near[:150], "changed", *near[151:]]), " ".join([*near[:80], "other", *near[81:]]), "\0ends\0 é €",
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(None, texts[17], "en", "s1"), (None, None, None, None), (10**15, texts[6], "de", "s2")]
    rows += [rows[14], rows[14], rows[4]]
    rows += [(100 + i, words(rng, rng.randrange(1, 200)), "en", "s1" if i % 3 else "s2") for i in range(60)]
    return [(*r, -1, 7, "k", 3, 0.5, 2, 9) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
