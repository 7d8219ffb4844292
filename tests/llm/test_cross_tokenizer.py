import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelforge.llm import token_alignment
from panelforge.llm.cross_tokenizer import VOCABULARY_A, VOCABULARY_B, Files, align_documents, pair_counts, tree_summed
from panelforge.llm.perfect_hash import PerfectHash
from panelforge.llm.token_alignment import Tokenizers, byte_letters

SPECIAL = [
    "line\nbreaks\n\n  and\ttabs \t mixed \n\t x", "trailing  ", "   leading", "\n", " ", "  \n ", "é€😀 naïve “quoted” 漢字かな", "a b  c",
    "piece ▁ mark", "▁", "odd\x1cspace \x1f y", "\x85 next", "zero\u200bwidth \ufeff bom", "nul \x00 byte", "<|endoftext|> <s> </s> <unk> <0x41>",
    "it's we'll don't 12345 3.14 +49 x_y", "{\r\n}\r\n);\r", "wide　space  em", "ﬁne ﬃ ½ ①", "é combining", "tab\there\rcr", "a  b   c    d",
]


@pytest.fixture(scope="module")
def tokenizers():
    files = Files.read(VOCABULARY_A, VOCABULARY_B)
    return Tokenizers(files.json, files.model)


class Plain:
    """Whole texts encoded at once, links found token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(VOCABULARY_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY_B)
        self.letters = byte_letters()

    def piece(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = [self.piece(i) for i in b]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (bytes_a, bytes_b)]
        links, j = [], 0
        for i, end in enumerate(ends[0]):
            start = end - len(bytes_a[i])
            while ends[1][j] <= start:
                j += 1
            k = j
            while k < len(b) and ends[1][k] - len(bytes_b[k]) < end:
                links.append((a[i], b[k]))
                k += 1
        groups, at_a, at_b = [], 0, 0
        after_a, after_b = ({end: k + 1 for k, end in enumerate(side)} for side in ends)
        for cut in sorted(after_a.keys() & after_b.keys()):
            to_a, to_b = after_a[cut], after_b[cut]
            groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        return len(a), len(b), groups, links

    def rows(self, texts):
        found = [(doc_id, self.tokens(text)) for doc_id, text in texts]
        counts = Counter(link for _, t in found if t for link in t[3])
        highest = {}
        for (_, b), n in counts.items():
            highest[b] = max(n, highest.get(b, 0))
        out = []
        for doc_id, t in found:
            if t is None:
                out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
                continue
            best = sum(counts[link] == highest[link[1]] for link in t[3])
            digest = hashlib.sha256(";".join(t[2]).encode()).hexdigest()
            out.append((doc_id, t[0], t[1], len(t[2]), len(t[3]), best, sum(counts[link] for link in t[3]), digest))
        return out, counts


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def docs(spark, odd):
    extra = spark.createDataFrame(list(enumerate(SPECIAL, 5_000)), "doc_id long, text string")
    return odd.unionByName(extra, allowMissingColumns=True).repartition(5)


def test_segments_are_encoded_like_whole_texts(tokenizers):
    plain, rng = Plain(), random.Random(4)
    letters = " \n\t\r \x1c▁ab'é漢.1{}"
    texts = SPECIAL + ["".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(2000)]
    assert tokenizers.cuts
    for text in texts:
        segments = tokenizers.segments(text)
        assert "".join(segments) == " " + text
        found = tokenizers.encode(segments)
        if all(found.n_a):  # the bytes are the text's
            a, b = ({k: [] for k in range(len(segments))} for _ in range(2))
            for k, ids_a, ids_b in zip(found.places, np.split(found.ids_a, np.cumsum(found.n_a)), np.split(found.ids_b, np.cumsum(found.n_b))):
                a[k], b[k] = ids_a.tolist(), ids_b.tolist()
            assert sum(a.values(), []) == plain.a.encode(" " + text, add_special_tokens=False).ids, text
            assert sum(b.values(), []) == plain.b.encode(text), text
        else:
            assert plain.tokens(text) is None, text


def test_both_ways_agree_with_brute_force(spark, docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, counts = Plain().rows(texts)
    assert in_order(align_documents(docs).collect()) == in_order(want)
    assert in_order(align_documents(docs, sent_pairs=0).collect()) == in_order(want)
    got = {(r["a"], r["b"]): r["n"] for r in pair_counts(docs).collect()}
    assert got == counts
    mismatched = {5_008, 5_009}
    assert {r[0] for r in want if r[1] == 0} >= mismatched


def test_forgotten_segments_change_nothing(spark, docs, monkeypatch, tokenizers):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, _ = Plain().rows(texts)
    aligner = token_alignment.Aligner(tokenizers)
    total = np.zeros(3, np.int64)
    for _, text in texts:
        aligner.clear()
        (numbers,) = aligner.texts([text])
        total += [int(aligner.column(c)[numbers].sum()) for c in ("n_a", "n_b", "n_groups")]
    assert total.tolist() == [sum(r[k] for r in want) for k in (1, 2, 3)]


def test_perfect_hash_is_minimal_and_one_to_one():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        hashed = PerfectHash.unpacked(*PerfectHash.of(keys).packed())
        assert sorted(hashed.slots(keys)) == list(range(len(keys)))
    assert len(hashed.packed()[0]) * 8 < 6 * len(keys)


def test_vectors_are_summed_in_a_tree(spark):
    vectors = [(b, node, np.array([b, node, 1], np.int64).tobytes()) for b in (0, 1) for node in range(300)]
    df = spark.createDataFrame(vectors, "bucket long, node long, vector binary")
    got = {r["bucket"]: np.frombuffer(r["vector"], np.int64).tolist() for r in tree_summed(df, 300).collect()}
    assert got == {0: [0, 44850, 300], 1: [300, 44850, 300]}


def test_empty_table(none):
    assert align_documents(none).count() == 0
    assert pair_counts(none).count() == 0
