"""Token alignment of one text under two tokenizers, by byte offsets.

Neither tokenizer joins anything over the start of a run of white space that
follows other letters and begins with a space or a line break. Texts are cut there
into segments, each of which is encoded once for all its occurrences in a task.
"""

from __future__ import annotations

import itertools
import os
import re
from dataclasses import dataclass

import numpy as np

#: A run of white space with what follows it; other white space than blank and line break does not begin a segment.
_SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: Letters that one of the tokenizers may or may not take as white space: such texts stay in one piece.
_UNSURE = re.compile(r"[\x1c-\x1f\x85\u180e\u200b\u2060\u2581\ufeff]")

#: Segments kept between texts, and the longest that is kept.
KEPT_SEGMENTS = 600_000
LONGEST_KEPT = 200

#: Segments encoded end to end.
CHUNK = 256


def byte_letters() -> dict[str, int]:
    """The printable letters that a byte-level vocabulary writes for the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """A byte-level vocabulary (A) and a piece vocabulary (B) from the contents of their files."""

    def __init__(self, json: bytes, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        added = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = [
            added[i].encode() if i in added else bytes(letters[c] for c in self.a.id_to_token(i) or "") for i in range(size)
        ]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        pieces = (self.b.id_to_piece(i).replace("▁", " ") for i in range(len(self.bytes_b)))
        self.cuts = not any(re.search(r"\S[ \n]", p) for p in pieces)
        self.lead = self.b.encode("a")

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def segments(self, text: str) -> list[str]:
        """Pieces of the blank and ``text`` that both tokenizers encode on their own."""
        text = " " + text
        if not self.cuts or _UNSURE.search(text):
            return [text]
        return _SEGMENT.findall(text)

    def encode(self, segments: list[str]) -> Encoded:
        """Ids of segments under both. Segments are encoded end to end, a chunk at a time, as they would be cut again."""
        kept: list[Encoded] = []
        open_ends = {c for c in {s[-1] for s in segments} if c.isspace() or _UNSURE.search(c)}
        apart = [k for k, s in enumerate(segments) if not self.cuts or s[-1] in open_ends or s[0] not in " \n"]
        alone = set(apart)
        together = [k for k in range(len(segments)) if k not in alone]
        chunks = [together[k : k + CHUNK] for k in range(0, len(together), CHUNK)]
        texts = ["".join(map(segments.__getitem__, chunk)) for chunk in chunks]
        for chunk, text, ids_a, ids_b in zip(chunks, texts, self._ids_a(texts), self._ids_b(texts)):
            parts = map(segments.__getitem__, chunk)
            sizes = np.cumsum(list(map(len, parts if text.isascii() else map(str.encode, parts))))
            ends = [np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])]
            cut = [np.searchsorted(end, sizes) for end in ends]
            if self.same_bytes(text, ids_a, ids_b) and all(np.array_equal(end[at], sizes) for end, at in zip(ends, cut)):
                n_a, n_b = (np.diff(at + 1, prepend=0) for at in cut)
                kept.append(Encoded(chunk, np.asarray(ids_a), np.asarray(ids_b), n_a, n_b))
            else:
                apart += chunk
        texts = [segments[k] for k in apart]
        for k, text, ids_a, ids_b in zip(apart, texts, self._ids_a(texts), self._ids_b(texts)):
            if not self.same_bytes(text, ids_a, ids_b):
                ids_a = ids_b = []
            sizes = np.array([len(ids_a)]), np.array([len(ids_b)])
            kept.append(Encoded([k], np.asarray(ids_a, np.int64), np.asarray(ids_b, np.int64), *sizes))
        return Encoded.joined(kept)

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]

    def _ids_b(self, texts: list[str]) -> list[list[int]]:
        """B puts a blank before a text, so a letter is set before it and its token taken off."""
        lead = self.lead
        return [ids[len(lead) :] for ids in self.b.encode(["a" + t for t in texts], num_threads=1)]

    def same_bytes(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole


@dataclass
class Encoded:
    """Ids of the segments numbered ``places``, end to end, and how many each has; none where the bytes are not the segment's."""

    places: list[int]
    ids_a: np.ndarray
    ids_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    @classmethod
    def joined(cls, parts: list[Encoded]) -> Encoded:
        none = np.zeros(0, np.int64)
        columns = (np.concatenate([none, *[getattr(p, c) for p in parts]]) for c in ("ids_a", "ids_b", "n_a", "n_b"))
        return cls([k for p in parts for k in p.places], *columns)


@dataclass
class Aligned:
    """Segments with their token counts, groups as text, and links, end to end."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pairs: np.ndarray


def align(tokenizers: Tokenizers, encoded: Encoded, with_groups: bool = True) -> Aligned:
    """Aligns segments whose tokens join to the same bytes on both sides; all at once, end to end on one line of bytes."""
    ids_a, ids_b, n_a, n_b = encoded.ids_a, encoded.ids_b, encoded.n_a, encoded.n_b
    end_a, end_b = np.cumsum(tokenizers.length_a[ids_a]), np.cumsum(tokenizers.length_b[ids_b])
    start_a, start_b = end_a - tokenizers.length_a[ids_a], end_b - tokenizers.length_b[ids_b]
    # links: the tokens of B from the one that holds A's first byte to the one that holds its last
    first = np.searchsorted(end_b, start_a, "right")
    links = np.searchsorted(start_b, end_a, "left") - first
    a = np.repeat(np.arange(len(ids_a)), links)
    b = np.arange(len(a)) - np.repeat(np.cumsum(links) - links, links) + np.repeat(first, links)
    pairs = ids_a[a] * len(tokenizers.bytes_b) + ids_b[b]
    segment_a = np.repeat(np.arange(len(n_a)), n_a)
    of_segment = np.bincount(segment_a, links, len(n_a)).astype(np.int64)
    # groups end where tokens of both end
    closes_a, closes_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
    n_groups = np.bincount(segment_a, closes_a, len(n_a)).astype(np.int64)
    groups, at = [], 0
    side_a, side_b = (_joined(ids_a, closes_a), _joined(ids_b, closes_b)) if with_groups else ([], [])
    for n in n_groups.tolist() if with_groups else ():
        groups.append(";".join(map("|".join, zip(side_a[at : at + n], side_b[at : at + n]))))
        at += n
    return Aligned(n_a, n_b, n_groups, of_segment, groups, pairs)


def _joined(ids: np.ndarray, closes: np.ndarray) -> list[str]:
    """Ids of one group joined by commas."""
    words = list(map(str, ids.tolist()))
    ends = (np.flatnonzero(closes) + 1).tolist()
    return [words[i] if j == i + 1 else ",".join(words[i:j]) for i, j in zip([0, *ends], ends)]


class Aligner:
    """Aligns texts; every segment is encoded and aligned once while it is kept."""

    def __init__(self, tokenizers: Tokenizers, with_groups: bool = True):
        self.tokenizers = tokenizers
        self.with_groups = with_groups
        self.cleared = 0
        self.clear()

    def clear(self) -> None:
        """Forgets the kept segments."""
        self.cleared += 1
        self.number: dict[str, int] = {}
        self.bad: set[int] = set()
        self.parts: list[Aligned] = []
        self.groups: list[str] = []
        self.columns: dict[str, tuple[int, np.ndarray]] = {}
        self.size = 0

    def is_full(self) -> bool:
        return self.size > KEPT_SEGMENTS

    def _add(self, fresh: list[str]) -> list[int]:
        """Aligns segments and numbers them."""
        encoded = self.tokenizers.encode(fresh)
        numbers = [0] * len(fresh)
        for number, k in enumerate(encoded.places, self.size):
            numbers[k] = number
        self.bad.update((self.size + np.flatnonzero(encoded.n_a == 0)).tolist())
        part = align(self.tokenizers, encoded, self.with_groups)
        self.parts.append(part)
        self.groups += part.groups
        self.size += len(fresh)
        return numbers

    def texts(self, texts: list[str | None]) -> list[list[int]]:
        """Numbers of the segments of every text; none for a text without tokens."""
        cut = [self.tokenizers.segments(t) if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(cut))
        met = list(map(self.number.get, flat))
        unknown = [k for k, number in enumerate(met) if number is None]
        fresh = list({flat[k] for k in unknown})
        self.number |= zip(fresh, self._add(fresh))
        for k in unknown:
            met[k] = self.number[flat[k]]
        for s in fresh:
            if len(s) > LONGEST_KEPT:
                del self.number[s]
        ends = list(itertools.accumulate(map(len, cut), initial=0))
        numbers = [met[i:j] for i, j in itertools.pairwise(ends)]
        if self.bad:
            for k, found in enumerate(numbers):
                if not self.bad.isdisjoint(found):
                    # the text as a whole decides
                    whole = self._add([" " + texts[k]]) if len(found) > 1 else found
                    numbers[k] = [] if whole[0] in self.bad else whole
        return numbers

    def column(self, name: str) -> np.ndarray:
        """A count of every segment."""
        done, known = self.columns.get(name, (0, np.zeros(0, np.int64)))
        if done < len(self.parts):
            known = np.concatenate([known, *[getattr(p, name) for p in self.parts[done:]]])
            self.columns[name] = len(self.parts), known
        return known

    def pairs(self, since: int = 0, forget: bool = False) -> np.ndarray:
        """Links of the segments added from part ``since`` on, end to end; with ``forget`` they are not kept."""
        found = np.concatenate([np.zeros(0, np.int64), *[p.pairs for p in self.parts[since:]]])
        if forget:
            for p in self.parts[since:]:
                p.pairs = p.pairs[:0].copy()
        return found
