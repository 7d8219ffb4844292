"""Minimal acceptors of word lists, and their composition with a one-edit transducer.

The words of an acceptor are numbered in code-point order: every arc knows how
many words come before it, so a path sums up to the number of its word.
"""

from __future__ import annotations

import os

import numpy as np

#: Start rows of the second tape that are followed at a time.
CHUNK = 400_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, place)`` of all places ``starts[row] … starts[row] + sizes[row] - 1``."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    before = np.cumsum(sizes) - sizes
    return row, np.arange(len(row)) - before[row] + starts[row]


class Acceptor:
    """The minimal deterministic acceptor of ``words`` (distinct, in code-point order)."""

    def __init__(self, words: list[str]):
        parent, label, depth, ends = self._tree(words)
        state = self._states(parent, label, depth, ends)
        self._arcs(parent, label, state, ends)

    @staticmethod
    def _tree(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The prefix tree in preorder; a word adds what it does not share with the one before it."""
        parents, labels, depths, ends = [np.zeros(1, np.int64)], [], [np.zeros(1, np.int64)], []
        path, nodes, last = [0], 1, ""
        for word in words:
            shared = len(os.path.commonprefix((last, word)))
            fresh = len(word) - shared
            grown = range(nodes, nodes + fresh)
            if fresh:
                parents.append(np.r_[path[shared], np.arange(nodes, nodes + fresh - 1)])
                depths.append(np.arange(shared + 1, len(word) + 1))
                labels.append(word[shared:])
            path[shared + 1 :] = grown
            nodes += fresh
            ends.append(path[len(word)])
            last = word
        codes = np.frombuffer("".join(labels).encode("utf-32-le"), np.uint32).astype(np.int64)
        final = np.zeros(nodes, bool)
        final[ends] = True
        return np.concatenate(parents), np.r_[0, codes], np.concatenate(depths), final

    @staticmethod
    def _states(parent: np.ndarray, label: np.ndarray, depth: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Class of every node; nodes of equal right languages share one, found from the leaves upwards."""
        n = len(parent)
        height = np.zeros(n, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.r_[np.flatnonzero(np.diff(depth[order], prepend=-1)), n]
        for a, b in zip(cuts[-2:0:-1], cuts[:0:-1]):
            level = order[a:b]
            np.maximum.at(height, parent[level], height[level] + 1)
        state = np.zeros(n, np.int64)
        signature = ends.astype(np.uint64)
        found = 0
        order = np.argsort(height, kind="stable")
        cuts = np.r_[np.flatnonzero(np.diff(height[order], prepend=-1)), n]
        for a, b in zip(cuts[:-1], cuts[1:]):
            level = order[a:b]
            # equal signatures of 64 bits on one height stand for equal sets of arcs
            distinct, inverse = np.unique(signature[level], return_inverse=True)
            state[level] = found + inverse
            found += len(distinct)
            above = level[level > 0]
            arc = _mixed(state[above].astype(np.uint64) * _MIX + label[above].astype(np.uint64))
            np.add.at(signature, parent[above], _mixed(arc + np.uint64(1)))
        return state

    def _arcs(self, parent: np.ndarray, label: np.ndarray, state: np.ndarray, ends: np.ndarray) -> None:
        """Arcs of one node per state, by state and label, with the number of words before each."""
        states, shown = np.unique(state, return_index=True)
        self.final = ends[shown]
        self.root = int(state[0])
        kept = np.zeros(len(parent), bool)
        kept[shown] = True
        arcs = 1 + np.flatnonzero(kept[parent[1:]])
        self.labels, code = np.unique(label[arcs], return_inverse=True)
        key = state[parent[arcs]] * max(1, len(self.labels)) + code
        order = np.argsort(key)
        self.key, self.code, self.target = key[order], code[order], state[arcs][order]
        source = state[parent[arcs]][order]
        self.first = np.searchsorted(source, np.arange(len(states)))
        self.degree = np.searchsorted(source, np.arange(len(states)), "right") - self.first
        self.words = np.zeros(len(states), np.int64)
        self.before = np.zeros(len(arcs), np.int64)
        # states are numbered by height, so targets are counted before their sources
        for s in range(len(states)):
            a, b = self.first[s], self.first[s] + self.degree[s]
            sums = np.cumsum(self.words[self.target[a:b]]) + self.final[s]
            self.before[a:b] = np.r_[int(self.final[s]), sums[:-1]][: b - a]
            self.words[s] = sums[-1] if b > a else self.final[s]

    def _common(self, r: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray, bar: np.ndarray | None) -> list:
        """Words ``(i, j)`` that go on alike from states ``r`` and ``s``; ``bar`` is a label not to go on with."""
        out = []
        while len(r):
            same = r == s if bar is None else np.zeros(len(r), bool)
            if same.any():  # one state: everything behind it is common
                row, step = _spread(np.zeros(int(same.sum()), np.int64), self.words[r[same]])
                out.append((i[same][row] + step, j[same][row] + step))
                r, s, i, j = (x[~same] for x in (r, s, i, j))
            both = self.final[r] & self.final[s]
            out.append((i[both], j[both]))
            row, arc = _spread(self.first[r], self.degree[r])
            if bar is not None:
                open_ = self.code[arc] != bar[row]
                row, arc, bar = row[open_], arc[open_], None
            wanted = s[row] * len(self.labels) + self.code[arc]
            place = np.searchsorted(self.key, wanted)
            met = np.flatnonzero(np.r_[self.key, -1][place] == wanted)
            row, arc, other = row[met], arc[met], place[met]
            r, s = self.target[arc], self.target[other]
            i, j = i[row] + self.before[arc], j[row] + self.before[other]
        return out

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pairs of words one edit apart, each pair once.

        The composition of acceptor, one-edit transducer and acceptor reads both
        words alike up to the edit, so both tapes are in one state there. An edit
        is taken where the words first differ, so each pair has one path.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        state, base = np.array([self.root]), np.zeros(1, np.int64)
        while len(state):
            cost = np.cumsum(self.degree[state] ** 2 + self.degree[state])
            cuts = np.searchsorted(cost, np.arange(CHUNK, cost[-1], CHUNK))
            for q, at in zip(np.split(state, cuts), np.split(base, cuts)):
                row, arc = _spread(self.first[q], self.degree[q])
                # another letter: every two arcs of the state
                rest = self.first[q][row] + self.degree[q][row] - arc - 1
                left, second = _spread(arc + 1, rest)
                start = at[row][left]
                found += self._common(
                    self.target[arc[left]], self.target[second], start + self.before[arc[left]], start + self.before[second], None
                )
                # a letter more: the first tape moves, the second does not begin with that letter
                found += self._common(self.target[arc], q[row], at[row] + self.before[arc], at[row], self.code[arc])
            row, arc = _spread(self.first[state], self.degree[state])
            state, base = self.target[arc], base[row] + self.before[arc]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
