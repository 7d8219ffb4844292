"""Suffix arrays by linear grouping, over many short rows of names at once.

The text is the rows of an integer matrix, one after the other, each followed by
an end sign of its own that is below all names. Suffixes start in groups by
their first name. Groups are processed from the highest to the lowest: the
suffixes of a group hand themselves to the suffix that their previous-smaller
pointer names, and suffixes of one group that were handed to more often move to
a new group just above it. In the end a group holds the suffixes that begin
with the same longest Lyndon word. One pass over the suffixes in rising order
then puts each into the next free place of its group: the order is emitted from
the groups, and no name is ever given anew.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def previous_smaller(names: np.ndarray) -> np.ndarray:
    """For every place of every row the nearest place before it with a smaller suffix; -1 if there is none in the row."""
    rows, width = names.shape
    sign = np.zeros((rows, width + 1, width + 1), np.int8)
    for p in range(width - 1, -1, -1):
        # the shorter suffix, which begins later, meets its end sign first
        sign[:, p, width] = 1
        for s in range(width - 1, p, -1):
            step = np.sign(names[:, p] - names[:, s]).astype(np.int8)
            sign[:, p, s] = np.where(step == 0, sign[:, p + 1, s + 1], step)
    pointer = np.full((rows, width), -1, np.int64)
    for s in range(width):
        for p in range(s):
            pointer[sign[:, p, s] < 0, s] = p
    return pointer


def lyndon_groups(names: np.ndarray, pointer: np.ndarray) -> tuple[list[int], list[int]]:
    """The group of every suffix (row by row, without end signs) and the groups in rising order."""
    rows, width = names.shape
    flat = names.reshape(-1)
    base = np.repeat(np.arange(rows) * width, width)
    parent = np.where(pointer.reshape(-1) >= 0, base + pointer.reshape(-1), -1).tolist()
    order = np.argsort(flat, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0))
    members: list[list[int]] = [part.tolist() for part in np.split(order, starts[1:])]
    group = [0] * len(flat)
    for g, held in enumerate(members):
        for s in held:
            group[s] = g
    below = list(range(-1, len(members) - 1))
    above: dict[int, int] = {g: g + 1 for g in range(len(members) - 1)}
    top = len(members) - 1
    current = top
    while current >= 0:
        handed = Counter(parent[s] for s in members[current])
        handed.pop(-1, None)
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in handed.items():
            moved.setdefault((group[p], times), []).append(p)
        touched: dict[int, list[int]] = {}
        for old, times in moved:
            touched.setdefault(old, []).append(times)
        for old, counts in touched.items():
            counts.sort()
            leaving = sum(len(moved[old, times]) for times in counts)
            if leaving == len(members[old]):
                # all leave: the lowest count keeps the group
                members[old] = moved[old, counts[0]]
                counts = counts[1:]
            elif counts:
                gone = {p for times in counts for p in moved[old, times]}
                members[old] = [p for p in members[old] if p not in gone]
            low = old
            for times in counts:
                new = len(members)
                members.append(moved[old, times])
                for p in members[new]:
                    group[p] = new
                high = above.get(low)
                below.append(low)
                above[low] = new
                if high is None:
                    top = new
                else:
                    below[high] = new
                    above[new] = high
                low = new
        current = below[current]
    rising, at = [], top
    while at >= 0:
        rising.append(at)
        at = below[at]
    return group, rising[::-1]


def row_order(names: np.ndarray) -> np.ndarray:
    """The rows in the order of their suffix arrays' full-row suffixes (equal rows next to each other)."""
    rows, width = names.shape
    if not rows:
        return np.empty(0, np.int64)
    pointer = previous_smaller(names)
    group, rising = lyndon_groups(names, pointer)
    sizes = Counter(group)
    front, total = {}, rows
    for g in rising:
        front[g] = total
        total += sizes[g]
    step = width + 1
    # places with end signs: row r's suffixes are r * step ..., its end sign r * step + width
    suffixes = [0] * total
    suffixes[:rows] = [r * step + width for r in range(rows)]
    previous = np.where(pointer >= 0, pointer + np.arange(rows)[:, None] * step, -1).tolist()
    placed = bytearray(rows * step)
    for k in range(total):
        row, place = divmod(suffixes[k], step)
        s = place - 1
        ahead = previous[row]
        while s >= 0 and not placed[row * step + s]:
            placed[row * step + s] = 1
            g = group[row * width + s]
            suffixes[front[g]] = row * step + s
            front[g] += 1
            q = ahead[s]
            s = q - row * step if q >= 0 else -1
    return np.fromiter((x // step for x in suffixes if x % step == 0), np.int64, rows)
