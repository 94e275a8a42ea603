"""Burrows-Wheeler transforms of small shards of strings, merged by iterative interleave refinement.

Each shard's suffixes are sorted once. Merging never sorts suffixes again: starting from the interleave by the first
character, each round moves every row by its shard's last-to-first mapping and keeps the rows of equal character in
their order, which refines the interleave from prefixes of length k to k + 1. Rows whose prefix occurs only once
leave the work; the last round that a row is in gives its longest common prefix with any other row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PACK = 7


@dataclass
class Shard:
    """``start``: position in the shard's text of the suffix of each row; ``before``: the character before it, plus
    one, zero at the start of a string; ``first``: its first character, plus one, zero at the end of a string;
    ``to_first``: the row of the suffix that is longer by that character."""

    start: np.ndarray
    before: np.ndarray
    first: np.ndarray
    to_first: np.ndarray


def build_shard(text: np.ndarray, left: np.ndarray) -> Shard:
    """The transform of one shard.

    ``text``: int16 characters plus one, each string followed by a zero; ``left``: characters from a position to the
    end of its string. Equal suffixes of different strings stand in the order of the strings.
    """
    n = len(text)
    longest = int(left.max()) if n else 0
    key = np.zeros(n, np.int64)
    padded = np.concatenate((text.astype(np.int64), np.zeros(PACK, np.int64)))
    for j in range(PACK):
        key <<= 9
        key |= np.where(j < left, padded[j : j + n], 0)
    rank = _ranks(key)
    width = PACK
    while width < longest:
        inside = left > width
        second = np.zeros(n, np.int64)
        second[inside] = rank[np.flatnonzero(inside) + width] + 1
        rank = _ranks(rank * (n + 1) + second)
        width *= 2
    start = np.argsort(rank, kind="stable")
    before = np.where(start > 0, text[start - 1], 0).astype(np.int16)
    to_first = np.empty(n, np.int64)
    to_first[np.argsort(before, kind="stable")] = np.arange(n)
    return Shard(start, before, text[start], to_first)


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ordered = key[order]
    step = np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64)))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def repeated_intervals(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, groups, common): the rows, numbered through the shards, whose first ``depth`` characters occur more
    than once, in merged order, the number of the interval that each is in, and for every row of all shards the
    length of its longest common prefix with another row, up to ``depth``."""
    offset = np.cumsum([0, *[len(s.start) for s in shards]])
    before = np.concatenate([s.before for s in shards])
    first = np.concatenate([s.first for s in shards])
    to_first = np.concatenate([s.to_first + o for s, o in zip(shards, offset)])
    common = np.zeros(len(before), np.uint8)
    rows = np.flatnonzero(first > 0)
    rows = rows[np.argsort(first[rows], kind="stable")]
    group = np.cumsum(np.concatenate(([0], first[rows][1:] != first[rows][:-1]))) if len(rows) else rows
    rows, group = _repeated(rows, group, common, 1)
    for k in range(2, depth + 1):
        c = before[rows]
        go = c > 0
        c, rows, group = (c[go] - 1).astype(np.uint8), to_first[rows[go]], group[go]
        order = np.argsort(c, kind="stable")
        c, rows, group = c[order], rows[order], group[order]
        if len(rows):
            fresh = (c[1:] != c[:-1]) | (group[1:] != group[:-1])
            group = np.concatenate(([0], np.cumsum(fresh)))
        rows, group = _repeated(rows, group, common, k)
        if not len(rows):
            break
    return rows, group, common


def _repeated(rows: np.ndarray, group: np.ndarray, common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Without rows that are alone in their group; all others share ``depth`` characters at least with another."""
    if not len(rows):
        return rows, group
    edge = np.concatenate(([True], group[1:] != group[:-1], [True]))
    several = ~(edge[:-1] & edge[1:])
    rows, group = rows[several], group[several]
    common[rows] = depth
    return rows, group
