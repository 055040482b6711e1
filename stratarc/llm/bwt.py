"""Merging Burrows-Wheeler transforms of shards, in numpy; small arrays inside one task.

Each shard of strings has its own transform: its suffixes in order, the character in front of each, and the LF mapping
(the row of the suffix that is one character longer).  The merged order is found by refining the interleave of the
shards' rows: rows start in shard order; a round takes each row along the LF mapping of its own shard and deals rows
stably by the character met (two rounds are done at once).  After k rounds the rows are in the order of their first k
characters, and rows with the same k characters are neighbours; where two neighbours part in round k, their common
prefix is k - 1 long.  Rows that have parted from both neighbours cannot be in a repeated interval any more and leave;
rows without enough characters in front never enter.  No suffixes of different shards are ever compared or sorted.
"""

from __future__ import annotations

import numpy as np


def shard_transforms(text: np.ndarray, lengths: np.ndarray, shard: np.ndarray, depth: int):
    """(order, before, back) of the suffixes of all strings, shard after shard.

    ``shard``: the shard of each string, ascending from 0.  A string of n characters has n + 1 suffixes (the empty one
    too).  ``order``: places of suffixes, those of one shard by their first ``depth`` characters; ``before``: the
    character in front of each; ``back``: the row of that longer suffix (both arbitrary where a string begins).
    """
    n = len(text) + len(lengths)
    ends = np.cumsum(lengths + 1) - 1
    plain = np.zeros(n, np.uint8)
    body = np.ones(n, bool)
    body[ends] = False
    plain[body] = text
    codes = np.cumsum(np.bincount(text, minlength=256) > 0)  # letters in use, from 1; 0 ends a string
    chars = np.where(body, codes[plain], 0).astype(np.uint64)
    width = np.uint64(int(codes[-1]).bit_length())
    places = np.uint64(n.bit_length())
    key = np.repeat(shard.astype(np.uint64), lengths + 1)
    reach = max(1, (64 - int(places) - int(shard[-1]).bit_length()) // int(width))
    chars = np.concatenate((chars, np.zeros(reach, np.uint64)))
    for j in range(reach):
        key <<= width
        key |= chars[j : j + n]
    key <<= places
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << int(places)) - 1)).astype(np.int64)
    key >>= places
    slots = np.arange(n)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.maximum.accumulate(np.where(new, slots, 0))  # slot of the first row of the row's group
    rank = np.zeros(n + 1, np.int64)
    while reach < depth:
        slots = slots[~(new & np.concatenate((new[1:], [True])))]
        if not len(slots):
            break
        if reach and not rank.any():
            rank[order] = first + 1
        at, own = order[slots], first[slots]
        key = (own.astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + reach, n)].astype(np.uint64)
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[slots] = at[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first[slots] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[order[slots]] = first[slots] + 1
        reach *= 2
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    longer = np.maximum(order - 1, 0)
    return order, plain[longer], row[longer]


def repeated_intervals(text: np.ndarray, lengths: np.ndarray, shard: np.ndarray, depth: int):
    """Intervals of the merged order whose rows share ``depth`` characters: (string, offset, interval), rows in order.

    Only intervals of two rows or more are given.
    """
    order, before, back = shard_transforms(text, lengths, shard, depth)
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    string = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    # only rows with enough characters in front can reach the depth
    front = (np.arange(len(order)) - np.repeat(begins, lengths + 1))[order]
    rows = np.flatnonzero(front >= depth).astype(np.int32)
    block = np.zeros(len(rows), np.int32)
    both, far = before.astype(np.uint16), back[back]
    both |= before[back].astype(np.uint16) << np.uint16(8)  # two rounds at once: by the nearer character last
    for step in [1] * (depth % 2) + [2] * (depth // 2):
        if not len(rows):
            break
        chars, jump = (before, back) if step == 1 else (both, far)
        char = chars[rows]
        by = np.argsort(char, kind="stable")
        char, block, rows = char[by], block[by], jump[rows[by]]
        part = np.concatenate(([True], (char[1:] != char[:-1]) | (block[1:] != block[:-1])))
        keep = ~(part & np.concatenate((part[1:], [True])))
        rows, block = rows[keep], np.cumsum(part, dtype=np.int32)[keep]
    where = order[rows]
    owner = string[where]
    return owner, where - begins[owner], block


def least_in_intervals(text: np.ndarray, lengths: np.ndarray, shard: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """For each place where ``depth`` characters begin, string after string: the least owner of all strings with these."""
    counts = np.maximum(lengths - depth + 1, 0)
    out = np.repeat(owner, counts)
    if len(out):
        begin = np.cumsum(counts) - counts
        string, offset, block = repeated_intervals(text, lengths, shard, depth)
        if len(string):
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            least = np.minimum.reduceat(owner[string], first)
            out[begin[string] + offset] = np.repeat(least, np.diff(np.append(first, len(block))))
    return out
