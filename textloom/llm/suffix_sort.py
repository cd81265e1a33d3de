"""Deep-shallow sorting of suffixes.

Suffixes are first split by a multikey quicksort that takes eight bytes at a time, down to a
shallow depth. Groups that still agree there have long common prefixes, where comparing from the
front again and again would be slow; each is ordered by a blind trie, which compares a suffix
with one other suffix only.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

WORD = 8


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros beyond the end."""
    padded = np.concatenate((data, np.zeros(WORD - 1, np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(padded, WORD)[: len(data)].copy().view(">u8").ravel().astype(np.uint64)


def common_prefix(a: bytes, b: bytes) -> int:
    """Of two strings of one length."""
    differ = int.from_bytes(a) ^ int.from_bytes(b)
    return len(a) - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Strings of one length; an inner node knows at which byte its branches part and no more."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, text: bytes, item: int) -> None:
        """A node is [depth, {byte: node}]; a leaf [-1, text, items]."""
        if self.root is None:
            self.root = [-1, text, [item]]
            return
        node = self.root
        while node[0] >= 0:  # blindly
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node[1] == text:
            node[2].append(item)
            return
        depth = common_prefix(node[1], text)
        other = node[1][depth]
        above, node = None, self.root
        while 0 <= node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        leaf = [-1, text, [item]]
        if node[0] == depth:
            node[1][text[depth]] = leaf
            return
        split = [depth, {other: node, text[depth]: leaf}]
        if above is None:
            self.root = split
        else:
            above[1][text[above[0]]] = split

    def in_order(self, length: int) -> tuple[list[int], list[int]]:
        """Items by their strings, and the common prefix of each with the one before (0 first)."""
        items: list[int] = []
        shared: list[int] = []
        todo = [(self.root, 0)] if self.root else []
        while todo:
            node, before = todo.pop()
            if node[0] < 0:
                items += node[2]
                shared += [before] + [length] * (len(node[2]) - 1)
                continue
            branches = sorted(node[1])
            for i in range(len(branches) - 1, -1, -1):
                todo.append((node[1][branches[i]], node[0] if i else before))
        return items, shared


def deep_shallow_sort(data: bytes, starts: np.ndarray, length: int, shallow: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``length`` bytes, and the prefix each shares with the one before.

    Every suffix has ``length`` bytes. Shared prefixes under ``shallow`` are given as the number
    of whole words that agree, in bytes, and above that exactly.
    """
    n = len(starts)
    words = words_at(np.frombuffer(data, np.uint8))
    order = np.arange(n)
    lcp = np.zeros(n, np.int64)
    open_ = np.arange(n)  # slots of the order that belong to groups of two and more
    group = np.zeros(n, np.int64)
    depth = 0
    while len(open_) and depth < min(shallow, length - WORD + 1):
        member = order[open_]
        key = words[starts[member] + depth]
        by = np.lexsort((key, group))
        member, key, group = member[by], key[by], group[by]
        order[open_] = member
        first = np.ones(len(open_), bool)
        first[1:] = group[1:] != group[:-1]
        new = first.copy()
        new[1:] |= key[1:] != key[:-1]
        depth += WORD
        lcp[open_[~new]] = depth
        group = np.cumsum(new)
        size = np.bincount(group)[group]
        open_, group = open_[size > 1], group[size > 1]
    bounds = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [len(group)]
    slots, at = open_.tolist(), starts.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        trie = BlindTrie()
        for i in order[slots[a] : slots[a] + b - a].tolist():
            trie.add(data[at[i] : at[i] + length], i)
        items, shared = trie.in_order(length)
        order[slots[a] : slots[a] + b - a] = items
        lcp[slots[a] + 1 : slots[a] + b - a] = shared[1:]
    return order, lcp


def repeated_windows(texts: list[bytes], runs: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each text the ranges of its first ``runs`` windows that equal another window of any text."""
    first = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    counts = np.array(runs, np.int64)
    offset = np.concatenate(([0], np.cumsum(counts)))
    starts = np.repeat(first[:-1] - offset[:-1], counts) + np.arange(offset[-1])
    order, lcp = deep_shallow_sort(b"".join(texts), starts, length)
    same = lcp >= length
    hit = same.copy()
    hit[:-1] |= same[1:]
    again = np.zeros(len(starts), bool)
    again[order[hit]] = True
    edge = np.diff(np.concatenate(([0], again.astype(np.int8), [0])))
    ups, downs = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    ends = offset.tolist()
    for a, b in zip(ups, downs, strict=True):
        t = bisect_left(ends, a + 1) - 1
        while a < b:  # a range may run on into the next text
            stop = min(b, ends[t + 1])
            out[t].append((a - ends[t], stop - ends[t]))
            a, t = stop, t + 1
    return out
