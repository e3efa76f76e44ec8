"""Suffix array by linear grouping construction.

Phase 1 sorts the suffixes into groups by their longest Lyndon prefix. Groups
are processed in descending order; a suffix's pointer leads to the nearest
earlier suffix in a smaller group (previous smaller), and the suffixes pointed to are
split off their groups, those with more pointers from the current group ranking
higher. Phase 2 walks the array in ascending order and emits each group's
members along the pointers. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``symbols`` (non-negative integers; an end smaller than all is understood)."""
    text = np.append(np.asarray(symbols, np.int64) + 1, 0)
    n = len(text)
    if n == 1:
        return np.empty(0, np.int64)
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    first = np.flatnonzero(np.append(True, sorted_text[1:] != sorted_text[:-1]))
    sizes = np.diff(np.append(first, n))
    start_of = np.empty(n, np.int64)
    start_of[order] = np.repeat(first, sizes)
    group = start_of.tolist()                 # start of a suffix's group
    listed = order.tolist()
    size = [0] * n                            # by group start
    by_end = [0] * n                          # group's last index -> its start
    members: dict[int, list[int]] = {}
    for g, k in zip(first.tolist(), sizes.tolist()):
        size[g] = k
        by_end[g + k - 1] = g
        members[g] = listed[g:g + k]
    prev = [-1] * n

    end = n - 1
    while end >= 0:
        g = by_end[end]
        own = members.pop(g)
        k = size[g]
        end -= k
        if len(own) != k:
            own = [x for x in own if group[x] == g]   # the others moved up meanwhile
        pointed: list[int] = []
        counts: list[int] = []
        last = -1
        for x in own:                                 # ascending, so pointers never fall
            p = x - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[x] = p
            if p == last:
                if p >= 0:
                    counts[-1] += 1
            else:
                pointed.append(p)
                counts.append(1)
                last = p
        if not pointed:
            continue
        if len(pointed) == 1:
            rounds = [pointed]
        else:
            most = max(counts)
            if most == 1:
                rounds = [pointed]
            else:
                by_count: dict[int, list[int]] = {}
                for p, c in zip(pointed, counts):
                    by_count.setdefault(c, []).append(p)
                rounds = [by_count[c] for c in sorted(by_count, reverse=True)]
        for ps in rounds:
            if len(ps) == 1:
                h = group[ps[0]]
                parts = ((h, ps),) if size[h] > 1 else ()
            else:
                split: dict[int, list[int]] = {}
                for p in ps:
                    h = group[p]
                    if size[h] > 1:
                        if h in split:
                            split[h].append(p)
                        else:
                            split[h] = [p]
                parts = split.items()
            for h, moved in parts:
                c, whole = len(moved), size[h]
                if c == whole:
                    continue
                at = h + whole - c
                size[h] = whole - c
                by_end[at - 1] = h
                size[at] = c
                by_end[at + c - 1] = at
                members[at] = moved
                for p in moved:
                    group[p] = at

    out = [0] * n
    free = list(range(n))                             # next slot, by group start
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = prev[p]
    return np.array(out[1:], np.int64)
