"""Suffix arrays by linear grouping, without recursion or renaming.

First pass: suffixes start grouped by their first symbol. Groups are taken in descending order;
each member points to the nearest earlier suffix of a lower group (pointers of higher groups
serve as shortcuts), and the suffixes pointed to move up to new groups right above their old
ones, those with more pointers higher. In the end a group holds the suffixes that share their
longest Lyndon prefix. Second pass: suffixes are emitted in ascending order; what stands before
an emitted suffix, along the pointers, is next in its group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``text`` (non-negative symbols) in ascending order."""
    n = len(text) + 1  # with a sentinel below all symbols
    if n == 1:
        return np.zeros(0, np.int64)
    symbols = np.append(np.asarray(text, np.int64) + 1, 0)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sizes = np.diff(np.r_[heads, n])
    start_at = np.empty(n, np.int64)
    start_at[order] = np.repeat(heads, sizes)
    place_at = np.empty(n, np.int64)
    place_at[order] = np.arange(n)
    size_at = np.zeros(n, np.int64)
    size_at[heads] = sizes

    members, group, place, size = order.tolist(), start_at.tolist(), place_at.tolist(), size_at.tolist()
    before = [-1] * n
    pointed = [0] * n
    stop = n
    while stop > 0:
        start = group[members[stop - 1]]
        if stop - start == 1:
            i = members[start]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                _lift([p], members, group, place, size)
        else:
            targets = []
            for i in sorted(members[start:stop]):
                p = i - 1
                while p >= 0 and group[p] >= start:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    if not pointed[p]:
                        targets.append(p)
                    pointed[p] += 1
            if targets:
                if len(targets) > 1:
                    by_count: dict[int, list[int]] = {}
                    for p in targets:
                        by_count.setdefault(pointed[p], []).append(p)
                    for count in sorted(by_count, reverse=True):
                        _lift(by_count[count], members, group, place, size)
                else:
                    _lift(targets, members, group, place, size)
                for p in targets:
                    pointed[p] = 0
        stop = start

    out = [0] * n
    free = list(range(n))  # next open place of the group that begins here
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            done[j] = True
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = before[j]
    return np.array(out[1:], np.int64)


def _lift(some: list[int], members: list[int], group: list[int], place: list[int], size: list[int]) -> None:
    """Moves suffixes to the upper ends of their groups, as new groups."""
    moved: dict[int, int] = {}
    for p in some:
        g = group[p]
        k = moved.get(g, 0) + 1
        moved[g] = k
        to, at = g + size[g] - k, place[p]
        other = members[to]
        members[to], members[at] = p, other
        place[p], place[other] = to, at
    for g, k in moved.items():
        if k < size[g]:
            new = g + size[g] - k
            size[g] -= k
            size[new] = k
            for i in members[new : new + k]:
                group[i] = new
