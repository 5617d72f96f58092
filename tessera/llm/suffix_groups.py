"""Suffix arrays by linear grouping over Lyndon prefixes, for many strings side by side.

First, suffixes are put into groups of equal first symbol, and groups are taken in descending order.
For each suffix of the group, ``prev`` is the nearest position to its left in a lower group, found
over the pointers of suffixes done before. Suffixes that are some others' prev, once, twice, and so
on, leave their group for new ones right above it, more often named ones higher. In the end groups
hold the suffixes of one Lyndon prefix each. Then each group's order is emitted: suffixes are visited
in rank order, and from the position to the left the prev pointers lead along all suffixes whose
place is next in their groups. No symbols are renamed and nothing recurs.

Each step is done for the current group, or rank, of all strings of a batch at once.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - before, size)


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of all strings, string by string, each string's in the order of its suffixes.

    symbols: small non-negative integers; string q is symbols[offsets[q]:offsets[q + 1]] and must end
    with a symbol that is less than all its others.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    low = np.asarray(offsets[:-1], np.int64)
    string = np.repeat(np.arange(len(low)), np.diff(offsets))
    floor = low[string]
    key = string * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(first, np.diff(np.append(first, n)))
    end = np.zeros(n, np.int64)  # by the index where a group starts
    end[first] = np.append(first[1:], n)
    prev = np.arange(-1, n - 1)

    top = np.asarray(offsets[1:], np.int64).copy()
    while len(top):
        at = group[order[top - 1]]
        members = order[_ranges(at, top - at)]
        base, own = floor[members], group[members]
        todo = np.arange(len(members))
        while len(todo):
            p = prev[members[todo]]
            todo = todo[(p >= base[todo])]
            p = prev[members[todo]]
            todo = todo[group[p] >= own[todo]]
            prev[members[todo]] = prev[prev[members[todo]]]
        p = prev[members]
        p = p[p >= base]
        if len(p):
            target, times = np.unique(p, return_counts=True)
            old = group[target]
            by = np.lexsort((times, old))
            target, times, old = target[by], times[by], old[by]
            head = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
            many = np.diff(np.append(head, len(old)))
            stop = end[old[head]]
            slots = _ranges(stop - many, many)  # the last places of each group are for its targets
            is_target = np.zeros(len(slots), bool)
            mine = place[target]
            begin = np.repeat(stop - many, many)
            inside = mine >= begin
            of_slot = np.cumsum(many) - many
            is_target[mine[inside] - begin[inside] + np.repeat(of_slot, many)[inside]] = True
            free, stay = mine[~inside], order[slots[~is_target]]
            order[free] = stay
            place[stay] = free
            order[slots] = target
            place[target] = slots
            new = np.flatnonzero(np.concatenate(([True], (old[1:] != old[:-1]) | (times[1:] != times[:-1]))))
            size = np.diff(np.append(new, len(old)))
            group[target] = np.repeat(slots[new], size)
            end[old[head]] = stop - many
            end[slots[new]] = slots[new] + size
        top = at[at > floor[order[at]]]

    out = np.full(n, -1)
    filled = np.zeros(n, np.int64)  # by group
    done = np.zeros(n, bool)
    last = np.asarray(offsets[1:], np.int64) - 1
    out[low], done[last] = last, True
    length = np.diff(offsets)
    by = np.argsort(-length, kind="stable")
    low, length = low[by], length[by]
    for r in range(int(length[0])):
        live = low[: np.searchsorted(-length, -r)]
        j = out[live + r] - 1
        j = j[(j >= live) & ~done[np.maximum(j, 0)]]
        while len(j):
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            done[j] = True
            b = floor[j]
            j = prev[j]
            j = j[(j >= b) & ~done[np.maximum(j, 0)]]
    return out
