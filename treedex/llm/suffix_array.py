"""Suffix sorting in linear time by grouping (after Baier, "Linear-time suffix sorting", CPM 2016).

Phase 1 sorts suffixes into groups with a common Lyndon prefix: groups are taken in descending order; each member's pointer to the previous smaller group is
found by following pointers already set, and suffixes pointed at move to a new, higher group behind their own, those pointed at more often further up.
Phase 2 emits each group's order in one pass over the array: a suffix that is placed places the one before it and all along that one's pointers. Nothing
is renamed and no smaller problem is solved.

suffix_arrays() sorts many texts. Short ones go side by side: in each step every text takes its own highest group, as array operations over all texts, so that the
steps are as many as the groups of one text. Long ones go one by one, symbol by symbol.
"""

from __future__ import annotations

import numpy as np

#: Symbols up to which a text goes side by side with others.
SHORT = 128


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many each."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


def suffix_arrays(text: np.ndarray, off: np.ndarray) -> np.ndarray:
    """text: integers of texts one behind another, each text's last symbol smaller than its others; off: where each begins, and the end.

    The starts of the suffixes, text by text, in ascending order.
    """
    lens = np.diff(off)
    out = np.empty(len(text), np.int64)
    size = np.where(lens <= SHORT, np.ceil(np.log2(np.maximum(lens, 2))), 0).astype(np.int64)
    for k in np.unique(size).tolist():  # texts of like lengths end together
        which = np.flatnonzero(size == k)
        at = ranges(off[:-1][which], lens[which])
        if k:
            own = np.concatenate([[0], np.cumsum(lens[which])])
            out[at] = at[_side_by_side(text[at], own)]
        else:
            for i in which.tolist():
                out[off[i] : off[i + 1]] = off[i] + suffix_array(text[off[i] : off[i + 1]])
    return out


def _side_by_side(text: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(text)
    lane = np.repeat(np.arange(len(off) - 1), np.diff(off))
    first = off[:-1][lane]
    sa = np.lexsort((text, lane))
    head = np.concatenate([[True], (text[sa][1:] != text[sa][:-1]) | (lane[sa][1:] != lane[sa][:-1])])
    at = np.flatnonzero(head)
    size = np.zeros(n, np.int64)
    size[at] = np.diff(np.append(at, n))
    group, place = np.empty(n, np.int64), np.empty(n, np.int64)
    group[sa], place[sa] = np.repeat(at, size[at]), np.arange(n)
    prev, moving = np.full(n, -1, np.int64), np.zeros(n, bool)
    begin, end = off[:-1].copy(), off[1:].copy()
    while len(end):
        g = group[sa[end - 1]]
        members = sa[ranges(g, end - g)]
        own = group[members]
        live = g > begin
        begin, end = begin[live], g[live]
        p = members - 1
        p[p < first[members]] = -1
        prev[members] = p
        todo = np.flatnonzero((p >= 0) & (group[p] >= own))
        while len(todo):
            m = members[todo]
            p = prev[prev[m]]
            prev[m] = p
            todo = todo[(p >= 0) & (group[p] >= own[todo])]
        j = prev[members]
        j = j[j >= 0]
        if not len(j):
            continue
        hit, times = np.unique(j, return_counts=True)
        for c in range(int(times.max()), 0, -1):
            js = hit[times == c]
            if not len(js):
                continue
            h = group[js]
            order = np.argsort(h, kind="stable")
            js, h = js[order], h[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            moved, of = np.diff(np.append(start, len(h))), h[start]
            part = moved < size[of]
            if not part.any():
                continue
            js, h = js[np.repeat(part, moved)], h[np.repeat(part, moved)]
            moved, of = moved[part], of[part]
            top = of + size[of] - moved
            moving[js] = True
            zone = sa[ranges(top, moved)]
            out = zone[~moving[zone]]
            into = js[place[js] < np.repeat(top, moved)]
            moving[js] = False
            p, q = place[into], place[out]
            sa[p], sa[q], place[out], place[into] = out, into, p, q
            group[js] = np.repeat(top, moved)
            size[of], size[top] = size[of] - moved, moved
    out, put, free = np.zeros(n, np.int64), np.zeros(n, bool), np.arange(n)
    lens, start = np.diff(off), off[:-1]
    out[start] = off[1:] - 1
    put[off[1:] - 1] = True
    by_length = np.argsort(-lens, kind="stable")
    lens, start = lens[by_length], start[by_length]
    for i in range(int(lens[0]) if len(lens) else 0):
        live = start[: int(np.searchsorted(-lens, -i, "left"))]
        j = out[live + i] - 1
        j = j[j >= live]
        while len(j := j[~put[j]]):
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            put[j] = True
            j = prev[j]
            j = j[j >= 0]
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text: integers, the last one smaller than all others. The start of each suffix in ascending order."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    at = np.flatnonzero(head)
    starts = np.repeat(at, np.diff(np.append(at, n)))
    group = np.empty(n, np.int64)
    group[order] = starts
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sizes = np.zeros(n, np.int64)
    sizes[at] = np.diff(np.append(at, n))
    sa, group, place, size, prev = order.tolist(), group.tolist(), place.tolist(), sizes.tolist(), [-1] * n
    end = n
    while end > 0:
        g = group[sa[end - 1]]
        members = sa[g:end]
        end = g
        if len(members) == 1:
            i = members[0]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j < 0:
                continue
            hit = {1: [j]}
        else:
            members.sort()
            times: dict[int, int] = {}
            for i in members:
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            hit = {}
            for j, c in times.items():
                hit.setdefault(c, []).append(j)
        for c in sorted(hit, reverse=True):
            by_group: dict[int, list[int]] = {}
            for j in hit[c]:
                by_group.setdefault(group[j], []).append(j)
            for h, moved in by_group.items():
                k = size[h]
                if len(moved) == k:
                    continue
                top = h + k
                for j in moved:
                    top -= 1
                    p, other = place[j], sa[top]
                    sa[p], sa[top] = other, j
                    place[other], place[j] = p, top
                for j in moved:
                    group[j] = top
                size[h], size[top] = k - len(moved), len(moved)
    out, put, free = [0] * n, [False] * n, list(range(n))
    out[0], put[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not put[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            put[j] = True
            j = prev[j]
    return np.array(out)
