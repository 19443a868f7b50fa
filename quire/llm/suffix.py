"""Suffix sorting by grouping, in linear time and without recursive renaming.

Phase 1 keeps suffixes in groups and handles groups in descending order. When a group is
handled, each of its suffixes has a pointer to the nearest earlier suffix of a smaller
group. Suffixes that are pointed at are moved, most pointers first, into new groups
right above the rest of their own. In the end a group holds the suffixes that share
their longest Lyndon prefix, and groups are in order. Phase 2 goes through the
result from its least suffix and, along the same pointers, sets each suffix at the next
free place of its group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ``symbols`` in lexicographic order.

    Any integers; a suffix that is a prefix of another comes first. Empty input gives
    an empty result.
    """
    n = len(symbols) + 1  # with an end symbol below all others
    if n == 1:
        return np.zeros(0, np.int64)
    text = np.empty(n, np.int64)
    text[:-1] = symbols
    text[-1] = text[:-1].min() - 1
    by_symbol = np.argsort(text, kind="stable")
    ordered = text[by_symbol]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(heads, n))
    of = np.empty(n, np.int64)
    of[by_symbol] = np.repeat(heads, sizes)
    size_at = np.zeros(n, np.int64)
    size_at[heads] = sizes
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    group, size, slots, place = of.tolist(), size_at.tolist(), by_symbol.tolist(), place.tolist()
    smaller = [-1] * n

    end = n
    while end:
        start = group[slots[end - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(slots[start:end]) if end - start > 1 else slots[start:end]:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            if len(pointed) == 1 or max(pointed.values()) == 1:
                _raise(list(pointed), group, size, slots, place)
            else:
                by_count: dict[int, list[int]] = {}
                for p, c in pointed.items():
                    by_count.setdefault(c, []).append(p)
                for c in sorted(by_count, reverse=True):
                    _raise(by_count[c], group, size, slots, place)
        end = start

    out, free, done = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not done[p]:
            head = group[p]
            out[free[head]] = p
            free[head] += 1
            done[p] = 1
            p = smaller[p]
    return np.array(out[1:], np.int64)


def _raise(moved: list[int], group: list[int], size: list[int], slots: list[int], place: list[int]) -> None:
    """Moves suffixes to the upper end of their groups and makes groups of them there."""
    taken: dict[int, int] = {}
    for p in moved:
        head = group[p]
        m = taken.get(head, 0) + 1
        taken[head] = m
        top = head + size[head] - m
        other, at = slots[top], place[p]
        slots[top], slots[at] = p, other
        place[p], place[other] = top, at
    for head, m in taken.items():
        rest = size[head] - m
        size[head] = rest
        new = head + rest
        size[new] = m
        for k in range(new, new + m):
            group[slots[k]] = new


def repeated_windows(symbols: np.ndarray, width: int) -> np.ndarray:
    """Whether each position's next ``width`` symbols also start elsewhere; False near the end."""
    out = np.zeros(len(symbols), bool)
    order = suffix_array(symbols)
    order = order[order <= len(symbols) - width]
    if len(order) > 1:
        seen = np.lib.stride_tricks.sliding_window_view(symbols, width)
        same = np.zeros(len(order) - 1, bool)
        for a in range(0, len(same), 1 << 16):
            b = min(a + (1 << 16), len(same))
            same[a:b] = (seen[order[a:b]] == seen[order[a + 1 : b + 1]]).all(axis=1)
        out[order[:-1][same]] = True
        out[order[1:][same]] = True
    return out
