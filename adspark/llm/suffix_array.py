"""Suffix arrays by grouping suffixes under their longest Lyndon prefixes.

Phase one starts from groups by first symbol and visits groups in descending
order. Each suffix of the visited group points to the nearest suffix before it
in a smaller group. Suffixes that are pointed at the same number of times leave
their group for a new one right behind it, more pointers farther behind. At the
end, a group's suffixes share their longest Lyndon prefix, and groups are in
order. Phase two emits the array from left to right: the suffix just emitted is
the next smaller suffix of the one before it, and of those along its pointers;
each takes the front of its group. Nothing is renamed and nothing recurs, and
every suffix is pointed from, moved and emitted a bounded number of times.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols) -> np.ndarray:
    """The starts of a sequence's suffixes in lexicographic order; a prefix comes first."""
    raw = np.frombuffer(symbols, np.uint8) if isinstance(symbols, (bytes, bytearray)) else np.asarray(symbols)
    n = len(raw) + 1
    if n < 3:
        return np.arange(len(raw))
    _, rank = np.unique(raw, return_inverse=True)
    text = np.concatenate((rank + 1, [0]))
    order = np.argsort(text, kind="stable")
    s = text[order]
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    sizes = np.diff(np.append(starts, n))
    first = np.empty(n, np.int64)
    first[order] = np.repeat(starts, sizes)
    group: list[int] = first.tolist()
    members: dict[int, list[int]] = {a: order[a : a + z].tolist() for a, z in zip(starts.tolist(), sizes.tolist())}
    size = {a: z for a, z in zip(starts.tolist(), sizes.tolist())}
    end_of = {a: a + z for a, z in size.items()}
    at_end = {e: a for a, e in end_of.items()}
    before = [-1] * n

    e = n
    while e > 0:
        g = at_end[e]
        e = g
        own = members.pop(g)
        pointed: dict[int, int] = {}
        for i in own:
            if group[i] != g:
                continue  # left for a later group meanwhile
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if not pointed:
            continue
        if len(pointed) == 1:
            (p,) = pointed
            moves = [(group[p], [p])]
        else:
            parts: dict[tuple[int, int], list[int]] = {}
            for p, c in pointed.items():
                parts.setdefault((-c, group[p]), []).append(p)
            moves = [(key[1], parts[key]) for key in sorted(parts)]
        for old, part in moves:
            z = len(part)
            if z == size[old]:
                continue  # all that was left of the group
            end = end_of[old]
            new = end - z
            size[old] -= z
            end_of[old] = new
            at_end[new] = old
            size[new] = z
            end_of[new] = end
            at_end[end] = new
            part.sort()
            members[new] = part
            for p in part:
                group[p] = new

    out = [0] * n
    front = list(range(n))
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            done[j] = True
            j = before[j]
    return np.array(out[1:], np.int64)


def repeated_starts(text: bytes, length: int) -> np.ndarray:
    """Starts of all substrings of ``length`` that also start elsewhere in ``text``."""
    order = suffix_array(text)
    n = len(text)
    hit = np.zeros(max(n - length + 1, 0), bool)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
        if max(a, b) + length <= n and text[a : a + length] == text[b : b + length]:
            hit[a] = hit[b] = True
    return np.flatnonzero(hit)
