"""Suffix arrays by linear grouping (Baier's GSACA, 2016), without recursion or renaming."""

from __future__ import annotations

from collections import defaultdict


def suffix_array(data: bytes) -> list[int]:
    """Start positions of the suffixes of data in ascending order (a suffix precedes its extensions).

    Phase 1 groups suffixes by their longest Lyndon prefix.  Groups begin as first bytes and
    are handled from the greatest down.  A member's previous pointer leads to the nearest
    earlier suffix in a lower group; suffixes that more pointers of the group lead to form
    higher new groups, right after what stays of their old group.  Phase 2 walks the array
    from its least suffix: the suffix before each, and along its previous pointers, takes
    the next free place of its group, until one has been placed.
    """
    n = len(data) + 1
    text = [b + 1 for b in data]
    text.append(0)
    size_of = defaultdict(int)
    for c in text:
        size_of[c] += 1
    starts, at = {}, 0
    for c in sorted(size_of):
        starts[c] = at
        at += size_of[c]
    group = [starts[c] for c in text]  # of each suffix: where its group starts
    sizes = {starts[c]: k for c, k in size_of.items()}
    order, place, free = [0] * n, [0] * n, dict(starts)
    for i, c in enumerate(text):
        k = free[c]
        order[k], place[i] = i, k
        free[c] = k + 1
    prev = [-1] * n
    end = n
    while end:
        g = group[order[end - 1]]
        if end - g == 1:
            i = order[g]
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            counts = {p: 1} if p >= 0 else {}
        else:
            counts = defaultdict(int)
            for i in sorted(order[g:end]):
                p = i - 1
                while p >= 0 and group[p] >= g:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    counts[p] += 1
        if len(counts) == 1:
            levels = [(1, list(counts))]
        else:
            by_count = defaultdict(list)
            for p, k in counts.items():
                by_count[k].append(p)
            levels = sorted(by_count.items(), reverse=True)
        for _, found in levels:
            by_group = defaultdict(list)
            for p in found:
                by_group[group[p]].append(p)
            for q, moved in by_group.items():
                size = sizes[q]
                if size == len(moved):
                    continue
                e = q + size
                for p in moved:
                    e -= 1
                    here, other = place[p], order[e]
                    order[here], place[other] = other, here
                    order[e], place[p] = p, e
                for p in moved:
                    group[p] = e
                sizes[e] = len(moved)
                sizes[q] = size - len(moved)
        end = g
    placed = bytearray(n)
    free = list(range(n))
    out = [-1] * n
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = prev[p]
    return out[1:]
