"""Suffix arrays by Lyndon grouping, in linear time and without renaming or recursion.

Phase 1 groups suffixes by their Lyndon prefix.  Groups start as first characters and are taken in descending order:
each member gets a pointer to the last earlier position of a lower group (its previous smaller), and the positions that
are pointed to, whose prefixes grow by the group's, move to new groups right after their own, one for each number
of pointers, the more the higher.  Phase 2 emits each group's order: walking the finished part of the array upwards, the
position before each suffix, and the chain of its pointers, take the next free places of their groups.
"""

from __future__ import annotations


def suffix_array(data: bytes) -> list[int]:
    """Starts of the suffixes of data in ascending order (a prefix comes before what extends it)."""
    n = len(data) + 1
    size_of = [0] * 257
    size_of[0] = 1
    for b in data:
        size_of[b + 1] += 1
    first, at = [0] * 257, 0
    for c, size in enumerate(size_of):
        first[c] = at
        at += size
    group = [first[b + 1] for b in data]  # a group is named by its first place
    group.append(0)
    members, place, free = [0] * n, [0] * n, [*first]
    for i, b in enumerate(data):
        k = free[b + 1]
        members[k], place[i], free[b + 1] = i, k, k + 1
    members[0], place[n - 1] = n - 1, 0
    size = [0] * (n + 1)
    for c, s in enumerate(size_of):
        if s:
            size[first[c]] = s
    before = [-1] * n

    end = n
    while end > 1:
        start = group[members[end - 1]]
        if end - start == 1:  # most groups have one member in the end
            i = members[start]
            p = i - 1
            while p >= 0 and group[p] > start:
                p = before[p]
            before[i] = p
            if p >= 0:
                g = group[p]
                left = size[g] - 1
                if left:
                    k, new = place[p], g + left
                    other = members[new]
                    members[k], place[other] = other, k
                    members[new], place[p] = p, new
                    size[g], size[new], group[p] = left, 1, new
            end = start
            continue
        count: dict[int, int] = {}
        for i in sorted(members[start:end]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        levels: dict[int, list[int]] = {}
        for p, c in count.items():
            levels.setdefault(c, []).append(p)
        for c in sorted(levels, reverse=True):
            touched: dict[int, int] = {}
            for p in levels[c]:
                g = group[p]
                moved = touched.get(g, 0) + 1
                touched[g] = moved
                k, last = place[p], g + size[g] - moved
                other = members[last]
                members[k], place[other] = other, k
                members[last], place[p] = p, last
            for g, moved in touched.items():
                left = size[g] - moved
                if left:
                    new = g + left
                    size[g], size[new] = left, moved
                    for k in range(new, new + moved):
                        group[members[k]] = new
        end = start

    out = [-1] * n
    out[0] = n - 1
    free_at = [*range(n)]
    done = bytearray(n)
    done[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free_at[g]] = j
            free_at[g] += 1
            done[j] = 1
            j = before[j]
    return out[1:]
