"""Suffix sorting by linear grouping."""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Start positions of the suffixes of ``s`` in order.

    First the suffixes are grouped by their longest Lyndon prefix. Groups start as single symbols and are done from the
    highest to the lowest: each suffix of the group points to the last one before it in a lower group (its previous
    smaller one), and those pointed to are lengthened by the group's prefix, as often as they are pointed to, so they
    move to new groups right above their old one. Then one pass in ascending order fills each group: the suffixes for
    which the current one is the next smaller are placed at the next free slot of their groups. No renaming recurses.
    """
    n = len(s)
    if not n:
        return []
    symbols = sorted(set(s))
    number = {c: i for i, c in enumerate(symbols)}
    group = [number[c] for c in s]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))  # the next lower group; the order is a list linked downwards
    above = list(range(1, len(symbols) + 1))
    above[-1] = -1
    done, prev = bytearray(n), [-1] * n
    sizes = [len(m) for m in members]
    g = len(symbols) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g] if len(members[g]) != sizes[g] else members[g]
        own.sort()
        members[g] = own
        times: dict[int, int] = {}
        for i in own:
            done[i] = 1
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            most = max(times.values())
            for k in range(most, 0, -1) if most > 1 else (1,):
                fresh: dict[int, int] = {}
                for p, t in times.items():
                    if t != k:
                        continue
                    old = group[p]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        sizes.append(0)
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        if up >= 0:
                            below[up] = new
                    members[new].append(p)
                    sizes[new] += 1
                    sizes[old] -= 1
                    group[p] = new
        g = below[g]
    slot, at = [0] * len(members), 0
    g = 0  # the lowest group keeps its number: nothing is ever put below it
    while g >= 0:
        slot[g] = at
        at += sizes[g]
        g = above[g]
    order, placed = [0] * n, bytearray(n)

    def place(p: int) -> None:
        while p >= 0 and not placed[p]:
            placed[p] = 1
            h = group[p]
            order[slot[h]] = p
            slot[h] += 1
            p = prev[p]

    place(n - 1)
    for k in range(n):
        place(order[k] - 1)
    return order
