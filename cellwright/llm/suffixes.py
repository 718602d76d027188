"""Suffix array by linear grouping: Lyndon-prefix groups in descending order, then each group's order from the one below."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in ascending order; a suffix precedes those it begins.

    Groups hold suffixes that begin with the same Lyndon word. From the highest group down, each suffix of the group finds the
    nearest position before it that lies in a lower group (its previous smaller one), and that position moves to a
    new group just above its own: its Lyndon word goes on with this group's, once for each suffix that points to it.
    Then one pass in ascending order places each suffix at the front of its group: when a suffix is placed, the one before it
    and those along the pointers follow. No rank is computed again, and every suffix moves as often as it is pointed to.
    """
    n = len(symbols)
    if n < 2:
        return list(range(n))
    by_symbol: dict[int, list[int]] = {}
    for at, symbol in enumerate(symbols):
        if symbol in by_symbol:
            by_symbol[symbol].append(at)
        else:
            by_symbol[symbol] = [at]
    members = [by_symbol[s] for s in sorted(by_symbol)]
    group = [0] * n
    for g, places in enumerate(members):
        for at in places:
            group[at] = g
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    pointer, done = [-1] * n, bytearray(n)
    descending = []

    current = len(members) - 1
    while current >= 0:
        places = [at for at in members[current] if group[at] == current]
        descending.append((current, len(places)))
        for at in places:
            done[at] = 1
        pointed: list[int] = []  # previous smaller positions, ascending because their spans nest
        times: list[int] = []
        last = -1
        for at in places:
            j = at - 1
            while j >= 0 and done[j]:
                j = pointer[j]
            pointer[at] = j
            if j < 0:
                continue
            if j == last:
                times[-1] += 1
            else:
                pointed.append(j)
                times.append(1)
                last = j
        rounds = sorted(set(times), reverse=True) if len(times) > 1 else times
        for k in rounds:
            moved: dict[int, int] = {}
            for j, n_times in zip(pointed, times):  # noqa: B905
                if n_times == k:
                    g = group[j]
                    new = moved.get(g)
                    if new is None:
                        new = moved[g] = len(members)
                        members.append([j])
                        below.append(g)
                        above.append(above[g])
                        below[above[g]] = new
                        above[g] = new
                    else:
                        members[new].append(j)
                    group[j] = new
        current = below[current]

    front, at = {}, 0
    for g, size in reversed(descending):
        front[g] = at
        at += size
    order, placed = [0] * n, bytearray(n)
    j = n - 1
    for i in range(n):
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            j = pointer[j]
        j = order[i] - 1
    return order
