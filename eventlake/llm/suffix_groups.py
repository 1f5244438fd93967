"""Linear suffix sorting by groups.

A group holds the suffixes that share a Lyndon prefix. Starting from one group for each first symbol, the
groups are taken in descending order; each member's pointer to the nearest suffix on its left in a lower
group moves that suffix into a new group, whose prefix is longer by the member's. What is left are groups
in the order of their prefixes; one ascending walk over the result then fills each group in its final
order, by the same pointers. Nothing is renamed and no smaller text is sorted.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The suffixes' starts in ascending order. The last symbol must be the least and occur once."""
    n = len(text)
    if n < 2:
        return list(range(n))
    order, group, size, place, previous = _by_first_symbol(text)
    high = n
    while high > 1:
        low = group[order[high - 1]]
        members = order[low:high]
        if len(members) > 1:
            members.sort()
        sons: dict[int, int] = {}
        for s in members:
            p = s - 1
            while group[p] >= low:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                sons[p] = sons.get(p, 0) + 1
        if len(sons) == len(members) or not sons:
            _move(sons, order, group, size, place)
        else:
            levels: dict[int, list[int]] = {}
            for p, k in sons.items():
                levels.setdefault(k, []).append(p)
            for k in sorted(levels, reverse=True):
                _move(levels[k], order, group, size, place)
        high = low
    return _emit(n, group, previous)


def _by_first_symbol(text: list[int]):
    order = sorted(range(len(text)), key=text.__getitem__)
    group, size, place = [0] * len(text) + [-1], [0] * len(text), [0] * len(text)  # group[-1] stands for left of the text
    start = 0
    for i, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = i
        group[s], place[s] = start, i
        size[start] += 1
    return order, group, size, place, [-1] * len(text)


def _move(parents, order: list[int], group: list[int], size: list[int], place: list[int]) -> None:
    """Moves `parents` to the ends of their groups, as new groups."""
    for p in parents:
        g = group[p]
        size[g] -= 1
        end, at = g + size[g], place[p]
        other = order[end]
        order[at], order[end] = other, p
        place[other], place[p] = at, end
    new: dict[int, int] = {}
    for p in parents:
        g = group[p]
        start = new.get(g)
        if start is None:
            start = new[g] = g + size[g]
        group[p] = start
    for p in parents:
        size[group[p]] += 1


def _emit(n: int, group: list[int], previous: list[int]) -> list[int]:
    out, filled = [-1] * n, [0] * n
    out[0] = n - 1
    group[n - 1] = -1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and (g := group[s]) >= 0:
            out[g + filled[g]] = s
            filled[g] += 1
            group[s] = -1
            s = previous[s]
    return out
