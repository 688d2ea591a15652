"""Suffix sorting in linear time by grouping suffixes on their Lyndon prefixes."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of all suffixes of text (integers) in ascending order of the suffixes; an end sorts first.

    Groups of suffixes start as those with the same first symbol and are handled from the highest down. Each
    member points to the nearest suffix before it that is in a lower group; the suffixes pointed at, split by
    how many members point at them, become groups right above the groups they leave. A suffix's group, which is
    its Lyndon prefix, is final when it is handled. Then one pass in order fills every group from its low end.
    """
    n = len(text)
    symbols = sorted(set(text))
    number = {s: g for g, s in enumerate(symbols)}
    group = [number[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    down = list(range(-1, len(symbols) - 1))
    up = list(range(1, len(symbols) + 1))
    up[-1:] = [-1] * bool(symbols)
    handled = bytearray(n)
    before = [-1] * n
    groups: list[list[int]] = []  # from the highest
    g = len(symbols) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            handled[i] = 1
        pointed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and handled[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            split.setdefault((-times, group[j]), []).append(j)
        for (_, low), part in sorted(split.items()) if len(split) > 1 else split.items():
            if len(part) == len(members[low]):  # the whole group: it keeps its place
                continue
            new = len(members)
            members.append(part)
            for j in part:
                group[j] = new
            high = up[low]
            down.append(low)
            up.append(high)
            down[high], up[low] = new, new
        groups.append(own)
        g = down[g]
    # All groups, low to high, get their room; the empty suffix at the end starts the pass.
    room = [0] * len(members)
    at = 0
    for own in reversed(groups):
        if own:
            room[group[own[0]]] = at
            at += len(own)
    order = [-1] * n
    placed = bytearray(n)
    for at in range(-1, n):
        j = (order[at] if at >= 0 else n) - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            order[room[g]] = j
            room[g] += 1
            j = before[j]
    return order
