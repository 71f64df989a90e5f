"""Suffix sorting by linear grouping.

Suffixes are first grouped by their Lyndon prefix: the longest prefix that is smaller than
all its proper suffixes. Groups start as runs of one leading symbol and are processed in
descending order. For a group, each member points to the nearest position before it whose
group is smaller still; members that share that pointer lengthen its prefix by as many
copies of the group's own, so the positions pointed to move to new groups just above their
old ones, more copies higher. Once all groups are final, the ascending pass emits each
group's order: whatever is placed next puts the chain of positions before it, as far as
they aren't placed, at the front of their groups' free places. No suffixes are compared and
none are renamed.
"""

from __future__ import annotations


def lyndon_groups(text: list[int]) -> tuple[list[list[int]], list[int]]:
    """The groups' members in ascending order of groups, and previous-smaller pointers."""
    symbols = sorted(set(text))
    number = {s: k for k, s in enumerate(symbols)}
    group = [number[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    down, up = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    done = bytearray(len(text))
    smaller = [-1] * len(text)
    final: list[list[int]] = []
    g = len(symbols) - 1
    while g >= 0:
        own = sorted(i for i in members[g] if group[i] == g)  # others have moved up since
        members[g] = []
        if own:
            final.append(own)
        for i in own:
            done[i] = 1
        copies: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                copies[j] = copies.get(j, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for p, c in copies.items():
            split.setdefault((-c, group[p]), []).append(p)
        for key in sorted(split):  # most copies first: the next goes beneath it, on top of the old group
            old, new, positions = key[1], len(members), split[key]
            members.append(positions)
            above = up[old]
            down.append(old)
            up.append(above)
            up[old] = new
            if above >= 0:
                down[above] = new
            for p in positions:
                group[p] = new
        g = down[g]
    return final[::-1], smaller


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of text, which must end in a unique least symbol."""
    groups, smaller = lyndon_groups(text)
    free, start = [0] * len(text), 0  # of each position: its group; of each group: its next place
    places = []
    for k, own in enumerate(groups):
        places.append(start)
        for i in own:
            free[i] = k
        start += len(own)
    order, placed = [-1] * len(text), bytearray(len(text))
    order[0] = len(text) - 1
    placed[-1] = 1
    places[0] = 1
    for at in range(len(text)):
        j = order[at] - 1
        while j >= 0 and not placed[j]:
            k = free[j]
            order[places[k]] = j
            places[k] += 1
            placed[j] = 1
            j = smaller[j]
    return order


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Symbols that each suffix shares with the one before it in order."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    shared, length = [0] * n, 0
    for i in range(n):
        if not rank[i]:
            length = 0
            continue
        j = order[rank[i] - 1]
        while i + length < n and j + length < n and text[i + length] == text[j + length]:
            length += 1
        shared[rank[i]] = length
        length = max(0, length - 1)
    return shared
