"""Packing plans from a histogram of lengths, by linear grouping.

The input has one count per length up to the capacity, so the work here does not grow with the corpus. Large items
are cut into groups of equal cardinality and each counts as the largest of its group; few sizes remain, for which
the configuration linear program is solved by column generation (whole parts of its answer are used). The real
lengths then take their group's slots, and what is left, small items above all, goes best-fit into the gaps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Bins:
    """``n`` equally filled bins. A slot (length, per, first) gives bin i the items first + i*per and on, by rank in their length."""

    n: int
    room: int
    slots: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, m: int) -> tuple[Bins, Bins]:
        rest = [(length, per, first + m * per) for length, per, first in self.slots]
        return Bins(m, self.room, list(self.slots)), Bins(self.n - m, self.room, rest)


def grouped(counts: dict[int, int], groups: int) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Sizes of about equal-cardinality groups, descending, and the (length, count) runs of each.

    Groups that are rounded up to the same size are one.
    """
    each = -(-sum(counts.values()) // groups) if counts else 0
    sizes: list[int] = []
    members: list[list[tuple[int, int]]] = []
    free = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not free:
                free = each
                if not sizes or sizes[-1] != length:
                    sizes.append(length)
                    members.append([])
            take = min(left, free)
            members[-1].append((length, take))
            left, free = left - take, free - take
    return sizes, members


class Patterns:
    """Finds the most valuable multiset of sizes that fits the capacity: an unbounded knapsack, one more item each round."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        rooms = np.arange(capacity + 1)
        self.sizes, self.rooms = sizes, rooms
        self.before = np.maximum(rooms[None, :] - sizes[:, None], 0)
        self.unfit = rooms[None, :] < sizes[:, None]

    def best(self, values: np.ndarray) -> tuple[float, np.ndarray]:
        worth, chosen = np.zeros(len(self.rooms)), []
        while True:
            got = worth[self.before] + values[:, None]
            got[self.unfit] = -1.0
            item = got.argmax(0)
            top = got[item, self.rooms]
            better = top > worth + 1e-12
            if not better[-1]:
                break
            chosen.append(np.where(better, item, -1))
            worth = np.where(better, top, worth)
        pattern, room = np.zeros(len(self.sizes)), len(self.rooms) - 1
        for item in reversed(chosen):
            if item[room] >= 0:
                pattern[item[room]] += 1
                room -= self.sizes[item[room]]
        return float(values @ pattern), pattern


def configurations(
    sizes: list[int], demand: list[int], capacity: int, near: float = 0.001, rounds: int = 3000
) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of bins per pattern, from the linear program of fewest bins that meet the demand.

    Ends when no pattern is worth more than ``1 + near`` bins, so within that factor of the optimum. Each pattern is
    used as often as its part of the answer rounded down, so no more items are asked for than there are.
    """
    if not sizes:
        return []
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag(np.floor(capacity / size)).astype(float)
    inverse, patterns = np.linalg.inv(basis), Patterns(size, capacity)
    for step in range(1, rounds):
        value, pattern = patterns.best(inverse.sum(0))
        if value <= 1 + near:
            break
        amount, change = inverse @ need, inverse @ pattern
        ratios = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratios.argmin())
        basis[:, out] = pattern
        if step % 50:
            row = inverse[out] / change[out]
            inverse = inverse - np.outer(change, row)
            inverse[out] = row
        else:
            inverse = np.linalg.inv(basis)
    amount = np.linalg.solve(basis, need)
    return [(int(np.floor(x + 1e-6)), basis[:, k]) for k, x in enumerate(amount) if x >= 1 - 1e-6]


#: What counts as small, as parts of the capacity: each is tried, a second or two at most, and the fewest bins win.
SMALL = (0.125, 0.1875, 0.25, 0.3125)


def plan(counts: dict[int, int], capacity: int, groups: int = 96, small: tuple[float, ...] = SMALL) -> list[Bins]:
    """Bins that hold every item, as few as found; lengths are 1 to ``capacity``."""
    plans = [_plan(counts, capacity, groups, int(part * capacity)) for part in small]
    return min(plans, key=lambda bins: sum(b.n for b in bins))


def _plan(counts: dict[int, int], capacity: int, groups: int, small: int) -> list[Bins]:
    rank = dict.fromkeys(counts, 0)
    done = []
    if counts.get(capacity):
        done.append(Bins(counts[capacity], 0, [(capacity, 1, 0)]))
    large = {x: n for x, n in counts.items() if small < x < capacity and n}
    sizes, members = grouped(large, groups)
    have = [sum(n for _, n in runs) for runs in members]
    bins = []
    for n, pattern in configurations(sizes, have, capacity):
        slots = [(g, int(round(a))) for g, a in enumerate(pattern) if a > 0.5]
        n = min([n, *[sum(c for _, c in members[g]) // a for g, a in slots]])
        bins += _substituted(n, slots, members, capacity, rank)
    rest = {x: n for x, n in counts.items() if x <= small and n}
    for runs in members:
        for length, n in runs:
            rest[length] = rest.get(length, 0) + n
    return done + _best_fit(bins, rest, capacity, rank)


def _substituted(n: int, slots: list[tuple[int, int]], members: list[list[tuple[int, int]]], capacity: int, rank: dict[int, int]) -> list[Bins]:
    """``n`` bins of a pattern with the real lengths of its groups, which leave ``members``."""
    made = []
    while n:
        same = min(n, *[members[g][0][1] // a for g, a in slots]) if len(slots) else n
        bins = Bins(max(same, 1), capacity)
        for g, a in slots:
            wanted = a * bins.n
            while wanted:
                length, there = members[g][0]
                take = min(wanted, there)
                # A single bin may take its slots from several runs; many bins take from one run each.
                bins.slots.append((length, a if same else take, rank[length]))
                bins.room -= length * (a if same else take)
                rank[length] += take
                wanted -= take
                members[g][0] = (length, there - take)
                if there == take:
                    members[g].pop(0)
        made.append(bins)
        n -= bins.n
    return made


def _best_fit(bins: list[Bins], counts: dict[int, int], capacity: int, rank: dict[int, int]) -> list[Bins]:
    """The counts, longest first, each into the bin with the least room that holds it; new bins where none does."""
    by_room: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    for b in bins:
        by_room[b.room].append(b)
    for length in sorted(counts, reverse=True):
        left, room = counts[length], length
        while left:
            while room <= capacity and not by_room[room]:
                room += 1
            if room > capacity:
                by_room[capacity].append(Bins(left, capacity))
                room = capacity
            b = by_room[room].pop()
            per = room // length
            full = min(b.n, left // per)
            if not full:
                per, full = left, 1
            if full < b.n:
                b, other = b.split(full)
                by_room[room].append(other)
            b.slots.append((length, per, rank[length]))
            rank[length] += per * full
            left -= per * full
            b.room -= per * length
            by_room[b.room].append(b)
            # What was just filled may have become the best fit for nothing longer; start from the least room again.
            room = length
    return [b for same in by_room for b in same if b.slots]


def slot_table(bins: list[Bins]) -> dict[str, np.ndarray]:
    """Arrays sorted by (length, first rank): where the item of a length and rank goes."""
    rows, sequence = [], 0
    for b in bins:
        offset = 0
        for length, per, first in b.slots:
            rows.append((length, first, per, sequence, offset))
            offset += length * per
        sequence += b.n
    rows.sort()
    names = ("length", "first", "per", "sequence", "offset")
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(names)}
