"""Tiered barcode lookup: exact at the declared place, seeded by k-mers, then by local alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np

from strandloom.plans.chemistry import Chemistry, Component, Kind

EXACT, KMER, ALIGN = "EXACTMATCH", "KMERMATCH", "ALIGNMATCH"
K = 4
GAP_FIRST, GAP_MORE = -0.5, -1.0
ATTEMPT = "struct<bc:string,method:string,candidate:string,match:string,start:int,end:int,distance:int,upstream:string,downstream:string>"


@dataclass
class Attempt:
    """One try at a component: without a match it says what was looked at, or nothing."""

    bc: str
    method: str
    candidate: str | None = None
    match: str | None = None
    start: int | None = None
    end: int | None = None
    distance: int | None = None
    upstream: str | None = None
    downstream: str | None = None


#: Distances that a worker remembers, and how many at most.
KNOWN: dict[tuple[str, str], tuple[int, ...]] = {}
REMEMBERED = 1 << 17


def prefix_distances(text: str, entry: str) -> tuple[int, ...]:
    """The edit distance of every prefix of ``text`` to the entry; N equals anything."""
    if (found := KNOWN.get((text, entry))) is not None:
        return found
    row = list(range(len(entry) + 1))
    out = [row[-1]]
    for i, x in enumerate(text, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(entry, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y and x != "N" and y != "N"))
        out.append(row[-1])
    if len(KNOWN) >= REMEMBERED:
        KNOWN.clear()
    return KNOWN.setdefault((text, entry), tuple(out))


def best_window(read: str, entry: str, expected: int, budget: int, floor: int = 0) -> tuple[int, int, int] | None:
    """(start, end, distance) of the window nearest to an entry around a place.

    The first without errors, by start, wins; else the fewest errors, then the nearest length, the nearest start, the
    first start, and the shortest. None if all have more errors than the budget.
    """
    best = None
    for start in range(max(0, floor, expected - budget), min(len(read) - 1, expected + budget) + 1):
        dists = prefix_distances(read[start : start + len(entry) + budget], entry)
        for n in range(max(1, len(entry) - budget), len(dists)):
            d = dists[n]
            if d == 0:
                rank = (0, 0, 0, start, n)
            elif d <= budget:
                rank = (d, abs(n - len(entry)), abs(start - expected), start, n)
            else:
                continue
            if best is None or rank < best:
                best = rank
    return (best[3], best[3] + best[4], best[0]) if best else None


class Place:
    """Where the layout lets a component be, and what stands beside it."""

    def __init__(self, chemistry: Chemistry, component: Component, budget: int):
        self.component, self.budget = component, budget
        self.drift = chemistry.drift().get(component.name)
        beside = [chemistry.layout.beside(component.name, step) for step in (-1, 1)]
        self.spacers = [c if c is not None and c.sequence and c.verify and c.kind.value in ("primer", "other") else None for c in beside]

    def window(self, read: str) -> tuple[int, int]:
        c = self.component
        if c.start is None or self.drift is None:
            return 0, len(read)
        slack = self.drift + self.budget
        return max(0, c.start - slack), min(len(read), c.start + c.size + slack)

    def far(self, start: int) -> bool:
        """Whether a match so far off needs a spacer beside it."""
        c = self.component
        return c.start is not None and self.drift is not None and abs(start - c.start) > max(self.drift, self.budget)

    def found_spacers(self, read: str, start: int, end: int) -> tuple[str | None, str | None]:
        up, down = self.spacers
        before = up.name if up and start >= len(up.sequence) and read[start - len(up.sequence) : start] == up.sequence else None
        return before, down.name if down and read[end : end + len(down.sequence)] == down.sequence else None


#: Matchers by name, which a cascade tries in an order of its own.
MATCHERS: dict[str, type[Matcher]] = {}


class Matcher:
    """One way to find a component's barcode in a read. A subclass says how by ``tried`` and is registered under ``method``.

    kinds: the kinds of components that it can handle; others raise when it's made.
    """

    method: ClassVar[str] = ""
    kinds: ClassVar[frozenset[Kind]] = frozenset({Kind.BARCODE, Kind.TARGET})

    def __init__(self, chemistry: Chemistry, component: Component, budget: int):
        if component.kind not in self.kinds:
            raise ValueError(f"{type(self).__name__} can't handle {component.name}, a {component.kind.value}; it takes {', '.join(sorted(k.value for k in self.kinds))}")
        self.component, self.budget = component, budget

    def tried(self, read: str, floor: int = 0) -> list[Attempt]:
        """One attempt, with a match or without, or several that tie. floor: where the read's component before ends, as a hint."""
        raise TypeError(f"{type(self).__name__} doesn't say how it matches")


def register_matcher(kind: type[Matcher]) -> type[Matcher]:
    """Makes a matcher known by its ``method``; a name that is taken raises."""
    if not kind.method or kind.method in MATCHERS:
        raise ValueError(f"a matcher's name is missing or taken: {kind.method}")
    MATCHERS[kind.method] = kind
    return kind


@register_matcher
class Exact(Matcher):
    method = EXACT

    def __init__(self, chemistry: Chemistry, component: Component, budget: int):
        super().__init__(chemistry, component, budget)
        self.entries = frozenset(chemistry.whitelist(component.name))

    def tried(self, read: str, floor: int = 0) -> list[Attempt]:
        c = self.component
        if c.start is None:
            raise ValueError(f"the layout doesn't place {c.name}")
        piece = read[c.start : c.start + c.size]
        if len(piece) < c.size or piece not in self.entries:
            return [Attempt(c.name, EXACT)]
        return [Attempt(c.name, EXACT, piece, piece, c.start, c.start + c.size)]


@register_matcher
class Kmer(Matcher):
    method = KMER

    def __init__(self, chemistry: Chemistry, component: Component, budget: int):
        super().__init__(chemistry, component, budget)
        self.place = Place(chemistry, component, budget)
        self.seeds: dict[str, list] = {}  # of each k-mer, the (entry, place)s that have it
        for entry in chemistry.whitelist(component.name):
            for j in range(len(entry) - K + 1):
                self.seeds.setdefault(entry[j : j + K], []).append((entry, j))

    def candidates(self, read: str, floor: int = 0) -> set[tuple[str, int, int, int]]:
        if len(read) < K:
            raise ValueError(f"a read of {len(read)} bases has no seed of {K}")
        low, high = self.place.window(read)
        # Seeds that could only extend to windows outside the component's region aren't looked up.
        reach = self.budget + max((len(e) for es in self.seeds.values() for e, _ in es), default=0)
        starts = {(e, i - j) for i in range(max(floor, low - reach), min(len(read) - K, high + reach) + 1) for e, j in self.seeds.get(read[i : i + K], ())}
        found = {(e, *w) for e, at in starts if (w := best_window(read, e, at, self.budget))}
        return {x for x in found if x[1] >= low and x[2] <= high}

    def tried(self, read: str, floor: int = 0) -> list[Attempt]:
        name, nothing = self.component.name, [Attempt(self.component.name, KMER)]
        found = self.candidates(read, floor)
        least = min((x[3] for x in found), default=0)
        best = sorted(x for x in found if x[3] == least)
        if not best:
            return nothing
        call = lambda x, s=(None, None): Attempt(name, KMER, read[x[1] : x[2]], x[0], x[1], x[2], x[3], *s)
        if len(best) == 1:
            spacers = self.place.found_spacers(read, best[0][1], best[0][2]) if self.place.far(best[0][1]) else (None, None)
            return nothing if self.place.far(best[0][1]) and not any(spacers) else [call(best[0], spacers)]
        held = [(x, s) for x in best if any(s := self.place.found_spacers(read, x[1], x[2]))]
        both = [h for h in held if all(h[1])]
        if not held:
            return nothing
        if len(held) == 1 or len(both) == 1:
            return [call(*(held[0] if len(held) == 1 else both[0]))]
        if len({x[0] for x, _ in held}) == 1:
            return [call(*min(held, key=lambda h: (abs(h[0][2] - h[0][1] - len(h[0][0])), h[0][1])))]
        return [Attempt(name, KMER, read[x[1] : x[2]], None, x[1], x[2], x[3], *s) for x, s in held]


def local_starts(window: str, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, start) of the best local alignment of each entry, rows of equal length, to a window.

    1 for equal bases, -1 for others, N equals all as 0 places cost; a gap costs 0.5, then 1 a base. Of the cells that
    reach the best score the one with the first place in the window counts, then in the entry; of the alignments that
    end there, the one that starts last.
    """
    n, m = entries.shape
    low = -1e9
    shape = (m + 1, n)
    match, up, left = np.full(shape, low), np.full(shape, low), np.full(shape, low)
    sm, su, sl = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    best, start = np.zeros(n), np.zeros(n, np.int64)
    wild = entries == ord("N")

    def join(values: tuple, starts: tuple) -> tuple[np.ndarray, np.ndarray]:
        top = np.maximum.reduce(values)
        return top, np.maximum.reduce([np.where(v == top, s, -1) for v, s in zip(values, starts, strict=True)])

    for i, c in enumerate(window):
        m1, u1, l1 = np.full(shape, low), np.full(shape, low), np.full(shape, low)
        t1, tu, tl = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        u1[1:], tu[1:] = join((match[1:] + GAP_FIRST, left[1:] + GAP_FIRST, up[1:] + GAP_MORE), (sm[1:], sl[1:], su[1:]))
        same = np.where((entries.T == ord(c)) | wild.T | (c == "N"), 1.0, -1.0)
        before, from_ = join((match[:-1], up[:-1], left[:-1]), (sm[:-1], su[:-1], sl[:-1]))
        fresh = before <= 0
        m1[1:] = np.maximum(same + np.maximum(before, 0), 0)
        t1[1:] = np.where(fresh, i, from_)
        for j in range(1, m + 1):
            l1[j], tl[j] = join((m1[j - 1] + GAP_FIRST, u1[j - 1] + GAP_FIRST, l1[j - 1] + GAP_MORE), (t1[j - 1], tu[j - 1], tl[j - 1]))
            better = m1[j] > best
            best, start = np.where(better, m1[j], best), np.where(better, t1[j], start)
        match, up, left, sm, su, sl = m1, u1, l1, t1, tu, tl
    return best, start


@register_matcher
class Align(Matcher):
    method = ALIGN

    def __init__(self, chemistry: Chemistry, component: Component, budget: int):
        super().__init__(chemistry, component, budget)
        self.place = Place(chemistry, component, budget)
        by_length: dict[int, list[str]] = {}
        for e in chemistry.whitelist(component.name):
            by_length.setdefault(len(e), []).append(e)
        self.groups = [(es, np.array([list(e.encode()) for e in es], np.uint8)) for es in by_length.values()]

    def tried(self, read: str, floor: int = 0) -> list[Attempt]:
        name, nothing = self.component.name, [Attempt(self.component.name, ALIGN)]
        low, high = self.place.window(read)
        low = max(low, min(floor, len(read)))
        window = "".join(c if c in "ACGTN" else "N" for c in read[low:high])
        found = []
        for entries, codes in self.groups if window else ():
            score, start = local_starts(window, codes)
            for k in np.flatnonzero(score >= codes.shape[1] - 2 * self.budget):
                w = best_window(read, entries[k], int(start[k]) + low, self.budget, low)
                if w and abs(w[1] - w[0] - len(entries[k])) <= self.budget:
                    found.append((entries[k], *w))
        least = min((x[3] for x in found), default=0)
        best = sorted({x for x in found if x[3] == least})
        if not best:
            return nothing
        held = [(x, self.place.found_spacers(read, x[1], x[2])) for x in best]
        call = lambda x, s: Attempt(name, ALIGN, read[x[1] : x[2]], x[0], x[1], x[2], x[3], *s)
        if len(held) == 1:
            return nothing if self.place.far(best[0][1]) and not any(held[0][1]) else [call(*held[0])]
        some = [h for h in held if any(h[1])]
        both = [h for h in some if all(h[1])]
        if len(some) == 1 or len(both) == 1:
            return [call(*(some[0] if len(some) == 1 else both[0]))]
        return [Attempt(name, ALIGN, read[x[1] : x[2]], None, x[1], x[2], None, *s) for x, s in some or held]


class Cascade:
    """All components by the exact matcher, then the open ones by k-mers, then by alignment, or by other registered matchers."""

    def __init__(self, chemistry: Chemistry, fast: bool = False, tiers: tuple[str, ...] | None = None):
        """tiers: names of the matchers after the exact one."""
        self.components = chemistry.barcodes
        budget = chemistry.errors.barcode
        names = (EXACT, *(tiers if tiers is not None else (KMER,) if fast else (KMER, ALIGN)))
        if unknown := [n for n in names if n not in MATCHERS]:
            raise ValueError(f"no such matcher: {', '.join(unknown)}")
        self.tiers = [{c.name: MATCHERS[n](chemistry, c, budget) for c in self.components} for n in names]

    def run(self, read: str) -> list[Attempt]:
        """Every attempt at every component, in order; a component has its match, or is ambiguous, or stays open."""
        attempts: dict[str, list[Attempt]] = {c.name: [] for c in self.components}
        ended: dict[str, int | None] = {}
        for tier in self.tiers:
            before = 0
            for c in self.components:
                if c.name not in ended:
                    at = before if before < len(read) - c.size else 0
                    tried = tier[c.name].tried(read, at)
                    attempts[c.name] += tried
                    if len(tried) > 1:
                        ended[c.name] = None
                    elif tried[0].match is not None:
                        ended[c.name] = tried[0].end
                before = ended.get(c.name) or 0
            if len(ended) == len(self.components):
                break
        return [a for c in self.components for a in attempts[c.name]]


def attempts_of(reads: Iterator[str | None], cascade: Cascade) -> Iterator[list[dict] | None]:
    for read in reads:
        yield None if read is None else [vars(a) for a in cascade.run(read)]
