"""Read layouts and what follows from them when a query is planned: starts, drift, anchors, whitelists."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum

from strandloom.functions.headers import position_key
from strandloom.functions.sequences import MAX_LEADING


#: Targets from which on a chance match is likely.
MANY_TARGETS = 4


class Kind(Enum):
    BARCODE = "barcode"
    HOMOPOLYMER = "homopolymer"
    PRIMER = "primer"
    TARGET = "target"
    UMI = "umi"
    OTHER = "other"


@dataclass(frozen=True)
class Component:
    """A part of a read. A homopolymer has no length but a base and the run it needs."""

    name: str
    kind: Kind
    length: int | None = None
    base: str | None = None
    min_run: int | None = None
    sequence: str | None = None
    start: int | None = None
    verify: bool = True

    def __post_init__(self) -> None:
        if self.kind is Kind.HOMOPOLYMER:
            if self.base is None or self.min_run is None or self.min_run < 1:
                raise ValueError(f"{self.name} needs a base and a run of 1 at least")
        elif self.length is None and self.sequence is None:
            raise ValueError(f"{self.name} has neither a length nor a sequence")
        if self.sequence is not None and self.length not in (None, len(self.sequence)):
            raise ValueError(f"{self.name}'s sequence isn't of its length")

    @property
    def size(self) -> int | None:
        return self.length if self.length is not None else len(self.sequence) if self.sequence is not None else None

    @property
    def spans(self) -> str:
        return position_key(self.name)


class Layout:
    """Components in order; each starts where those before it end, until one of no fixed length."""

    def __init__(self, components: list[Component]):
        if len({c.name for c in components}) != len(components):
            raise ValueError("component names repeat")
        at: int | None = 0
        self.components: list[Component] = []
        for c in components:
            self.components.append(replace(c, start=at))
            at = None if at is None or c.size is None else at + c.size

    def __iter__(self):
        return iter(self.components)

    def __len__(self) -> int:
        return len(self.components)

    def __getitem__(self, name: str) -> Component:
        for c in self.components:
            if c.name == name:
                return c
        raise ValueError(f"no component {name}")

    def of(self, *kinds: Kind) -> list[Component]:
        return [c for c in self.components if c.kind in kinds]

    def beside(self, name: str, step: int, barcodes: bool = False) -> Component | None:
        """The next (1) or previous (-1) component, of barcodes only if asked; None at an end."""
        row = [c for c in self.components if not barcodes or c.kind is Kind.BARCODE or c.name == name]
        at = [c.name for c in row].index(self[name].name) + step
        return row[at] if 0 <= at < len(row) else None


@dataclass(frozen=True)
class Errors:
    barcode: int
    spacer: int
    target: int = 1


@dataclass
class Chemistry:
    """A layout with its error budgets and whitelists. ``slices`` cut the padding off whitelist lines."""

    name: str
    layout: Layout
    errors: Errors
    whitelists: dict[str, tuple[str, ...]] = field(default_factory=dict)
    slices: dict[str, tuple[int | None, int | None]] = field(default_factory=dict)
    enforce: bool = False
    exempt: frozenset = frozenset()

    @property
    def barcodes(self) -> list[Component]:
        return self.layout.of(Kind.BARCODE)

    def first(self, kind: Kind) -> Component | None:
        return next(iter(self.layout.of(kind)), None)

    def drift(self) -> dict:
        """How far each component may have moved: the budgets of all before it, None after one without a fixed length."""
        share = {Kind.BARCODE: self.errors.barcode, Kind.PRIMER: self.errors.spacer, Kind.OTHER: self.errors.spacer, Kind.TARGET: self.errors.target}
        out, total = {}, 0
        for c in self.layout:
            out[c.name] = total
            if total is not None:
                total = None if c.size is None else total + share.get(c.kind, 0)
        return out

    def anchor(self, name: str) -> tuple[Component, int]:
        """The nearest barcode before a component and the fixed gap to it; raises if something without a fixed length is between."""
        gap, c = 0, self.layout.beside(name, -1)
        while c is not None:
            if c.kind is Kind.BARCODE:
                return c, gap
            if c.size is None:
                raise ValueError(f"{name} follows {c.name}, which has no fixed length")
            gap, c = gap + c.size, self.layout.beside(c.name, -1)
        raise ValueError(f"nothing before {name} that reads record")

    def whitelist(self, name: str) -> tuple[str, ...]:
        if name not in self.whitelists:
            raise KeyError(f"no whitelist for {name}")
        return self.whitelists[name]

    def load(self, spark, paths: dict[str, str]) -> Chemistry:
        """This chemistry with whitelists read from files, one entry a line, in order and without blank ones."""
        from strandloom.sources.tables import whitelist

        unknown = set(paths) - {c.name for c in self.layout}
        if unknown:
            raise ValueError(f"no components {sorted(unknown)}")
        found = {k: tuple(r.entry for r in whitelist(spark, p, self.slices.get(k)).orderBy("ord").collect()) for k, p in paths.items()}
        return replace(self, whitelists=self.whitelists | found)

    def check(self) -> list[str]:
        """Raises for a barcode without whitelist, and for entries too close if enforced; else returns what is close."""
        missing = [c.name for c in self.barcodes if not self.whitelists.get(c.name)]
        if missing:
            raise KeyError(f"no whitelist for {missing}")
        said = self.check_targets()
        for c in self.layout.of(Kind.BARCODE, Kind.TARGET):
            budget = self.errors.target if c.kind is Kind.TARGET else self.errors.barcode
            close = [p for p in close_pairs(self.whitelists.get(c.name, ()), budget) if frozenset(p[:2]) not in self.exempt]
            said += [f"{c.name}: {a} and {b} are {d} edits apart" for a, b, d in close]
        close = [x for x in said if "edits apart" in x]
        if close and self.enforce:
            raise ValueError("; ".join(close))
        return said

    def check_targets(self) -> list[str]:
        """Raises for a target that begins with more of its anchor's base than a window allows for; says if there are many."""
        said = []
        for c in self.layout.of(Kind.TARGET):
            anchor, entries = self.layout.beside(c.name, -1), self.whitelists.get(c.name, ())
            for e in entries:
                if anchor is not None and anchor.kind is Kind.HOMOPOLYMER and e.startswith(anchor.base * (MAX_LEADING + 1)):
                    raise ValueError(f"{c.name}: {e} begins with over {MAX_LEADING} bases of its anchor")
            if len(entries) > MANY_TARGETS:
                said.append(f"{c.name}: with {len(entries)} targets, reads without one are often given one")
        return said


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def close_pairs(entries: tuple[str, ...], budget: int) -> list[tuple[str, str, int]]:
    """Pairs of entries at most ``budget`` edits apart, found among those that share a text with as many deletions."""
    buckets = defaultdict(set)
    for e in set(entries):
        found = {e}
        for _ in range(budget):
            found |= {s[:i] + s[i + 1 :] for s in found for i in range(len(s))}
        for s in found:
            buckets[s].add(e)
    pairs = {(a, b) for group in buckets.values() for a in group for b in group if a < b}
    return sorted((a, b, d) for a, b in pairs if (d := distance(a, b)) <= budget)


REGISTRY: dict[str, Callable[[], Chemistry]] = {}


def register(name: str) -> Callable:
    def keep(make: Callable[[], Chemistry]) -> Callable[[], Chemistry]:
        REGISTRY[name] = make
        return make

    return keep


def chemistry(name: str) -> Chemistry:
    if name not in REGISTRY:
        raise ValueError(f"no chemistry {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]()


def custom_parts() -> list[Component]:
    return [
        Component("BC3", Kind.BARCODE, 10),
        Component("PRIMER_C", Kind.PRIMER, sequence="TGTGTATAAGGACCTCGTTGCC"),
        Component("BC2", Kind.BARCODE, 10),
        Component("PRIMER_A", Kind.PRIMER, sequence="ATGGAAGCCGACGAATTAGACC"),
        Component("BC1", Kind.BARCODE, 10),
        Component("UMI", Kind.UMI, 8),
        Component("POLYG", Kind.HOMOPOLYMER, base="G", min_run=3),
        Component("TGIDX", Kind.TARGET, 8),
        Component("ME", Kind.PRIMER, sequence="AGATGTGTATAAGAGACAG", verify=False),
    ]


@register("hydrop")
def hydrop() -> Chemistry:
    parts = [Component("BC3", Kind.BARCODE, 10), Component("SPACER_1", Kind.OTHER, sequence="AGGGTACTCG"), Component("BC2", Kind.BARCODE, 10), Component("SPACER_2", Kind.OTHER, sequence="GCAGTAGCTG"), Component("BC1", Kind.BARCODE, 10)]
    return Chemistry("hydrop", Layout(parts), Errors(2, 1), slices={"BC1": (10, -10), "BC2": (10, -10), "BC3": (15, -10)})


@register("custom_seq_1_0")
def custom_seq() -> Chemistry:
    return Chemistry("custom_seq_1_0", Layout(custom_parts()), Errors(1, 2, 1), {"TGIDX": ("TATAGCCT",)}, enforce=True, exempt=frozenset([frozenset(("AGCTTGAGAG", "GGCTTGAGAG"))]))


@register("custom_seq_1_0_primd")
def custom_seq_primd() -> Chemistry:
    return replace(custom_seq(), name="custom_seq_1_0_primd", layout=Layout([Component("PRIMER_D", Kind.PRIMER, 22), *custom_parts()]))
