"""Dimensions of series and the clauses that put correlated series into groups. Metadata-sized, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

TYPES = {"int": int, "integer": int, "long": int, "float": float, "double": float, "text": str, "string": str}
SQL = {"int": "int", "integer": "int", "long": "bigint", "float": "float", "double": "double", "text": "string", "string": "string"}


@dataclass
class Dimension:
    name: str
    levels: list[tuple[str, str]]  # name and type, from the most general down
    weight: float = 1.0


@dataclass
class Dimensions:
    """Hierarchies, and each source's members in the order of ``columns``."""

    dims: list[Dimension]
    members: dict[str, tuple] = field(default_factory=dict)

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [(n.lower(), t) for d in self.dims for n, t in d.levels]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {SQL[t]}" for n, t in self.columns)

    def add(self, source: str, row: list[str]) -> None:
        cols = self.columns
        if len(row) != len(cols):
            raise ValueError(f"{source}: {len(row)} members for {len(cols)} levels")
        self.members[source] = tuple(TYPES[t](v.strip() if isinstance(v, str) else v) for v, (_, t) in zip(row, cols))

    def path(self, source: str, d: Dimension) -> tuple:
        at = 0
        for x in self.dims:
            if x is d:
                return self.members[source][at : at + len(d.levels)]
            at += len(x.levels)
        raise KeyError(d.name)

    def named(self, name: str) -> Dimension:
        return next(d for d in self.dims if d.name.lower() == name.lower())

    def lca(self, sources: list[str], d: Dimension) -> int:
        """Leading levels on which all sources agree."""
        paths = [self.path(s, d) for s in sources]
        n = 0
        while n < len(d.levels) and len({p[n] for p in paths}) == 1:
            n += 1
        return n

    def distance(self, sources: list[str]) -> float:
        """Mean over dimensions of the weighted share of levels below the lowest common ancestor, at most 1."""
        parts = [d.weight * (len(d.levels) - self.lca(sources, d)) / len(d.levels) for d in self.dims]
        return min(1.0, sum(parts) / len(parts)) if parts else 1.0

    def auto(self) -> float:
        return 1.0 / max(len(d.levels) for d in self.dims) / len(self.dims)


def wanted(level: int, d: Dimension) -> int:
    """0 asks for all levels, n for the first n, -n for all but the last n."""
    return len(d.levels) if level == 0 else level if level > 0 else len(d.levels) + level


def parse_dimensions(text: str) -> Dimensions:
    """``Name, level type, ...[, weight]`` lines, an empty line, then ``source, member, ...`` lines. A weight W counts 1/W."""
    head, _, body = text.strip("\n").partition("\n\n")
    dims = []
    for line in filter(str.strip, head.replace(";", "\n").splitlines()):
        name, *rest = [x.strip() for x in line.split(",")]
        weight = 1.0
        if rest and len(rest[-1].split()) == 1:
            weight = 1.0 / float(rest.pop())
        dims.append(Dimension(name, [(x.split()[0], x.split()[1].lower()) for x in rest], weight))
    out = Dimensions(dims)
    for line in filter(str.strip, body.splitlines()):
        source, *row = [x.strip() for x in line.split(",")]
        out.add(source, row)
    return out


@dataclass
class Clause:
    """All conditions must hold for the series of two groups together."""

    sources: set[str] = field(default_factory=set)
    levels: list[tuple[str, int]] = field(default_factory=list)
    members: list[tuple[str, int, set[str]]] = field(default_factory=list)
    distance: float | None = None
    scale_sources: dict[str, float] = field(default_factory=dict)
    scale_members: list[tuple[str, int, str, float]] = field(default_factory=list)

    def correlated(self, series: list[str], dims: Dimensions) -> bool:
        if self.sources and not set(series) <= self.sources:
            return False
        for name, level in self.levels:
            d = dims.named(name)
            if dims.lca(series, d) < wanted(level, d) or not series:
                return False
        for name, level, names in self.members:
            d = dims.named(name)
            k = wanted(level, d) - 1
            if any(str(dims.path(s, d)[k]) not in names for s in series):
                return False
        return self.distance is None or dims.distance(series) <= self.distance

    def scaling(self, source: str, dims: Dimensions) -> float | None:
        if source in self.scale_sources:
            return self.scale_sources[source]
        for name, level, member, f in self.scale_members:
            d = dims.named(name)
            if str(dims.path(source, d)[wanted(level, d) - 1]) == member:
                return f
        return None


def parse_clause(line: str, dims: Dimensions) -> Clause:
    """Comma-separated: ``src src ...`` | ``Dim level`` | ``Dim level member ...`` | a distance | ``auto`` |
    ``* src factor`` | ``* Dim level member factor``."""
    names = {d.name.lower() for d in dims.dims}
    c = Clause()
    for part in filter(None, (p.strip() for p in line.split(","))):
        w = part.split()
        if w[0] == "*":
            if len(w) == 3:
                c.scale_sources[w[1]] = float(w[2])
            else:
                c.scale_members.append((w[1], int(w[2]), w[3], float(w[4])))
        elif w[0].lower() in names and len(w) >= 2:
            if len(w) == 2:
                c.levels.append((w[0], int(w[1])))
            else:
                c.members.append((w[0], int(w[1]), set(w[2:])))
        elif part == "auto":
            c.distance = dims.auto()
        else:
            try:
                c.distance = float(part)
            except ValueError:
                c.sources |= set(w)
    return c


def agreement(c: Clause, g: list[str], dims: Dimensions) -> tuple | None:
    """For a clause without distance: what all series of two groups must have in common for the clause to hold for both
    together; None where it can't hold for this one."""
    if not c.correlated(g, dims):
        return None
    return tuple(dims.path(g[0], d)[: wanted(level, d)] for d, level in ((dims.named(n), x) for n, x in c.levels))


def merged(groups: list[list[str]], c: Clause, intervals: dict[str, int], dims: Dimensions) -> list[list[str]]:
    """Groups merged until the clause holds for no two together. With a distance, later groups are tried against each in turn:
    what doesn't fit a group doesn't fit a larger one either. Without, groups that agree are found by hash."""
    out: list[list[str]] = []
    if c.distance is None:
        at: dict[tuple, int] = {}
        for g in groups:
            key = agreement(c, g, dims)
            key = None if key is None else (intervals[g[0]], key)
            if key is not None and key in at:
                out[at[key]] = out[at[key]] + g
                continue
            if key is not None:
                at[key] = len(out)
            out.append(g)
        return out
    rest = groups
    while rest:
        first, others = rest[0], []
        for g in rest[1:]:
            if intervals[g[0]] == intervals[first[0]] and c.correlated(first + g, dims):
                first = first + g
            else:
                others.append(g)
        out.append(first)
        rest = others
    return out


def group(sources: list[str], intervals: dict[str, int], dims: Dimensions, clauses: list[Clause]) -> tuple[list[list[str]], dict[str, float]]:
    """Groups of correlated sources and each source's scaling factor. Each clause merges groups until none can be merged; only
    series of one sampling interval share a group. Scaling applies to all series, grouped or not."""
    groups = [[s] for s in sources]
    for c in clauses:
        groups = merged(groups, c, intervals, dims)
    factors = {}
    for s in sources:
        for c in clauses:
            if (f := c.scaling(s, dims)) is not None:
                factors[s] = f
    order = {s: k for k, s in enumerate(sources)}
    return [sorted(g, key=order.get) for g in groups], factors
