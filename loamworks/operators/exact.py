"""Exact quantiles of whole columns, in narrow passes and without a sort, a shuffle of rows or one task that holds a column.

A first pass sketches all columns at once; each rank asked for then lies in a bracket of
a few ten-thousandths of the rows. A further pass counts the values below the bracket and,
once the bracket is small, the values in it; from these the value at the rank is exact.
Brackets that are still large are narrowed by another pass, so the number of passes grows
with the logarithm of the rows. A bracket that misses its rank is widened, not trusted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000  # of the sketches: their error in rank is at most 1 / ACCURACY
FEW = 100_000  # rows in a bracket from which on its values are no longer collected, but narrowed


@dataclass
class Bracket:
    """Where the values at some neighbouring ranks of a column lie: above `lo` (or at it) up to `hi`, with `below` values under `lo`."""

    name: str
    ranks: tuple[int, ...]  # from 0, ascending
    lo: float = -math.inf
    hi: float = math.inf
    below: int = 0
    inside: int = 0
    values: dict[int, float] = field(default_factory=dict)

    def column(self, x: Column) -> Column:
        """The value if it lies in the bracket."""
        inside = x.isNotNull()
        if self.lo > -math.inf:
            inside = inside & (x >= F.lit(self.lo))
        if self.hi < math.inf:
            inside = inside & (x <= F.lit(self.hi))
        return F.when(inside, x)

    def under(self, x: Column) -> Column:
        return F.count_if(x < F.lit(self.lo)) if self.lo > -math.inf else F.lit(0).cast("long")


@dataclass
class Summary:
    n: int
    nulls: int
    mean: float | None
    std: float | None
    at: dict[int, float]  # rank (from 0) to value

    def quantile(self, q: float) -> float | None:
        """The quantile, linear between the two nearest ranks; null without values."""
        if not self.n:
            return None
        k = (self.n - 1) * q
        lo, hi = self.at[math.floor(k)], self.at[math.ceil(k)]
        return lo + (hi - lo) * (k - math.floor(k))

    def filled_quantile(self, q: float, fill: float) -> float | None:
        """The same after the nulls have become `fill`, which must lie between two neighbouring values or be one."""
        total = self.n + self.nulls
        k = (total - 1) * q

        def value(rank: int) -> float:
            own = self.at[rank] if rank < self.n else math.inf
            shifted = self.at[rank - self.nulls] if rank >= self.nulls else -math.inf
            return own if own < fill else shifted if shifted > fill else fill

        lo, hi = value(math.floor(k)), value(math.ceil(k))
        return lo + (hi - lo) * (k - math.floor(k))


def _ranks(n: int, nulls: int, qs: Sequence[float], filled: bool) -> list[tuple[int, ...]]:
    """Groups of ranks that are asked for: those of each quantile, and those it has once nulls are filled."""
    groups = []
    for q in qs:
        groups.append({math.floor((n - 1) * q), math.ceil((n - 1) * q)})
        if filled and nulls:
            k = (n + nulls - 1) * q
            groups += [{r for r in (math.floor(k), math.ceil(k)) if r < n}, {r - nulls for r in (math.floor(k), math.ceil(k)) if 0 <= r - nulls < n}]
    return sorted({tuple(sorted(g)) for g in groups if g})


def summaries(df: DataFrame, columns: Mapping[str, Column], qs: Sequence[float] = (0.25, 0.5, 0.75), filled: bool = False, accuracy: int = ACCURACY, few: int = FEW) -> dict[str, Summary]:
    """Count, nulls, mean, population deviation and the values at the ranks of quantiles of each column (as double).

    `filled` adds the ranks that `Summary.filled_quantile` needs. Ties, repeated rows, columns without values and
    empty tables are allowed. Only a few numbers a column, and the distinct values of small brackets, reach the driver.
    """
    if not columns:
        return {}
    t = df.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns.values())])
    x = {name: F.col(f"c{k}") for k, name in enumerate(columns)}
    points = sorted({p for q in qs for p in (max(0.0, q - 4.0 / accuracy), q, min(1.0, q + 4.0 / accuracy))} | {i / 64 for i in range(65)})
    one = t.agg(F.count(F.lit(1)).alias("rows"), *[y for k, c in enumerate(x.values()) for y in (F.count(c).alias(f"n{k}"), F.avg(c).alias(f"m{k}"), F.stddev_pop(c).alias(f"s{k}"), F.percentile_approx(c, points, accuracy).alias(f"p{k}"))]).first()
    out: dict[str, Summary] = {}
    open_brackets: list[Bracket] = []
    done: list[Bracket] = []
    for k, name in enumerate(x):
        n = one[f"n{k}"]
        out[name] = Summary(n, one["rows"] - n, one[f"m{k}"], one[f"s{k}"], {})
        for ranks in _ranks(n, one["rows"] - n, qs, filled) if n else []:
            b = Bracket(name, ranks)
            slack = 2.0 / accuracy + 1.0 / n
            lows = [v for p, v in zip(points, one[f"p{k}"]) if p <= ranks[0] / n - slack]
            highs = [v for p, v in zip(points, one[f"p{k}"]) if p >= (ranks[-1] + 1) / n + slack]
            b.lo, b.hi = (lows[-1] if lows else -math.inf), (highs[0] if highs else math.inf)
            b.inside = max(1, int(n * (next((p for p in points if p >= (ranks[-1] + 1) / n + slack), 1.0) - max((p for p in points if p <= ranks[0] / n - slack), default=0.0))))
            open_brackets.append(b)
    while open_brackets:
        small = [b for b in open_brackets if b.inside <= few]
        large = [b for b in open_brackets if b.inside > few]
        open_brackets = []
        if large:
            open_brackets += _narrowed(t, x, large, accuracy)
        if small:
            for b, found in zip(small, _counted(t, x, small)):
                (done if found else open_brackets).append(b)
    for b in done:
        out[b.name].at.update(b.values)
    return out


def _narrowed(t: DataFrame, x: dict[str, Column], brackets: list[Bracket], accuracy: int) -> list[Bracket]:
    """One pass that counts below and in each bracket and sketches it; then narrower brackets, or wider ones if a rank lies outside."""
    aggs = []
    steps = [i / 256 for i in range(257)]
    for i, b in enumerate(brackets):
        inside = b.column(x[b.name])
        aggs += [b.under(x[b.name]).alias(f"u{i}"), F.count(inside).alias(f"n{i}"), F.percentile_approx(inside, steps, accuracy).alias(f"p{i}"), F.min(inside).alias(f"l{i}"), F.max(inside).alias(f"h{i}")]
    row = t.agg(*aggs).first()
    for i, b in enumerate(brackets):
        below, n = row[f"u{i}"], row[f"n{i}"]
        if not (below <= b.ranks[0] and b.ranks[-1] < below + n):
            b.lo, b.hi = (-math.inf if below > b.ranks[0] else b.lo), (math.inf if b.ranks[-1] >= below + n else b.hi)
            b.inside = n + max(below, 1) * 2
            continue
        if row[f"l{i}"] == row[f"h{i}"]:  # ties fill the bracket
            b.inside = 1
            b.lo = b.hi = row[f"l{i}"]
            continue
        slack = 2.0 / accuracy + 1.0 / n
        first, last = (b.ranks[0] - below) / n - slack, (b.ranks[-1] + 1 - below) / n + slack
        lows = [(p, v) for p, v in zip(steps, row[f"p{i}"]) if p <= first]
        highs = [(p, v) for p, v in zip(steps, row[f"p{i}"]) if p >= last]
        was = (b.lo, b.hi)
        b.lo, b.hi = (lows[-1][1] if lows else b.lo), (highs[0][1] if highs else b.hi)
        share = (highs[0][0] if highs else 1.0) - (lows[-1][0] if lows else 0.0)
        # a bracket that cannot be narrowed holds few distinct values, however many rows
        b.inside = 1 if (b.lo, b.hi) == was else max(1, int(n * share))
    return brackets


def _counted(t: DataFrame, x: dict[str, Column], brackets: list[Bracket]) -> list[bool]:
    """One pass that counts the values in each bracket, one row for each; whether the ranks were found in it, else it is widened."""
    cells = []
    for i, b in enumerate(brackets):
        c = x[b.name]
        under = c < F.lit(b.lo) if b.lo > -math.inf else F.lit(False)
        # values below the bracket share one key, those above have none
        cells.append(F.when(under, F.struct(F.lit(i).alias("b"), F.lit(None).cast("double").alias("v"))).when(b.column(c).isNotNull(), F.struct(F.lit(i).alias("b"), c.alias("v"))))
    rows = t.select(F.explode(F.array_compact(F.array(*cells))).alias("y")).groupBy("y.b", "y.v").count().collect()
    values: dict[int, list[tuple[float, int]]] = {}
    below = [0] * len(brackets)
    for b, v, n in rows:
        if v is None:
            below[b] = n
        else:
            values.setdefault(b, []).append((v, n))
    found = []
    for i, b in enumerate(brackets):
        at, got = below[i], {}
        for v, n in sorted(values.get(i, [])):
            got |= {r: v for r in b.ranks if at <= r < at + n}
            at += n
        found.append(len(got) == len(b.ranks))
        if found[-1]:
            b.values = got
        else:
            b.lo, b.hi = (-math.inf if b.ranks[0] < below[i] else b.lo), (math.inf if b.ranks[-1] >= at else b.hi)
            b.inside = 1 << 62  # narrowed again first
    return found
