"""Imputation, outliers, encoding, scaling: fit(df) gives small values, transform is a projection.

A fitted object holds only literals or a small table, so the same one also serves a stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stats(df: DataFrame, columns: Sequence[str], exact: bool) -> dict[str, dict[str, float | None]]:
    from loamworks.operators.profile import quantiles

    return {r["column_name"]: r.asDict() for r in quantiles(df, columns, exact).collect()}  # a row for each column


@dataclass
class NumericImputer:
    """Fill numeric columns with `mean`, `median` or `zero`; a column without values stays null."""

    strategy: str = "median"
    exact: bool = True
    values: dict[str, float | None] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> NumericImputer:
        if self.strategy == "zero":
            self.values = dict.fromkeys(columns, 0.0)
        else:
            stats = _stats(df, columns, self.exact)
            self.values = {c: stats[c][self.strategy] for c in columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")) for c, v in self.values.items()})


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest of ties; null without values. Sums run before the shuffle."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("v"))).alias("mode_value"))


@dataclass
class CategoryImputer:
    """Fill text columns with their `mode`, with `unknown`, or with another word (`default`), which also stands in for a column without a mode.

    To fill them from the rows before, see `fill_forward`.
    """

    strategy: str = "mode"
    default: str = "unknown"
    values: dict[str, str] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> CategoryImputer:
        found: dict[str, str] = {}
        if self.strategy == "mode" and columns:  # one scan and one shuffle for all columns
            from loamworks.operators.profile import unpivot

            counts = unpivot(df, columns).filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
            modes = counts.groupBy("column_name").agg(F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("mode_value"))
            found = {r["column_name"]: r["mode_value"] for r in modes.collect()}  # a row for each column
        elif self.strategy not in ("mode", "unknown", "default"):
            raise ValueError(f"unknown strategy {self.strategy}")
        word = "unknown" if self.strategy == "unknown" else self.default
        self.values = {c: found.get(c, word) for c in columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in self.values.items()})


def fill_forward(df: DataFrame, columns: Sequence[str], key: str, order: Sequence[str], default: str | None = None, backward: bool = False) -> DataFrame:
    """Columns filled from the last row before, in an order, that has a value; then, if asked, from the next; then with `default`.

    The key must be unique. Only the key, the order and the columns are put in order, range by range; rows without gaps are not.
    """
    from loamworks.operators.ranges import filled

    gaps = filled(df, columns, key, order, backward).select(F.col(key).alias("_row"), *[F.col(c).alias(f"_g{k}") for k, c in enumerate(columns)])
    joined = df.join(gaps, F.col(key) == F.col("_row"), "left")
    return joined.withColumns({c: F.coalesce(c, f"_g{k}", F.lit(default).cast(df.schema[c].dataType)) for k, c in enumerate(columns)}).select(*df.columns)


@dataclass
class IqrOutliers:
    """Values beyond q1 - k*iqr or q3 + k*iqr: `cap`, `remove` (to null) or `ignore`. Nulls stay null; under `least` values nothing is done."""

    action: str = "cap"
    k: float = 1.5
    least: int = 0
    exact: bool = True
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> IqrOutliers:
        if self.action != "ignore":
            for c, s in _stats(df, columns, self.exact).items():
                if s["q1"] is not None and s["n"] >= self.least:
                    width = s["q3"] - s["q1"]
                    self.bounds[c] = (s["q1"] - self.k * width, s["q3"] + self.k * width)
        return self

    def value(self, c: str) -> Column:
        if c not in self.bounds:
            return F.col(c)
        lo, hi = self.bounds[c]
        x = F.col(c).cast("double")
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi))) if self.action == "cap" else F.when(x.between(lo, hi), x)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.value(c) for c in self.bounds})


@dataclass
class ZScoreRows:
    """A row is an outlier if any column is further than `limit` population deviations from its mean."""

    limit: float = 3.0
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> ZScoreRows:
        one = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m|{c}"), F.stddev_pop(c).alias(f"s|{c}"))]).first()
        self.stats = {c: (one[f"m|{c}"], one[f"s|{c}"]) for c in columns if one[f"m|{c}"] is not None}
        return self

    def flag(self) -> Column:
        from loamworks.operators.profile import any_true

        return any_true(*[F.abs((F.col(c) - m) / (s + 1e-8)) > self.limit for c, (m, s) in self.stats.items()])

    def transform(self, df: DataFrame, out: str = "is_outlier") -> DataFrame:
        return df.withColumn(out, self.flag())


@dataclass
class StandardScaler:
    """(x - mean) / population deviation; a constant column is divided by 1."""

    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> StandardScaler:
        self.stats = ZScoreRows().fit(df, columns).stats
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - m) / (s or 1.0) for c, (m, s) in self.stats.items()})


def label_mapping(df: DataFrame, column: str) -> DataFrame:
    """code, original_value: the distinct values in order, from 0, numbered range by range."""
    from loamworks.operators.ranges import running

    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("original_value")).distinct()
    return running(values, [F.col("original_value")], {"code": F.lit(1)}).select((F.col("code") - 1).cast("int").alias("code"), "original_value")


def label_encode(df: DataFrame, column: str, mapping: DataFrame, out: str | None = None, broadcast_most: int = 1_000_000) -> DataFrame:
    """Codes of a column by a mapping; null and unknown values are null. The mapping is broadcast only up to a counted size."""
    out = out or f"{column}_code"
    small = mapping.select(F.col("original_value").alias("_v"), F.col("code").alias("_c"))
    if mapping.limit(broadcast_most + 1).count() <= broadcast_most:
        small = F.broadcast(small)
    return df.join(small, F.col(column).cast("string") == F.col("_v"), "left").drop("_v").withColumnRenamed("_c", out)


def label_decode(df: DataFrame, code: str, mapping: DataFrame, out: str = "original_value", broadcast_most: int = 1_000_000) -> DataFrame:
    small = mapping.select(F.col("code").alias("_c"), F.col("original_value").alias("_v"))
    if mapping.limit(broadcast_most + 1).count() <= broadcast_most:
        small = F.broadcast(small)
    return df.join(small, F.col(code) == F.col("_c"), "left").drop("_c").withColumnRenamed("_v", out)
