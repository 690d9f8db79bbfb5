"""Quality gates: rules as predicates, violations, quarantine, fixes and a score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.functions.columns import number


@dataclass(frozen=True)
class Rule:
    """`bad` is true for a violating row. `fix`, if there is one, gives the mended value of the column."""

    name: str
    column: str
    bad: Column
    severity: str = "medium"
    fix: Column | None = None
    repeated: bool = False  # rows whose value of the column occurs again; `bad` is not used


def in_range(column: str, lo: float, hi: float, severity: str = "high", clip: bool = False) -> Rule:
    """Missing, unreadable and outlying values violate."""
    x = number(F.col(column))
    fix = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))) if clip else None
    return Rule(f"{column}_range", column, ~F.coalesce(x.between(lo, hi), F.lit(False)), severity, fix)


def in_set(column: str, values: Sequence[str], severity: str = "medium", other: str | None = None) -> Rule:
    """Missing values and those not in the set (case counts) violate."""
    inside = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return Rule(f"{column}_values", column, ~inside, severity, F.when(inside, F.col(column)).otherwise(F.lit(other)) if other is not None else None)


def not_null(column: str) -> Rule:
    return Rule(f"{column}_not_null", column, F.col(column).isNull(), "critical")


def matches(column: str, pattern: str, severity: str = "medium") -> Rule:
    return Rule(f"{column}_pattern", column, ~F.coalesce(F.col(column).rlike(pattern), F.lit(False)), severity)


def unique(column: str) -> Rule:
    """Rows whose value occurs again; null values are not compared."""
    return Rule(f"{column}_unique", column, F.lit(False), "critical", repeated=True)


def from_spec(spec: Sequence[dict]) -> list[Rule]:
    """Rules from plain records, as a file holds them: {"range": [column, lo, hi]}, {"set": [column, [values]]}, {"pattern": [column, regex]},
    {"not_null": column} or {"unique": column}; a record may give a severity, a range `clip`, a set the value of `other`."""
    out = []
    for record in spec:
        kinds = {"range", "set", "pattern", "not_null", "unique"} & record.keys()
        if len(kinds) != 1:
            raise ValueError(f"not a rule: {record}")
        kind = kinds.pop()
        value = record[kind]
        more = {k: record[k] for k in ("severity", "clip", "other") if k in record}
        make = {"range": in_range, "set": in_set, "pattern": matches, "not_null": not_null, "unique": unique}[kind]
        out.append(make(*(value if isinstance(value, list) else [value]), **more))
    return out


def _flagged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows with a flag _r0, _r1 ... for each rule.

    Repeated values are counted first, with sums before the shuffle, and rows joined to them by key: a value that a third
    of all rows bear is split by the adaptive join, where a window would put it in one task.
    """
    out = df
    for k, r in enumerate(rules):
        if r.repeated:
            again = df.filter(F.col(r.column).isNotNull()).groupBy(F.col(r.column).alias(f"_u{k}")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(f"_u{k}")
            out = out.join(again, F.col(r.column) == F.col(f"_u{k}"), "left").withColumn(f"_r{k}", F.col(f"_u{k}").isNotNull()).drop(f"_u{k}")
    plain = {f"_r{k}": r.bad for k, r in enumerate(rules) if not r.repeated}
    return out.withColumns(plain) if plain else out


def has_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that are not there: a schema check without a job."""
    return [c for c in required if c not in df.columns]


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows with `violated`, the names of the rules that each breaks."""
    flagged = _flagged(df, rules)
    names = F.array_compact(F.array(*[F.when(F.col(f"_r{k}"), F.lit(r.name)) for k, r in enumerate(rules)]))
    return flagged.withColumn("violated", names).drop(*[f"_r{k}" for k in range(len(rules))])


def report(df: DataFrame, rules: Sequence[Rule], samples: int = 5) -> DataFrame:
    """rule, column_name, severity, violations, fixable and the smallest `samples` different violating values of each rule.

    Counts are one aggregate. Sample values are made distinct by key and cut to the first ones in each task before they meet.
    """
    flagged = _flagged(df, rules)
    one = flagged.agg(*[F.count_if(F.col(f"_r{k}")).alias(f"r{k}") for k in range(len(rules))])
    rows = F.array(*[F.struct(F.lit(k).alias("_k"), F.lit(r.name).alias("rule"), F.lit(r.column).alias("column_name"), F.lit(r.severity).alias("severity"), F.col(f"r{k}").alias("violations"), F.lit(r.fix is not None).alias("fixable")) for k, r in enumerate(rules)])
    cells = F.array_compact(F.array(*[F.when(F.col(f"_r{k}") & F.col(r.column).isNotNull(), F.struct(F.lit(k).alias("_s"), F.col(r.column).cast("string").alias("value"))) for k, r in enumerate(rules)]))
    values = flagged.select(F.explode(cells).alias("x")).select("x.*").distinct()
    first = values.withColumn("_n", F.row_number().over(Window.partitionBy("_s").orderBy("value"))).filter(F.col("_n") <= samples)
    first = first.groupBy("_s").agg(F.sort_array(F.collect_list("value")).alias("samples"))  # at most `samples` values a rule
    out = one.select(F.explode(rows).alias("x")).select("x.*").join(F.broadcast(first), F.col("_k") == F.col("_s"), "left")  # a row for each rule
    return out.select("rule", "column_name", "severity", "violations", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), "fixable")


def score(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows, rules_violated and quality_score = max(0, (3 columns - violated rules) / (3 columns)); 1 for an empty table."""
    one = _flagged(df, rules).agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.bool_or(F.col(f"_r{k}")), F.lit(False)).cast("int").alias(f"r{k}") for k in range(len(rules))])
    broken = sum((F.col(f"r{k}") for k in range(len(rules))), F.lit(0))
    checks = 3 * len(df.columns)
    return one.select("rows", F.when(F.col("rows") == 0, F.lit(0)).otherwise(broken).alias("rules_violated")).withColumn("quality_score", F.greatest(F.lit(0.0), (checks - F.col("rules_violated")) / F.lit(float(checks))))


def fixed(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows with every fixable rule's column mended."""
    return df.withColumns({r.column: r.fix for r in rules if r.fix is not None})


def split(df: DataFrame, rules: Sequence[Rule], quarantine_fixed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined). Rows that a fix mends are quarantined too unless told otherwise. Both together are the input."""
    decisive = [r for r in rules if quarantine_fixed or r.fix is None]
    v = violations(df, decisive) if decisive else df.withColumn("violated", F.array().cast("array<string>"))
    return v.filter(F.size("violated") == 0).drop("violated"), v.filter(F.size("violated") > 0)


def split_by_id(df: DataFrame, bad: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined) by the row ids of a table of violations, by an anti and a semi join."""
    ids = bad.select(row_id).distinct()
    return df.join(ids, row_id, "left_anti"), df.join(ids, row_id, "left_semi")
