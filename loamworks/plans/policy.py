"""Cleaning of a whole table by column types: detect, decide, one projection, quarantine, audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamworks.functions import columns as C
from loamworks.functions import synonyms
from loamworks.functions.text import nfkc_casefold
from loamworks.operators import profile, ranges
from loamworks.operators.exact import summaries
from loamworks.operators.prepare import CategoryImputer, IqrOutliers, NumericImputer

# The rules that each type is cleaned by.
STRATEGIES = {
    "id_hash": ["lower case", "trim"], "categorical_low": ["synonyms", "fill with mode"], "categorical_high": ["fill with unknown"], "free_text": ["compatibility form", "case fold", "trim"], "email": ["well formed or quarantined", "lower case"],
    "phone": ["digits with +, or quarantined"], "url": [], "code": [], "currency_price": ["read as amount", "fill with median"], "rating_score": ["read as rating", "fill with median"], "date_datetime": ["read as date", "fill forward"], "numeric_measure": ["fill with median", "cap by quartiles"], "boolean": [],
}


@dataclass
class Decision:
    column: str
    column_type: str
    rules: list[str]
    confidence: float = 0.8
    before: list[str] = field(default_factory=list)
    after: list[str] = field(default_factory=list)


@dataclass
class Audit:
    timestamp: str
    rows_in: int
    columns: int
    decisions: list[Decision]
    quarantined_cells: int = 0

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass
class Cleaned:
    cleaned: DataFrame
    quarantined: DataFrame
    audit: Audit


def clean(df: DataFrame, row_id: str, order: Sequence[str] | None = None, table: str = "policy", fill_dates: bool = True, samples: int = 5) -> Cleaned:
    """Clean every column of a table by its detected type.

    `row_id` names rows in the quarantine; `order` is the order of rows that samples, pattern tests and the
    forward fill of dates go by (the row id if not given). The row id must be unique. Columns of arrays, maps and structs pass unchanged.
    """
    order = list(order or [row_id])
    columns = [c for c in profile.columns_of(df, *profile.SIMPLE) if c != row_id]
    types = {r["column_name"]: r["column_type"] for r in profile.column_types(df, order, columns).collect()}  # a row for each column
    text = set(profile.columns_of(df, T.StringType))
    exprs, bad = {}, {}
    for c in columns:
        kind, x = types.get(c, "free_text"), F.col(c)
        if kind == "id_hash":
            exprs[c] = C.identifier(x)
        elif kind == "email":
            exprs[c], bad[c] = C.email(x), x.isNotNull() & C.email(x).isNull()
        elif kind == "phone":
            exprs[c], bad[c] = C.phone(x), x.isNotNull() & C.phone(x).isNull()
        elif kind == "free_text" and c in text:
            exprs[c] = nfkc_casefold(x)
        elif kind == "categorical_low" and c in text and (k := synonyms.kind_of(c, table)):
            exprs[c] = C.categorical(x, k, table)
        elif kind == "currency_price" and c in text:
            exprs[c] = C.price(x)
        elif kind == "rating_score" and c in text:
            exprs[c] = C.rating(x)
        elif kind == "date_datetime" and c in text:
            exprs[c] = C.date(x)
    first = df.withColumns(exprs)
    numbers = [c for c in columns if types.get(c) in ("numeric_measure", "currency_price", "rating_score") and isinstance(first.schema[c].dataType, T.NumericType)]
    # medians, and the quartiles that the columns have once their gaps are filled, from the same passes
    stats = summaries(first, {c: F.col(c) for c in numbers}, filled=True)
    fills = {c: s.quantile(0.5) for c, s in stats.items()}
    caps = IqrOutliers("cap", least=3)
    for c in (c for c in numbers if types[c] == "numeric_measure" and stats[c].n and stats[c].n + stats[c].nulls >= caps.least):
        q1, q3 = stats[c].filled_quantile(0.25, fills[c]), stats[c].filled_quantile(0.75, fills[c])
        caps.bounds[c] = (q1 - caps.k * (q3 - q1), q3 + caps.k * (q3 - q1))
    steps = [NumericImputer(values=fills), caps]
    low = [c for c in columns if types.get(c) == "categorical_low" and c in text]
    high = [c for c in columns if types.get(c) == "categorical_high" and c in text]
    steps += [CategoryImputer(how).fit(first, some) for how, some in (("mode", low), ("unknown", high)) if some]
    dates = [c for c in columns if types.get(c) == "date_datetime" and c in exprs] if fill_dates else []
    gaps = None
    if dates:
        gaps = ranges.filled(first, dates, row_id, order).select(F.col(row_id).alias("_row"), *[F.col(c).alias(f"_g_{c}") for c in dates])

    def finished(part: DataFrame) -> DataFrame:
        """A part of the table after all fitted steps: projections, and the values that gaps in dates get."""
        out = part.withColumns(exprs)
        for step in steps:
            out = step.transform(out)
        if gaps is not None:
            out = out.join(gaps, F.col(row_id) == F.col("_row"), "left").withColumns({c: F.coalesce(c, f"_g_{c}") for c in dates})
        return out.select(*df.columns)

    cells = [F.when(b, F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("original_value"), F.lit(f"invalid {types[c]}").alias("reason"))) for c, b in bad.items()]
    empty = "array<struct<column_name:string,original_value:string,reason:string>>"
    quarantined = df.select(F.col(row_id).alias("row_id"), F.explode(F.array_compact(F.array(*cells)) if cells else F.array().cast(empty)).alias("x")).select("row_id", "x.*")
    head = df.orderBy(*order).limit(samples).collect()
    tail = {r[row_id]: r for r in finished(df.sparkSession.createDataFrame(head, df.schema)).collect()} if head else {}
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(b).alias(f"b{k}") for k, b in enumerate(bad.values())]).first()
    shown = lambda v: None if v is None else str(v)
    decisions = [Decision(c, types.get(c, "free_text"), STRATEGIES[types.get(c, "free_text")], 0.8, [shown(r[c]) for r in head], [shown(tail[r[row_id]][c]) for r in head if r[row_id] in tail]) for c in columns]
    audit = Audit(datetime.now(timezone.utc).isoformat(), counted["rows"], len(df.columns), decisions, sum(counted[f"b{k}"] for k in range(len(bad))))
    return Cleaned(finished(df), quarantined, audit)
