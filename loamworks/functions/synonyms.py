"""Synonym tables, value to canonical value, and their lookup."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Canonical value and its spellings, for each kind of column. "pipe" and "policy" are two tables in use.
TABLES: dict[str, dict[str, dict[str, list[str]]]] = {
    "pipe": {
        "status": {"delivered": ["delivered", "completed", "shipped", "fulfilled"], "pending": ["pending", "processing", "in_progress", "awaiting"], "cancelled": ["cancelled", "canceled", "failed", "aborted"], "returned": ["returned", "refunded", "rejected"]},
        "gender": {"male": ["male", "m", "man", "masculine"], "female": ["female", "f", "woman", "feminine"], "other": ["other", "non-binary", "nb", "prefer_not_to_say"]},
        "rating": {"excellent": ["excellent", "outstanding", "amazing", "perfect", "5"], "good": ["good", "great", "satisfactory", "4"], "average": ["average", "ok", "okay", "fair", "3"], "poor": ["poor", "bad", "terrible", "awful", "2"], "very_poor": ["very poor", "worst", "horrible", "1"]},
    },
    "policy": {
        "status": {"delivered": ["delivered", "completed", "shipped", "fulfilled", "done"], "pending": ["pending", "processing", "in_progress", "waiting"], "cancelled": ["cancelled", "canceled", "aborted", "terminated"], "returned": ["returned", "refunded", "exchanged"]},
        "gender": {"male": ["male", "m", "man", "masculine"], "female": ["female", "f", "woman", "feminine"], "other": ["other", "non-binary", "nb", "nonbinary"]},
        "rating": {"excellent": ["excellent", "outstanding", "amazing", "fantastic", "perfect"], "good": ["good", "great", "nice", "satisfactory"], "average": ["average", "okay", "ok", "mediocre"], "poor": ["poor", "bad", "terrible", "awful"]},
    },
}


def flat(kind: str, table: str = "pipe") -> dict[str, str]:
    """Spelling to canonical value."""
    return {s: canonical for canonical, spellings in TABLES[table][kind].items() for s in spellings}


def register(table: str, kind: str, mapping: dict[str, list[str]]) -> None:
    """Add or replace a kind of column in a table (made if new)."""
    TABLES.setdefault(table, {})[kind] = mapping


def map_literal(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def lookup(key: Column, mapping: dict) -> Column:
    """Value of a key in a small mapping; null where there is none. The map is a literal in the plan."""
    return F.try_element_at(map_literal(mapping), key)


def lookup_table(df: DataFrame, column: str, table: DataFrame, spelling: str = "spelling", canonical: str = "canonical", limit: int = 1_000_000) -> DataFrame:
    """`column` canonicalised through a synonym table held as a DataFrame, unmatched values kept.

    The table is broadcast only if it has at most `limit` rows, else joined by its key; of a spelling
    listed twice the smallest canonical value holds, so no row is doubled.
    """
    small = table.filter(F.col(spelling).isNotNull()).groupBy(F.lower(F.trim(spelling)).alias("_k")).agg(F.min(canonical).alias("_v"))
    if table.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    joined = df.join(small, F.lower(F.trim(F.col(column))) == F.col("_k"), "left")
    return joined.select(*[F.coalesce("_v", F.col(column)).alias(c) if c == column else F.col(c) for c in df.columns])


def kind_of(column: str, table: str = "pipe") -> str | None:
    """The first kind of a table whose name is part of a column's name."""
    return next((kind for kind in TABLES[table] if kind in column.lower()), None)
