"""Order-dependent work without a single task: rows are ranged by the order, worked on range by range, and joined by sums of whole ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.session import cut

RANGE = "_range"


def ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with the number of their range; kept on disk, since every use must see the same ranges."""
    return cut(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """The rows with running sums, in the order, each with its own row included."""
    r = ranged(df.withColumns({f"_v_{n}": c for n, c in sums.items()}), order)
    within = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    whole = r.groupBy(RANGE).agg(*[F.sum(f"_v_{n}").alias(n) for n in sums])
    whole = whole.select(RANGE, *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_a_{n}") for n in sums])
    out = r.join(F.broadcast(whole), RANGE)  # as many rows as shuffle partitions
    out = out.withColumns({n: F.sum(f"_v_{n}").over(within) + F.col(f"_a_{n}") for n in sums})
    return out.drop(RANGE, *[f"_v_{n}" for n in sums], *[f"_a_{n}" for n in sums])


def fill(df: DataFrame, column: str, order: Sequence[str], partition: Sequence[str] = (), backward: bool = False, out: str | None = None) -> DataFrame:
    """Forward fill of a column in an order within its partition, then backward if asked.

    Ranges are of (partition, order), so a partition of any size is spread over tasks. A value crosses from one range
    to the next only for the partitions that a range's border splits: at most one for each border.
    """
    out, keys = out or column, list(partition)
    r = ranged(df, [F.col(c) for c in (*keys, *order)])
    w = Window.partitionBy(RANGE, *keys).orderBy(*order)
    r = r.withColumn("_f", F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("_b", F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if backward else F.lit(None).cast(df.schema[column].dataType))
    at = F.struct(*order)
    ends = r.groupBy(RANGE, *keys).agg(F.max_by("_f", at).alias("_e"), F.min_by("_b", at).alias("_s"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    line = over.orderBy(RANGE)
    ends = ends.withColumn("_n", F.count(F.lit(1)).over(over)).filter("_n > 1")  # split by a border
    ends = ends.select(F.col(RANGE).alias("_q"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.last("_e", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_s", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    same = F.col(RANGE) == F.col("_q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = r.join(F.broadcast(ends), same, "left")  # at most two rows for each border
    value = F.coalesce("_f", "_before", *(["_b", "_after"] if backward else []))
    return joined.withColumn("_o", value).select(*[c for c in df.columns if c != out], F.col("_o").alias(out))


def filled(df: DataFrame, columns: Sequence[str], key: str, order: Sequence[str], backward: bool = False) -> DataFrame:
    """key and the columns filled forward in an order, of the rows in which one of the columns was null.

    Only the key, the order and these columns are ranged and kept on disk, once for all columns; the caller joins
    the result to its table by the key, which must be unique. A value crosses a range's border by a row for each range.
    """
    rest = [c for c in dict.fromkeys([key, *order]) if c not in columns]
    r = ranged(df.select(*rest, *columns, F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False)).alias("_open")), [F.col(c) for c in order])
    at = Window.partitionBy(RANGE).orderBy(*order)
    ahead, behind = at.rowsBetween(Window.unboundedPreceding, 0), at.rowsBetween(0, Window.unboundedFollowing)
    kinds = df.select(*columns).schema
    r = r.withColumns({f"_f{k}": F.last(c, ignorenulls=True).over(ahead) for k, c in enumerate(columns)} | {f"_b{k}": F.first(c, ignorenulls=True).over(behind) if backward else F.lit(None).cast(kinds[c].dataType) for k, c in enumerate(columns)})
    key_of = F.struct(*order)
    ends = r.groupBy(RANGE).agg(*[x for k in range(len(columns)) for x in (F.max_by(f"_f{k}", key_of).alias(f"_e{k}"), F.min_by(f"_b{k}", key_of).alias(f"_s{k}"))])
    line = Window.orderBy(RANGE)  # a row for each range
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(F.col(RANGE).alias("_q"), *[x for k in range(len(columns)) for x in (F.last(f"_e{k}", ignorenulls=True).over(before).alias(f"_p{k}"), F.first(f"_s{k}", ignorenulls=True).over(after).alias(f"_n{k}"))])
    joined = r.filter("_open").join(F.broadcast(ends), F.col(RANGE) == F.col("_q"), "left")  # as many rows as shuffle partitions
    return joined.select(key, *[F.coalesce(c, f"_f{k}", f"_p{k}", f"_b{k}", f"_n{k}").alias(c) for k, c in enumerate(columns)])


def previous(df: DataFrame, columns: dict[str, str], order: Sequence[str], partition: Sequence[str]) -> DataFrame:
    """The rows with the values that columns have in the row before, in the order within the partition; null in the first.

    `columns` names the result of each column. Ranges are of (partition, order), as in `fill`.
    """
    keys = list(partition)
    r = ranged(df, [F.col(c) for c in (*keys, *order)])
    w = Window.partitionBy(RANGE, *keys).orderBy(*order)
    r = r.withColumns({f"_l_{out}": F.lag(c).over(w) for c, out in columns.items()} | {"_i": F.row_number().over(w)})
    ends = r.groupBy(RANGE, *keys).agg(F.max_by(F.struct(*[F.col(c).alias(out) for c, out in columns.items()]), F.struct(*order)).alias("_e"))
    over = Window.partitionBy(*keys)
    ends = ends.withColumn("_n", F.count(F.lit(1)).over(over)).filter("_n > 1")
    ends = ends.select(F.col(RANGE).alias("_q"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.lag("_e").over(over.orderBy(RANGE)).alias("_before"))
    same = F.col(RANGE) == F.col("_q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = r.join(F.broadcast(ends), same, "left")  # at most two rows for each border
    values = [F.when(F.col("_i") == 1, F.col(f"_before.{out}")).otherwise(F.col(f"_l_{out}")).alias(out) for out in columns.values()]
    return joined.select(*df.columns, *values)
