"""Profiles of whole tables: one scan for all columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamworks.operators import ranges
from loamworks.operators.exact import summaries

SIMPLE = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def columns_of(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name and value (as text) of every cell: one row for each, so that many distinct counts share one shuffle."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.column_name", "x.value")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, dtype, non_null, nulls, null_pct, distinct_values, case_variants, of each column.

    Values are counted by (column, value) first, with sums before the shuffle; the exact distinct counts
    follow from that. An empty table gives no row. case_variants: distinct values that differ from another only by case.
    """
    columns = list(columns or columns_of(df, *SIMPLE))
    kinds = dict(df.dtypes)
    counts = unpivot(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    lowered = counts.groupBy("column_name", F.lower("value").alias("low")).agg(F.sum("n").alias("n"), F.count("value").alias("d"))
    out = lowered.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("low").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"), F.coalesce(F.sum(F.when(F.col("low").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.sum("d").alias("distinct_values"), (F.sum("d") - F.count("low")).alias("case_variants"),
    )
    dtype = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])[F.col("column_name")]
    return out.select("column_name", dtype.alias("dtype"), "non_null", "nulls", (100.0 * F.col("nulls") / (F.col("nulls") + F.col("non_null"))).alias("null_pct"), "distinct_values", "case_variants")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, nulls: one aggregate without a shuffle of rows."""
    columns = list(columns or df.columns)
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("nulls")) for c in columns])).alias("x")).select("x.*")


def total_missing(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(F.sum("nulls").alias("missing_cells"))


def case_variants(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """original_unique, lowered_unique and the smallest `most` examples of values that occur in several cases."""
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).count()
    low = values.groupBy(F.lower("v").alias("low")).agg(F.count(F.lit(1)).alias("d"), F.min("v").alias("least"))
    several = low.filter("d > 1").select("least").orderBy("least").limit(most).agg(F.array_sort(F.collect_list("least")).alias("examples"))
    return low.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("original_unique"), F.count(F.lit(1)).alias("lowered_unique")).crossJoin(several)  # one row each


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of their kind; arrays and structs compare whole, maps as text."""
    plain = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(*plain).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def value_counts(df: DataFrame, column: str, most: int | None = 10) -> DataFrame:
    """Values by falling count (ties by value), null a value of its own; all of them if `most` is None."""
    out = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return out if most is None else out.limit(most)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (1 to bins), its edges and count, over equal widths from the least to the largest value; empty bins are left out."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL").crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, F.lit(1)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width) + 1, F.lit(bins))).cast("int")
    return x.groupBy(at.alias("bin"), (F.col("lo") + (at - 1) * width).alias("lo"), (F.col("lo") + at * width).alias("hi")).agg(F.count(F.lit(1)).alias("n"))


def dtype_histogram(df: DataFrame) -> DataFrame:
    """dtype, n: from the schema alone."""
    return df.sparkSession.createDataFrame(sorted(Counter(t for _, t in df.dtypes).items()), "dtype string, n long")


def quantiles(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """q1, median, q3 (linear between neighbours), mean and population deviation of each column.

    Exact ones take a few narrow passes (`operators.exact`), approximate ones a single pass. No task holds a column's values.
    """
    if exact:
        found = summaries(df, {c: F.col(f"`{c}`") for c in columns})
        rows = [(c, s.quantile(0.25), s.quantile(0.5), s.quantile(0.75), s.mean, s.std, s.n) for c, s in found.items()]
        return df.sparkSession.createDataFrame(rows, "column_name string, q1 double, median double, q3 double, mean double, std double, n long")
    q = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000)
    one = df.agg(*[F.struct(q(F.col(c)).alias("q"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.count(c).alias("n")).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`.q")[0].cast("double").alias("q1"), F.col(f"`{c}`.q")[1].cast("double").alias("median"), F.col(f"`{c}`.q")[2].cast("double").alias("q3"), F.col(f"`{c}`.mean").alias("mean"), F.col(f"`{c}`.std").alias("std"), F.col(f"`{c}`.n").alias("n")) for c in columns]))
    return one.select(rows.alias("x")).select("x.*")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_a, column_b, corr of every two columns (a before b in order), over rows in which both have values; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def target_correlations(df: DataFrame, target: str, columns: Sequence[str], most: int = 10) -> DataFrame:
    """Columns by falling absolute correlation with the target."""
    one = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))).alias(c) for c in columns])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("abs_corr")) for c in columns])).alias("x")).select("x.*")
    return rows.orderBy(F.desc_nulls_last("abs_corr"), "column_name").limit(most)


def first_values(df: DataFrame, column: str, order: Sequence[str], n: int = 100) -> DataFrame:
    """The first n values that are not null, in an order given by columns; a top-n, no global sort."""
    return df.filter(F.col(column).isNotNull()).orderBy(*order).limit(n).select(column)


# Words that speak for a domain.
DOMAIN_WORDS = {
    "healthcare": ["patient", "diagnosis", "symptom", "medication", "treatment", "hospital", "doctor", "age", "gender"],
    "finance": ["account", "balance", "transaction", "amount", "currency", "payment", "credit", "debit"],
    "retail": ["product", "price", "category", "order", "customer", "rating", "review", "inventory"],
}


def domain_of(columns: Sequence[str]) -> str:
    """healthcare, finance, retail or general: the domain most of whose words stand in some column's name; ties in this order."""
    text = "\n".join(columns).lower()
    hits = {d: sum(w in text for w in words) for d, words in DOMAIN_WORDS.items()}
    best = max(hits.values())
    return next(d for d in hits if hits[d] == best) if best else "general"


def target_kind(df: DataFrame, column: str) -> DataFrame:
    """classification or regression of a target column, from one aggregate.

    Text, and numbers that are whole with a share of distinct values up to 0.05, or have up to 10 distinct values, are classes.
    """
    if not isinstance(df.schema[column].dataType, T.NumericType):
        return df.sparkSession.createDataFrame([("classification",)], "target_type string")
    c = F.col(column).cast("double")
    whole = F.coalesce(F.bool_and(c == F.floor(c)), F.lit(True))
    one = df.agg(F.count(c).alias("n"), F.count_distinct(c).alias("u"), whole.alias("whole"))
    few = (F.col("n") == 0) | (F.col("whole") & (F.col("u") / F.greatest("n", F.lit(1)) <= 0.05)) | (F.col("u") <= 10)
    return one.select(F.when(few, "classification").otherwise("regression").alias("target_type"))


def schema_warnings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, warning: all_missing, constant, or numeric_identifier (a numeric column with id, key, code or number in its name)."""
    columns = list(columns or columns_of(df, *SIMPLE))
    numeric = set(columns_of(df, T.NumericType))
    named = F.col("column_name").isin([c for c in columns if c in numeric and any(w in c.lower() for w in ("id", "key", "code", "number"))])
    p = column_profile(df, columns)
    rules = F.array_compact(F.array(F.when(F.col("non_null") == 0, F.lit("all_missing")), F.when((F.col("distinct_values") <= 1) & (F.col("non_null") > 0), F.lit("constant")), F.when(named, F.lit("numeric_identifier"))))
    return p.select("column_name", F.explode(rules).alias("warning"))


#: Order of the cascade that detects a column's type.
COLUMN_TYPES = ("id_hash", "boolean", "email", "phone", "url", "date_datetime", "currency_price", "rating_score", "code", "numeric_measure", "categorical_low", "categorical_high", "free_text")


def column_types(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, sample: int = 100) -> DataFrame:
    """column_name, column_type by a cascade in which the first rule that holds wins.

    Counts are exact over all rows. Patterns are tried on the first `sample` values in the order given: that
    the first rows decide is the rule's definition.
    """
    columns = list(columns or columns_of(df, *SIMPLE))
    numeric = set(columns_of(df, T.NumericType))
    counts = unpivot(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    token = F.lower("value").isin("true", "false", "1", "0", "yes", "no", "y", "n")
    stats = counts.groupBy("column_name").agg(F.sum("n").alias("rows"), F.count("value").alias("u"), F.coalesce(F.bool_and(F.when(F.col("value").isNotNull(), token)), F.lit(True)).alias("tokens"))
    heads = _heads(df, order, columns, sample)
    share = lambda p: F.avg(p.cast("int"))
    looks = heads.groupBy("column_name").agg(share(F.col("v").rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")).alias("mails"), share(F.col("v").rlike(r"[+]?[1-9]?[0-9]{7,15}")).alias("phones"), share(F.col("v").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+")).alias("urls"))
    s = stats.join(looks, "column_name", "left")
    has = lambda *ws: F.col("column_name").isin([c for c in columns if any(w in c.lower() for w in ws)])
    over = lambda c, x: F.coalesce(F.col(c) > x, F.lit(False))
    kind = (
        F.when(has("id", "key", "hash", "uuid") & ((F.col("u") == F.col("rows")) | (F.col("u") / F.col("rows") > 0.95)), "id_hash")
        .when((F.col("u") <= 2) & F.col("tokens"), "boolean")
        .when(has("email") | over("mails", 0.7), "email").when(has("phone") | over("phones", 0.5), "phone").when(has("url", "link") | over("urls", 0.5), "url")
        .when(has("date", "time", "created", "updated"), "date_datetime").when(has("price", "cost", "amount", "value", "currency"), "currency_price").when(has("rating", "score", "grade", "rank"), "rating_score")
        .when(has("code", "sku", "product_id"), "code").when(F.col("column_name").isin(sorted(numeric)), "numeric_measure")
        .when(F.col("u") < 50, "categorical_low").when(F.col("u") < 0.1 * F.col("rows"), "categorical_high").otherwise("free_text")
    )
    return s.select("column_name", kind.alias("column_type"))


def _heads(df: DataFrame, order: Sequence[str], columns: Sequence[str], sample: int) -> DataFrame:
    """column_name, v: the first `sample` values that are not null of each column, as text.

    Ten times as many first rows are taken once; only columns with too few values in them are looked through on their own.
    """
    most = 10 * sample
    first = df.orderBy(*order).limit(most).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).collect()
    rows, open_columns = [], []
    for c in columns:
        values = [r[c] for r in first if r[c] is not None]
        if len(values) >= sample or len(first) < most:
            rows += [(c, v) for v in values[:sample]]
        else:
            open_columns.append(c)
    heads = df.sparkSession.createDataFrame(rows, "column_name string, v string")
    for c in open_columns:
        heads = heads.unionAll(first_values(df, c, order, sample).select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")))
    return heads


def any_true(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def fill_dates(df: DataFrame, column: str, order: Sequence[str], default: str | None = None, out: str | None = None) -> DataFrame:
    """Dates as YYYY-MM-DD filled forward in an order, then with the median date, then with `default`.

    The median is of the dates that are there; of an even number of them the mean of the middle two, cut to a day.
    """
    out = out or column
    day = F.unix_date(F.col(column).try_cast("date"))
    middle = summaries(df, {"day": day}, [0.5])["day"].quantile(0.5)
    known = F.lit(default) if middle is None else F.date_format(F.date_from_unix_date(F.lit(int(middle // 1))), "yyyy-MM-dd")
    return ranges.fill(df, column, order, out=out).withColumn(out, F.coalesce(out, known))


def default_target(df: DataFrame) -> str:
    """The last text column, or else the last column."""
    text = columns_of(df, T.StringType)
    return text[-1] if text else df.columns[-1]


def unique_ratio(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.try_divide(F.count_distinct(column), F.count(column)).alias("unique_ratio"))
