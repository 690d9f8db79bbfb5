"""Column-level quality profile of large Parquet tables (problem 3).

Footers are read in tasks: a column chunk's statistics give its exact nulls, and its
extrema where they are proved. The dictionary page of a chunk gives its distinct values,
and the extrema that the footer leaves open. Only chunks that neither settles are scanned. For the profile of each feed and load a chunk is settled by its footer where it
holds a single load and nothing but nulls in the column; else its values are counted once
for each load, and all measures follow from these counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.operators.chunks import chunk_dictionary
from loamworks.operators.ranges import previous
from loamworks.session import cut

# Words that stand for no value, in lower case. Cells without letters, digits or @ stand for none either.
NO_VALUE = ("n/a", "#n/a", "na", "n.a.", "null", "(null)", "none", "nan", "nil", "nat", "<na>", "not given", "not available", "unknown", "missing", "undefined")
TRIM = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
NO_SIGN = r"^[^\p{L}\p{N}@]*$"
AGE_FORM = r"^[+-]?[0-9]+([.][0-9]+)?$"
EMAIL_FORM = r"^[^\s\p{Z}@]+@[^\s\p{Z}@]+[.][^\s\p{Z}@.]+$"
EPSILON = 1e-9

CHUNK_SCHEMA = "file string, row_group int, rows long, column_name string, nulls long, lo string, hi string, exact boolean, dictionary boolean"
FIXED_WIDTH = ("BOOLEAN", "INT32", "INT64")  # physical types whose statistics are never cut short


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """The data files of a Parquet table, found by tasks: a scan of no column yields the files' names."""
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct()


def _system(uri: str):
    from urllib.parse import unquote

    import pyarrow.fs as fs

    system, place = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return system, unquote(place) if "%" in place else place


def _proved(chunk, nulls: int | None, rows: int) -> bool:
    """Whether a chunk's extrema are proved by its footer: of a type that no writer cuts short, or marked as exact; or no value at all."""
    s = chunk.statistics
    if nulls is not None and nulls == rows:
        return True
    if s is None or not s.has_min_max:
        return False
    return chunk.physical_type in FIXED_WIDTH or (getattr(s, "is_min_value_exact", None) is True and getattr(s, "is_max_value_exact", None) is True)


def _nulls(chunk) -> int | None:
    return chunk.statistics.null_count if chunk.statistics is not None and chunk.statistics.has_null_count else None


def footer_chunks(spark: SparkSession, path: str, columns: Sequence[str], coded: Sequence[str] = ()) -> DataFrame:
    """A row for each column chunk of a table, from footers alone: rows, nulls (null if the footer has none), extrema as text.

    `exact` says that nulls and extrema are valid: the nulls are counted and the extrema proved not to be cut short.
    The dictionary page proves them for the columns in `coded` whose footers don't.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for b in batches:
            out = []
            for uri in b["file"]:
                system, place = _system(uri)
                meta = pq.ParquetFile(place, filesystem=system).metadata
                places = {meta.schema.column(i).path: i for i in range(len(meta.schema))}
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in columns:
                        chunk = group.column(places[c])
                        nulls, proved = _nulls(chunk), _proved(chunk, _nulls(chunk), group.num_rows)
                        lo, hi = (chunk.statistics.min, chunk.statistics.max) if proved and nulls != group.num_rows else (None, None)
                        if not proved and c in coded:
                            with system.open_input_file(place) as file:
                                found = chunk_dictionary(file, chunk)
                            proved = found.complete
                            values = [v.decode("utf-8", "surrogateescape") if isinstance(v, bytes) else v for v in found.values]
                            lo, hi = min(values, default=None), max(values, default=None)
                        out.append((uri, g, group.num_rows, c, nulls, None if lo is None else str(lo), None if hi is None else str(hi), nulls is not None and proved, chunk.has_dictionary_page))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in CHUNK_SCHEMA.split(", ")])

    return files_of(spark, path).mapInPandas(read, CHUNK_SCHEMA)


READ_SCHEMA = "column_name string, value string, rows long, nulls long, lo string, hi string, footer long, dictionary long, scan long, of long"


def chunk_values(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """For each column chunk a row with its rows, nulls and extrema, and a row for each of its distinct values.

    The footer gives nulls and proved extrema, the dictionary page the distinct values and extrema that the footer
    leaves open; only a chunk whose data pages do not all refer to a dictionary, or whose nulls are not counted, is
    scanned, it alone. `footer`, `dictionary` and `scan` are 1 for the source of a chunk's distinct values (`footer`: a
    chunk without values); `of` is the number of bytes of the chunk that were read.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
        for b in batches:
            for uri in b["file"]:
                system, place = _system(uri)
                whole = pq.ParquetFile(place, filesystem=system)
                meta = whole.metadata
                places = {meta.schema.column(i).path: i for i in range(len(meta.schema))}
                with system.open_input_file(place) as file:
                    for g in range(meta.num_row_groups):
                        for c in columns:
                            chunk = meta.row_group(g).column(places[c])
                            yield pd.DataFrame(_chunk_rows(whole, file, g, c, chunk, meta.row_group(g).num_rows), columns=names)

    return files_of(spark, path).mapInPandas(read, READ_SCHEMA)


def _chunk_rows(whole, file, g: int, c: str, chunk, rows: int) -> list[tuple]:
    nulls = _nulls(chunk)
    if nulls is not None and nulls == rows:
        return [(c, None, rows, nulls, None, None, 1, 0, 0, 0)]
    found = chunk_dictionary(file, chunk)
    read, scanned = found.bytes_read, 0
    if found.complete and nulls is not None:
        values = {v.decode("utf-8", "surrogateescape") if isinstance(v, bytes) else v for v in found.values}
    else:
        cells = whole.read_row_group(g, columns=[c]).column(0)
        nulls, scanned, read = cells.null_count, 1, read + chunk.total_compressed_size
        values = {v for v in cells.unique().to_pylist() if v is not None}
    if _proved(chunk, nulls, rows) and nulls != rows:
        lo, hi = chunk.statistics.min, chunk.statistics.max
    else:
        lo, hi = min(values, default=None), max(values, default=None)
    text = lambda v: None if v is None else str(v)
    return [(c, None, rows, nulls, text(lo), text(hi), 0, 1 - scanned, scanned, read)] + [(c, str(v), 0, 0, None, None, 0, 0, 0, 0) for v in values]


def table_profile(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """rows, nulls, distinct values and extrema (as text) of each column of a Parquet table, by `chunk_values`.

    Values are made distinct by (column, value) with sums before the shuffle. An empty table gives 0 rows and
    null extrema. Columns must be text or integers.
    """
    kinds = dict(spark.read.parquet(path).dtypes)
    by_value = chunk_values(spark, path, columns).groupBy("column_name", "value").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), *[x for c in columns for x in _extrema(c, kinds[c])])
    one = by_value.groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.count("value").alias("d"), *[f(x).alias(x) for c in columns for f, x in ((F.min, f"lo_{c}"), (F.max, f"hi_{c}"))])
    end = lambda side: F.coalesce(*[F.when(F.col("column_name") == c, F.col(f"{side}_{c}").cast("string")) for c in columns])
    named = spark.createDataFrame([(c,) for c in columns], "column_name string")
    out = named.join(F.broadcast(one), "column_name", "left")  # a row for each column
    return out.select("column_name", *[F.coalesce(x, F.lit(0)).alias(y) for x, y in (("rows", "rows"), ("nulls", "nulls"), ("d", "distinct_values"))], end("lo").alias("lo"), end("hi").alias("hi"))


def profile_costs(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """For each column: how many chunks its footers, dictionaries and scans settled, and the bytes of chunks that were read."""
    return chunk_values(spark, path, columns).groupBy("column_name").agg(*[F.sum(x).alias(y) for x, y in (("footer", "by_footer"), ("dictionary", "by_dictionary"), ("scan", "by_scan"), ("of", "bytes_read"))])


def _extrema(c: str, kind: str) -> list[Column]:
    own = F.col("column_name") == c
    as_kind = lambda x: F.when(own, F.col(x).try_cast(kind))
    return [F.min(as_kind("lo")).alias(f"lo_{c}"), F.max(as_kind("hi")).alias(f"hi_{c}")]


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def is_missing(cell: Column) -> Column:
    """Whether a trimmed cell stands for no value."""
    return F.coalesce(cell.rlike(NO_SIGN) | F.lower(cell).isin(*NO_VALUE), F.lit(True))


def load_counts(spark: SparkSession, path: str, columns: Sequence[str], feed: str = "feed", load: str = "load_no") -> DataFrame:
    """feed, load_no, column_name, value, n: how often each value (trimmed, in lower case; null if missing) occurs in a load.

    Partial counts run before the shuffle, which is keyed by load, column and value: no load is one task's work.
    Files that their footers settle (one load, nothing but nulls in every column) are not scanned.
    """
    chunks = footer_chunks(spark, path, [feed, load, *columns], [feed, load])
    per_file = chunks.groupBy("file").agg(
        F.max(F.when(F.col("column_name") == feed, F.col("lo"))).alias("feed"), F.max(F.when(F.col("column_name") == load, F.col("lo"))).alias("load_no"),
        F.bool_and(F.when(F.col("column_name").isin(feed, load), F.col("exact") & (F.col("nulls") == 0) & (F.col("lo") == F.col("hi")))).alias("one_each"),
        F.countDistinct(F.when(F.col("column_name").isin(feed, load), F.struct("column_name", "lo"))).alias("keys"),
        F.bool_and(F.when(~F.col("column_name").isin(feed, load), F.coalesce(F.col("nulls") == F.col("rows"), F.lit(False)))).alias("empty"), F.sum(F.when(F.col("column_name") == feed, F.col("rows"))).alias("rows"),
    ).filter("one_each and empty and keys = 2")
    settled = cut(per_file.select("file", "feed", F.col("load_no").cast("int").alias("load_no"), "rows"))  # a row for each such file
    t = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    t = t.join(settled.select(F.col("file").alias("_file")), "_file", "left_anti")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lower(trimmed(F.col(c).cast("string"))).alias("cell")) for c in columns]))
    long = t.select(F.col(feed).alias("feed"), F.col(load).alias("load_no"), cells.alias("x")).select("feed", "load_no", "x.column_name", F.when(~is_missing(F.col("x.cell")), F.col("x.cell")).alias("value"))
    known = settled.select("feed", "load_no", F.explode(F.array(*map(F.lit, columns))).alias("column_name"), F.lit(None).cast("string").alias("value"), F.col("rows").alias("n"))
    counts = long.withColumn("n", F.lit(1).cast("long")).unionByName(known).groupBy("feed", "load_no", "column_name", "value").agg(F.sum("n").alias("n"))
    return counts


def load_profile(counts: DataFrame) -> DataFrame:
    """One row for each feed, load and column: cells, missing, malformed, out of range, distinct, median."""
    value, n = F.col("value"), F.col("n")
    age = F.when((F.col("column_name") == "age") & value.rlike(AGE_FORM), value.try_cast("double"))
    malformed = F.when(F.col("column_name") == "age", ~value.rlike(AGE_FORM)).when(F.col("column_name") == "email", ~value.rlike(EMAIL_FORM))
    inside = F.when(age.between(0, 120), age)
    return counts.groupBy("feed", "load_no", "column_name").agg(
        F.sum(n).alias("cells"), F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(malformed, n)), F.lit(0)).alias("malformed"),
        F.coalesce(F.sum(F.when(age.isNotNull(), n)), F.lit(0)).alias("numbers"), F.coalesce(F.sum(F.when(~age.between(0, 120), n)), F.lit(0)).alias("outside"),
        F.count(value).alias("distinct_values"), F.percentile(inside, F.lit(0.5), n).alias("median"), F.min(age).alias("lo"), F.max(age).alias("hi"),
    )


def load_issues(spark: SparkSession, path: str) -> DataFrame:
    """feed, load_no, column_name, issue: limits that a load breaks and differences from the feed's load before.

    Rows whose feed or load_no is null form groups of their own, which have no load before. Repeated rows count.
    A measure over no cells is undefined and raises no issue. An empty table gives no row.
    """
    counts = cut(load_counts(spark, path, ["age", "email", "status"]))  # the values of each load, read twice below
    present = F.col("cells") - F.col("missing")
    p = load_profile(counts).withColumns({"share": F.col("missing") / F.col("cells"), "ratio": F.when(present > 0, F.col("distinct_values") / present), "present": present})
    keyed = F.col("feed").isNotNull() & F.col("load_no").isNotNull()
    before = previous(p.filter(keyed), {"share": "share_was", "ratio": "ratio_was", "median": "median_was", "load_no": "load_was", "present": "present_was"}, ["load_no"], ["feed", "column_name"])
    p = cut(before.unionByName(p.filter(~keyed), allowMissingColumns=True))
    is_age, is_email = F.col("column_name") == "age", F.col("column_name") == "email"
    rules = {
        "missing": F.abs(F.col("share") - F.col("share_was")) >= 0.15 - EPSILON,
        "pattern": (is_age | is_email) & (F.col("present") > 0) & (F.col("malformed") >= (0.1 - EPSILON) * F.col("present")),
        "range": is_age & (F.col("numbers") > 0) & (F.col("outside") >= (0.05 - EPSILON) * F.col("numbers")),
        "distinct": is_email & (F.col("ratio") < 0.5 * F.col("ratio_was") - EPSILON),
        "shift": is_age & (F.abs(F.col("median") - F.col("median_was")) >= 8 - EPSILON),
    }
    issues = p.select("feed", "load_no", "column_name", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("issue"))
    return issues.unionByName(_status_shift(counts, p))


def _status_shift(counts: DataFrame, profile: DataFrame) -> DataFrame:
    """Loads whose shares of status values differ from the load before: each share meets the one before by its value, no two loads are joined."""
    loads = profile.filter("column_name = 'status' AND feed IS NOT NULL AND load_no IS NOT NULL").select("feed", "load_no", "present", "load_was", "present_was")
    values = counts.filter("column_name = 'status' AND value IS NOT NULL").select("feed", "load_no", "value", "n")
    both = loads.filter("present > 0 AND present_was > 0")  # a load without values has no shares
    own = values.join(both, ["feed", "load_no"]).select("feed", "load_no", "value", (F.col("n") / F.col("present")).alias("s"))
    was = both.select("feed", F.col("load_no").alias("now"), F.col("load_was").alias("load_no"), "present_was")
    old = values.join(was, ["feed", "load_no"]).select("feed", F.col("now").alias("load_no"), "value", (-F.col("n") / F.col("present_was")).alias("s"))
    apart = own.unionByName(old).groupBy("feed", "load_no", "value").agg(F.sum("s").alias("s")).groupBy("feed", "load_no").agg((F.sum(F.abs("s")) / 2).alias("apart"))
    return apart.filter(F.col("apart") >= 0.3 - EPSILON).select("feed", "load_no", F.lit("status").alias("column_name"), F.lit("shift").alias("issue"))


_WORDS = ", ".join(f"'{w}'" for w in NO_VALUE)
ISSUES_SQL = f"""
WITH cells AS (
  SELECT feed, load_no, u.column_name, lower(regexp_replace(u.cell, '{TRIM}', '', 'g')) AS cell
  FROM test_data, LATERAL (VALUES ('age', age), ('email', email), ('status', status)) AS u(column_name, cell)),
marked AS (SELECT feed, load_no, column_name, CASE WHEN cell IS NULL OR regexp_matches(cell, '{NO_SIGN}') OR cell IN ({_WORDS}) THEN NULL ELSE cell END AS v FROM cells),
forms AS (SELECT *, CASE WHEN column_name = 'age' AND regexp_matches(v, '{AGE_FORM}') THEN CAST(v AS DOUBLE) END AS num,
  CASE WHEN column_name = 'age' THEN NOT regexp_matches(v, '{AGE_FORM}') WHEN column_name = 'email' THEN NOT regexp_matches(v, '{EMAIL_FORM}') END AS bad FROM marked),
prof AS (SELECT feed, load_no, column_name, count(*) AS cells, count(v) AS present, count(DISTINCT v) AS d, count(*) FILTER (WHERE bad) AS bad, count(num) AS nums,
  count(*) FILTER (WHERE num < 0 OR num > 120) AS outside, quantile_cont(num, 0.5) FILTER (WHERE num BETWEEN 0 AND 120) AS med FROM forms GROUP BY 1, 2, 3),
m AS (SELECT *, 1 - present / cells::DOUBLE AS share, CASE WHEN present > 0 THEN d / present::DOUBLE END AS ratio FROM prof),
w AS (SELECT *, lag(share) OVER x AS share_was, lag(ratio) OVER x AS ratio_was, lag(med) OVER x AS med_was, lag(load_no) OVER x AS load_was, lag(present) OVER x AS present_was FROM m WINDOW x AS (PARTITION BY feed, column_name ORDER BY load_no)),
st AS (SELECT f.feed, f.load_no, v, count(*) / sum(count(*)) OVER (PARTITION BY f.feed, f.load_no) AS share FROM forms f WHERE column_name = 'status' AND v IS NOT NULL GROUP BY 1, 2, 3),
pairs AS (SELECT feed, load_no, load_was FROM w WHERE column_name = 'status' AND load_was IS NOT NULL AND present > 0 AND present_was > 0),
diffs AS (SELECT p.feed, p.load_no, v, share FROM pairs p JOIN st USING (feed, load_no) UNION ALL SELECT p.feed, p.load_no, v, -share FROM pairs p JOIN st s ON s.feed = p.feed AND s.load_no = p.load_was),
apart AS (SELECT feed, load_no, sum(abs(s)) / 2 AS a FROM (SELECT feed, load_no, v, sum(share) AS s FROM diffs GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT feed, load_no, column_name, 'missing' AS issue FROM w WHERE abs(share - share_was) >= 0.15 - 1e-9
UNION ALL SELECT feed, load_no, column_name, 'pattern' FROM w WHERE column_name IN ('age', 'email') AND present > 0 AND bad >= (0.1 - 1e-9) * present
UNION ALL SELECT feed, load_no, column_name, 'range' FROM w WHERE column_name = 'age' AND nums > 0 AND outside >= (0.05 - 1e-9) * nums
UNION ALL SELECT feed, load_no, column_name, 'distinct' FROM w WHERE column_name = 'email' AND ratio < 0.5 * ratio_was - 1e-9
UNION ALL SELECT feed, load_no, column_name, 'shift' FROM w WHERE column_name = 'age' AND abs(med - med_was) >= 8 - 1e-9
UNION ALL SELECT feed, load_no, 'status', 'shift' FROM apart WHERE a >= 0.3 - 1e-9
"""
PROFILE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS VARCHAR) AS lo, CAST(max({c}) AS VARCHAR) AS hi FROM test_data" for c in ("row_id", "feed", "load_no", "age", "email", "status"))
