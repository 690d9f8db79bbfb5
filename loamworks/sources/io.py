"""Reading and writing of tables and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamworks.session import nan_to_null

READERS = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "json"}


def normalised(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def normalise_headers(df: DataFrame) -> DataFrame:
    """Column names without blanks at the ends, in lower case, with underscores. Names that then collide are an error."""
    names = [normalised(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns collide after renaming: {', '.join(twice)}")
    return df.toDF(*names)


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table by its file's suffix; NaN becomes null. A CSV without a schema is read twice, to infer one."""
    kind = READERS.get(Path(path.rstrip("/")).suffix.lower())
    if kind is None:
        raise ValueError(f"Unsupported file format: {path}")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").option("quote", '"').option("escape", '"').option("multiLine", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    elif schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.load(path))


def row_count(df: DataFrame) -> int:
    return df.count()


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, nested ones as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema])


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> dict[str, str]:
    """Write as `parquet`, `csv`, `json` or `both` (Parquet and CSV); the paths written. Overwrites, so a retry is safe."""
    out = {}
    for k in ("parquet", "csv") if kind == "both" else (kind,):
        target = f"{path}.{k}" if kind == "both" else path
        writer = (as_text(df) if k == "csv" else df).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if k == "csv":
            writer.option("header", True).option("escape", '"').csv(target)
        else:
            writer.format(k).save(target)
        out[k] = target
    return out


def write_text(text: str, path: str) -> str:
    """A small text as one file of the file system that the path names (as Spark would write it); overwrites."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
        return path
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return path


def write_json(value: dict | list, path: str) -> str:
    """A small record as a JSON file."""
    return write_text(json.dumps(value, indent=2, ensure_ascii=False, default=lambda x: x.isoformat() if isinstance(x, datetime) else str(x)), path)


def write_mappings(mappings: DataFrame, path: str, kind: str = "csv", most: int = 100_000) -> str:
    """Label mappings (column_name, code, original_value) as `csv` (by Spark), or `json` or `markdown` (by the driver, up to `most` rows)."""
    if kind == "csv":
        mappings.orderBy("column_name", "code").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return path
    rows = mappings.orderBy("column_name", "code").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} values: write them as csv")
    by: dict[str, dict[int, str]] = {}
    for r in rows:
        by.setdefault(r["column_name"], {})[r["code"]] = r["original_value"]
    if kind == "json":
        return write_json(by, path)
    lines = [x for c, m in by.items() for x in (f"## {c}", "", "| code | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in m.items()), "")]
    return write_text("\n".join(["# Mappings", "", *lines]), path)
