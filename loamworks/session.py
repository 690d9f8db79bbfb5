"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the cluster names none."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = tempfile.mkdtemp(prefix="loamworks-")
    return made


def passing_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place)  # only what is there can be marked
    system.deleteOnExit(place)
    return f"{path}/data"


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read again: a lineage cut that outlives a lost executor."""
    path = passing_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column: the only place where the two meet."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def with_row_id(df: DataFrame, column: str = "_row_id") -> DataFrame:
    """Add a unique row id. Not stable across reads; give a real key wherever one exists."""
    if column in df.columns:
        raise ValueError(f"column {column} exists already")
    return df.withColumn(column, F.monotonically_increasing_id())


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, so that they need no copy of their own."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_loamworks_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="loamworks-")) / "loamworks.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, Path("loamworks") / file.relative_to(root))
    context.addPyFile(str(target))  # Spark's own file server hands it to the executors
    context._loamworks_shipped = True
