"""Shared plumbing: the shared folder, staged tables, and column hygiene."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.shared import shared_dir


BATCH_BYTES = 4 << 20
BROADCAST_BYTES = 8 << 20


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut in the lineage that survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tideline_path = path
    return out


def drop(staged: DataFrame | str) -> None:
    """Delete a staged table that no later plan reads."""
    path = staged if isinstance(staged, str) else getattr(staged, "_tideline_path", None)
    if path is None:
        return
    spark = SparkSession.active() if isinstance(staged, str) else staged.sparkSession
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most in this session from now on; what is computed doesn't depend on it.

    A batch is held by the JVM and by the Python worker at once, beside what the worker makes of it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under a path, from the file system's own summary."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def small(staged: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A staged table, to be broadcast in joins if its files hold no more than `limit` bytes."""
    return F.broadcast(staged) if stored_bytes(staged.sparkSession, staged._tideline_path) <= limit else staged


def only(df: DataFrame, **wanted: str) -> DataFrame:
    """Exactly the wanted columns with the wanted types; whatever else the table carries cannot clash with ours."""
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in wanted.items()])


def fresh(columns: Iterable[str], name: str) -> str:
    """`name`, lengthened until none of the columns has it, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(**fields: T.DataType | str) -> T.StructType:
    out = T.StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out
