"""The folder that every executor can reach, and what is kept there."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, but on one machine only: on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files under a path: unlike after any change of them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return "|".join(sorted(seen))
