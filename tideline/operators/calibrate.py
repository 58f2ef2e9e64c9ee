"""Finite-horizon thresholds: circular block bootstrap of a channel's path, largest statistics, threshold search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import joined_key
from .walk import UNIT, WalkConfig, reflected_walk


def draw(*parts: Column) -> Column:
    """A number below 2^28 from the SHA-256 of the parts, the same on every engine and in any order of work."""
    return F.conv(F.substring(F.sha2(joined_key(*parts).cast("binary"), 256), 1, 7), 16, 10).cast("long")


def tasks(df: DataFrame) -> int:
    """Tasks for rows that a few small ones grow into: a number of our own, as by their bytes they would go to one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_bootstrap(paths: DataFrame, replicates: int = 20, block: int = 10) -> DataFrame:
    """(condition_id, replicate, position, z): each replicate joins blocks that start where drawn and wrap around.

    A block is looked up once by its start, where the path's next `block` values lie as one array; neither the starts
    nor the values are broadcast, as both grow with the paths.
    """
    sizes = paths.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n"), F.min("bucket_index").alias("first"))
    spread = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).repartition(tasks(paths), "condition_id", "replicate")
    blocks = spread.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    started = blocks.withColumn("begin", F.pmod(draw(F.col("condition_id"), F.col("replicate").cast("string"), F.col("block").cast("string")), F.col("n"))).drop("first")
    source = paths.join(F.broadcast(sizes), "condition_id").withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))  # one row a contract
    source = source.withColumn("begin", F.pmod(F.col("bucket_index") - F.col("first") - F.col("offset"), F.col("n")))
    runs = source.groupBy("condition_id", "begin").agg(F.collect_list(F.struct("offset", "z")).alias("run"))
    placed = started.join(runs.hint("shuffle_hash"), ["condition_id", "begin"]).withColumn("step", F.explode("run"))
    return placed.select("condition_id", "replicate", (F.col("block") * block + F.col("step.offset")).alias("position"), F.col("step.z").alias("z"), "n").where("position < n").drop("n")


def bootstrap_maxima(paths: DataFrame, config: WalkConfig, replicates: int = 20, block: int = 10, chunks: int = 24) -> DataFrame:
    """`largest_statistics` of `block_bootstrap`, drawn and walked replicate by replicate, so that no drawn path is a table.

    A task holds one path and one replicate of it; the path goes to `chunks` tasks at most, whatever the replicates.
    """
    chunks = min(chunks, replicates)
    steps = [(round(4 * d) * s, round(d * d / 2 * UNIT)) for d in config.deltas for s in ((1, -1) if config.two_sided else (1,))]
    start = config.start

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        condition, chunk, n = str(pdf["condition_id"].iloc[0]), int(pdf["chunk"].iloc[0]), len(pdf)
        index = pdf["bucket_index"].to_numpy(np.int64)
        index = index - index.min()
        there, path = np.zeros(n, bool), np.zeros(n, np.int64)
        own = index < n
        there[index[own]], path[index[own]] = True, pdf["z"].to_numpy(np.int64)[own]
        exact = max(abs(int(path.max())), abs(int(path.min()))) * 4 * max(abs(s) for s, _ in steps) * (n + 1) >= 1 << 62  # sums may pass a long
        out = []
        for replicate in range(chunk, replicates, chunks):
            text = f"{condition}|{replicate}|"
            begins = np.fromiter((int(hashlib.sha256(f"{text}{b}".encode()).hexdigest()[:7], 16) % n for b in range((n - 1) // block + 1)), np.int64)
            at = ((begins[:, None] + np.arange(block)) % n).ravel()[:n]
            z, most = path[at][there[at]], None
            walked = path[at[start:]][there[at[start:]]]
            if exact:
                walked = walked.astype(object)
            for step, drift in steps if len(walked) else ():
                s = np.cumsum(step * walked - drift)
                top = int((s - np.minimum(0, np.minimum.accumulate(s))).max())
                most = top if most is None else max(most, top)
            if most is not None:
                out.append((condition, replicate, most, bool(z.max() == z.min())))
        if any(x[2] >= 1 << 63 for x in out):
            raise OverflowError(f"a walk of {condition} does not fit a long")
        return pd.DataFrame(out, columns=["condition_id", "replicate", "max_stat", "degenerate"])

    spread = paths.select("condition_id", "bucket_index", "z").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(tasks(paths), "condition_id", "chunk")
    return spread.groupBy("condition_id", "chunk").applyInPandas(run, "condition_id string, replicate int, max_stat long, degenerate boolean")


def largest_statistics(replicated: DataFrame, config: WalkConfig) -> DataFrame:
    """The largest walk of every replicate; one whose path doesn't move is degenerate."""
    rows = replicated.select("condition_id", F.col("replicate").cast("string").alias("channel"), F.col("position").alias("bucket_index"), "z")
    most = reflected_walk(rows, config).groupBy("condition_id", "channel").agg(F.max("w").alias("max_stat"))
    flat = rows.groupBy("condition_id", "channel").agg((F.max("z") - F.min("z") == 0).alias("degenerate"))
    return most.join(flat, ["condition_id", "channel"]).select("condition_id", F.col("channel").cast("int").alias("replicate"), "max_stat", "degenerate")


def threshold(maxima: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The least observed value that a share of at most alpha reaches, or one unit above the largest; and that share.

    A search, not a quantile: with ties a quantile would be reached too often.
    """
    values = maxima.groupBy(F.col("max_stat").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("h")).rowsBetween(Window.unboundedPreceding, 0)  # one row a distinct maximum
    told = values.withColumn("reached", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    good = told.agg(F.min(F.when(F.col("reached") <= alpha * F.col("total"), F.col("h"))).alias("found"), F.max("h").alias("most"), F.max("total").alias("n_maxima"))
    h = F.coalesce("found", F.col("most") + 1)
    return good.select(h.alias("threshold"), "n_maxima").join(values, F.col("h") >= F.col("threshold"), "left").groupBy("threshold", "n_maxima").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_reached"))


def accounting(paths: DataFrame, horizon: int, block: int = 10) -> DataFrame:
    """What a pooled calibration rests on: sources, buckets, whole blocks, horizon over the shortest source."""
    sizes = paths.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_sources"), F.sum("n").alias("n_buckets"), F.sum(F.floor(F.col("n") / block)).cast("long").alias("effective_blocks"), (F.lit(float(horizon)) / F.min("n")).alias("horizon_ratio"))


def alpha_grid(maxima: DataFrame, low: float, high: float, points: int = 41) -> DataFrame:
    """The share of maxima that reach each of evenly spaced thresholds, in units of the walk."""
    spark = maxima.sparkSession
    unit = 4_000_000
    levels = spark.range(points).select("id", F.floor(F.lit(low * unit) + F.col("id") * ((high - low) * unit / (points - 1)) + 0.5).cast("long").alias("h"))
    counted = maxima.select("max_stat").crossJoin(F.broadcast(levels))  # 41 literals
    return counted.groupBy("h").agg(F.count_if(F.col("max_stat") >= F.col("h")).alias("n_reached"), F.count(F.lit(1)).alias("n_maxima"))


def refuse_degenerate(maxima: DataFrame) -> DataFrame:
    """Maxima of paths that move; one that doesn't ends the query, since its threshold would be met by anything."""
    return maxima.withColumn("max_stat", F.when(F.col("degenerate") | F.col("max_stat").isNull(), F.raise_error(F.concat(F.lit("degenerate null path: "), F.col("condition_id"))).cast("long")).otherwise(F.col("max_stat")))


def raw_largest_statistics(rows: DataFrame, standardizer: Callable[[DataFrame], DataFrame], config: WalkConfig, replicates: int = 20, block: int = 10) -> DataFrame:
    """Largest walk of replicates whose raw values are drawn first and standardized each by its own baseline.

    `rows` has condition_id, bucket_index and x of one channel; the standardizer takes and returns rows as `baseline` has them.
    """
    drawn = block_bootstrap(rows.select("condition_id", "bucket_index", F.col("x").alias("z")), replicates, block)
    paths = drawn.select("condition_id", F.col("replicate").cast("string").alias("channel"), F.col("position").alias("bucket_index"), F.col("z").alias("x"))
    most = reflected_walk(standardizer(paths).select("condition_id", "channel", "bucket_index", "z"), config).groupBy("condition_id", "channel").agg(F.max("w").alias("max_stat"))
    return most.select("condition_id", F.col("channel").cast("int").alias("replicate"), "max_stat")
