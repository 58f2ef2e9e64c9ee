"""Baselines of a channel and standardized paths. x and z are longs in millionths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import micro

KEYS = ("condition_id", "channel")
SCALE = 1.4826
DEGENERATE = 10_000  # millionths


def _median(x: Column) -> Column:
    return F.percentile(x, 0.5)


def robust_baseline(rows: DataFrame, head: int | None = None) -> DataFrame:
    """mu and sigma = 1.4826 MAD by contract and channel, of all buckets or of the first `head` (two at least)."""
    used = rows if head is None else rows.where(F.col("bucket_index") < max(head, 2))
    center = used.groupBy(*KEYS).agg(_median(F.col("x")).alias("mu"))
    spread = used.join(center, list(KEYS)).groupBy(*KEYS).agg(F.first("mu").alias("mu"), _median(F.abs(F.col("x") - F.col("mu"))).alias("mad"))
    return spread.select(*KEYS, "mu", (F.col("mad") * SCALE).alias("sigma"))


def _scored(rows: DataFrame) -> DataFrame:
    """z from x, mu and sigma; what has no value or baseline is imputed as 0, a scale near zero is flagged."""
    z = micro((F.col("x") - F.col("mu")) / (F.col("sigma") + 1e-3))
    imputed = F.col("x").isNull() | F.col("mu").isNull() | F.col("sigma").isNull()
    return rows.select(
        *KEYS, "bucket_index", "x",
        F.when(~imputed, F.col("mu")).alias("mu"),
        F.when(~imputed, F.col("sigma")).alias("sigma"),
        F.when(imputed, F.lit(0).cast("long")).otherwise(z).alias("z"),
        imputed.alias("imputed"),
        (F.col("x").isNotNull() & (F.col("sigma").isNull() | (F.col("sigma") <= DEGENERATE))).alias("scale_degenerate"),
    )


def standardized(rows: DataFrame, head: int = 20) -> DataFrame:
    """Paths against the burn-in baseline. Baselines are one row a contract and channel."""
    return _scored(rows.join(robust_baseline(rows, head), list(KEYS), "left"))


def trailing_standardized(rows: DataFrame, ref: int = 30, gap: int = 0, least: int = 10) -> DataFrame:
    """Paths against the median and MAD of the `ref` buckets before each, `gap` left out; warm-up with fewer than `least` is imputed.

    The frame's values are gathered once by a window, at most `ref` of them, and reduced by array functions.
    """
    frame = Window.partitionBy(*KEYS).orderBy("bucket_index").rowsBetween(-(ref + gap), -(gap + 1))
    held = rows.withColumn("held", F.collect_list("x").over(frame))
    at = lambda a, k: F.element_at(F.array_sort(a), F.floor(k).cast("int"))
    middle = lambda a: (at(a, (F.size(a) + 1) / 2) + at(a, F.size(a) / 2 + 1)) / 2.0
    warm = F.size("held") >= least
    told = held.withColumn("mu", F.when(warm, middle(F.col("held")).cast("double")))
    told = told.withColumn("off", F.when(warm, F.transform("held", lambda v: F.abs(v - F.col("mu")))))
    return _scored(told.withColumn("sigma", F.when(warm, middle(F.col("off")) * SCALE)))
