"""The two-sided multi-shift reflected walk and the verdict it gives.

Increments are delta * d * z - delta^2 / 2 in quarter millionths, whole numbers for every shift that is a multiple
of a quarter: zeros, ties and crossings are exact. The walk is S - min(0, min S so far), S the plain sum.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

UNIT = 4_000_000
PATH = ("condition_id", "channel", "delta", "side")
RUN = ("condition_id", "channel")


@dataclass(frozen=True)
class WalkConfig:
    deltas: tuple[float, ...] = (0.5, 0.75, 1.0)
    two_sided: bool = True
    start: int = 0  # no monitoring before this bucket
    threshold: float = 4.0


def _paths(rows: DataFrame, config: WalkConfig) -> DataFrame:
    """Rows by shift and side with their increments. Shift times four is an integer, so is four millionths of its half square."""
    spark = rows.sparkSession
    sides = (1, -1) if config.two_sided else (1,)
    values = ", ".join(f"({round(4 * d)}L, {round(d * d / 2 * UNIT)}L, {d}D, {s})" for d in config.deltas for s in sides)
    grid = spark.sql(f"SELECT * FROM VALUES {values} AS g(step, drift, delta, side)")
    moved = rows.where(F.col("bucket_index") >= config.start).crossJoin(F.broadcast(grid))  # a handful of literals
    return moved.withColumn("inc", F.col("step") * F.col("side") * F.col("z") - F.col("drift"))


def reflected_walk(rows: DataFrame, config: WalkConfig = WalkConfig()) -> DataFrame:
    """w of every path and bucket, and the onset: the bucket after the last zero before this one."""
    order = Window.partitionBy(*PATH).orderBy("bucket_index")
    sums = _paths(rows, config).withColumn("s", F.sum("inc").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.least(F.lit(0).cast("long"), F.min("s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    walked = sums.withColumn("w", F.col("s") - low)
    zero = F.when(F.col("w") == 0, F.col("bucket_index"))
    last = F.last(zero, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return walked.withColumn("onset", F.least(F.col("bucket_index"), F.coalesce(last + 1, F.lit(config.start).cast("long")))).drop("s", "step", "drift")


def folded_walk(rows: DataFrame, config: WalkConfig = WalkConfig()) -> DataFrame:
    """The same walk as an exact left fold over each path's buckets, the recursion read literally.

    Array functions hand on a state but keep no list of states without copying it at every step, so the fold runs in
    Python, one step a bucket.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket_index")
        steps = itertools.accumulate(pdf["inc"].tolist(), lambda w, inc: max(0, w + inc), initial=0)
        return pdf[[*PATH, "bucket_index"]].assign(w=np.array(list(steps)[1:], np.int64))

    kept = _paths(rows, config).select(*PATH, "bucket_index", "inc")
    return kept.groupBy(*PATH).applyInPandas(run, "condition_id string, channel string, delta double, side int, bucket_index long, w long")


def statistics(walked: DataFrame) -> DataFrame:
    """By bucket the largest walk over shifts and sides; ties to the up side, then the smaller shift."""
    best = F.max_by(F.struct("delta", "side", "onset"), F.struct("w", "side", (-F.col("delta")).alias("order")))
    return walked.groupBy(*RUN, "bucket_index").agg(F.max("w").alias("statistic"), best.alias("best")).select(*RUN, "bucket_index", "statistic", F.col("best.delta").alias("delta"), F.col("best.side").alias("direction"), F.col("best.onset").alias("onset"))


def verdicts(walked: DataFrame, threshold: float = 4.0) -> DataFrame:
    """One row a run: largest statistic and, if it reaches the threshold, the first alarm, its side, winning shift and onsets.

    The wide onset is the earliest over the shifts of the alarm's side, the narrow one that of the winning shift.
    """
    limit = int(round(threshold * UNIT))
    stats = statistics(walked)
    runs = stats.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_buckets"), F.max("statistic").alias("max_statistic"), F.min(F.when(F.col("statistic") >= limit, F.col("bucket_index"))).alias("alarm_bucket"))
    at = stats.select(*RUN, F.col("bucket_index").alias("alarm_bucket"), "statistic", F.col("delta").alias("winning_delta"), "direction", F.col("onset").alias("onset_mle"))
    wide = walked.select(*RUN, F.col("bucket_index").alias("alarm_bucket"), F.col("side").alias("direction"), "onset").groupBy(*RUN, "alarm_bucket", "direction").agg(F.min("onset").alias("onset_bucket"))
    out = runs.join(at, [*RUN, "alarm_bucket"], "left").join(wide, [*RUN, "alarm_bucket", "direction"], "left")
    return out.select(*RUN, "n_buckets", "max_statistic", F.col("alarm_bucket").isNotNull().alias("alarmed"), "alarm_bucket", "direction", "winning_delta", "onset_bucket", "onset_mle")
