"""Tables behind charts: calendar resampling, concentration curves, before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expr import ratio


def vwap(trades: DataFrame, seconds: int) -> DataFrame:
    """Volume-weighted Yes price by calendar interval; intervals without volume are left out."""
    start = F.floor(F.col("timestamp") / seconds) * seconds
    sums = trades.groupBy("condition_id", start.alias("start_ts")).agg(F.sum(F.col("yes_price").cast("decimal(38,0)") * F.col("shares")).alias("paid"), F.sum("shares").alias("shares"))
    return sums.where("shares > 0").select("condition_id", "start_ts", "shares", F.floor(F.col("paid").cast("double") / F.col("shares")).cast("long").alias("vwap"))


def volume_filled(trades: DataFrame, seconds: int = 3600) -> DataFrame:
    """Volume by interval from the first to the last of each contract; an interval without trades has 0."""
    slot = F.floor(F.col("timestamp") / seconds)
    sums = trades.groupBy("condition_id", slot.alias("slot")).agg(F.sum("shares").alias("shares"))
    every = sums.groupBy("condition_id").agg(F.explode(F.sequence(F.min("slot"), F.max("slot"))).alias("slot"))
    return every.join(sums, ["condition_id", "slot"], "left").select("condition_id", (F.col("slot") * seconds).alias("start_ts"), F.coalesce("shares", F.lit(0).cast("long")).alias("shares"))


def lorenz(trades: DataFrame) -> DataFrame:
    """Wallets of a contract from the largest down: place and cumulative share of volume."""
    wallets = trades.groupBy("condition_id", "active_wallet").agg(F.sum("shares").alias("shares"))
    order = Window.partitionBy("condition_id").orderBy(F.desc("shares"), "active_wallet")
    return wallets.select("condition_id", "active_wallet", F.row_number().over(order).cast("long").alias("place"), ratio(F.sum("shares").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("shares").over(Window.partitionBy("condition_id"))).alias("share"))


def pre_post(bucketed: DataFrame, windows: DataFrame) -> DataFrame:
    """Imbalance before the onset and from it to the alarm."""
    w = windows.select("window_id", "condition_id", "onset_bucket", "alarm_bucket")
    rows = bucketed.join(w, "condition_id").where(F.col("bucket_index") <= F.col("alarm_bucket")).withColumn("inside", F.col("bucket_index") >= F.col("onset_bucket"))
    side = lambda flag, c: F.sum(F.when(F.col("inside") == flag, c))
    size = F.abs("signed")
    return rows.groupBy("window_id").agg(ratio(side(False, F.col("signed")), side(False, size)).alias("before"), ratio(side(True, F.col("signed")), side(True, size)).alias("inside"))


def crosscheck(sample: DataFrame, trades: DataFrame, seconds: int) -> DataFrame:
    """On the contract with most trades of the sample, the sample's VWAP beside the table's, by interval.

    Ties of the count go to the smaller name.
    """
    counts = sample.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n"))
    busiest = counts.orderBy(F.desc("n"), "condition_id").limit(1).select("condition_id")
    one = lambda df, name: vwap(df.join(F.broadcast(busiest), "condition_id", "left_semi"), seconds).select("condition_id", "start_ts", F.col("vwap").alias(name))
    return one(trades, "vwap_all").join(one(sample, "vwap_sample"), ["condition_id", "start_ts"], "left").withColumn("gap", F.col("vwap_sample") - F.col("vwap_all"))
