"""Fixed-count event-time buckets and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import clip, micro, ratio

SLICE_SECONDS = 6 * 3600
CHANNELS = ("imbalance", "imbalance_winsor", "imbalance_cash", "wallet_hhi")


def assign_buckets(trades: DataFrame, size: int | Column, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Adds bucket_index = (place in the contract's total order by timestamp and hash) // size; the last bucket may be short.

    The place is the rows of earlier time slices plus the place within the slice, so that a contract with a third of
    all trades is ranked by many tasks; only slice counts, one row each, are cumulated by contract.
    """
    sliced = trades.withColumn("slice", F.floor(F.col("timestamp") / slice_seconds))
    before = Window.partitionBy("condition_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy("condition_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("condition_id", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("condition_id", "slice").orderBy("timestamp", "transaction_hash")) - 1
    return sliced.withColumn("within", within).join(starts, ["condition_id", "slice"]).withColumn("bucket_index", F.floor((F.col("start") + F.col("within")) / size)).drop("slice", "within", "start")


def wallet_hhi(bucketed: DataFrame) -> DataFrame:
    """Concentration of absolute size over wallets, sum of squares over square of sum, by bucket; sizes in thousandths."""
    wallets = bucketed.groupBy("condition_id", "bucket_index", "active_wallet").agg(F.floor(F.sum("shares") / 1000).cast("long").alias("w"))
    sums = wallets.groupBy("condition_id", "bucket_index").agg(F.sum(F.col("w") * F.col("w")).alias("squares"), F.sum("w").alias("total"))
    return sums.select("condition_id", "bucket_index", ratio(F.col("squares"), F.col("total").cast("double") * F.col("total").cast("double")).alias("wallet_hhi"))


def winsorized(bucketed: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Imbalance with sizes capped at the bucket's own quantile. The cap goes to the grid with boundaries that no
    interpolated value of 20 or 100 trades can meet."""
    by = Window.partitionBy("condition_id", "bucket_index")
    cap = F.floor(F.percentile("shares", quantile).over(by) + 0.475).cast("long")
    capped = bucketed.withColumn("capped", F.least(F.col("shares"), cap))
    sums = capped.groupBy("condition_id", "bucket_index").agg(F.sum(F.when(F.col("signed") >= 0, F.col("capped")).otherwise(-F.col("capped"))).alias("net"), F.sum("capped").alias("gross"))
    return sums.select("condition_id", "bucket_index", clip(ratio(F.col("net"), F.col("gross")), -1, 1).alias("imbalance_winsor"))


def features(bucketed: DataFrame, quantile: float = 0.95) -> DataFrame:
    """One row a bucket: bounds, counts, imbalance in shares, winsorized and in cash, largest share, concentration.

    One pass: the bucket's cap by a window, sums by wallet, then sums over wallets, all in one partitioning.
    """
    by = Window.partitionBy("condition_id", "bucket_index")
    cap = F.floor(F.percentile("shares", quantile).over(by) + 0.475).cast("long")
    capped = bucketed.withColumn("capped", F.least(F.col("shares"), cap))
    signed = lambda c: F.when(F.col("signed") >= 0, F.col(c)).otherwise(-F.col(c))
    wallets = capped.groupBy("condition_id", "bucket_index", "active_wallet").agg(
        F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("end_ts"),
        F.count(F.lit(1)).alias("n_trades"),
        F.sum("cash").alias("gross_cash"),
        F.sum(F.abs("signed")).alias("abs_signed"),
        F.sum("signed").alias("net"),
        F.max(F.abs("signed")).alias("largest"),
        F.sum(signed("cash")).alias("net_cash"),
        F.sum(signed("capped")).alias("net_capped"),
        F.sum("capped").alias("capped"),
        F.floor(F.sum("shares") / 1000).cast("long").alias("w"),
    )
    sums = [F.sum(c).alias(c) for c in ("n_trades", "gross_cash", "abs_signed", "net", "net_cash", "net_capped", "capped", "w")]
    plain = wallets.groupBy("condition_id", "bucket_index").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.max("largest").alias("largest"), F.sum(F.col("w") * F.col("w")).alias("squares"), *sums)
    return plain.select(
        "condition_id", "bucket_index", "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("bucket_duration"), "n_trades", "gross_cash", "abs_signed",
        clip(ratio(F.col("net"), F.col("abs_signed")), -1, 1).alias("imbalance"),
        clip(ratio(F.col("net_cash"), F.col("gross_cash")), -1, 1).alias("imbalance_cash"),
        ratio(F.col("largest"), F.col("abs_signed")).alias("max_trade_share"),
        clip(ratio(F.col("net_capped"), F.col("capped")), -1, 1).alias("imbalance_winsor"),
        ratio(F.col("squares"), F.col("w").cast("double") * F.col("w").cast("double")).alias("wallet_hhi"),
    )


def imbalance_rows(bucketed: DataFrame) -> DataFrame:
    """The imbalance channel alone, as channel_rows has it."""
    sums = bucketed.groupBy("condition_id", "bucket_index").agg(F.sum("signed").alias("net"), F.sum(F.abs("signed")).alias("gross"))
    return sums.select("condition_id", "bucket_index", F.lit("imbalance").alias("channel"), micro(clip(ratio(F.col("net"), F.col("gross")), -1, 1)).alias("x"))


def channel_rows(featured: DataFrame) -> DataFrame:
    """(condition_id, bucket_index, channel, x): the channels as rows, x in millionths; concentration enters by its logarithm."""
    logged = featured.withColumn("wallet_hhi", F.log(F.greatest(F.col("wallet_hhi"), F.lit(1e-9))))
    pairs = ", ".join(f"'{c}', {c}" for c in CHANNELS)
    long = logged.select("condition_id", "bucket_index", F.expr(f"stack({len(CHANNELS)}, {pairs}) AS (channel, value)"))
    return long.select("condition_id", "bucket_index", "channel", micro(F.col("value")).alias("x"))


def top_wallet_share(bucketed: DataFrame, n: int = 3) -> DataFrame:
    """Share of a contract's volume held by its n largest wallets; strictly n, ties to the smaller name."""
    wallets = bucketed.groupBy("condition_id", "active_wallet").agg(F.sum("shares").alias("shares"))
    rank = F.row_number().over(Window.partitionBy("condition_id").orderBy(F.desc("shares"), "active_wallet"))
    total = wallets.groupBy("condition_id").agg(F.sum("shares").alias("total"))
    top = wallets.withColumn("rank", rank).where(F.col("rank") <= n).groupBy("condition_id").agg(F.sum("shares").alias("top"))
    return top.join(total, "condition_id").select("condition_id", ratio(F.col("top"), F.col("total")).alias("share"))
