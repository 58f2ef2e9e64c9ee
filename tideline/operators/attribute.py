"""From alarms to wallets: canonical windows, ledger of contributions, scores, profiles, wallet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import joined_key, normal_quantile

WINDOW = "window_id"
PROFILES = ("NEW", "OLD_SMALL", "OLD_LARGE")


def run_rows(verdicts: DataFrame, method: str, threshold: float, size: int, stream: str = "events") -> DataFrame:
    """Alarmed runs with their readable keys."""
    v = verdicts.where("alarmed").withColumn("method", F.lit(method)).withColumn("threshold", F.lit(threshold))
    episode = joined_key(stream, F.col("condition_id"), F.col("channel"), f"K{size}")
    return v.withColumn("episode_id", episode).withColumn("window_id", F.concat(episode, F.lit("|a"), F.col("alarm_bucket").cast("string"))).withColumn("detector_run_id", F.concat_ws("|", episode, F.lit(method)))


def canonical(runs: DataFrame) -> DataFrame:
    """One run an episode: the largest statistic over threshold, ties to the smaller run id."""
    order = Window.partitionBy("episode_id").orderBy(F.desc(F.col("max_statistic") / F.col("threshold")), "detector_run_id")
    return runs.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def slots(windows: DataFrame, bucketed: DataFrame) -> DataFrame:
    """Trades of each window's buckets, onset to alarm, with slot_index in their order and the narrow window's flag."""
    w = windows.select(WINDOW, "condition_id", "onset_bucket", "onset_mle", "alarm_bucket", "direction", "winning_delta")
    joined = bucketed.join(w, (bucketed["condition_id"] == w["condition_id"]) & F.col("bucket_index").between(F.col("onset_bucket"), F.col("alarm_bucket"))).drop(w["condition_id"])
    return numbered_slots(joined).withColumn("in_mle", F.col("bucket_index") >= F.col("onset_mle"))


def numbered_slots(rows: DataFrame) -> DataFrame:
    """Adds slot_index, the place in the window by bucket, time and hash: the trades of earlier buckets and the place in the own."""
    order = Window.partitionBy(WINDOW, "bucket_index").orderBy("timestamp", "transaction_hash")
    before = Window.partitionBy(WINDOW).orderBy("bucket_index").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(WINDOW, "bucket_index").agg(F.count(F.lit(1)).alias("_n"))  # one row a bucket
    starts = counts.select(WINDOW, "bucket_index", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = rows.withColumn("_within", F.row_number().over(order) - 1).join(starts, [WINDOW, "bucket_index"])
    return placed.withColumn("slot_index", F.col("_start") + F.col("_within")).drop("_within", "_start")


def membership_digest(slotted: DataFrame) -> DataFrame:
    """SHA-256 over a window's 'bucket|transaction' lines in slot order."""
    line = F.concat(joined_key(F.col("bucket_index").cast("string"), F.col("transaction_hash")), F.lit("\n"))
    lists = slotted.groupBy(WINDOW).agg(F.sort_array(F.collect_list(F.struct("slot_index", line.alias("line")))).alias("lines"), F.count(F.lit(1)).alias("n_slots"))
    return lists.select(WINDOW, "n_slots", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), ""), 256).alias("membership_sha256"))


def count_report(slotted: DataFrame) -> DataFrame:
    wallets = slotted.groupBy(WINDOW, "active_wallet").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_mle").alias("n_mle"))
    return wallets.groupBy(WINDOW).agg(F.sum("n").alias("n_wide"), F.sum("n_mle").alias("n_mle"), F.count(F.lit(1)).alias("wallets_wide"), F.count_if(F.col("n_mle") > 0).alias("wallets_mle"))


def average_rank(x: Column, *keys: Column | str) -> Column:
    """Ranks with ties at their average."""
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0


def ledger(slotted: DataFrame, path: DataFrame) -> DataFrame:
    """Contributions and scores of every trade of the narrow windows, null outside them.

    With d the side, delta the winning shift, q a trade's signed size and A its bucket's absolute size:
    dnc = delta d q / (A sigma), agc = kappa |q| / A with kappa = -delta d mu / sigma - delta^2 / 2, dfa their sum;
    score_sign is the sign of d q, score_vdw the normal quantile of its average rank in the bucket over m + 1.
    """
    keys = [WINDOW, "bucket_index"]
    joined = slotted.join(path.select("condition_id", "bucket_index", "mu", "sigma"), ["condition_id", "bucket_index"], "left")
    inside = joined.where("in_mle").withColumn("total", F.sum(F.abs("signed")).over(Window.partitionBy(*keys))).withColumn("aligned", F.col("direction") * F.col("signed"))
    scale = F.col("sigma") + 1e-3
    share = F.when(F.col("total") != 0, F.col("signed") * 1e6 / F.col("total"))
    kappa = -F.col("winning_delta") * F.col("direction") * F.col("mu") / scale - F.col("winning_delta") * F.col("winning_delta") / 2.0
    inside = inside.withColumn("dnc", F.col("winning_delta") * F.col("direction") * share / scale).withColumn("agc", kappa * F.abs(share) / 1e6)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    scored = inside.withColumn("score_sign", F.signum("aligned").cast("long")).withColumn("score_vdw", normal_quantile(average_rank(F.col("aligned"), *keys) / (size + 1)))
    outside = joined.where("not in_mle")
    return scored.withColumn("dfa", F.col("dnc") + F.col("agc")).drop("total", "aligned").unionByName(outside, allowMissingColumns=True)


def conservation(ledgered: DataFrame) -> DataFrame:
    """Sum of dfa by window and bucket against the bucket's own increment, by which the window's walk rose."""
    return ledgered.where("in_mle").groupBy(WINDOW, "condition_id", "bucket_index").agg(F.sum("dfa").alias("dfa"), F.first("direction").alias("direction"), F.first("winning_delta").alias("winning_delta"), F.first("mu").alias("mu"), F.first("sigma").alias("sigma"))


def history(windows: DataFrame, bucketed: DataFrame) -> DataFrame:
    """Per window and wallet what came strictly before the onset: trades, median size, first time."""
    w = windows.select(WINDOW, "condition_id", "onset_bucket")
    past = bucketed.join(w, "condition_id").where(F.col("bucket_index") < F.col("onset_bucket"))
    return past.groupBy(WINDOW, "active_wallet").agg(F.count(F.lit(1)).alias("n_before"), F.percentile("shares", 0.5).alias("median_shares"), F.min("timestamp").alias("first_ts"))


def profiles(slotted: DataFrame, past: DataFrame) -> DataFrame:
    """NEW without history; else small or large against the median of the medians of the narrow window's old wallets."""
    wallets = slotted.groupBy(WINDOW, "active_wallet").agg(F.max("in_mle").alias("any_mle"))
    known = wallets.join(past, [WINDOW, "active_wallet"], "left")
    cutoff = known.where("any_mle and n_before > 0").groupBy(WINDOW).agg(F.percentile("median_shares", 0.5).alias("cutoff"))
    told = known.join(cutoff, WINDOW, "left")
    profile = F.when(F.coalesce(F.col("n_before"), F.lit(0)) == 0, "NEW").when(F.col("median_shares") <= F.col("cutoff"), "OLD_SMALL").otherwise("OLD_LARGE")
    return told.select(WINDOW, "active_wallet", profile.alias("profile"), F.coalesce("n_before", F.lit(0)).cast("long").alias("n_before"))


def wallet_rows(ledgered: DataFrame, profiled: DataFrame) -> DataFrame:
    """One row a window and wallet. Sums over the narrow window are null for wallets that only stand in the wide one."""
    mle = F.col("in_mle")
    rows = ledgered.groupBy(WINDOW, "condition_id", "active_wallet").agg(
        F.count(F.lit(1)).alias("n_wide"),
        F.count_if(mle).alias("n_mle"),
        F.sum(F.when(mle, F.col("direction") * F.col("signed"))).alias("e_mle"),
        F.sum("dnc").alias("dnc"),
        F.sum("dfa").alias("dfa"),
        F.sum("score_vdw").alias("vdw"),
        F.sum("score_sign").alias("sign"),
        F.min("slot_index").alias("first_slot"),
    )
    joined = rows.join(profiled, [WINDOW, "active_wallet"])
    for name in ("e_mle", "dnc", "dfa"):
        place = F.row_number().over(Window.partitionBy(WINDOW).orderBy(F.desc_nulls_last(name if name == "e_mle" else F.floor(F.col(name) * 1e6 + 0.5)), "first_slot"))
        joined = joined.withColumn(f"rank_{name}", F.when(F.col("n_mle") > 0, place))
    return joined


def first_trades(windows: DataFrame, bucketed: DataFrame) -> DataFrame:
    """Each wallet's first trade in the contract up to the alarm bucket: time, place and bucket."""
    w = windows.select(WINDOW, "condition_id", "alarm_bucket")
    seen = bucketed.join(w, "condition_id").where(F.col("bucket_index") <= F.col("alarm_bucket"))
    return seen.groupBy(WINDOW, "active_wallet").agg(F.min(F.struct("timestamp", "transaction_hash", "bucket_index")).alias("f")).select(WINDOW, "active_wallet", "f.timestamp", "f.transaction_hash", "f.bucket_index")


def scrambled_after_onset(windows: DataFrame, bucketed: DataFrame) -> DataFrame:
    """The trades with sizes after each contract's earliest onset changed: nothing computed from history may notice."""
    onset = windows.groupBy("condition_id").agg(F.min("onset_bucket").alias("first_onset"))
    mixed = bucketed.join(onset, "condition_id", "left")
    return mixed.withColumn("shares", F.when(F.col("bucket_index") >= F.col("first_onset"), F.col("shares") * 7 + 13).otherwise(F.col("shares"))).drop("first_onset")
