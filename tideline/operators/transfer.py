"""Alarm intervals carried to other contracts: overlap spans, placebo spans, exposure, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .attribute import numbered_slots
from .multiple import benjamini_hochberg, holm


def bucket_bounds(bucketed: DataFrame) -> DataFrame:
    return bucketed.groupBy("condition_id", "bucket_index").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"))


def intervals(windows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Wall-clock interval of each window: from its onset bucket's start to its alarm bucket's end."""
    w = windows.select("window_id", F.col("condition_id"), "onset_bucket", "alarm_bucket", "direction")
    inside = bounds.join(w, "condition_id").where(F.col("bucket_index").between(F.col("onset_bucket"), F.col("alarm_bucket")))
    return inside.groupBy("window_id", F.col("condition_id").alias("source"), "direction").agg(F.min("start_ts").alias("lo"), F.max("end_ts").alias("hi"))


def overlap_spans(spans: DataFrame, bounds: DataFrame, bin_seconds: int = 7 * 86400) -> DataFrame:
    """For each interval and other contract the contiguous hull of the buckets that overlap it.

    A range join as an equi-join on time bins: both sides are listed in every bin they touch, a pair counts in the
    bin where its overlap starts, and the exact test follows.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_seconds), F.floor(F.col(b) / bin_seconds)))
    left, right = spans.withColumn("bin", bins("lo", "hi")), bounds.withColumn("bin", bins("start_ts", "end_ts"))
    met = left.join(right, "bin").where((F.col("start_ts") <= F.col("hi")) & (F.col("end_ts") >= F.col("lo")) & (F.col("source") != F.col("condition_id")))
    once = met.where(F.col("bin") == F.floor(F.greatest("lo", "start_ts") / bin_seconds))
    return once.groupBy("window_id", "source", "condition_id", "direction").agg(F.min("bucket_index").alias("first_bucket"), F.max("bucket_index").alias("last_bucket"))


def without_tested(spans: DataFrame, tested: DataFrame) -> DataFrame:
    """Spans that are not tested already as a contract's own wide or narrow window."""
    return spans.join(tested.select("condition_id", "first_bucket", "last_bucket"), ["condition_id", "first_bucket", "last_bucket"], "left_anti")


def free_gaps(blocked: DataFrame, sizes: DataFrame) -> DataFrame:
    """(condition_id, gap_lo, gap_hi): the buckets of a contract between its merged blocked spans, before and after them."""
    order = Window.partitionBy("condition_id").orderBy("first_bucket", "last_bucket")
    reach = F.max("last_bucket").over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = blocked.withColumn("gap_lo", F.coalesce(reach + 1, F.lit(0).cast("long"))).select("condition_id", "gap_lo", (F.col("first_bucket") - 1).alias("gap_hi"))
    last = sizes.join(blocked.groupBy("condition_id").agg(F.max("last_bucket").alias("reach")), "condition_id", "left")
    after = last.select("condition_id", F.coalesce(F.col("reach") + 1, F.lit(0).cast("long")).alias("gap_lo"), (F.col("n_buckets") - 1).alias("gap_hi"))
    return before.unionByName(after).where("gap_lo <= gap_hi")


def placebo_spans(spans: DataFrame, blocked: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each span the nearest span of its length on the same contract that meets neither itself nor a blocked one.

    In each free gap the nearest place on either side of the span is known at once; the earlier side wins a tie.
    """
    length = F.col("last_bucket") - F.col("first_bucket") + 1
    met = spans.withColumn("length", length).join(free_gaps(blocked, sizes), "condition_id")
    hi = F.least(F.col("gap_hi"), F.col("first_bucket") - 1)
    lo = F.greatest(F.col("gap_lo"), F.col("last_bucket") + 1)
    earlier = F.struct((F.col("first_bucket") - 1 - hi).alias("gap"), F.lit(0).alias("side"), (hi - F.col("length") + 1).alias("lo"), hi.alias("hi"))
    later = F.struct((lo - F.col("last_bucket") - 1).alias("gap"), F.lit(1).alias("side"), lo.alias("lo"), (lo + F.col("length") - 1).alias("hi"))
    fits = met.withColumn("c", F.explode(F.array(earlier, later))).where((F.col("c.lo") >= F.col("gap_lo")) & (F.col("c.hi") <= F.col("gap_hi")) & (F.col("c.gap") >= 0))
    best = fits.groupBy("window_id", "condition_id", "first_bucket", "last_bucket").agg(F.min("c").alias("m"))
    return best.select("window_id", "condition_id", F.col("first_bucket").alias("source_first"), F.col("last_bucket").alias("source_last"), F.col("m.lo").alias("first_bucket"), F.col("m.hi").alias("last_bucket"))


def exposures(spans: DataFrame, bucketed: DataFrame) -> DataFrame:
    """Per span and wallet the size along the source alarm's side, its mirror, and the rank by it."""
    s = spans.select("window_id", "condition_id", "direction", "first_bucket", "last_bucket")
    rows = bucketed.join(s, "condition_id").where(F.col("bucket_index").between(F.col("first_bucket"), F.col("last_bucket")))
    held = rows.groupBy("window_id", "condition_id", "active_wallet").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("direction") * F.col("signed")).alias("e"), F.min(F.struct("timestamp", "transaction_hash")).alias("first"))
    place = F.row_number().over(Window.partitionBy("window_id", "condition_id").orderBy(F.desc("e"), "first", "active_wallet"))
    return held.select("window_id", "condition_id", "active_wallet", "n", "e", (-F.col("e")).alias("mirror"), place.cast("long").alias("rank_e"))


def lead_lag(windows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Alarms in order of the time they could be acted on, in seconds after the first."""
    at = windows.join(bounds, (windows["condition_id"] == bounds["condition_id"]) & (windows["alarm_bucket"] == bounds["bucket_index"])).select("window_id", F.col("end_ts").alias("available_ts"))
    first = at.agg(F.min("available_ts").alias("first_ts"))
    return at.crossJoin(F.broadcast(first)).select("window_id", "available_ts", (F.col("available_ts") - F.col("first_ts")).alias("seconds_after_first"))  # one row


# --- windows carried to other contracts, tested there ---

TRANSFER, PLACEBO = "transfer", "placebo"
KEYS = ("window_id", "active_wallet")


def planned(spans: DataFrame, placebos: DataFrame, windows: DataFrame, warm_up: int = 20) -> DataFrame:
    """One row a window to test: each span an alarm maps to another contract, and each one's placebo.

    `window_id` is the window's own key from here on, `source_id` the alarm's. A window that starts inside the
    buckets its baseline is estimated from has no detector-weighted arm.
    """
    own = windows.select(F.col("window_id").alias("source_id"), F.col("condition_id").alias("source"), "direction", "winning_delta")
    key = lambda role, first, last: F.concat_ws("|", F.lit(role), "source_id", "condition_id", F.concat(F.lit("b"), first.cast("string"), F.lit("-"), last.cast("string")))
    moved = spans.select(F.col("window_id").alias("source_id"), "condition_id", "first_bucket", "last_bucket")
    moved = moved.withColumn("window_id", key(TRANSFER, F.col("first_bucket"), F.col("last_bucket"))).withColumn("role", F.lit(TRANSFER)).withColumn("controls", F.lit(None).cast("string"))
    held = placebos.select(F.col("window_id").alias("source_id"), "condition_id", "source_first", "source_last", "first_bucket", "last_bucket")
    held = held.withColumn("window_id", key(PLACEBO, F.col("first_bucket"), F.col("last_bucket"))).withColumn("role", F.lit(PLACEBO)).withColumn("controls", key(TRANSFER, F.col("source_first"), F.col("source_last")))
    rows = moved.unionByName(held.drop("source_first", "source_last")).join(own, "source_id")
    return rows.withColumn("baseline_available", F.col("first_bucket") >= warm_up)


def target_slots(windows: DataFrame, bucketed: DataFrame) -> DataFrame:
    """Every trade of each window's buckets in slot order; all of them are tested."""
    w = windows.select("window_id", "condition_id", "first_bucket", "last_bucket", "direction", "winning_delta")
    rows = bucketed.join(w, "condition_id").where(F.col("bucket_index").between(F.col("first_bucket"), F.col("last_bucket")))
    return numbered_slots(rows).withColumn("in_mle", F.lit(True))


def usable(windows: DataFrame, path: DataFrame) -> DataFrame:
    """Adds w_window, the plain sum of single-step log likelihood ratios in quarter millionths, and why it is missing if it is.

    No walk is reflected here: the sum is of delta d z - delta^2 / 2 over the window's buckets. It fails closed on a
    baseline not there yet, and on any imputed or degenerate bucket inside.
    """
    w = windows.select("window_id", "condition_id", "first_bucket", "last_bucket", "direction", "winning_delta")
    inside = path.join(w, "condition_id").where(F.col("bucket_index").between(F.col("first_bucket"), F.col("last_bucket")))
    step = (F.col("winning_delta") * 4).cast("long") * F.col("direction") * F.col("z") - (F.col("winning_delta") * F.col("winning_delta") / 2 * 4_000_000).cast("long")
    sums = inside.groupBy("window_id").agg(F.sum(step).alias("llr"), F.bool_or(F.col("imputed") | F.col("scale_degenerate")).alias("bad"))
    told = windows.join(sums, "window_id", "left")
    reason = F.when(~F.col("baseline_available"), "inside_baseline").when(F.coalesce("bad", F.lit(True)), "imputed_or_degenerate_bucket")
    return told.withColumn("rejected", reason).withColumn("w_window", F.when(reason.isNull(), F.col("llr"))).drop("llr", "bad")


#: p-value, whether only transferred windows (True), only placebos (False), and what else a member needs, share of alpha.
FAMILIES = {
    "primary": ("p_mag_e", TRANSFER, "true", 1.0),
    "mag": ("p_vdw", TRANSFER, "true", 0.5),
    "dir": ("p_dir", TRANSFER, "true", 0.5),
    "no_leak": ("p_mag_e", TRANSFER, "NOT crosses_source", 1.0),
    "mirror": ("p_mirror", TRANSFER, "true", 1.0),
    "secondary_dnc": ("p_dnc", TRANSFER, "measured", 1.0),
    "placebo": ("p_mag_e", PLACEBO, "true", 1.0),
}


def family_decisions(rows: DataFrame, alpha: float) -> DataFrame:
    """(window_id, active_wallet, family, p, holm_p, holm_rank, m, reject, reachable): each family by window, at its own level.

    Reachable: the orbit's floor meets the family's first step, 1 / orbit <= level / m, on logarithms.
    """
    kinds = [F.when(F.col("eligible") & (F.col("role") == role) & F.expr(needs), F.struct(F.lit(name).alias("family"), F.col(p).alias("p"), F.lit(share * alpha).alias("level"))) for name, (p, role, needs, share) in FAMILIES.items()]
    long = rows.select(*KEYS, "log_orbit", F.explode(F.array_compact(F.array(*kinds))).alias("f")).select(*KEYS, "log_orbit", "f.*").withColumn("unit", F.concat_ws("|", "family", "window_id"))
    told = holm(long, "p", "unit", "active_wallet", alpha)
    m = F.count(F.lit(1)).over(Window.partitionBy("unit"))
    return told.withColumn("m", m).select(*KEYS, "family", "p", "holm_p", "holm_rank", "m", (F.col("holm_p") <= F.col("level")).alias("reject"), (F.log(F.col("level") / F.col("m")) + F.col("log_orbit") >= 0).alias("reachable"))


def pair_decisions(rows: DataFrame, families: DataFrame, bh_q: float) -> DataFrame:
    """One row a pair: its rejections by family, both tails, what only the sensitivity says, and the screen of the study's own pairs."""
    names = list(FAMILIES)
    wide = families.groupBy(*KEYS).agg(*[F.max(F.when(F.col("family") == n, F.col("reject"))).alias(f"reject_{n}") for n in names])
    told = rows.withColumn("screened", F.when(F.col("role") == TRANSFER, F.col("p_mag_e")))
    told = benjamini_hochberg(told, "screened", "window_id", "active_wallet", bh_q, "screen").join(wide, list(KEYS), "left")
    yes = lambda n: F.coalesce(F.col(f"reject_{n}"), F.lit(False))
    return told.withColumn("both_tails", yes("primary") & yes("mirror")).withColumn("secondary_only", yes("secondary_dnc") & ~yes("primary"))


def contrast(windows: DataFrame, decisions: DataFrame) -> DataFrame:
    """By role: windows, pairs, rejections of its own family and their share of eligible pairs. The two are never one family."""
    rejected = F.coalesce(F.when(F.col("role") == TRANSFER, F.col("reject_primary")).otherwise(F.col("reject_placebo")), F.lit(False))
    told = decisions.withColumn("rejected", rejected)
    pairs = told.groupBy("role").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if("eligible").alias("eligible_pairs"), F.count_if("rejected").alias("rejections"), F.countDistinct(F.when(F.col("rejected"), F.col("window_id"))).alias("windows_with_rejection"), F.min("p_mag_e").alias("least_p")
    )
    counted = windows.groupBy("role").agg(F.count(F.lit(1)).alias("windows"))
    share = F.when(F.col("eligible_pairs") > 0, F.col("rejections") / F.col("eligible_pairs"))
    return counted.join(pairs, "role", "left").withColumn("rate", share)


def uncontrolled(windows: DataFrame) -> DataFrame:
    """Transferred windows for which their contract had no room for a placebo."""
    controls = windows.where("controls IS NOT NULL").select(F.col("controls").alias("window_id"))
    return windows.where(F.col("role") == TRANSFER).join(controls, "window_id", "left_anti").select("window_id")
