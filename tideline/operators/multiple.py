"""Multiplicity: step-down and step-up adjustments by family, ladders, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def holm(rows: DataFrame, p: str, family: str, key: str, alpha: float = 0.05, out: str = "holm") -> DataFrame:
    """Adds {out}_p, the running largest of (m - j) p in order of p capped at 1, {out}_rank, {out}_threshold, alpha / (m - j),
    and {out}_reject. Rows with null p are no members."""
    order = Window.partitionBy(family, F.col(p).isNull()).orderBy(p, key)
    m = F.count(p).over(Window.partitionBy(family))
    step = (m - F.row_number().over(order) + 1) * F.col(p)
    rank = F.when(F.col(p).isNotNull(), F.row_number().over(order)).cast("long")
    told = rows.withColumn(f"{out}_step", F.when(F.col(p).isNotNull(), step)).withColumn(f"{out}_rank", rank).withColumn(f"{out}_threshold", F.when(F.col(p).isNotNull(), alpha / (m - F.row_number().over(order) + 1)))
    adjusted = F.least(F.lit(1.0), F.max(f"{out}_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn(f"{out}_p", F.when(F.col(p).isNotNull(), adjusted))
    return told.withColumn(f"{out}_reject", F.col(f"{out}_p") <= alpha).drop(f"{out}_step")


def benjamini_hochberg(rows: DataFrame, p: str, family: str, key: str, q: float = 0.10, out: str = "bh") -> DataFrame:
    """Adds {out}_q, the running least of m p / rank from the largest p down, and {out}_reject."""
    up = Window.partitionBy(family, F.col(p).isNull()).orderBy(p, key)
    down = Window.partitionBy(family, F.col(p).isNull()).orderBy(F.desc(p), F.desc(key))
    m = F.count(p).over(Window.partitionBy(family))
    told = rows.withColumn(f"{out}_step", F.when(F.col(p).isNotNull(), m * F.col(p) / F.row_number().over(up)))
    value = F.least(F.lit(1.0), F.min(f"{out}_step").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn(f"{out}_q", F.when(F.col(p).isNotNull(), value))
    return told.withColumn(f"{out}_reject", F.col(f"{out}_q") <= q).drop(f"{out}_step")


def top_with_ties(rows: DataFrame, score: str, family: str, n: int) -> DataFrame:
    """The rows of each family that reach its n-th largest score; a tie at the cut is not split."""
    place = F.rank().over(Window.partitionBy(family).orderBy(F.desc_nulls_last(score)))
    return rows.withColumn("_place", place).where((F.col("_place") <= n) & F.col(score).isNotNull()).drop("_place")


def calibrated_status(rows: DataFrame, t_star: float) -> DataFrame:
    """The reference's ladder: a Holm rejection on size counts as a finding only with p_mag at most t_star, one on direction always."""
    mag, direction, screened = (F.coalesce(F.col(c), F.lit(False)) for c in ("holm_mag_reject", "holm_dir_reject", "screen_reject"))
    label = F.when((mag & (F.col("p_mag") <= t_star)) | direction, "confirmed_repeat_active").when(mag, "review_queue").when(screened, "bh_review_screen").when(F.col("top10"), "top10_descriptive")
    return rows.withColumn("status", label)


HEADLINE, SENSITIVITY = ("mag", "dir"), ("dnc", "dfa")


def _adjusted(rows: DataFrame, levels: dict[str, float]) -> DataFrame:
    """Adds holm_{leg}_rank, _threshold and _p of `holm` over eligible rows for every leg, and for the headline legs
    screen_{leg}_q of `benjamini_hochberg` over all rows, top_{leg} and strict_{leg}.

    Legs are rows, so that a task sorts one leg of one window, three times in all: by p up for Holm, whose ranks are the
    eligible rows so far, and for the screen's ranks; by p down; by score.
    """
    keys, own = ("window_id", "active_wallet"), ("window_id", "_leg")
    base = [c for c in rows.columns if c not in keys]
    legs = [F.struct(F.lit(leg).alias("leg"), F.lit(float(level)).alias("alpha"), F.col(f"p_{leg}").alias("p"), F.col(score).cast("long").alias("score")) for (leg, level), score in zip(levels.items(), ("e", "sign", "e", "e"))]
    long = rows.withColumn("_l", F.explode(F.array(*legs))).select(*keys, *base, *[F.col(f"_l.{c}").alias(f"_{c}") for c in ("leg", "alpha", "p", "score")])
    member = F.col("eligible") & F.col("_p").isNotNull()
    up = Window.partitionBy(*own, F.col("_p").isNull()).orderBy("_p", "active_wallet")
    down = Window.partitionBy(*own, F.col("_p").isNull()).orderBy(F.desc("_p"), F.desc("active_wallet"))
    far = Window.unboundedPreceding
    long = long.withColumns({"_m": F.count_if(member).over(Window.partitionBy(*own)), "_all": F.count("_p").over(Window.partitionBy(*own))})
    long = long.withColumns({"_rank": F.when(member, F.count_if(member).over(up.rowsBetween(far, 0))), "_place": F.row_number().over(up)})
    left = F.col("_m") - F.col("_rank") + 1
    long = long.withColumn("_step", F.when(member, left * F.col("_p"))).withColumn("_holm", F.when(member, F.least(F.lit(1.0), F.max("_step").over(up.rowsBetween(far, 0)))))
    long = long.withColumn("_q", F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.min(F.col("_all") * F.col("_p") / F.col("_place")).over(down.rowsBetween(far, 0)))))
    best = Window.partitionBy(*own).orderBy(F.desc("_score"), "first_slot")
    long = long.withColumn("_strict", F.row_number().over(best) <= 10).withColumn("_top", F.rank().over(Window.partitionBy(*own).orderBy(F.desc("_score"))) <= 10)
    long = long.withColumn("_threshold", F.when(member, F.col("_alpha") / left))
    of = lambda leg, c, name: F.max(F.when(F.col("_leg") == leg, F.col(c))).alias(name)
    told = [of(leg, c, f"holm_{leg}_{name}") for leg in levels for c, name in (("_rank", "rank"), ("_threshold", "threshold"), ("_holm", "p"))]
    told += [of(leg, c, name) for leg in HEADLINE for c, name in (("_q", f"screen_{leg}_q"), ("_top", f"top_{leg}"), ("_strict", f"strict_{leg}"))]
    return long.groupBy(*keys).agg(*[F.first(c).alias(c) for c in base], *told)


def decide(slots: DataFrame, tested: DataFrame, alpha_leg: float, alpha: float, bh_q: float, t_star: float, least: int = 3) -> DataFrame:
    """Every wallet's decisions from its p-values by leg.

    Holm by window on wallets of `least` trades and more: at alpha_leg on the two headline legs, at alpha on the two
    sensitivity legs, which never enter the headline. The screen is over all wallets, on both headline legs. The
    descriptive top ten needs exposure on the alarm's side; tied members beyond ten are flagged.
    """
    exposure = F.sum("exposure" if "exposure" in slots.columns else "e").alias("exposure")
    n = slots.groupBy("window_id", "active_wallet").agg(F.count(F.lit(1)).alias("n_slots"), F.sum("e").alias("e"), F.sum("sign").alias("sign"), exposure, F.min("slot_index").alias("first_slot"))
    rows = tested.join(n, ["window_id", "active_wallet"]).withColumn("eligible", F.col("n_slots") >= least)
    levels = {leg: alpha_leg if leg in HEADLINE else alpha for leg in (*HEADLINE, *SENSITIVITY) if f"p_{leg}" in rows.columns}
    rows = _adjusted(rows, levels)
    for leg, level in levels.items():
        rows = rows.withColumn(f"c_{leg}", F.when(F.col("eligible"), F.col(f"p_{leg}"))).withColumn(f"holm_{leg}_reject", F.col(f"holm_{leg}_p") <= level)
    for leg in HEADLINE:
        rows = rows.withColumn(f"screen_{leg}_reject", F.col(f"screen_{leg}_q") <= bh_q)
    mag, direction = (F.coalesce(F.col(f"holm_{leg}_reject"), F.lit(False)) for leg in HEADLINE)
    rows = rows.withColumn("headline_reject", mag | direction).withColumn("screen_reject", F.col("screen_mag_reject") | F.col("screen_dir_reject"))
    rows = rows.withColumn("leg_that_rejected", F.when(mag & direction, "both").when(mag, "mag").when(direction, "dir").otherwise("none"))
    rows = rows.withColumn("top10", (F.col("top_mag") | F.col("top_dir")) & (F.col("exposure") > 0))
    rows = rows.withColumn("passes_t_star", F.col("p_mag") <= t_star)
    rows = calibrated_status(rows, t_star)
    tied = (F.col("status") == "top10_descriptive") & ~(F.col("strict_mag") | F.col("strict_dir"))
    return rows.withColumn("tied_into_top", F.coalesce(tied, F.lit(False))).drop("top_mag", "top_dir", "strict_mag", "strict_dir")


def sensitivity_agreement(decided: DataFrame) -> DataFrame:
    """Per sensitivity leg the two by two of its rejections and the headline's."""
    headline = F.col("headline_reject")
    frames = []
    for leg in SENSITIVITY:
        own = F.coalesce(F.col(f"holm_{leg}_reject"), F.lit(False))
        frames.append(
            decided.agg(
                F.count_if(own).alias("rejections"), F.count_if(own & ~headline).alias("sensitivity_only"), F.count_if(own & headline).alias("both"), F.count_if(~own & headline).alias("headline_only"), F.count_if(~own & ~headline).alias("neither")
            ).select(F.lit(leg).alias("leg"), "rejections", "sensitivity_only", "both", "headline_only", "neither")
        )
    return frames[0].unionByName(frames[1])


def pooled_holm(decided: DataFrame, streams: DataFrame, p: str, alpha: float) -> DataFrame:
    """Holm once more over all windows of a stream together, as a regression against the families by window."""
    rows = decided.where("eligible").select("window_id", "active_wallet", p).join(streams, "window_id").withColumn("pair", F.concat_ws("|", "window_id", "active_wallet"))
    return holm(rows, p, "stream_id", "pair", alpha, "pooled")


def top_view(decided: DataFrame, n: int) -> DataFrame:
    """The n first of the ladder: by tier, then the smaller of the two Holm values, then size; a display cut that may split ties."""
    tier = F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), F.col("status")), F.lit(0))
    tier = F.when(tier == 0, len(TIERS) + 1).otherwise(tier).cast("long")
    least = F.least(*[F.coalesce(F.col(f"holm_{leg}_p"), F.lit(float("inf"))) for leg in HEADLINE])
    return decided.withColumn("tier", tier).orderBy("tier", least, F.desc("e"), "window_id", "active_wallet").limit(n)


TIERS = ("confirmed_repeat_active", "review_queue", "bh_review_screen", "top10_descriptive")
