"""The permutation and bootstrap queries at the reference's draws and levels.

The queries of `inference` and `attribution` with the same names draw little, as DuckDB repeats every draw of theirs;
these have no SQL and rest on brute force over small fixtures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, multiple, permute
from . import attribution as a
from . import detection as d
from . import inference as i

DRAWS = 1_999_999
CHUNKS = 64
SEED = 2026
ALPHA_LEG, ALPHA = 0.025, 0.05
BH_Q = 0.10
T_STAR = 5e-7  # the reference's calibrated threshold of the magnitude leg, the least p these draws can give
REPLICATES = 500


def decide(slots, counts):
    """Every wallet's p-values and decisions at the reference's levels, and how far each p is from its threshold."""
    told = counts.withColumnsRenamed({"n_e": "n_mag", "n_sign": "n_dir"})
    return permute.distances(multiple.decide(slots, permute.p_values(told), ALPHA_LEG, ALPHA, BH_Q, T_STAR))


@d.shared
def full_slots(spark, sf_dir):
    """Labelled slots whose magnitude weight e is the van der Waerden score on the grid, as the reference's; exposure is the aligned size."""
    score = a.ledgered(spark, sf_dir).select("window_id", F.col("slot_index").cast("long").alias("slot_index"), F.floor(F.col("score_vdw") * 1e6 + 0.5).cast("long").alias("vdw"))
    return i.labelled(spark, sf_dir).join(score, ["window_id", "slot_index"]).withColumnsRenamed({"e": "exposure", "vdw": "e"})


@d.shared
def full_counts(spark, sf_dir):
    return permute.philox_counts(full_slots(spark, sf_dir), DRAWS, SEED, chunks=CHUNKS)


@d.shared
def full_decided(spark, sf_dir):
    return decide(full_slots(spark, sf_dir), full_counts(spark, sf_dir))


def _columns(*names):
    return lambda spark, sf_dir: full_decided(spark, sf_dir).select("window_id", "active_wallet", *names)


def full_second_seed(spark, sf_dir):
    """Windows with a wallet near its threshold drawn again with the next seed: each such wallet's p beside its thresholds."""
    near = full_decided(spark, sf_dir).where("review").select("window_id", "active_wallet", "p_mag", "p_dir", "holm_mag_threshold", "holm_dir_threshold", "holm_mag_reject", "holm_dir_reject")
    slots = full_slots(spark, sf_dir).join(near.select("window_id").distinct(), "window_id", "left_semi")
    again = permute.philox_counts(slots, DRAWS, SEED + 1, chunks=CHUNKS)
    told = again.select("window_id", "active_wallet", ((F.col("n_e") + 1) / (F.col("draws") + 1)).alias("p_mag_second"), ((F.col("n_sign") + 1) / (F.col("draws") + 1)).alias("p_dir_second"), "draws")
    rows = near.join(told, ["window_id", "active_wallet"])
    for leg in ("mag", "dir"):
        rows = rows.withColumn(f"{leg}_stable", (F.col(f"p_{leg}_second") <= F.col(f"holm_{leg}_threshold")) == F.col(f"holm_{leg}_reject"))
    return rows


def full_two_layer(spark, sf_dir):
    layer = F.when(F.col("headline_reject"), F.concat(F.lit("validated_"), "leg_that_rejected")).when(F.col("screen_reject"), "screening").otherwise("none")
    return full_decided(spark, sf_dir).groupBy("window_id", layer.alias("layer")).agg(F.count(F.lit(1)).alias("n"))


def full_leg_agreement(spark, sf_dir):
    return full_decided(spark, sf_dir).where("eligible").groupBy(F.col("holm_mag_reject").alias("mag"), F.col("holm_dir_reject").alias("dir")).agg(F.count(F.lit(1)).alias("n"))


def full_tests_table(spark, sf_dir):
    w = a.wallets(spark, sf_dir).select("window_id", "active_wallet", "profile", "n_mle", "e_mle")
    return _columns("eligible", "p_mag", "p_dir", "headline_reject", "status")(spark, sf_dir).join(w, ["window_id", "active_wallet"])


def full_block_bootstrap(spark, sf_dir):
    return calibrate.block_bootstrap(a.paths(spark, sf_dir), REPLICATES, 10)


@d.shared
def full_bootstrap_max(spark, sf_dir):
    return calibrate.bootstrap_maxima(a.paths(spark, sf_dir), a.BOOT, REPLICATES, 10)


def full_threshold_search(spark, sf_dir):
    return calibrate.threshold(full_bootstrap_max(spark, sf_dir), 0.05)


def full_alpha_curve(spark, sf_dir):
    return calibrate.alpha_grid(full_bootstrap_max(spark, sf_dir), 2.0, 12.0)


QUERIES = {
    "full_p_values": _columns("n_mag", "n_dir", "draws", "p_mag", "p_dir"),
    "full_mc_sigma": _columns("sigma_mag", "sigma_dir", "review"),
    "full_sensitivity": _columns("p_dnc", "holm_dnc_p", "holm_dnc_reject", "p_dfa", "holm_dfa_p", "holm_dfa_reject"),
    "full_holm": _columns("eligible", "holm_mag_p", "holm_mag_threshold", "holm_mag_reject", "holm_dir_p", "holm_dir_threshold", "holm_dir_reject"),
    "full_bh": _columns("screen_mag_q", "screen_mag_reject", "screen_dir_q", "screen_dir_reject"),
    "full_headline_union": _columns("headline_reject", "leg_that_rejected"),
    "full_status_ladder": _columns("status"),
} | {f.__name__: f for f in (full_second_seed, full_two_layer, full_leg_agreement, full_tests_table, full_block_bootstrap, full_bootstrap_max, full_threshold_search, full_alpha_curve)}
