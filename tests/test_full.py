"""The full-size inference against enumeration and by hand."""

import pytest
from pyspark.sql import functions as F

from test_permute import exact, slots

from tideline.operators import permute
from tideline.plans import full


def test_chunked_draws_reach_the_enumerated_shares_at_the_reference_size(spark):
    counts = permute.philox_counts(slots(spark), full.DRAWS, chunks=full.CHUNKS)
    out = {r.active_wallet: r for r in counts.collect()}
    for w, p in exact().items():
        assert out[w].draws == 1_999_999
        assert abs(out[w].n_e / full.DRAWS - p) <= 4.5 * (max(p * (1 - p), 1e-9) / full.DRAWS) ** 0.5


def test_levels_reject_what_twenty_draws_cannot(spark):
    rows = [("w", f"k{i:02d}", *n, full.DRAWS) for i, n in enumerate([(0, 900_000), (3, 900_000), (900_000, 0), (99_999, 900_000), (1_999_999, 1_999_999), (0, 0)])]
    counts = spark.createDataFrame(rows, "window_id string, active_wallet string, n_e long, n_sign long, draws long")
    held = counts.select("window_id", "active_wallet", F.explode(F.sequence(F.lit(1), F.when(F.col("active_wallet") == "k05", 2).otherwise(3))), F.lit(1).alias("e"), F.lit(1).alias("sign"), F.lit(1).alias("exposure"), F.lit(1).alias("slot_index"))
    out = {r.active_wallet: r for r in full.decide(held, counts).collect()}
    assert [out[f"k{i:02d}"].status for i in range(6)] == ["confirmed_repeat_active", "review_queue", "confirmed_repeat_active", "bh_review_screen", "top10_descriptive", "bh_review_screen"]
    assert [out[f"k{i:02d}"].leg_that_rejected for i in range(6)] == ["mag", "mag", "dir", "none", "none", "none"]
    assert out["k00"].holm_mag_threshold == pytest.approx(0.025 / 5) and out["k03"].holm_mag_threshold == pytest.approx(0.025 / 3)
    assert out["k05"].eligible is False and out["k05"].holm_mag_threshold is None and out["k05"].review is None
    p = 100_000 / 2_000_000
    assert out["k03"].sigma_mag == pytest.approx((p - 0.025 / 3) / (p * (1 - p) / full.DRAWS) ** 0.5)
    assert out["k04"].sigma_mag == float("inf")


def test_bootstrap_has_every_replicate(spark):
    got = full.full_bootstrap_max(spark, "/root/testdata/sf0.01").groupBy("condition_id").count().collect()
    assert got and all(r["count"] == 500 for r in got)
