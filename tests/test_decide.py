"""Decisions with legs as rows against the adjustments leg by leg."""

import random

from pyspark.sql import functions as F

from tideline.operators import multiple


def tables(spark):
    rng = random.Random(3)
    slots, tested = [], []
    for w in ("v", "w"):
        for k in range(60):
            tested.append((w, f"u{k}", *[rng.choice((1, 2, 2, 5, 9, 21)) / 21 for _ in range(4)]))
            slots += [(w, f"u{k}", 3 * k + j, rng.randint(-4, 9), rng.choice((-1, 1))) for j in range(rng.randint(1, 6))]
    return spark.createDataFrame(slots, "window_id string, active_wallet string, slot_index long, e long, sign long"), spark.createDataFrame(tested, "window_id string, active_wallet string, p_mag double, p_dir double, p_dnc double, p_dfa double")


def test_decisions_equal_those_leg_by_leg_with_few_sorts(spark):
    slots, tested = tables(spark)
    got = multiple.decide(slots, tested, 0.2, 0.4, 0.25, 0.06)
    rows = tested.join(slots.groupBy("window_id", "active_wallet").agg(F.count(F.lit(1)).alias("n_slots")), ["window_id", "active_wallet"])
    for leg in ("mag", "dir", "dnc", "dfa"):
        rows = rows.withColumn(f"c_{leg}", F.when(F.col("n_slots") >= 3, F.col(f"p_{leg}")))
        rows = multiple.holm(rows, f"c_{leg}", "window_id", "active_wallet", 0.2 if leg in ("mag", "dir") else 0.4, f"holm_{leg}")
    for leg in ("mag", "dir"):
        rows = multiple.benjamini_hochberg(rows, f"p_{leg}", "window_id", "active_wallet", 0.25, f"screen_{leg}")
    names = sorted(set(rows.columns) & set(got.columns))
    assert len(names) > 24
    key = lambda df: sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    assert key(got) == key(rows)
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 10  # every sort keeps a page of memory or more
