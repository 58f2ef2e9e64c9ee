"""Scalar functions and keys at their edges; invariances of the tests; gates that must refuse."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.functions import expr, ids
from tideline.operators import calibrate, permute, recall
from tideline.sources import trades as source
from test_permute import slots


def test_log_factorials_equal_lgamma(spark):
    df = spark.createDataFrame([(n,) for n in [*range(40), 100, 1000, 10**6]], "n long").select("n", expr.log_factorial(F.col("n")).alias("v"))
    assert all(r.v == pytest.approx(math.lgamma(r.n + 1), rel=1e-12, abs=1e-11) for r in df.collect())


def test_times_names_and_slugs(spark):
    df = spark.createDataFrame([("2025-11-30T12:00:00Z",), ("2025-11-30 12:00:00",), ("2025-11-30T13:00:00+01:00",), (" ",), (None,), ("soon",)], "t string")
    got = [r.s for r in df.select(expr.utc_seconds(F.col("t")).alias("s")).collect()]
    assert got == [1764504000] * 3 + [None] * 3
    one = spark.range(1).select(expr.utc_text(F.lit(1764504000).cast("long")).alias("a"), expr.utc_text(F.lit(None).cast("long")).alias("b"), expr.utc_text(F.lit(-1).cast("long")).alias("c"), expr.slug(F.lit(" Out by Nov 30, 2025? ")).alias("d"), expr.shortened(F.lit("short")).alias("e")).collect()[0]
    assert tuple(one) == ("2025-11-30 12:00:00 UTC", None, "1969-12-31 23:59:59 UTC", "out-by-nov-30-2025", "short")


@pytest.mark.parametrize("value", ["", "a|b", "a b", None])
def test_malformed_keys_are_refused(spark, value):
    df = spark.createDataFrame([(value,)], "v string")
    with pytest.raises(Exception, match="malformed"):
        df.select(ids.token(F.col("v"))).collect()
    with pytest.raises(Exception, match="malformed"):
        df.select(ids.choice(F.col("v"), ids.METHODS)).collect()


def test_exact_families_on_and_off_the_line(spark):
    s = slots(spark, {0: "A" + "B" * 39, 1: "C" * 20 + "D" * 20, 2: "EE"})
    rows = {r.active_wallet: r for r in permute.exact_families(s, least=1).collect()}
    m = len(rows)
    orbit = {"A": 40, "B": 40, "C": math.comb(40, 20), "D": math.comb(40, 20), "E": 1}
    for w, size in orbit.items():
        assert rows[w].screening_reachable == (size >= 40 * m) and rows[w].screening_tie == (size == 40 * m)
    one = {r.active_wallet: r for r in permute.exact_families(slots(spark, {0: "A" + "B" * 39}), least=10).collect()}
    assert one["B"].m_confirmatory == 1 and one["B"].tie and one["B"].reachable and one["A"].reachable is None
    report = permute.family_report(permute.exact_families(s, least=1)).collect()[0]
    assert (report.m_screening, report.reach_screening) == (5, 2)
    assert {r.active_wallet: r.orbit for r in permute.exact_orbits(s).collect()} == {w: str(n) for w, n in orbit.items()}


def test_counts_do_not_depend_on_names_or_partitions(spark):
    s = slots(spark)
    plain = {r.active_wallet: tuple(r)[2:] for r in permute.philox_counts(s, 300).collect()}
    cut = {r.active_wallet: tuple(r)[2:] for r in permute.philox_counts(s.repartition(7), 300).collect()}
    assert plain == cut
    shift = s.withColumn("active_wallet", F.concat(F.lit("z"), "active_wallet"))  # keeps the order of names
    assert {f"z{w}": n for w, n in plain.items()} == {r.active_wallet: tuple(r)[2:] for r in permute.philox_counts(shift, 300).collect()}
    named = recall.renamed(s)
    assert named.select("active_wallet").distinct().count() == s.select("active_wallet").distinct().count()


def test_slots_without_profile_and_degenerate_paths_are_refused(spark):
    ledgered = spark.createDataFrame([("w", "c", 1, 0, "A", 1, 2, 0.5, 0.5, 1, True)], "window_id string, condition_id string, bucket_index long, slot_index long, active_wallet string, direction int, signed long, dnc double, dfa double, score_sign long, in_mle boolean")
    none = spark.createDataFrame([], "window_id string, active_wallet string, profile string")
    with pytest.raises(Exception, match="no profile"):
        permute.labelled(ledgered, none).collect()
    flat = spark.createDataFrame([("c", 0, 5, True)], "condition_id string, replicate int, max_stat long, degenerate boolean")
    with pytest.raises(Exception, match="degenerate"):
        calibrate.refuse_degenerate(flat).collect()


def test_schema_drift_is_refused(spark):
    with pytest.raises(ValueError, match="drift"):
        source.assert_schema(spark.range(1))


def test_bins_cover_every_count(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 6, 7, 15, 16, 40, 41, 100, 101, 5000)], "n long")
    assert [r.b for r in df.select(recall.bin_label(F.col("n")).alias("b")).collect()] == ["1-2", "1-2", "3-6", "3-6", "7-15", "7-15", "16-40", "16-40", "41-100", "41-100", "101+", "101+"]
