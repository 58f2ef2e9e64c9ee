"""Hand fixtures of the walk, its onset and its verdict."""

import pytest

from tideline.operators import walk
from tideline.operators.walk import UNIT, WalkConfig


def path(spark, z):
    return spark.createDataFrame([("c", "x", b, int(v * 1e6)) for b, v in enumerate(z)], "condition_id string, channel string, bucket_index long, z long")


def verdict(spark, z, h=4.0, **config):
    return walk.verdicts(walk.reflected_walk(path(spark, z), WalkConfig(**config)), h).collect()[0]


def test_recursion(spark):
    rows = walk.reflected_walk(path(spark, [2, 2, 2]), WalkConfig(deltas=(1.0,), two_sided=False)).orderBy("bucket_index").collect()
    assert [r.w / UNIT for r in rows] == [1.5, 3.0, 4.5]


@pytest.mark.parametrize(
    "z, h, config, alarm, direction, onset",
    [
        ([0] * 200, 4.0, {}, None, None, None),
        ([0] * 20 + [1] * 40, 4.0, {}, True, 1, 20),
        ([0] * 20 + [-1] * 40, 4.0, {}, True, -1, 20),
        ([0] * 20 + [-1] * 80, 4.0, {"two_sided": False}, None, None, None),
        ([0] * 5 + [2] * 3 + [-1] * 6 + [1] * 60, 6.0, {}, True, 1, 14),
        ([1] * 40, 4.0, {}, True, 1, 0),
    ],
)
def test_verdicts(spark, z, h, config, alarm, direction, onset):
    v = verdict(spark, z, h, **config)
    assert v.alarmed == bool(alarm) and v.direction == direction and v.onset_bucket == onset
    if alarm:
        assert v.onset_bucket <= v.onset_mle <= v.alarm_bucket


def test_no_monitoring_before_the_start(spark):
    v = verdict(spark, [0] * 10 + [3] * 20, 5.0, start=10)
    assert v.alarmed and v.onset_bucket >= 10


def test_fold_equals_the_closed_form(spark):
    import random

    rng = random.Random(1)
    p = path(spark, [round(rng.gauss(0, 1), 6) for _ in range(200)])
    keys = ["delta", "side", "bucket_index", "w"]
    a, b = (sorted(map(tuple, f(p).select(*keys).collect())) for f in (walk.reflected_walk, walk.folded_walk))
    assert a == b
