"""The streamed detector against the batch walk: equal on whole buckets, whatever the micro-batches."""

import pandas as pd
import pytest

from pyspark.sql import functions as F

from tideline.operators import walk
from tideline.plans import detection as d
from tideline.plans import studies
from tideline.streaming import detector


def test_streamed_statistics_equal_the_batch(spark):
    sf = "/root/testdata/sf0.01"
    streamed = {(r.condition_id, r.bucket_index): (r.x, r.z, r.statistic, r.direction) for r in studies.stream_cusum(spark, sf).collect()}
    rows = d.standard(spark, sf).where("channel = 'imbalance'")
    stats = walk.statistics(walk.reflected_walk(rows, d.CONFIG)).join(rows, ["condition_id", "channel", "bucket_index"])
    full = d.bucketed(spark, sf).groupBy("condition_id", "bucket_index").agg(F.count(F.lit(1)).alias("n")).where(f"n = {d.SIZE}")
    batch = {(r.condition_id, r.bucket_index): (r.x, r.z, r.statistic, r.direction) for r in stats.join(full, ["condition_id", "bucket_index"]).collect()}
    assert len(batch) > 300 and streamed == batch


def test_streamed_vwap_is_part_of_the_batch(spark, sf_dir):
    batch = set(map(tuple, studies.vwap_6h(spark, sf_dir).collect()))
    streamed = list(map(tuple, studies.stream_vwap(spark, sf_dir).collect()))
    assert streamed and set(streamed) <= batch


class Kept:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def fed(rows, cuts, **parameters):
    run, state, out = detector.detector(size=4, head=3, **parameters), Kept(), []
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        frame = pd.DataFrame(rows[a:b], columns=["timestamp", "transaction_hash", "signed"])
        out += [tuple(r) for f in run(("c",), iter([frame]), state) for r in f.itertuples(index=False)]
    return out


@pytest.mark.parametrize("parameters", [{}, {"trailing": (5, 3)}])
def test_micro_batches_change_nothing_and_only_the_first_alarm_is_first(parameters):
    rows = [(i, f"h{i:04d}", (1 if i % 3 else -1) * (5 + i % 7) if i < 40 else 9) for i in range(100)]
    whole = fed(rows, [], **parameters)
    assert whole == fed(rows, [7, 13, 14, 50], **parameters) == fed(rows, list(range(1, 100, 9)), **parameters)
    alarms = [r for r in whole if r[8]]
    assert len(alarms) > 1 and [r[9] for r in alarms] == [True] + [False] * (len(alarms) - 1)
    assert all(r[7] <= r[1] for r in whole)


def test_late_trades_are_counted_and_enter_no_bucket():
    rows = [(i, f"h{i:04d}", 3 if i % 2 else -2) for i in range(48)]
    late = [*rows[:40], (2, "late1", 500), (3, "late2", 500), *rows[40:]]
    a, b = fed(rows, [40]), fed(late, [40])
    assert [r[:10] for r in a] == [r[:10] for r in b] and b[-1][10] == 2 and a[-1][10] == 0
