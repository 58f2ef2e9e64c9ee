"""Bootstraps of paths: rows, maxima without rows, and that neither is held in one place."""

import random

from tideline.operators import calibrate, walk


def paths(spark, sizes, first=0):
    rng = random.Random(5)
    rows = [(f"c{k}", "x", first + b, round(rng.gauss(0.3, 1) * 1e6)) for k, n in enumerate(sizes) for b in range(n)]
    return spark.createDataFrame(rows, "condition_id string, channel string, bucket_index long, z long")


def drawn(path, replicates, block):
    import hashlib

    out = {}
    for c in {c for c, _ in path}:
        z = [v for (k, _), v in sorted(path.items()) if k == c]
        for r in range(replicates):
            begin = lambda b: int(hashlib.sha256(f"{c}|{r}|{b}".encode()).hexdigest()[:7], 16)
            for p in range(len(z)):
                out[c, r, p] = z[(begin(p // block) + p % block) % len(z)]
    return out


def test_blocks_wrap_around_and_paths_may_be_shorter_than_one(spark):
    p = paths(spark, (3, 10, 47), first=2)
    want = drawn({(r.condition_id, r.bucket_index): r.z for r in p.collect()}, 4, 10)
    assert {tuple(r)[:3]: r.z for r in calibrate.block_bootstrap(p, 4, 10).collect()} == want
    assert calibrate.block_bootstrap(p, 4, 10).count() == len(want)


def test_drawn_blocks_are_not_broadcast(spark):
    plan = calibrate.block_bootstrap(paths(spark, (3, 47)), 500, 10)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan  # starts and values both grow; the one row a contract may be broadcast
    assert plan.count("BroadcastHashJoin") <= 1


def test_maxima_equal_those_of_the_rows(spark):
    p = paths(spark, (3, 25, 101))
    for config in (walk.WalkConfig(start=0), walk.WalkConfig(start=7), walk.WalkConfig(deltas=(0.75,), two_sided=False)):
        slow = calibrate.largest_statistics(calibrate.block_bootstrap(p, 6, 10), config)
        fast = calibrate.bootstrap_maxima(p, config, 6, 10, chunks=4)
        key = lambda df: {(r.condition_id, r.replicate): r.max_stat for r in df.collect()}
        assert key(slow) == key(fast)
    flat = spark.createDataFrame([("f", "x", b, 5) for b in range(12)], "condition_id string, channel string, bucket_index long, z long")
    assert all(r.degenerate for r in calibrate.bootstrap_maxima(flat, walk.WalkConfig(), 3, 10).collect())


def test_sums_beyond_a_long_do_not_wrap(spark):
    huge = spark.createDataFrame([("h", "x", b, (-1) ** b * 2_000_000_000_000_000_000) for b in range(30)], "condition_id string, channel string, bucket_index long, z long")
    got = calibrate.bootstrap_maxima(huge, walk.WalkConfig(deltas=(0.25,)), 2, 1).collect
    try:
        assert all(0 <= r.max_stat < 1 << 63 for r in got())
    except Exception as e:
        assert "fit a long" in str(e)
