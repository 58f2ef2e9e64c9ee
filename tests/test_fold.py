"""The literal fold on a long path."""

import time

from tideline.operators import walk


def test_fold_of_a_long_path_is_linear(spark):
    n = 30_000  # a list copied at every step took over a minute
    rows = spark.range(n).selectExpr("'c' AS condition_id", "'x' AS channel", "id AS bucket_index", "(id * 7919) % 2000003 - 1000000 AS z")
    start = time.time()
    got = walk.folded_walk(rows).selectExpr("count(*) AS n", "sum(w) AS s").collect()[0]
    assert time.time() - start < 30
    assert got == walk.reflected_walk(rows).selectExpr("count(*) AS n", "sum(w) AS s").collect()[0]
