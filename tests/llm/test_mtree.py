import math

import numpy as np
import pytest

from tideline.llm import mtree
from tideline.llm.queries import ORACLE_SQL, op7_exact_top_k


def brute(ids, data, q, k, own):
    scores = [(int(sum(int(a) * int(b) for a, b in zip(v, q))), int(i)) for i, v in zip(ids, data) if i != own]
    return sorted(scores, key=lambda s: (-s[0], s[1]))[:k]


@pytest.mark.parametrize("spread", [3, 400])
def test_tree_equals_brute_force(spread):
    rng = np.random.default_rng(spread)
    data = rng.integers(-spread, spread + 1, (900, 6))
    data[100:260] = data[0]  # ties and repeated rows
    ids = rng.permutation(900)
    tree = mtree.MTree(ids, data, page=16)
    for i in range(0, 900, 60):
        assert tree.search(data[i], 10, int(ids[i])) == brute(ids, data, data[i], 10, ids[i])


def test_stored_bounds_spare_computations():
    rng = np.random.default_rng(0)
    centers = rng.integers(-1000, 1000, (40, 4))
    data = np.repeat(centers, 50, axis=0) + rng.integers(-5, 6, (2000, 4))
    tree = mtree.MTree(np.arange(2000), data)
    for i in range(0, 2000, 100):
        tree.search(data[i], 10, i)
    assert tree.computed < 20 * 2000 * 0.7


def test_all_equal_and_single_rows():
    tree = mtree.MTree(np.arange(500), np.ones((500, 3), dtype=np.int64))
    assert tree.search(np.ones(3, dtype=np.int64), 3, 0) == [(3, 1), (3, 2), (3, 3)]
    assert mtree.MTree(np.array([7]), np.ones((1, 2), dtype=np.int64)).search(np.ones(2, dtype=np.int64), 3, 7) == []


def test_query_equals_sql(spark, sf_dir, oracle, rows):
    assert rows(op7_exact_top_k(spark, sf_dir)) == oracle(ORACLE_SQL["op7_exact_top_k"])


def test_unusable_vectors_repeats_and_both_ways_to_meet(spark, monkeypatch):
    data = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (None, [1.0, 1.0]), (6, [-1.0]), (100, [0.25, 0.0]), (7, []), (8, [1e30, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<float>, rank int")
    vectors = mtree.quantized(df)
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in data if i is not None and i not in (1, 2, 3, 4, 8)]
    want = []
    for i, v in usable:
        if i % 100 == 0:
            want += [(i, n + 1, vec, s) for n, (s, vec) in enumerate(brute([a for a, _ in usable], [b for _, b in usable], v, 10, i))]
    for limit in (mtree.BROADCAST_BYTES, -1):
        monkeypatch.setattr(mtree, "BROADCAST_BYTES", limit)
        assert sorted(map(tuple, mtree.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect())) == sorted(want)
    assert mtree.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_large_components_count_exactly_and_overflow_is_told(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(300)] + [(400, [20000.0, -3e4, 16384.0]), (500, [1.0, 2e5, -1e12]), (501, [-3e5, 4e4, 7.5]), (502, [1e6, 1e6 + 0.5, 1.0])]
    vectors = mtree.quantized(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    plain = [(i, [math.floor(1024 * x) for x in v]) for i, v in data]
    got = {}
    for row in mtree.top_k(vectors, vectors.where("vec_id % 100 = 0")).orderBy("rank").collect():
        got.setdefault(row.query_id, []).append((row.score, row.vec_id))
    assert got == {i: brute([a for a, _ in plain], [b for _, b in plain], v, 10, i) for i, v in plain if i % 100 == 0}
    twice = mtree.quantized(spark.createDataFrame([(0, [4e9]), (1, [4e9])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="does not fit a long"):
        mtree.top_k(twice, twice).collect()
    data = np.array([[1 << 62, 1], [1 << 62, 2], [-(1 << 62), 5], [3, 1 << 40]])
    assert mtree.MTree(np.arange(4), data).search(data[0], 3, 9) == brute(range(4), data, data[0], 3, 9)
