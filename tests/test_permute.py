"""Permutation against enumeration, and multiplicity against the textbook."""

import itertools
import random

import pytest

from tideline.operators import multiple, permute

CELLS = {0: "AAB", 1: "CCDE"}


def slots(spark, cells=CELLS):
    rows, n = [], 0
    for b, wallets in cells.items():
        for w in wallets:
            rows.append(("w1", b, "NEW", f"w1|b{b}|NEW", n, w, 1 + n + 10 * b, 1 + n, 2 - n, 1 if n % 2 == 0 else -1))
            n += 1
    return spark.createDataFrame(rows, "window_id string, bucket_index long, profile string, cell_id string, slot_index long, active_wallet string, e long, dnc long, dfa long, sign long")


def exact():
    """Share of all arrangements in which a wallet's total reaches what was seen."""
    weights, n = {}, 0
    for b, wallets in CELLS.items():
        weights[b] = [1 + n + i + 10 * b for i in range(len(wallets))]
        n += len(wallets)
    arrangements = [sorted(set(itertools.permutations(w))) for w in CELLS.values()]
    total = lambda labels: {x: sum(v for b, lab in zip(CELLS, labels) for v, y in zip(weights[b], lab) if x == y) for x in "ABCDE"}
    seen = total([tuple(w) for w in CELLS.values()])
    draws = [total(labels) for labels in itertools.product(*arrangements)]
    assert len(draws) == 36
    return {x: sum(d[x] >= seen[x] for d in draws) / 36 for x in "ABCDE"}


@pytest.mark.parametrize("sampler, draws", [(permute.philox_counts, 4000), (permute.permuted_counts, 400)])
def test_shares_are_those_of_the_enumeration(spark, sampler, draws):
    out = {r.active_wallet: r for r in sampler(slots(spark), draws).collect()}
    for w, p in exact().items():
        n = out[w]["n_mag" if "n_mag" in out[w] else "n_e"]
        assert abs(n / draws - p) <= 4 * (max(p * (1 - p), 1e-9) / draws) ** 0.5 + 1e-9


def test_batches_change_nothing_and_stuck_wallets_have_p_one(spark):
    s = slots(spark, {0: "AA", 1: "BC"})
    a, b = (sorted(map(tuple, permute.philox_counts(s, 600, batch=n).collect())) for n in (512, 7))
    assert a == b
    stuck = next(r for r in permute.p_values(permute.permuted_counts(s, 50)).collect() if r.active_wallet == "A")
    assert stuck.p_mag == 1 and stuck.p_dir == 1 and stuck.sigma_mag is None
    chunked = permute.philox_counts(s, 600, chunks=3).collect()
    assert all(r.draws == 600 for r in chunked)


def test_holm_and_bh_equal_the_textbook(spark):
    rng = random.Random(3)
    rows = [(f, f"k{i:02d}", rng.choice([None, round(rng.random() ** 3, 4)])) for f in "ab" for i in range(25)]
    df = spark.createDataFrame(rows, "f string, k string, p double")
    out = {(r.f, r.k): r for r in multiple.benjamini_hochberg(multiple.holm(df, "p", "f", "k"), "p", "f", "k").collect()}
    for f in "ab":
        ps = sorted((p, k) for g, k, p in rows if g == f and p is not None)
        m, run = len(ps), 0.0
        for j, (p, k) in enumerate(ps):
            run = max(run, (m - j) * p)
            assert out[f, k].holm_p == pytest.approx(min(1, run))
        run = 1.0
        for j in range(m - 1, -1, -1):
            run = min(run, m * ps[j][0] / (j + 1))
            assert out[f, ps[j][1]].bh_q == pytest.approx(run)
    assert all(r.holm_p is None and r.bh_reject is None for r in out.values() if r.p is None)


def test_ties_at_the_cut_stay(spark):
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate([5, 4, 4, 4, 1])], "f string, i int, s int")
    assert multiple.top_with_ties(df, "s", "f", 2).count() == 4
