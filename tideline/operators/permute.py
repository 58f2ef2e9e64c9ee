"""Label permutation within cells: cells and seeds, orbits, and two samplers."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.expr import joined_key, log_choose, seed_of
from .attribute import PROFILES, WINDOW

CELL = (WINDOW, "bucket_index", "profile")
MOST_LABELS = 4_000_000  # slots times draws that a worker holds at once


def labelled(ledgered: DataFrame, profiled: DataFrame) -> DataFrame:
    """Slots of the narrow windows with their wallet's profile: what is permuted. Weights are on the grid."""
    rows = ledgered.where("in_mle").join(profiled.select(WINDOW, "active_wallet", "profile"), [WINDOW, "active_wallet"], "left")
    rows = rows.withColumn("profile", F.when(F.col("profile").isNull(), F.raise_error(F.lit("a slot has no profile"))).otherwise(F.col("profile")))
    grid = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(c)
    cell = F.concat(F.col(WINDOW), F.lit("|b"), F.col("bucket_index").cast("string"), F.lit("|"), F.col("profile"))
    return rows.select(WINDOW, "condition_id", "bucket_index", "profile", cell.alias("cell_id"), F.col("slot_index").cast("long").alias("slot_index"), "active_wallet", (F.col("direction") * F.col("signed")).alias("e"), grid("dnc"), grid("dfa"), F.col("score_sign").alias("sign"))


def cells(slots: DataFrame, seed_base: int = 2026) -> DataFrame:
    """One row a cell: slots, wallets, whether labels can move, and the seed of its own stream."""
    grouped = slots.groupBy("cell_id", *CELL).agg(F.count(F.lit(1)).alias("n_slots"), F.countDistinct("active_wallet").alias("n_wallets"))
    return grouped.withColumn("movable", F.col("n_wallets") > 1).withColumn("cell_seed", seed_of(joined_key(str(seed_base), F.col(WINDOW), F.col("cell_id"))))


def fixed_share(slots: DataFrame, limit: float = 0.2) -> DataFrame:
    """Share of a wallet's slots in cells it has to itself; above the limit its test has little power."""
    told = slots.join(cells(slots).select("cell_id", "movable"), "cell_id")
    rows = told.groupBy(WINDOW, "active_wallet").agg(F.count(F.lit(1)).alias("n_slots"), F.count_if(~F.col("movable")).alias("n_fixed"))
    return rows.withColumn("low_power", F.col("n_fixed") > limit * F.col("n_slots")).withColumn("no_movable_slots", F.col("n_fixed") == F.col("n_slots"))


def _held(slots: DataFrame) -> DataFrame:
    """Slots of each wallet (k) and of all (m) by cell."""
    held = slots.groupBy("cell_id", WINDOW, "active_wallet").agg(F.count(F.lit(1)).alias("k"))
    sizes = held.groupBy("cell_id").agg(F.sum("k").alias("m"))
    return held.join(sizes, "cell_id")


def orbits(slots: DataFrame) -> DataFrame:
    """Log size of each wallet's orbit: the sum over its cells of ln C(slots of the cell, slots of the wallet)."""
    return _held(slots).groupBy(WINDOW, "active_wallet").agg(F.sum("k").alias("n_slots"), F.sum(log_choose(F.col("m"), F.col("k"))).alias("log_orbit"))


def _pairs(slots: DataFrame) -> DataFrame:
    return _held(slots).groupBy(WINDOW, "active_wallet").agg(F.sum("k").alias("n_slots"), F.collect_list(F.struct("m", "k")).alias("pairs"))


def orbit_size(pairs) -> int:
    return math.prod(math.comb(p["m"], p["k"]) for p in pairs)


def exact_orbits(slots: DataFrame) -> DataFrame:
    """Orbit sizes as exact whole numbers in text; they pass any fixed-width number."""

    @F.pandas_udf(T.StringType())
    def product(pairs: pd.Series) -> pd.Series:
        return pairs.map(lambda x: str(orbit_size(x)))

    return _pairs(slots).select(WINDOW, "active_wallet", product("pairs").alias("orbit"))


def exact_families(slots: DataFrame, least: int = 3, alpha: Fraction = Fraction(1, 40)) -> DataFrame:
    """Eligibility, family sizes, and on exact fractions whether an orbit's floor reaches the first Holm step of the
    screening family and, for eligible wallets, of the confirmatory one (1 / orbit <= alpha / m), or lies right on it."""
    by = Window.partitionBy(WINDOW)
    told = _pairs(slots).withColumn("eligible", F.col("n_slots") >= least).withColumn("m_screening", F.count(F.lit(1)).over(by)).withColumn("m_confirmatory", F.count_if("eligible").over(by))

    @F.pandas_udf("reaches boolean, ties boolean")
    def judged(pairs: pd.Series, m: pd.Series) -> pd.DataFrame:
        room = [orbit_size(x) * alpha / int(n) if n else Fraction(0) for x, n in zip(pairs, m)]
        return pd.DataFrame({"reaches": [r >= 1 for r in room], "ties": [r == 1 for r in room]})

    told = told.withColumn("s", judged("pairs", "m_screening")).withColumn("c", judged("pairs", "m_confirmatory"))
    own = lambda c: F.when(F.col("eligible"), F.col(c))
    return told.select(WINDOW, "active_wallet", "n_slots", "eligible", "m_screening", "m_confirmatory", F.col("s.reaches").alias("screening_reachable"), F.col("s.ties").alias("screening_tie"), own("c.reaches").alias("reachable"), own("c.ties").alias("tie"))


def family_report(familied: DataFrame) -> DataFrame:
    """One row a family: sizes, first thresholds, and how many reach them or tie."""
    return familied.groupBy(WINDOW).agg(
        F.first("m_screening").alias("m_screening"),
        F.first("m_confirmatory").alias("m_confirmatory"),
        F.count_if("screening_reachable").alias("reach_screening"),
        F.count_if("reachable").alias("reach_confirmatory"),
        F.count_if("screening_tie").alias("ties_screening"),
        F.count_if("tie").alias("ties_confirmatory"),
    )


def resolution_by_size(orbited: DataFrame, alpha: float = 0.025, most: int = 6) -> DataFrame:
    """By family and slots of a wallet, `most` and more together: pairs, how many are eligible and reach, median log orbit."""
    told = families(orbited, alpha=alpha).withColumn("slots", F.least(F.col("n_slots"), F.lit(most)).cast("long"))
    return told.groupBy(WINDOW, "slots").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("eligible").alias("eligible"), F.count_if("reachable").alias("reachable"), F.percentile("log_orbit", 0.5).alias("median_log_orbit"))


def families(orbited: DataFrame, least: int = 3, alpha: float = 0.05) -> DataFrame:
    """Eligibility, family sizes and whether the first Holm step can be reached: orbit * alpha / m >= 1, on logarithms."""
    by = Window.partitionBy(WINDOW)
    told = orbited.withColumn("eligible", F.col("n_slots") >= least).withColumn("m_screening", F.count(F.lit(1)).over(by)).withColumn("m_confirmatory", F.count_if("eligible").over(by))
    return told.withColumn("reachable", F.when(F.col("eligible"), F.col("log_orbit") + F.log(F.lit(alpha) / F.col("m_confirmatory")) >= -1e-9))


def holm_walk_limit(orbited: DataFrame, alpha: float = 0.05) -> DataFrame:
    """How many steps Holm could take were every p at its floor: members by orbit downwards, up to the first that cannot reach its step."""
    f = families(orbited).where("eligible")
    place = F.row_number().over(Window.partitionBy(WINDOW).orderBy(F.desc(F.floor(F.col("log_orbit") * 1e6 + 0.5)), "active_wallet"))
    told = f.withColumn("step", place).withColumn("fails", F.col("log_orbit") + F.log(F.lit(alpha) / (F.col("m_confirmatory") - F.col("step") + 1)) < -1e-9)
    return told.groupBy(WINDOW).agg(F.coalesce(F.min(F.when(F.col("fails"), F.col("step"))) - 1, F.count(F.lit(1))).cast("long").alias("max_steps"), F.count(F.lit(1)).alias("m"))


def direction_floor(slots: DataFrame) -> DataFrame:
    """Log of the chance that a wallet draws the largest sum of signs its cells allow.

    In a cell with a plus, b zero and c minus signs, a wallet of k slots takes the best first: t = min(k, a) plus, then
    zeros, then minus; the draws that do so number C(a, t) C(b, u) C(c, v) of C(m, k).
    """
    held = slots.groupBy("cell_id", WINDOW, "active_wallet").agg(F.count(F.lit(1)).alias("k"))
    sizes = slots.groupBy("cell_id").agg(F.count_if(F.col("sign") > 0).alias("a"), F.count_if(F.col("sign") == 0).alias("b"), F.count_if(F.col("sign") < 0).alias("c"), F.count(F.lit(1)).alias("m"))
    rows = held.join(sizes, "cell_id").withColumn("t", F.least("k", "a")).withColumn("u", F.least(F.col("k") - F.col("t"), F.col("b"))).withColumn("v", F.col("k") - F.col("t") - F.col("u"))
    choose = lambda n, k: log_choose(F.col(n), F.col(k))
    return rows.withColumn("part", choose("a", "t") + choose("b", "u") + choose("c", "v") - choose("m", "k")).groupBy(WINDOW, "active_wallet").agg(F.sum("part").alias("log_floor"))


WEIGHTS = {"mag": "e", "dir": "sign", "dnc": "dnc", "dfa": "dfa"}


def permuted_counts(slots: DataFrame, draws: int = 20, seed: int = 2026) -> DataFrame:
    """Exceedances by hashed keys, in SQL alone: in each draw labels go to the slots of their cell by the order of a digest.

    Counts by leg how often a wallet's total reaches what was seen, and in n_mirror how often its size stays at or
    below it. Totals are sums of whole numbers, so ties count exactly. Draws are rows: for many draws take
    `philox_counts`.
    """
    key = F.sha2(joined_key(str(seed), F.col("cell_id"), F.col("draw").cast("string"), F.col("slot_index").cast("string")).cast("binary"), 256)
    drawn = slots.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("key", key)
    cell = Window.partitionBy("cell_id", "draw")
    labels = drawn.select("cell_id", "draw", "active_wallet", F.row_number().over(cell.orderBy("key", "slot_index")).alias("place"))
    weights = drawn.select("cell_id", "draw", WINDOW, *WEIGHTS.values(), F.row_number().over(cell.orderBy("slot_index")).alias("place"))
    totals = labels.join(weights, ["cell_id", "draw", "place"]).groupBy(WINDOW, "draw", "active_wallet").agg(*[F.sum(w).alias(w) for w in WEIGHTS.values()])
    seen = slots.groupBy(WINDOW, "active_wallet").agg(*[F.sum(w).alias(f"{w}_seen") for w in WEIGHTS.values()])
    reached = [F.count_if(F.col(w) >= F.col(f"{w}_seen")).alias(f"n_{leg}") for leg, w in WEIGHTS.items()]
    mirror = F.count_if(F.col("e") <= F.col("e_seen")).alias("n_mirror")
    return totals.join(seen, [WINDOW, "active_wallet"]).groupBy(WINDOW, "active_wallet").agg(*reached, mirror, F.count(F.lit(1)).alias("draws"))


def philox_counts(slots: DataFrame, draws: int = 2000, seed_base: int = 2026, batch: int = 512, chunks: int = 1) -> DataFrame:
    """Exceedances by NumPy's Philox streams, one a cell (and chunk of draws), for four weights on the same draws.

    A window and chunk is one task, so a large window's draws spread over `chunks` tasks whose counts add up. Counts
    don't depend on `batch`; they do on `chunks`, which enters the seeds when there are several.
    """
    order = {p: i for i, p in enumerate(PROFILES)}
    weights = ("e", "sign", "dnc", "dfa")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_p=pdf["profile"].map(order)).sort_values(["bucket_index", "_p", "slot_index"])
        names, wallet = np.unique(pdf["active_wallet"].to_numpy(str), return_inverse=True)
        values = [pdf[w].to_numpy(np.int64) for w in weights]
        chunk = int(pdf["chunk"].iloc[0])
        mine = len(range(chunk, draws, chunks))
        ids = pdf["cell_id"].to_numpy(str)
        edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
        moving = [(a, b) for a, b in zip(edges[:-1], edges[1:]) if (wallet[a:b] != wallet[a]).any()]
        counts = np.full((len(weights), len(names)), mine, np.int64)  # what stays in every draw is reached in every draw
        slots_ = np.concatenate([np.arange(a, b) for a, b in moving]) if moving else np.zeros(0, np.int64)
        movers, wallet = np.unique(wallet[slots_], return_inverse=True)
        values = [v[slots_] for v in values]
        seen = [np.bincount(wallet, v, len(movers)).astype(np.int64) for v in values]
        streams, at = [], 0
        for a, b in moving:
            text = f"{seed_base}|{pdf[WINDOW].iloc[0]}|{ids[a]}" + (f"|c{chunk}" if chunks > 1 else "")
            streams.append((at, at + b - a, np.random.Generator(np.random.Philox(int(hashlib.sha256(text.encode()).hexdigest()[:16], 16)))))
            at += b - a
        counts[:, movers] = 0
        tiled = [np.tile(v.astype(np.float64), min(batch, mine, max(1, MOST_LABELS // max(1, len(wallet))))) for v in values]
        step = max(1, min(batch, MOST_LABELS // max(1, len(wallet))))  # draws at a time, so that a large window's labels fit
        for start in range(0, mine if moving else 0, step):
            n = min(step, mine - start)
            labels = np.tile(wallet, (n, 1))
            for a, b, stream in streams:
                labels[:, a:b] = stream.permuted(labels[:, a:b], axis=1)
            flat = (labels + np.arange(n)[:, None] * len(movers)).ravel()
            for k, v in enumerate(tiled):
                totals = np.bincount(flat, v[: len(flat)], n * len(movers)).reshape(n, len(movers))
                counts[k, movers] += (totals >= seen[k]).sum(axis=0)
        return pd.DataFrame({WINDOW: pdf[WINDOW].iloc[0], "active_wallet": names, **{f"n_{w}": c for w, c in zip(weights, counts)}, "draws": mine})

    spread = slots.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    if chunks > 1:  # draws cost far more than rows: by size alone the chunks would be put together again
        spread = spread.repartition(chunks, WINDOW, "chunk")
    parts = spread.groupBy(WINDOW, "chunk").applyInPandas(run, f"{WINDOW} string, active_wallet string, n_e long, n_sign long, n_dnc long, n_dfa long, draws long")
    return parts.groupBy(WINDOW, "active_wallet").agg(*[F.sum(c).alias(c) for c in ("n_e", "n_sign", "n_dnc", "n_dfa", "draws")])


def p_values(counts: DataFrame) -> DataFrame:
    """Plus-one p-values, never 0, and their distance from 0.025 in Monte Carlo standard errors; none where p is 1."""
    p = lambda c: (F.col(c) + 1) / (F.col("draws") + 1)
    told = counts.withColumns({f"p_{leg}": p(f"n_{leg}") for leg in ("mag", "dir", "dnc", "dfa", "mirror") if f"n_{leg}" in counts.columns})
    sigma = lambda c: F.when(F.col(c) < 1, F.abs(F.col(c) - 0.025) / F.sqrt(F.col(c) * (1 - F.col(c)) / F.col("draws")))
    return told.withColumn("sigma_mag", sigma("p_mag")).withColumn("sigma_dir", sigma("p_dir")).withColumn("review", F.coalesce(F.least("sigma_mag", "sigma_dir") < 3, F.lit(False)))


def distances(decided: DataFrame, least: float = 3.0) -> DataFrame:
    """Signed distance of p from the threshold its Holm step used, in Monte Carlo standard errors, for members of the family.

    At p = 1 no Monte Carlo error is left, so the distance is infinite. review: a leg within `least`; null for others.
    """

    def sigma(leg: str):
        p = F.col(f"p_{leg}")
        error = F.sqrt(p * (1 - p) / F.col("draws"))
        return F.when(F.col(f"holm_{leg}_threshold").isNotNull(), F.when(error > 0, (p - F.col(f"holm_{leg}_threshold")) / error).otherwise(F.lit(float("inf"))))

    told = decided.withColumn("sigma_mag", sigma("mag")).withColumn("sigma_dir", sigma("dir"))
    return told.withColumn("review", F.least(F.abs("sigma_mag"), F.abs("sigma_dir")) < least)
