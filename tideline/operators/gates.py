"""Assertions as tables: (state, name, violations), all rules of a table in one pass.

A rule is the text of a condition that every row must meet; a row for which it is null fails. `planted` shows that a
gate sees what it is there for: the same rules over a copy of the table with chosen columns changed in chosen rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

Rules = dict[str, str]

LEGS = ("mag", "dir", "dnc", "dfa")

#: Gate 2: a window's slots are the trades of its buckets.
COUNTS: Rules = {"slots_fill_buckets": "n_slots = n_bucket_trades", "mle_within_wide": "n_mle <= n_wide AND n_mle > 0", "wallets_within_slots": "wallets_wide <= n_wide AND wallets_mle <= wallets_wide"}

#: Gate 3: contributions close by trade, and the ledger's shape by bucket.
LEDGER: Rules = {
    "trade_closes": "NOT in_mle OR abs(dfa - (dnc + agc)) <= 1e-9",
    "sign_is_sign": "NOT in_mle OR score_sign = CASE WHEN direction * signed > 0 THEN 1 WHEN direction * signed < 0 THEN -1 ELSE 0 END",
    "null_outside": "in_mle OR (dnc IS NULL AND agc IS NULL AND dfa IS NULL AND score_sign IS NULL AND score_vdw IS NULL)",
    "proportional": "NOT in_mle OR abs(dnc * total - unit * signed) <= 1e-6 * abs(unit * signed) + 1e-6",
}

#: Gate 4: what the decomposition divided by.
FAIL_CLOSED: Rules = {"not_imputed": "NOT imputed", "scale_sound": "NOT scale_degenerate AND sigma > 10000", "baseline_there": "x IS NOT NULL AND mu IS NOT NULL AND sigma IS NOT NULL AND z IS NOT NULL", "flow_there": "total > 0"}

#: Gate 6: p-values are on the grid of the draws.
P_VALUES: Rules = {
    **{f"p_{leg}_in_range": f"p_{leg} > 0 AND p_{leg} <= 1 AND n_{leg} >= 0 AND n_{leg} <= draws" for leg in LEGS},
    **{f"p_{leg}_on_grid": f"abs(p_{leg} - (n_{leg} + 1.0) / (draws + 1.0)) <= 1e-12" for leg in LEGS},
    **{f"stuck_{leg}_is_one": f"NOT no_movable_slots OR p_{leg} = 1" for leg in LEGS},
    "direction_floor_below_one": "log_floor <= 1e-9",
    "direction_floor_above_orbit": "log_floor + 1e-9 >= -log_orbit",
    "low_power_as_defined": "low_power = (n_fixed > 0.2 * n_slots)",
}

#: Gate 8: exact reach and reach on logarithms agree off the line; orbits bound.
RESOLUTION: Rules = {
    "orbit_at_least_one": "log_orbit >= -1e-9",
    "log_agrees": "NOT eligible OR tie OR reachable = (log_orbit + ln(0.025 / m_confirmatory) >= 0)",
    "screening_not_easier": "NOT eligible OR NOT screening_reachable OR reachable",
    "outside_has_no_flag": "eligible OR (reachable IS NULL AND tie IS NULL)",
    "family_counts": "m_screening = n_family AND m_confirmatory = n_eligible",
}

#: Gate 9: only eligible wallets reach Holm, both headline legs alone promote.
MULTIPLICITY: Rules = {
    **{f"holm_{leg}_for_eligible": f"eligible = (holm_{leg}_p IS NOT NULL) AND eligible = (holm_{leg}_rank IS NOT NULL) AND eligible = (holm_{leg}_threshold IS NOT NULL)" for leg in LEGS},
    **{f"holm_{leg}_rejects_at_level": f"NOT eligible OR holm_{leg}_reject = (holm_{leg}_p <= alpha_{leg})" for leg in LEGS},
    **{f"holm_{leg}_ranks_permute": f"NOT eligible OR (distinct_{leg} = n_eligible AND most_{leg} = n_eligible)" for leg in LEGS},
    "screen_for_all": "screen_mag_q IS NOT NULL AND screen_dir_q IS NOT NULL",
    "headline_is_union": "headline_reject = (coalesce(holm_mag_reject, false) OR coalesce(holm_dir_reject, false))",
    "leg_named": "leg_that_rejected = CASE WHEN coalesce(holm_mag_reject, false) AND coalesce(holm_dir_reject, false) THEN 'both' WHEN coalesce(holm_mag_reject, false) THEN 'mag' WHEN coalesce(holm_dir_reject, false) THEN 'dir' ELSE 'none' END",
}

#: The delivered table: exclusive tiers, and what may lift a pair into them.
STATUSES: Rules = {
    "known_tier": "status IS NULL OR status IN ('confirmed_repeat_active', 'review_queue', 'bh_review_screen', 'top10_descriptive')",
    "headline_needs_a_leg": "coalesce(status, '') <> 'confirmed_repeat_active' OR headline_reject",
    "queue_is_held_back": "(coalesce(status, '') = 'review_queue') = (coalesce(holm_mag_reject, false) AND NOT passes_t_star AND NOT coalesce(holm_dir_reject, false))",
    "tie_flag_in_its_tier": "NOT tied_into_top OR status = 'top10_descriptive'",
}

#: Timing is causal.
TIMING: Rules = {
    "first_before_alarm": "first_ts <= alarm_ts",
    "lead_not_negative": "seconds_to_alarm >= 0",
    "seen_by_alarm": "first_seen_ts IS NOT NULL AND first_seen_ts <= first_ts",
    "aligned_not_before_first": "first_aligned_ts IS NULL OR first_aligned_ts >= first_ts",
    "history_before_window": "history_ts IS NULL OR history_ts <= first_ts",
    "history_is_first_seen": "n_before = 0 OR history_ts = first_seen_ts",
}

#: Wallet rows: context wallets have no sums, ranks are a permutation, profiles follow their rule.
WALLETS: Rules = {
    "context_has_no_sums": "n_mle > 0 OR (e_mle IS NULL AND dnc IS NULL AND dfa IS NULL AND rank_e_mle IS NULL)",
    "rank_in_family": "n_mle = 0 OR (rank_e_mle >= 1 AND rank_e_mle <= n_roster AND distinct_ranks = n_roster)",
    "new_means_no_history": "(profile = 'NEW') = (n_before = 0)",
    "counts_within": "n_mle <= n_wide AND n_wide >= 1",
}

#: Gate 10: one build, and every digest as it was recorded.
PROVENANCE: Rules = {"one_build": "n_builds = 1", "digest_as_recorded": "digest = recorded"}


def checked(df: DataFrame, rules: Rules, state: str = "sound") -> DataFrame:
    """How many rows fail each rule."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in rules.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return counts.select(F.lit(state).alias("state"), F.expr(f"stack({len(rules)}, {pairs}) AS (name, violations)"))


def planted(df: DataFrame, rules: Rules, where: str, changes: dict[str, str]) -> DataFrame:
    """The rules over the table as it is, and over it with the columns in `changes` set anew in rows that meet `where`."""
    told = df.withColumns({c: F.when(F.expr(where), F.expr(text).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, text in changes.items()})
    return checked(df, rules).unionByName(checked(told, rules, "planted"))


def gate_sql(table: str, rules: Rules, where: str, changes: dict[str, str]) -> str:
    """The same counts as DuckDB text."""
    told = f"(SELECT * REPLACE ({', '.join(f'CASE WHEN {where} THEN {text} ELSE {c} END AS {c}' for c, text in changes.items())}) FROM {table})"
    rows = [f"SELECT '{state}' AS state, '{name}' AS name, CAST(coalesce(sum(CASE WHEN coalesce({rule}, false) THEN 0 ELSE 1 END), 0) AS BIGINT) AS violations FROM {source} q" for state, source in (("sound", table), ("planted", told)) for name, rule in rules.items()]
    return " UNION ALL ".join(rows)


def untestable(path: DataFrame) -> DataFrame:
    """(window_id, reason): why a window's narrow part can't be attributed, null where it can; the first reason that holds."""
    inside = path.where("in_mle").groupBy("window_id").agg(
        F.bool_or("imputed").alias("imputed"), F.bool_or("scale_degenerate").alias("degenerate"), F.bool_or(F.col("x").isNull() | F.col("mu").isNull() | F.col("sigma").isNull() | F.col("z").isNull()).alias("missing")
    )
    return inside.select("window_id", F.when(F.col("imputed"), "imputed_bucket_in_mle").when(F.col("degenerate"), "scale_at_floor_in_mle").when(F.col("missing"), "no_baseline_in_mle").alias("reason"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, counted; none where they are equal."""
    one, other = a.exceptAll(b), b.exceptAll(a)
    return one.select(F.lit("first_only").alias("side")).unionByName(other.select(F.lit("second_only").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
