"""Permutation tests, multiplicity and the delivered table over the imbalance windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import micro
from ..operators import attribute, multiple, permute
from . import attribution as a
from . import detection as d
from .sql import grid, part, query

DRAWS = 20


@d.shared
def labelled(spark, sf_dir):
    return permute.labelled(a.ledgered(spark, sf_dir), a.profiled(spark, sf_dir))


@d.shared
def tested(spark, sf_dir):
    return permute.p_values(permute.permuted_counts(labelled(spark, sf_dir), DRAWS))


LEVELS = {"alpha_leg": 0.2, "alpha": 0.4, "bh_q": 0.25, "t_star": 0.06}  # what 20 draws can reach; `full` has the reference's


@d.shared
def decided(spark, sf_dir):
    """Holm at half alpha on the two headline legs of wallets with three trades and more, the screen over all."""
    return multiple.decide(labelled(spark, sf_dir), tested(spark, sf_dir), **LEVELS)


def cells(spark, sf_dir):
    return permute.cells(labelled(spark, sf_dir)).select("cell_id", "window_id", "bucket_index", "profile", "n_slots", "n_wallets", "movable")


def cell_seeds(spark, sf_dir):
    return permute.cells(labelled(spark, sf_dir)).select("cell_id", F.col("cell_seed").cast("string").alias("cell_seed"))


def fixed_slot_share(spark, sf_dir):
    return permute.fixed_share(labelled(spark, sf_dir))


def orbit_log(spark, sf_dir):
    return permute.orbits(labelled(spark, sf_dir)).select("window_id", "active_wallet", "n_slots", micro(F.col("log_orbit")).alias("log_orbit"))


def orbit_exact(spark, sf_dir):
    return permute.exact_orbits(labelled(spark, sf_dir))


def family_sizes(spark, sf_dir):
    return permute.families(permute.orbits(labelled(spark, sf_dir))).select("window_id", "m_screening", "m_confirmatory").distinct()


def reachability(spark, sf_dir):
    return permute.families(permute.orbits(labelled(spark, sf_dir))).select("window_id", "active_wallet", "eligible", "reachable")


def holm_walk_limit(spark, sf_dir):
    return permute.holm_walk_limit(permute.orbits(labelled(spark, sf_dir)))


def direction_floor(spark, sf_dir):
    return permute.direction_floor(labelled(spark, sf_dir)).select("window_id", "active_wallet", micro(F.col("log_floor")).alias("log_floor"))


def permute_sql(spark, sf_dir):
    return permute.permuted_counts(labelled(spark, sf_dir), DRAWS)


def permute_philox(spark, sf_dir):
    return permute.philox_counts(labelled(spark, sf_dir), 2000)


def permute_philox_chunks(spark, sf_dir):
    return permute.philox_counts(labelled(spark, sf_dir), 2000, chunks=4)


def p_values(spark, sf_dir):
    return tested(spark, sf_dir).select("window_id", "active_wallet", "n_mag", "n_dir", micro(F.col("p_mag")).alias("p_mag"), micro(F.col("p_dir")).alias("p_dir"))


def mc_sigma(spark, sf_dir):
    return tested(spark, sf_dir).select("window_id", "active_wallet", micro(F.col("sigma_mag")).alias("sigma_mag"), micro(F.col("sigma_dir")).alias("sigma_dir"), "review")


def second_seed(spark, sf_dir):
    """Flagged windows drawn again with the next seed."""
    flagged = tested(spark, sf_dir).where("review").select("window_id").distinct()
    return permute.permuted_counts(labelled(spark, sf_dir).join(flagged, "window_id", "left_semi"), DRAWS, 2027)


def holm(spark, sf_dir):
    return decided(spark, sf_dir).select("window_id", "active_wallet", "eligible", micro(F.col("holm_mag_p")).alias("holm_mag_p"), "holm_mag_reject", micro(F.col("holm_dir_p")).alias("holm_dir_p"), "holm_dir_reject")


def bh(spark, sf_dir):
    return decided(spark, sf_dir).select("window_id", "active_wallet", *[micro(F.col(f"screen_{leg}_q")).alias(f"screen_{leg}_q") for leg in multiple.HEADLINE], "screen_reject")


def headline_union(spark, sf_dir):
    return decided(spark, sf_dir).select("window_id", "active_wallet", "headline_reject", "leg_that_rejected")


def top_n_ties(spark, sf_dir):
    return decided(spark, sf_dir).where("top10").select("window_id", "active_wallet", "e")


def status_ladder(spark, sf_dir):
    return decided(spark, sf_dir).select("window_id", "active_wallet", "status")


def two_layer(spark, sf_dir):
    layer = F.when(F.col("headline_reject"), F.concat(F.lit("validated_"), "leg_that_rejected")).when(F.col("screen_reject"), "screening").otherwise("none")
    return decided(spark, sf_dir).groupBy("window_id", layer.alias("layer")).agg(F.count(F.lit(1)).alias("n"))


def leg_agreement(spark, sf_dir):
    return decided(spark, sf_dir).where("eligible").groupBy(F.col("holm_mag_reject").alias("mag"), F.col("holm_dir_reject").alias("dir")).agg(F.count(F.lit(1)).alias("n"))


def timing(spark, sf_dir):
    """First trade and first aligned trade of each wallet in the narrow window, the alarm's availability, seconds to it."""
    s = a.ledgered(spark, sf_dir).where("in_mle")
    ends = a.slotted(spark, sf_dir).groupBy("window_id").agg(F.max("timestamp").alias("alarm_ts"))
    first = s.groupBy("window_id", "active_wallet").agg(F.min_by("timestamp", "slot_index").alias("first_ts"), F.min(F.when(F.col("dnc") > 0, F.struct("slot_index", "timestamp")))["timestamp"].alias("first_aligned_ts"))
    return first.join(ends, "window_id").withColumn("seconds_to_alarm", F.col("alarm_ts") - F.col("first_ts"))


def tests_table(spark, sf_dir):
    w = a.wallets(spark, sf_dir).select("window_id", "active_wallet", "profile", "n_mle", "e_mle")
    return decided(spark, sf_dir).select("window_id", "active_wallet", "eligible", micro(F.col("p_mag")).alias("p_mag"), micro(F.col("p_dir")).alias("p_dir"), "headline_reject", "status").join(w, ["window_id", "active_wallet"])


def sensitivity_agreement(spark, sf_dir):
    return multiple.sensitivity_agreement(decided(spark, sf_dir))


def pooled_dnc(spark, sf_dir):
    """Holm on dnc over a contract's windows together, beside the families by window."""
    streams = a.windows(spark, sf_dir).select("window_id", F.col("condition_id").alias("stream_id"))
    return multiple.pooled_holm(decided(spark, sf_dir), streams, "p_dnc", LEVELS["alpha"]).select("window_id", "active_wallet", micro(F.col("pooled_p")).alias("pooled_p"), "pooled_rank", "pooled_reject")


def paper_view(spark, sf_dir):
    return multiple.top_view(decided(spark, sf_dir), 25).select("window_id", "active_wallet", "tier", "status", "tied_into_top", "passes_t_star")


def resolution_by_size(spark, sf_dir):
    told = permute.resolution_by_size(permute.orbits(labelled(spark, sf_dir)))
    return told.select("window_id", "slots", "pairs", "eligible", "reachable", micro(F.col("median_log_orbit")).alias("median_log_orbit"))


def exact_families(spark, sf_dir):
    return permute.exact_families(labelled(spark, sf_dir))


def family_report(spark, sf_dir):
    return permute.family_report(permute.exact_families(labelled(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (sensitivity_agreement, pooled_dnc, paper_view, resolution_by_size, exact_families, family_report, cells, cell_seeds, fixed_slot_share, orbit_log, orbit_exact, family_sizes, reachability, holm_walk_limit, direction_floor, permute_sql, permute_philox, permute_philox_chunks, p_values, mc_sigma, second_seed, holm, bh, headline_union, top_n_ties, status_ladder, two_layer, leg_agreement, timing, tests_table)}

part("i_slots", "SELECT l.window_id, l.bucket_index, p.profile, l.window_id || '|b' || CAST(l.bucket_index AS VARCHAR) || '|' || p.profile AS cell_id, l.slot_index, l.active_wallet, l.aligned AS e, CAST(l.score_sign AS BIGINT) AS sign, CAST(floor(l.dnc * 1e6 + 0.5) AS BIGINT) AS dnc, CAST(floor(l.dfa * 1e6 + 0.5) AS BIGINT) AS dfa FROM a_ledger l JOIN a_profiles p ON l.window_id = p.window_id AND l.active_wallet = p.active_wallet")
part("i_cells", "SELECT cell_id, window_id, bucket_index, profile, count(*) AS n_slots, count(DISTINCT active_wallet) AS n_wallets, count(DISTINCT active_wallet) > 1 AS movable FROM i_slots GROUP BY 1, 2, 3, 4")
part("i_held", "SELECT *, CAST(sum(k) OVER (PARTITION BY cell_id) AS BIGINT) AS m FROM (SELECT cell_id, window_id, active_wallet, count(*) AS k FROM i_slots GROUP BY 1, 2, 3)")
part("i_logs", "SELECT range AS k, sum(CASE WHEN range > 0 THEN ln(CAST(range AS DOUBLE)) ELSE 0::DOUBLE END) OVER (ORDER BY range ROWS UNBOUNDED PRECEDING) AS value FROM range(500)")
part("i_orbits", "SELECT h.window_id, h.active_wallet, CAST(sum(h.k) AS BIGINT) AS n_slots, sum(a.value - b.value - c.value) AS log_orbit FROM i_held h JOIN i_logs a ON a.k = h.m JOIN i_logs b ON b.k = h.k JOIN i_logs c ON c.k = h.m - h.k GROUP BY 1, 2")
part("i_families", "SELECT *, n_slots >= 3 AS eligible, count(*) OVER (PARTITION BY window_id) AS m_screening, count(CASE WHEN n_slots >= 3 THEN 1 END) OVER (PARTITION BY window_id) AS m_confirmatory FROM i_orbits")
part("i_signs", "SELECT cell_id, count_if(sign > 0) AS a, count_if(sign = 0) AS b, count_if(sign < 0) AS c FROM i_slots GROUP BY 1")
part("i_take", "SELECT h.window_id, h.active_wallet, h.k, h.m, s.a, s.b, s.c, least(h.k, s.a) AS t, least(h.k - least(h.k, s.a), s.b) AS u FROM i_held h JOIN i_signs s USING (cell_id)")


def _drawn(name: str, seed: int, source: str) -> None:
    part(f"{name}_keys", f"SELECT *, draw.range + 1 AS d, sha256('{seed}|' || cell_id || '|' || CAST(draw.range + 1 AS VARCHAR) || '|' || CAST(slot_index AS VARCHAR)) AS key FROM {source} CROSS JOIN range({DRAWS}) draw")
    part(f"{name}_placed", f"SELECT *, row_number() OVER (PARTITION BY cell_id, d ORDER BY key, slot_index) AS by_key, row_number() OVER (PARTITION BY cell_id, d ORDER BY slot_index) AS by_slot FROM {name}_keys")
    legs = {"mag": "e", "dir": "sign", "dnc": "dnc", "dfa": "dfa"}
    sums = ", ".join(f"CAST(sum({{0}}{w}) AS BIGINT) AS {w}" for w in legs.values())
    part(f"{name}_totals", f"SELECT w.window_id, w.d, l.active_wallet, {sums.replace('{0}', 'w.')} FROM {name}_placed w JOIN {name}_placed l ON w.cell_id = l.cell_id AND w.d = l.d AND w.by_slot = l.by_key GROUP BY 1, 2, 3")
    reached = ", ".join(f"count_if(t.{w} >= s.{w}) AS n_{leg}" for leg, w in legs.items())
    part(name, f"SELECT t.window_id, t.active_wallet, {reached}, count_if(t.e <= s.e) AS n_mirror, count(*) AS draws FROM {name}_totals t JOIN (SELECT window_id, active_wallet, {sums.replace('{0}', '')} FROM i_slots GROUP BY 1, 2) s USING (window_id, active_wallet) GROUP BY 1, 2")


_drawn("i_counts", 2026, "i_slots")
LEGS = {"mag": 0.2, "dir": 0.2, "dnc": 0.4, "dfa": 0.4}
part("i_p", f"SELECT *, {', '.join(f'CAST(n_{leg} + 1 AS DOUBLE) / (draws + 1) AS p_{leg}' for leg in (*LEGS, 'mirror'))} FROM i_counts")
part("i_sigma", "SELECT *, CASE WHEN p_mag < 1 THEN abs(p_mag - 0.025::DOUBLE) / sqrt(p_mag * (1 - p_mag) / draws) END AS sigma_mag, CASE WHEN p_dir < 1 THEN abs(p_dir - 0.025::DOUBLE) / sqrt(p_dir * (1 - p_dir) / draws) END AS sigma_dir FROM i_p")
part("i_flagged", "SELECT * FROM i_slots WHERE window_id IN (SELECT window_id FROM i_sigma WHERE least(sigma_mag, sigma_dir) < 3)")
_drawn("i_again", 2027, "i_flagged")
part("i_roster", f"SELECT p.*, s.* EXCLUDE (window_id, active_wallet), s.n_slots >= 3 AS eligible, {', '.join(f'CASE WHEN s.n_slots >= 3 THEN p_{leg} END AS c_{leg}' for leg in LEGS)} FROM i_p p JOIN (SELECT window_id, active_wallet, count(*) AS n_slots, CAST(sum(e) AS BIGINT) AS e, CAST(sum(sign) AS BIGINT) AS sign, min(slot_index) AS first_slot FROM i_slots GROUP BY 1, 2) s USING (window_id, active_wallet)")
_ranks = ", ".join(f"CASE WHEN c_{leg} IS NOT NULL THEN row_number() OVER (PARTITION BY window_id, c_{leg} IS NULL ORDER BY c_{leg}, active_wallet) END AS holm_{leg}_rank, count(c_{leg}) OVER (PARTITION BY window_id) AS m_{leg}" for leg in LEGS)
_tops = ", ".join(f"count(*) OVER (PARTITION BY window_id) * p_{leg} / row_number() OVER (PARTITION BY window_id ORDER BY p_{leg}, active_wallet) AS step_q_{leg}, rank() OVER (PARTITION BY window_id ORDER BY {w} DESC) <= 10 AS top_{leg}, row_number() OVER (PARTITION BY window_id ORDER BY {w} DESC, first_slot) <= 10 AS strict_{leg}" for leg, w in (("mag", "e"), ("dir", "sign")))
part("i_steps", f"SELECT *, {_ranks}, {_tops} FROM i_roster")
_adjusted = ", ".join(f"CASE WHEN c_{leg} IS NOT NULL THEN least(1.0::DOUBLE, max((m_{leg} - holm_{leg}_rank + 1) * c_{leg}) OVER (PARTITION BY window_id, c_{leg} IS NULL ORDER BY c_{leg}, active_wallet ROWS UNBOUNDED PRECEDING)) END AS holm_{leg}_p, {alpha}::DOUBLE / (m_{leg} - holm_{leg}_rank + 1) AS holm_{leg}_threshold" for leg, alpha in LEGS.items())
_screens = ", ".join(f"least(1.0::DOUBLE, min(step_q_{leg}) OVER (PARTITION BY window_id ORDER BY p_{leg} DESC, active_wallet DESC ROWS UNBOUNDED PRECEDING)) AS screen_{leg}_q" for leg in ("mag", "dir"))
part("i_adjusted", f"SELECT *, {_adjusted}, {_screens} FROM i_steps")
part("i_flags", f"SELECT *, {', '.join(f'holm_{leg}_p <= {alpha}::DOUBLE AS holm_{leg}_reject' for leg, alpha in LEGS.items())}, screen_mag_q <= 0.25::DOUBLE AS screen_mag_reject, screen_dir_q <= 0.25::DOUBLE AS screen_dir_reject, screen_mag_q <= 0.25::DOUBLE OR screen_dir_q <= 0.25::DOUBLE AS screen_reject FROM i_adjusted")
part("i_headline", """
SELECT *, coalesce(holm_mag_reject, false) OR coalesce(holm_dir_reject, false) AS headline_reject, (top_mag OR top_dir) AND e > 0 AS top10, p_mag <= 0.06::DOUBLE AS passes_t_star,
  CASE WHEN holm_mag_reject AND holm_dir_reject THEN 'both' WHEN holm_mag_reject THEN 'mag' WHEN holm_dir_reject THEN 'dir' ELSE 'none' END AS leg_that_rejected FROM i_flags
""")
part("i_status", """
SELECT *, CASE WHEN (coalesce(holm_mag_reject, false) AND passes_t_star) OR coalesce(holm_dir_reject, false) THEN 'confirmed_repeat_active' WHEN holm_mag_reject THEN 'review_queue' WHEN screen_reject THEN 'bh_review_screen' WHEN top10 THEN 'top10_descriptive' END AS status FROM i_headline
""")
part("i_decided", "SELECT *, coalesce(status = 'top10_descriptive' AND NOT (strict_mag OR strict_dir), false) AS tied_into_top FROM i_status")
_choose = lambda n, k: f"(SELECT value FROM i_logs WHERE k = {n}) - (SELECT value FROM i_logs WHERE k = {k}) - (SELECT value FROM i_logs WHERE k = {n} - {k})"
ORACLE = {
    "cells": query("SELECT * FROM i_cells"),
    "cell_seeds": query("SELECT cell_id, CAST(CAST('0x' || substr(sha256('2026|' || window_id || '|' || cell_id), 1, 16) AS UBIGINT) AS VARCHAR) AS cell_seed FROM i_cells"),
    "fixed_slot_share": query("SELECT s.window_id, s.active_wallet, count(*) AS n_slots, count_if(NOT c.movable) AS n_fixed, count_if(NOT c.movable) > 0.2::DOUBLE * count(*) AS low_power, count_if(NOT c.movable) = count(*) AS no_movable_slots FROM i_slots s JOIN i_cells c USING (cell_id) GROUP BY 1, 2"),
    "orbit_log": query(f"SELECT window_id, active_wallet, n_slots, {grid('log_orbit')} AS log_orbit FROM i_orbits"),
    "family_sizes": query("SELECT DISTINCT window_id, m_screening, m_confirmatory FROM i_families"),
    "reachability": query("SELECT window_id, active_wallet, eligible, CASE WHEN eligible THEN log_orbit + ln(0.05::DOUBLE / m_confirmatory) >= -1e-9::DOUBLE END AS reachable FROM i_families"),
    "holm_walk_limit": query("SELECT window_id, CAST(coalesce(min(CASE WHEN log_orbit + ln(0.05::DOUBLE / (m_confirmatory - step + 1)) < -1e-9::DOUBLE THEN step END) - 1, count(*)) AS BIGINT) AS max_steps, count(*) AS m FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY floor(log_orbit * 1e6 + 0.5) DESC, active_wallet) AS step FROM i_families WHERE eligible) GROUP BY 1"),
    "direction_floor": query(f"SELECT window_id, active_wallet, {grid('sum(x)')} AS log_floor FROM (SELECT window_id, active_wallet, fa.value - ft.value - fat.value + fb.value - fu.value - fbu.value + fc.value - fv.value - fcv.value - (fm.value - fk.value - fmk.value) AS x FROM (SELECT *, k - t - u AS v FROM i_take) z JOIN i_logs fa ON fa.k = z.a JOIN i_logs ft ON ft.k = z.t JOIN i_logs fat ON fat.k = z.a - z.t JOIN i_logs fb ON fb.k = z.b JOIN i_logs fu ON fu.k = z.u JOIN i_logs fbu ON fbu.k = z.b - z.u JOIN i_logs fc ON fc.k = z.c JOIN i_logs fv ON fv.k = z.v JOIN i_logs fcv ON fcv.k = z.c - z.v JOIN i_logs fm ON fm.k = z.m JOIN i_logs fk ON fk.k = z.k JOIN i_logs fmk ON fmk.k = z.m - z.k) GROUP BY 1, 2"),
    "permute_sql": query("SELECT * FROM i_counts"),
    "p_values": query(f"SELECT window_id, active_wallet, n_mag, n_dir, {grid('p_mag')} AS p_mag, {grid('p_dir')} AS p_dir FROM i_p"),
    "mc_sigma": query(f"SELECT window_id, active_wallet, {grid('sigma_mag')} AS sigma_mag, {grid('sigma_dir')} AS sigma_dir, coalesce(least(sigma_mag, sigma_dir) < 3, false) AS review FROM i_sigma"),
    "second_seed": query("SELECT * FROM i_again"),
    "holm": query(f"SELECT window_id, active_wallet, eligible, {grid('holm_mag_p')} AS holm_mag_p, holm_mag_reject, {grid('holm_dir_p')} AS holm_dir_p, holm_dir_reject FROM i_decided"),
    "bh": query(f"SELECT window_id, active_wallet, {grid('screen_mag_q')} AS screen_mag_q, {grid('screen_dir_q')} AS screen_dir_q, screen_reject FROM i_decided"),
    "sensitivity_agreement": query(" UNION ALL ".join(f"SELECT '{leg}' AS leg, count_if(r) AS rejections, count_if(r AND NOT headline_reject) AS sensitivity_only, count_if(r AND headline_reject) AS both, count_if(NOT r AND headline_reject) AS headline_only, count_if(NOT r AND NOT headline_reject) AS neither FROM (SELECT coalesce(holm_{leg}_reject, false) AS r, headline_reject FROM i_decided)" for leg in ("dnc", "dfa"))),
    "pooled_dnc": query(f"SELECT window_id, active_wallet, {grid('least(1.0::DOUBLE, max((m - pooled_rank + 1) * p_dnc) OVER (PARTITION BY condition_id ORDER BY pooled_rank ROWS UNBOUNDED PRECEDING))')} AS pooled_p, pooled_rank, least(1.0::DOUBLE, max((m - pooled_rank + 1) * p_dnc) OVER (PARTITION BY condition_id ORDER BY pooled_rank ROWS UNBOUNDED PRECEDING)) <= 0.4::DOUBLE AS pooled_reject FROM (SELECT d.window_id, d.active_wallet, d.p_dnc, w.condition_id, row_number() OVER (PARTITION BY w.condition_id ORDER BY d.p_dnc, d.window_id || '|' || d.active_wallet) AS pooled_rank, count(*) OVER (PARTITION BY w.condition_id) AS m FROM i_decided d JOIN a_windows w USING (window_id) WHERE d.eligible)"),
    "paper_view": query("SELECT window_id, active_wallet, CAST(tier AS BIGINT) AS tier, status, tied_into_top, passes_t_star FROM (SELECT *, CASE status WHEN 'confirmed_repeat_active' THEN 1 WHEN 'review_queue' THEN 2 WHEN 'bh_review_screen' THEN 3 WHEN 'top10_descriptive' THEN 4 ELSE 5 END AS tier FROM i_decided) ORDER BY tier, least(coalesce(holm_mag_p, 'inf'::DOUBLE), coalesce(holm_dir_p, 'inf'::DOUBLE)), e DESC, window_id, active_wallet LIMIT 25"),
    "resolution_by_size": query(f"SELECT window_id, CAST(least(n_slots, 6) AS BIGINT) AS slots, count(*) AS pairs, count_if(eligible) AS eligible, count_if(eligible AND log_orbit + ln(0.025::DOUBLE / m_confirmatory) >= -1e-9::DOUBLE) AS reachable, {grid('quantile_cont(log_orbit, 0.5)')} AS median_log_orbit FROM i_families GROUP BY 1, 2"),
    "headline_union": query("SELECT window_id, active_wallet, headline_reject, leg_that_rejected FROM i_decided"),
    "top_n_ties": query("SELECT window_id, active_wallet, e FROM i_decided WHERE top10"),
    "status_ladder": query("SELECT window_id, active_wallet, status FROM i_decided"),
    "two_layer": query("SELECT window_id, CASE WHEN headline_reject THEN 'validated_' || leg_that_rejected WHEN screen_reject THEN 'screening' ELSE 'none' END AS layer, count(*) AS n FROM i_decided GROUP BY 1, 2"),
    "leg_agreement": query("SELECT holm_mag_reject AS mag, holm_dir_reject AS dir, count(*) AS n FROM i_decided WHERE eligible GROUP BY 1, 2"),
    "timing": query("SELECT window_id, active_wallet, arg_min(timestamp, slot_index) AS first_ts, arg_min(CASE WHEN dnc > 0 THEN timestamp END, CASE WHEN dnc > 0 THEN slot_index END) AS first_aligned_ts, any_value(alarm_ts) AS alarm_ts, any_value(alarm_ts) - arg_min(timestamp, slot_index) AS seconds_to_alarm FROM a_ledger JOIN (SELECT window_id, max(timestamp) AS alarm_ts FROM a_slots GROUP BY 1) USING (window_id) GROUP BY 1, 2"),
    "tests_table": query(f"SELECT d.window_id, d.active_wallet, d.eligible, {grid('d.p_mag')} AS p_mag, {grid('d.p_dir')} AS p_dir, d.headline_reject, d.status, w.profile, w.n_mle, w.e_mle FROM i_decided d JOIN a_wallets w ON d.window_id = w.window_id AND d.active_wallet = w.active_wallet"),
}
