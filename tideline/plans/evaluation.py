"""Evaluation against known change points: scenario streams of every contract, their verdicts, windows and tests.

A stream is 'mode~contract'. The chain from trades to decisions is the library's own, run over all scenario streams at
once; its SQL is that of the plain chain under other names. Draws and levels are those of `inference`.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.expr import micro
from ..operators import attribute, baseline, buckets, evaluate, multiple, permute, recall, simulate, transfer, walk
from . import attribution as a
from . import detection as d
from . import inference as i
from . import studies as s
from .sql import PARTS, grid, part, query

LEVELS = {"click": "L0", "purchase": "L1", "error": "L1"}  # the others are L2
THRESHOLD, ADDED = 4.0, 40_000_000_000


@d.shared
def scenario_rows(spark, sf_dir):
    return simulate.scenario_trades(s.grid_trades(spark, sf_dir))


def truth_streams(spark, sf_dir):
    """One row a stream: level, mode, tau and how its contract resolved."""
    resolved = d.trades(spark, sf_dir).groupBy(F.col("condition_id").alias("base")).agg(F.max("resolved_outcome").alias("resolved_outcome"))
    return simulate.scenario_truth(s.grid_trades(spark, sf_dir), LEVELS).join(resolved, "base")


@d.shared
def bucketed(spark, sf_dir):
    return buckets.assign_buckets(scenario_rows(spark, sf_dir), d.SIZE)


@d.shared
def bounds(spark, sf_dir):
    return transfer.bucket_bounds(bucketed(spark, sf_dir))


@d.shared
def standard(spark, sf_dir):
    return baseline.standardized(buckets.imbalance_rows(bucketed(spark, sf_dir)), d.HEAD)


@d.shared
def walked(spark, sf_dir):
    return walk.reflected_walk(standard(spark, sf_dir), d.CONFIG)


@d.shared
def evaluated(spark, sf_dir):
    w = walked(spark, sf_dir)
    return evaluate.evaluate_sim(walk.verdicts(w, THRESHOLD), walk.statistics(w), bounds(spark, sf_dir), truth_streams(spark, sf_dir), "plain", THRESHOLD)


@d.shared
def windows(spark, sf_dir):
    return attribute.run_rows(walk.verdicts(walked(spark, sf_dir), THRESHOLD), "plain", THRESHOLD, d.SIZE)


@d.shared
def slotted(spark, sf_dir):
    return attribute.slots(windows(spark, sf_dir), bucketed(spark, sf_dir))


@d.shared
def ledgered(spark, sf_dir):
    return attribute.ledger(slotted(spark, sf_dir), standard(spark, sf_dir))


@d.shared
def labelled(spark, sf_dir):
    past = attribute.history(windows(spark, sf_dir), bucketed(spark, sf_dir))
    return permute.labelled(ledgered(spark, sf_dir), attribute.profiles(slotted(spark, sf_dir), past))


@d.shared
def study_rows(spark, sf_dir):
    """Every wallet and window pair of the study with its decisions, orbit, stream and level."""
    slots = labelled(spark, sf_dir)
    told = multiple.decide(slots, permute.p_values(permute.permuted_counts(slots, i.DRAWS)), **i.LEVELS)
    reach = permute.families(permute.orbits(slots)).select("window_id", "active_wallet", "reachable")
    streams = windows(spark, sf_dir).select("window_id", F.col("condition_id").alias("stream_id"))
    levels = truth_streams(spark, sf_dir).select(F.col("condition_id").alias("stream_id"), "level")
    known = F.broadcast(streams.join(F.broadcast(levels), "stream_id"))  # one row a window
    return told.join(reach, ["window_id", "active_wallet"]).join(known, "window_id")


@d.shared
def truth(spark, sf_dir):
    """Injected wallets: those that hold an injected trade."""
    wallets = scenario_rows(spark, sf_dir).where("injected").select(F.col("condition_id").alias("stream_id"), "active_wallet").distinct()
    return wallets.join(truth_streams(spark, sf_dir).select(F.col("condition_id").alias("stream_id"), "injection_mode", "tau"), "stream_id")


@d.shared
def instances(spark, sf_dir):
    return recall.instances(study_rows(spark, sf_dir), truth(spark, sf_dir))


def scenario_counts(spark, sf_dir):
    return scenario_rows(spark, sf_dir).groupBy("condition_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("injected").alias("n_injected"), F.sum("signed").alias("net"))


def sim_eval(spark, sf_dir):
    return evaluated(spark, sf_dir)


def sim_summary(spark, sf_dir):
    told = evaluate.sim_summary(evaluated(spark, sf_dir))
    twice = lambda c: (F.col(c) * 2).cast("long").alias(c)
    return told.select("method", "channel", "level", "mode", "outcome", "n_scenarios", *[micro(F.col(c)).alias(c) for c in ("power", "false_alarm_rate", "coverage")], twice("median_delay"), twice("median_onset_error"))


def outcome_partition(spark, sf_dir):
    return evaluate.outcome_partition(evaluated(spark, sf_dir))


def paired_nulls(spark, sf_dir):
    return evaluate.paired_nulls(truth_streams(spark, sf_dir)).select("condition_id", "tau", "reference_tau")


def trades_before_tau(spark, sf_dir):
    return evaluate.trades_before(scenario_rows(spark, sf_dir), truth_streams(spark, sf_dir).select("condition_id", "tau"))


def around_tau(spark, sf_dir):
    told = evaluate.tau_buckets(bounds(spark, sf_dir), truth_streams(spark, sf_dir))
    return evaluate.around_tau(standard(spark, sf_dir), told).select("condition_id", "bucket_index", "place", "x", "z")


def real_alarm_report(spark, sf_dir):
    """The events' contracts: each closes an hour after its last trade."""
    t = d.trades(spark, sf_dir)
    markets = t.groupBy("condition_id", "question").agg((F.max("timestamp") + 3600).alias("closed_time"))
    w = d.walked(spark, sf_dir)
    return evaluate.evaluate_real(walk.verdicts(w, THRESHOLD), walk.statistics(w), s.bounds(spark, sf_dir), markets, "plain", THRESHOLD, d.SIZE)


def replay_audit(spark, sf_dir):
    """Verdicts built anew from trades against a frozen table in which some statistics and rows were changed."""
    now = d.verdict_table(spark, sf_dir, d.SIZE, d.HEAD)
    frozen = walk.verdicts(d.walked(spark, sf_dir), THRESHOLD).where("NOT (condition_id = 'view' AND channel = 'wallet_hhi')")
    frozen = frozen.withColumn("max_statistic", F.when(F.col("condition_id") == "click", F.col("max_statistic") + 1).otherwise(F.col("max_statistic")))
    told = evaluate.replayed(now, frozen, ["condition_id", "channel"], ["max_statistic", "alarm_bucket", "onset_bucket", "onset_mle", "direction"])
    return told.select("condition_id", "channel", "field", F.col("now").cast("long").alias("now"), F.col("frozen").cast("long").alias("frozen"))


def winning_path(spark, sf_dir):
    w = d.walked(spark, sf_dir)
    return evaluate.winning_path(w, walk.verdicts(w, THRESHOLD))


def recall_bins(spark, sf_dir):
    return recall.recall_bins(instances(spark, sf_dir))


def recall_rollup(spark, sf_dir):
    told = recall.recall_rollup(instances(spark, sf_dir))
    return told.select("level", "mode", "grouping", "instances", *recall.METRICS, *[micro(F.col(f"{m}_rate")).alias(f"{m}_rate") for m in recall.METRICS])


def background_minima(spark, sf_dir):
    told = recall.background_minima(study_rows(spark, sf_dir), truth(spark, sf_dir), "mag")
    return told.select("window_id", "stream_id", "level", "pairs", micro(F.col("min_p")).alias("min_p"), "rejected")


def t_star(spark, sf_dir):
    """Calibration of both headline legs."""
    rows, known = study_rows(spark, sf_dir), truth(spark, sf_dir)
    told = [recall.calibration(recall.background_minima(rows, known, leg), i.DRAWS, i.LEVELS["alpha_leg"]).withColumn("leg", F.lit(leg)) for leg in multiple.HEADLINE]
    both = told[0].unionByName(told[1])
    return both.select("leg", "level", "grouping", "studies", "pairs", "errors", "at_floor", micro(F.col("t_star")).alias("t_star"), micro(F.col("error_rate")).alias("error_rate"), "nominal_holds", "censored")


def digests(spark, sf_dir):
    named = attribute.membership_digest(slotted(spark, sf_dir).where("in_mle"))
    return named.join(windows(spark, sf_dir).select("window_id", F.col("condition_id").alias("stream_id")), "window_id")


def episode_dedup(spark, sf_dir):
    """Memberships are of bucket and hash alone, so streams whose injection never touched a window share its episode."""
    return recall.episodes(digests(spark, sf_dir), truth(spark, sf_dir))


def duplicate_episodes(spark, sf_dir):
    return recall.duplicate_groups(digests(spark, sf_dir), recall.payload_digests(ledgered(spark, sf_dir)))


def study_leg_agreement(spark, sf_dir):
    return recall.leg_agreement(study_rows(spark, sf_dir))


def top_sizes(spark, sf_dir):
    rows = study_rows(spark, sf_dir)
    both = recall.top_sizes(rows, "e").unionByName(recall.top_sizes(rows, "sign"))
    return both.withColumn("median", (F.col("median") * 2).cast("long"))


def slot_quantiles(spark, sf_dir):
    return recall.slot_quantiles(study_rows(spark, sf_dir)).select("pairs", *[micro(F.col(c)).alias(c) for c in ("median", "p75", "p90", "p99")], "most")


def window_times(spark, sf_dir):
    b = bounds(spark, sf_dir)
    w = windows(spark, sf_dir).select("window_id", "condition_id", "onset_bucket", "alarm_bucket")
    start = b.select("condition_id", F.col("bucket_index").alias("onset_bucket"), F.col("start_ts").alias("window_start"))
    end = b.select("condition_id", F.col("bucket_index").alias("alarm_bucket"), F.col("end_ts").alias("alarm_end"))
    return w.join(start, ["condition_id", "onset_bucket"]).join(end, ["condition_id", "alarm_bucket"]).withColumnRenamed("condition_id", "stream_id")


def conditional_h0(spark, sf_dir):
    return recall.conditional_h0(study_rows(spark, sf_dir), window_times(spark, sf_dir), truth(spark, sf_dir))


def engine_rows(spark, sf_dir):
    c = attribute.conservation(ledgered(spark, sf_dir)).join(standard(spark, sf_dir).select("condition_id", "bucket_index", "z"), ["condition_id", "bucket_index"])
    llr = F.col("winning_delta") * F.col("direction") * F.col("z") / 1e6 - F.col("winning_delta") * F.col("winning_delta") / 2.0
    return recall.engine_rows(instances(spark, sf_dir), c.select("window_id", (F.abs(F.col("dfa") - llr) < 1e-4).alias("conserved")))


def acceptance(spark, sf_dir):
    minima = recall.background_minima(study_rows(spark, sf_dir), truth(spark, sf_dir), "dir")
    return recall.acceptance(instances(spark, sf_dir), recall.calibration(minima, i.DRAWS, i.LEVELS["alpha_leg"]), 10, 3)


QUERIES = {f.__name__: f for f in (scenario_counts, sim_eval, sim_summary, outcome_partition, paired_nulls, trades_before_tau, around_tau, real_alarm_report, replay_audit, winning_path, recall_bins, recall_rollup, background_minima, t_star, episode_dedup, duplicate_episodes, study_leg_agreement, top_sizes, slot_quantiles, conditional_h0, engine_rows, acceptance)}

# --- SQL: the scenario streams, then the plain chain's parts over them under names with an x ---

part("v_tilt", "SELECT transaction_hash, CASE WHEN flipped THEN -signed ELSE signed END AS signed, flipped FROM (SELECT *, candidate AND row_number() OVER (PARTITION BY condition_id, candidate ORDER BY sha256('1|tilt|' || transaction_hash), transaction_hash) <= floor(count(*) OVER (PARTITION BY condition_id, candidate) * 90 / 100) AS flipped FROM (SELECT *, after AND signed < 0 AS candidate FROM s_after))")
part("v_moved", "SELECT transaction_hash, after AND row_number() OVER (PARTITION BY condition_id, after ORDER BY sha256('1|wallet|' || transaction_hash), transaction_hash) <= floor(count(*) OVER (PARTITION BY condition_id, after) * 25 / 100) AS moved FROM s_after")
part("v_rows", f"""
SELECT 'null~' || condition_id AS condition_id, timestamp, transaction_hash, active_wallet, shares, signed, false AS injected FROM t_grid
UNION ALL SELECT 'additive~' || condition_id, timestamp, transaction_hash, active_wallet, shares, signed, false FROM t_grid
UNION ALL SELECT 'additive~' || t.condition_id, t.tau + CAST(floor((m.last_ts - t.tau) * g.range / 40) AS BIGINT), 'x' || t.condition_id || CAST(g.range AS VARCHAR), 'informed', {ADDED // 40}, {ADDED // 40}, true
  FROM s_tau t JOIN (SELECT condition_id, max(timestamp) AS last_ts FROM t_grid GROUP BY 1) m USING (condition_id) CROSS JOIN range(40) g
UNION ALL SELECT 'direction_tilt~' || condition_id, timestamp, transaction_hash, active_wallet, shares, v.signed, v.flipped FROM t_grid JOIN v_tilt v USING (transaction_hash)
UNION ALL SELECT 'size_tilt~' || condition_id, timestamp, transaction_hash, active_wallet, CASE WHEN after AND signed > 0 THEN shares * 3 ELSE shares END, CASE WHEN after AND signed > 0 THEN signed * 3 ELSE signed END, after AND signed > 0 FROM s_after
UNION ALL SELECT 'wallet_only~' || condition_id, timestamp, transaction_hash, CASE WHEN v.moved THEN 'informed' ELSE active_wallet END, shares, signed, v.moved FROM t_grid JOIN v_moved v USING (transaction_hash)
""")
part("v_streams", """
SELECT m.mode || '~' || t.condition_id AS condition_id, t.condition_id AS base, CASE t.condition_id WHEN 'click' THEN 'L0' WHEN 'purchase' THEN 'L1' WHEN 'error' THEN 'L1' ELSE 'L2' END AS level,
  CASE WHEN m.mode <> 'null' THEN m.mode END AS injection_mode, CASE WHEN m.mode <> 'null' THEN t.tau END AS tau, r.resolved_outcome
FROM s_tau t CROSS JOIN (VALUES ('null'), ('additive'), ('direction_tilt'), ('size_tilt'), ('wallet_only')) AS m(mode) JOIN (SELECT condition_id, max(resolved_outcome) AS resolved_outcome FROM t_trades GROUP BY 1) r ON r.condition_id = t.condition_id
""")
part("xt_bucketed", "SELECT *, CAST((row_number() OVER (PARTITION BY condition_id ORDER BY timestamp, transaction_hash) - 1) // 20 AS BIGINT) AS bucket_index FROM v_rows")
part("xt_plain", "SELECT condition_id, bucket_index, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n_trades, CAST(sum(signed) AS DOUBLE) / CAST(nullif(sum(abs(signed)), 0) AS DOUBLE) AS imbalance FROM xt_bucketed GROUP BY 1, 2")
part("xt_channels", f"SELECT condition_id, bucket_index, 'imbalance' AS channel, {grid('imbalance')} AS x FROM xt_plain")
_CHAIN = ["t_burn_mu", "t_burn", "t_standard", "t_sums", "t_w", "t_walk", "t_best", "t_runs", "t_verdicts", "a_path", "a_windows", "a_slots", "a_inside", "a_terms", "a_ledger", "a_history", "a_known", "a_cutoff", "a_profiles", "i_slots", "i_held", "i_orbits", "i_families", "i_counts_keys", "i_counts_placed", "i_counts_totals", "i_counts", "i_p", "i_roster", "i_steps", "i_adjusted", "i_flags", "i_headline", "i_status", "i_decided"]
_RENAMED = {*_CHAIN, "t_bucketed", "t_channels"}
part("xa_runs", "SELECT *, 'events|' || condition_id || '|' || channel || '|K20' AS episode_id, 'events|' || condition_id || '|' || channel || '|K20|a' || CAST(alarm_bucket AS VARCHAR) AS window_id, 'plain' AS method FROM xt_verdicts WHERE alarmed")
for _name in _CHAIN:
    part(f"x{_name}", re.sub(r"[A-Za-z_][A-Za-z_0-9]*", lambda m: f"x{m[0]}" if m[0] in _RENAMED or m[0] == "a_runs" else m[0], PARTS[_name]))
# Parts are written in order of definition; the runs read verdicts, so they come after them.
PARTS["xa_runs"] = PARTS.pop("xa_runs")
for _name in _CHAIN[_CHAIN.index("a_path") :]:
    PARTS[f"x{_name}"] = PARTS.pop(f"x{_name}")
part("v_taub", "SELECT s.*, (SELECT min(b.bucket_index) FROM xt_plain b WHERE b.condition_id = s.condition_id AND b.end_ts >= s.tau) AS tau_bucket FROM v_streams s")


def utc_sql(x: str) -> str:
    return f"strftime(make_timestamp({x} * 1000000), '%Y-%m-%d %H:%M:%S UTC')"


part("v_eval", f"""
SELECT v.condition_id, s.level, s.injection_mode, s.resolved_outcome, 'plain' AS method, v.channel, n.n_buckets, s.tau, {utc_sql('s.tau')} AS tau_text, s.tau_bucket, v.alarm_bucket, b.start_ts AS alarm_start, b.end_ts AS alarm_available,
  {utc_sql('b.end_ts')} AS alarm_text, v.direction, coalesce(v.alarm_bucket >= s.tau_bucket, false) AS detected,
  CASE WHEN s.tau IS NULL THEN v.alarm_bucket IS NOT NULL ELSE coalesce(v.alarm_bucket < s.tau_bucket, false) END AS false_alarm,
  CASE WHEN v.alarm_bucket >= s.tau_bucket THEN v.alarm_bucket - s.tau_bucket END AS delay_buckets, CASE WHEN v.alarm_bucket >= s.tau_bucket THEN b.end_ts - s.tau END AS delay_seconds,
  v.onset_bucket, v.onset_mle, v.winning_delta, v.onset_bucket - s.tau_bucket AS onset_error, v.onset_bucket <= s.tau_bucket AND s.tau_bucket <= v.alarm_bucket AS covers_tau,
  CAST(coalesce(w.w, v.max_statistic) AS BIGINT) AS statistic, CAST(16000000 AS BIGINT) AS threshold
FROM xt_verdicts v JOIN v_taub s USING (condition_id) JOIN (SELECT condition_id, count(*) AS n_buckets FROM xt_plain GROUP BY 1) n USING (condition_id)
LEFT JOIN xt_best w ON w.condition_id = v.condition_id AND w.channel = v.channel AND w.bucket_index = v.alarm_bucket LEFT JOIN xt_plain b ON b.condition_id = v.condition_id AND b.bucket_index = v.alarm_bucket
""")
_H1 = lambda x, name: f"CASE WHEN mode <> 'null' THEN {x} END AS {name}"
part("v_classed", "SELECT *, coalesce(injection_mode, 'null') AS mode, CASE WHEN injection_mode IS NULL AND alarm_bucket IS NULL THEN 'null_quiet' WHEN injection_mode IS NULL THEN 'null_alarm' WHEN alarm_bucket IS NULL THEN 'missed' WHEN false_alarm THEN 'before_tau' WHEN coalesce(covers_tau, false) THEN 'covers_tau' ELSE 'starts_late' END AS class FROM v_eval")
part("v_truth", "SELECT DISTINCT r.condition_id AS stream_id, r.active_wallet, s.injection_mode, s.tau FROM v_rows r JOIN v_streams s USING (condition_id) WHERE r.injected")
part("v_study", "SELECT d.*, w.condition_id AS stream_id, s.level, CASE WHEN f.eligible THEN f.log_orbit + ln(0.05::DOUBLE / f.m_confirmatory) >= -1e-9::DOUBLE END AS reachable FROM xi_decided d JOIN xa_windows w USING (window_id) JOIN v_streams s ON s.condition_id = w.condition_id JOIN xi_families f ON f.window_id = d.window_id AND f.active_wallet = d.active_wallet")
part("v_found", "SELECT d.window_id, d.stream_id, d.active_wallet, d.level, t.injection_mode, d.eligible, coalesce(d.reachable, false) AS reachable, CASE WHEN n_slots <= 2 THEN '1-2' WHEN n_slots <= 6 THEN '3-6' WHEN n_slots <= 15 THEN '7-15' WHEN n_slots <= 40 THEN '16-40' WHEN n_slots <= 100 THEN '41-100' ELSE '101+' END AS bin, coalesce(holm_mag_reject, false) AS mag_rejected, coalesce(holm_dir_reject, false) AS dir_rejected, headline_reject AS union_rejected, top10 FROM v_study d JOIN v_truth t USING (stream_id, active_wallet)")
part("v_background", "SELECT * FROM v_study d WHERE eligible AND NOT EXISTS (SELECT 1 FROM v_truth t WHERE t.stream_id = d.stream_id AND t.active_wallet = d.active_wallet)")
for _leg in ("mag", "dir"):
    part(f"v_minima_{_leg}", f"SELECT window_id, any_value(stream_id) AS stream_id, any_value(level) AS level, count(*) AS pairs, min(p_{_leg}) AS min_p, bool_or(coalesce(holm_{_leg}_reject, false)) AS rejected FROM v_background GROUP BY 1")
part("v_digests", "SELECT s.window_id, w.condition_id AS stream_id, sha256(string_agg(CAST(s.bucket_index AS VARCHAR) || '|' || s.transaction_hash || chr(10), '' ORDER BY s.slot_index)) AS membership_sha256 FROM xa_slots s JOIN xa_windows w USING (window_id) WHERE s.in_mle GROUP BY 1, 2")
part("v_payload", "SELECT window_id, sha256(string_agg(transaction_hash || '|' || CAST(shares AS VARCHAR) || '|' || CAST(CAST(floor(dnc * 1e6 + 0.5) AS BIGINT) AS VARCHAR) || chr(10), '' ORDER BY transaction_hash)) AS payload_sha256 FROM xa_ledger GROUP BY 1")
part("v_units", "SELECT w.window_id, CASE WHEN t.tau IS NULL THEN 'pure_h0' WHEN NOT (t.tau BETWEEN b.start_ts AND e.end_ts) THEN 'before_tau' END AS stratum FROM xa_windows w LEFT JOIN (SELECT stream_id, min(tau) AS tau FROM v_truth GROUP BY 1) t ON t.stream_id = w.condition_id JOIN xt_plain b ON b.condition_id = w.condition_id AND b.bucket_index = w.onset_bucket JOIN xt_plain e ON e.condition_id = w.condition_id AND e.bucket_index = w.alarm_bucket")
part("v_pairs", "SELECT d.*, u.stratum, t.stream_id IS NOT NULL AS injected FROM v_study d JOIN v_units u USING (window_id) LEFT JOIN v_truth t ON t.stream_id = d.stream_id AND t.active_wallet = d.active_wallet WHERE u.stratum IS NOT NULL")
part("v_spread", "SELECT * FROM v_pairs UNION ALL SELECT * REPLACE ('before_tau_not_injected' AS stratum) FROM v_pairs WHERE stratum = 'before_tau' AND NOT injected")
_METRICS = ", ".join(f"count_if({m}) AS {m}" for m in recall.METRICS)
_top = lambda w: f"SELECT '{w}' AS score, min(size) AS least, CAST(quantile_cont(size, 0.5) * 2 AS BIGINT) AS median, max(size) AS most, count_if(size > 10) AS beyond, count(*) AS windows FROM (SELECT window_id, count_if(place <= 10) AS size FROM (SELECT *, rank() OVER (PARTITION BY window_id ORDER BY {w} DESC) AS place FROM v_study) GROUP BY 1)"
_frozen = lambda f: f"SELECT condition_id, channel, '{f}' AS field, CAST(a.{f} AS BIGINT) AS now, CAST(b.{f} AS BIGINT) AS frozen FROM t_verdicts a JOIN frozen b USING (condition_id, channel) WHERE a.{f} IS DISTINCT FROM b.{f}"
ORACLE = {
    "scenario_counts": query("SELECT condition_id, count(*) AS n, count_if(injected) AS n_injected, CAST(sum(signed) AS BIGINT) AS net FROM v_rows GROUP BY 1"),
    "sim_eval": query("SELECT * FROM v_eval"),
    "sim_summary": query(f"SELECT method, channel, level, mode, CASE WHEN mode <> 'null' THEN resolved_outcome END AS outcome, count(*) AS n_scenarios, {_H1(grid('avg(CAST(detected AS INTEGER))'), 'power')}, {grid('avg(CAST(false_alarm AS INTEGER))')} AS false_alarm_rate, {_H1(grid('avg(CASE WHEN detected THEN CAST(covers_tau AS INTEGER) END)'), 'coverage')}, {_H1('CAST(quantile_cont(CASE WHEN detected THEN delay_buckets END, 0.5) * 2 AS BIGINT)', 'median_delay')}, {_H1('CAST(quantile_cont(CASE WHEN detected THEN onset_error END, 0.5) * 2 AS BIGINT)', 'median_onset_error')} FROM v_classed GROUP BY 1, 2, 3, 4, 5"),
    "outcome_partition": query(f"SELECT level, mode, CAST(grouping(level, mode) AS BIGINT) AS grouping, count(*) AS runs, {', '.join(f'''count_if(class = '{c}') AS {c}''' for c in evaluate.CLASSES)}, true AS whole FROM v_classed GROUP BY ROLLUP (level, mode)"),
    "paired_nulls": query("SELECT s.condition_id, s.tau, coalesce(s.tau, p.tau) AS reference_tau FROM v_streams s LEFT JOIN (SELECT level, base, min(tau) AS tau FROM v_streams WHERE injection_mode IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT tau) = 1) p USING (level, base)"),
    "trades_before_tau": query("SELECT r.condition_id, s.tau, count_if(r.timestamp < s.tau) AS n_before, count(*) AS n_trades FROM v_rows r JOIN v_streams s USING (condition_id) WHERE s.tau IS NOT NULL GROUP BY 1, 2"),
    "around_tau": query("SELECT p.condition_id, p.bucket_index, p.bucket_index - s.tau_bucket AS place, p.x, p.z FROM xt_standard p JOIN v_taub s USING (condition_id) WHERE abs(p.bucket_index - s.tau_bucket) <= 15"),
    "real_alarm_report": query(f"""
SELECT v.condition_id, v.condition_id AS question, 'plain' AS method, v.channel, CAST(20 AS BIGINT) AS bucket_size, n.n_buckets, n.n_buckets < 30 AS shallow, v.alarmed, v.alarm_bucket, b.start_ts AS alarm_start, b.end_ts AS alarm_end,
  {utc_sql('b.start_ts')} AS alarm_start_text, {utc_sql('b.end_ts')} AS alarm_end_text, b.end_ts - b.start_ts AS bucket_duration, v.onset_bucket, v.onset_mle, v.winning_delta, o.start_ts AS window_start, {utc_sql('o.start_ts')} AS window_start_text,
  v.alarm_bucket - v.onset_bucket + 1 AS window_buckets, b.end_ts - o.start_ts AS window_duration, v.onset_bucket = 0 AS onset_at_start, v.onset_bucket < 20 AS onset_in_burn_in, v.direction, n.closed_time - b.end_ts AS lead_to_close,
  CAST(coalesce(w.w, v.max_statistic) AS BIGINT) AS statistic, CAST(16000000 AS BIGINT) AS threshold, n.closed_time, {utc_sql('n.closed_time')} AS closed_text
FROM t_verdicts v JOIN (SELECT p.condition_id, count(*) AS n_buckets, max(p.end_ts) + 3600 AS closed_time FROM t_plain p GROUP BY 1) n USING (condition_id) LEFT JOIN t_best w ON w.condition_id = v.condition_id AND w.channel = v.channel AND w.bucket_index = v.alarm_bucket
LEFT JOIN t_plain b ON b.condition_id = v.condition_id AND b.bucket_index = v.alarm_bucket LEFT JOIN t_plain o ON o.condition_id = v.condition_id AND o.bucket_index = v.onset_bucket"""),
    "replay_audit": query("SELECT condition_id, channel, 'row' AS field, CAST(1 AS BIGINT) AS now, CAST(0 AS BIGINT) AS frozen FROM t_verdicts WHERE condition_id = 'view' AND channel = 'wallet_hhi' UNION ALL SELECT condition_id, channel, 'max_statistic', max_statistic, max_statistic + 1 FROM t_verdicts WHERE condition_id = 'click'"),
    "winning_path": query("SELECT w.condition_id, w.channel, w.bucket_index, w.w AS w_winning, w.bucket_index = v.alarm_bucket AS at_alarm FROM t_walk w JOIN t_verdicts v ON w.condition_id = v.condition_id AND w.channel = v.channel AND w.delta = v.winning_delta AND w.side = v.direction WHERE v.alarmed"),
    "recall_bins": query(f"SELECT scope, bin, injection_mode AS mode, CAST(grouping(scope, bin, injection_mode) AS BIGINT) AS grouping, count(*) AS instances, {_METRICS} FROM (SELECT *, CASE WHEN injection_mode = 'wallet_only' THEN 'negative_control' ELSE 'all' END AS scope FROM v_found UNION ALL SELECT *, 'confirmatory' FROM v_found WHERE eligible AND injection_mode <> 'wallet_only') GROUP BY GROUPING SETS ((scope, bin, injection_mode), (scope, bin), (scope))"),
    "recall_rollup": query(f"SELECT level, injection_mode AS mode, CAST(grouping(level, injection_mode) AS BIGINT) AS grouping, count(*) AS instances, {_METRICS}, {', '.join(grid(f'CAST(count_if({m}) AS DOUBLE) / count(*)') + f' AS {m}_rate' for m in recall.METRICS)} FROM v_found WHERE injection_mode <> 'wallet_only' GROUP BY GROUPING SETS ((level, injection_mode), ())"),
    "background_minima": query(f"SELECT window_id, stream_id, level, pairs, {grid('min_p')} AS min_p, rejected FROM v_minima_mag"),
    "t_star": query(" UNION ALL ".join(f"SELECT '{leg}' AS leg, level, CAST(grouping(level) AS BIGINT) AS grouping, count(*) AS studies, CAST(sum(pairs) AS BIGINT) AS pairs, count_if(rejected) AS errors, count_if(min_p <= 1.0::DOUBLE / 21) AS at_floor, {grid('quantile_cont(min_p, 0.05)')} AS t_star, {grid('CAST(count_if(rejected) AS DOUBLE) / count(*)')} AS error_rate, CAST(count_if(rejected) AS DOUBLE) / count(*) <= 0.4::DOUBLE AS nominal_holds, quantile_cont(min_p, 0.05) <= 1.0::DOUBLE / 21 AS censored FROM v_minima_{leg} GROUP BY ROLLUP (level)" for leg in ("mag", "dir"))),
    "episode_dedup": query("SELECT membership_sha256, window_id, stream_id, injected, windows FROM (SELECT *, row_number() OVER (PARTITION BY membership_sha256 ORDER BY injected, window_id) AS place, count(*) OVER (PARTITION BY membership_sha256) AS windows FROM (SELECT d.*, EXISTS (SELECT 1 FROM v_truth t WHERE t.stream_id = d.stream_id) AS injected FROM v_digests d)) WHERE place = 1"),
    "duplicate_episodes": query("SELECT membership_sha256, string_agg(d.window_id, ',' ORDER BY d.window_id) AS windows, count(*) AS n, count(DISTINCT p.payload_sha256) = 1 AS identical_payload FROM v_digests d LEFT JOIN v_payload p USING (window_id) GROUP BY 1 HAVING count(*) > 1"),
    "study_leg_agreement": query("SELECT count(*) AS pairs, count_if(m AND d) AS both, count_if(m AND NOT d) AS mag_only, count_if(d AND NOT m) AS dir_only, count_if(NOT m AND NOT d) AS neither, count_if(m OR d) AS \"union\" FROM (SELECT coalesce(holm_mag_reject, false) AS m, coalesce(holm_dir_reject, false) AS d FROM v_study WHERE eligible)"),
    "top_sizes": query(f"{_top('e')} UNION ALL {_top('sign')}"),
    "slot_quantiles": query(f"SELECT count(*) AS pairs, {', '.join(grid(f'quantile_cont(n_slots, {q})') + f' AS {n}' for q, n in ((0.5, 'median'), (0.75, 'p75'), (0.9, 'p90'), (0.99, 'p99')))}, max(n_slots) AS most FROM v_study WHERE eligible"),
    "conditional_h0": query("SELECT stratum, count(DISTINCT window_id) AS windows, count_if(eligible) AS eligible_pairs, count_if(eligible AND headline_reject) AS rejected_pairs, count(DISTINCT CASE WHEN eligible AND headline_reject THEN stream_id END) AS streams_with_rejection, count_if(headline_reject AND injected) AS rejected_injected FROM v_spread GROUP BY 1"),
    "engine_rows": query("SELECT 'conservation' AS metric, count(*) AS instances, count_if(ok) AS count FROM (SELECT window_id, bool_and(abs(dfa - llr) < 1e-4::DOUBLE) AS ok FROM (SELECT l.window_id, l.bucket_index, sum(l.dfa) AS dfa, any_value(l.winning_delta * l.direction * p.z / 1e6::DOUBLE - l.winning_delta * l.winning_delta / 2) AS llr FROM xa_ledger l JOIN xa_path p ON p.condition_id = l.condition_id AND p.bucket_index = l.bucket_index GROUP BY 1, 2) GROUP BY 1) UNION ALL SELECT 'in_confirmatory_family', count(*), count_if(eligible) FROM v_found WHERE injection_mode <> 'wallet_only' UNION ALL SELECT 'orbit_reaches', count(*), count_if(reachable) FROM v_found WHERE injection_mode <> 'wallet_only' AND eligible"),
    "acceptance": query("SELECT 'union_recall' AS rule, coalesce(count_if(union_rejected), 0) AS count, count(*) AS of, coalesce(count_if(union_rejected), 0) >= 10 AS passed FROM v_found WHERE injection_mode <> 'wallet_only' AND eligible UNION ALL SELECT 'negative_control', coalesce(count_if(union_rejected), 0), count(*), coalesce(count_if(union_rejected), 0) = 0 FROM v_found WHERE injection_mode = 'wallet_only' UNION ALL SELECT 'direction_errors', coalesce(count_if(rejected), 0), count(*), coalesce(count_if(rejected), 0) <= 3 FROM v_minima_dir WHERE level = 'L2'"),
}
