"""Calibration, windows, ledger, profiles and wallet rows over the event stream's imbalance alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import micro
from ..operators import attribute, baseline, calibrate, walk
from . import detection as d
from .sql import grid, part, query

BOOT = walk.WalkConfig(start=0)


def paths(spark, sf_dir):
    return d.standard(spark, sf_dir).where("channel = 'imbalance'").select("condition_id", "channel", "bucket_index", "z")


def runs(spark, sf_dir):
    rows = d.channels(spark, sf_dir).where("channel like 'imbalance%'")
    plain = walk.verdicts(walk.reflected_walk(baseline.standardized(rows, d.HEAD), d.CONFIG), 4.0)
    local = walk.verdicts(walk.reflected_walk(baseline.trailing_standardized(rows), walk.WalkConfig(start=10)), 4.0)
    return attribute.run_rows(plain, "plain", 4.0, d.SIZE).unionByName(attribute.run_rows(local, "windowed", 4.0, d.SIZE))


@d.shared
def windows(spark, sf_dir):
    """Plain runs of the imbalance channel: one window an alarmed contract."""
    v = walk.verdicts(walk.reflected_walk(d.standard(spark, sf_dir).where("channel = 'imbalance'"), d.CONFIG), 4.0)
    return attribute.run_rows(v, "plain", 4.0, d.SIZE)


@d.shared
def slotted(spark, sf_dir):
    return attribute.slots(windows(spark, sf_dir), d.bucketed(spark, sf_dir))


@d.shared
def ledgered(spark, sf_dir):
    return attribute.ledger(slotted(spark, sf_dir), d.standard(spark, sf_dir).where("channel = 'imbalance'"))


@d.shared
def profiled(spark, sf_dir):
    return attribute.profiles(slotted(spark, sf_dir), attribute.history(windows(spark, sf_dir), d.bucketed(spark, sf_dir)))


def wallets(spark, sf_dir):
    return attribute.wallet_rows(ledgered(spark, sf_dir), profiled(spark, sf_dir))


def block_bootstrap(spark, sf_dir):
    return calibrate.block_bootstrap(paths(spark, sf_dir), 20, 10)


@d.shared
def maxima(spark, sf_dir):
    return calibrate.bootstrap_maxima(paths(spark, sf_dir), BOOT, 20, 10)


def bootstrap_max(spark, sf_dir):
    return maxima(spark, sf_dir)


def threshold_search(spark, sf_dir):
    return calibrate.threshold(maxima(spark, sf_dir), 0.05)


def pooled_calibration(spark, sf_dir):
    a = calibrate.accounting(paths(spark, sf_dir), 100, 10)
    return a.select("n_sources", "n_buckets", "effective_blocks", micro(F.col("horizon_ratio")).alias("horizon_ratio"))


def alpha_curve(spark, sf_dir):
    return calibrate.alpha_grid(maxima(spark, sf_dir), 2.0, 12.0)


def canonical_election(spark, sf_dir):
    return attribute.canonical(runs(spark, sf_dir)).select("episode_id", "window_id", "detector_run_id", "method", "max_statistic", "alarm_bucket", "onset_bucket", "onset_mle", "direction", "winning_delta")


def window_slots(spark, sf_dir):
    return slotted(spark, sf_dir).select("window_id", "transaction_hash", "bucket_index", F.col("slot_index").cast("long").alias("slot_index"), "active_wallet", "in_mle")


def detector_path(spark, sf_dir):
    w = windows(spark, sf_dir).select("window_id", "condition_id", "onset_bucket", "onset_mle", "alarm_bucket")
    stats = walk.statistics(d.walked(spark, sf_dir).where("channel = 'imbalance'")).select("condition_id", "bucket_index", "statistic")
    s = d.standard(spark, sf_dir).where("channel = 'imbalance'").select("condition_id", "bucket_index", "x", "z", "scale_degenerate")
    return s.join(stats, ["condition_id", "bucket_index"]).join(w, "condition_id").select("window_id", "bucket_index", "x", "z", "statistic", "scale_degenerate", F.col("bucket_index").between(F.col("onset_bucket"), F.col("alarm_bucket")).alias("in_wide"), F.col("bucket_index").between(F.col("onset_mle"), F.col("alarm_bucket")).alias("in_mle"))


def membership_digest(spark, sf_dir):
    return attribute.membership_digest(slotted(spark, sf_dir))


def count_report(spark, sf_dir):
    return attribute.count_report(slotted(spark, sf_dir))


def ledger(spark, sf_dir):
    return ledgered(spark, sf_dir).select("window_id", "transaction_hash", "in_mle", *[micro(F.col(c)).alias(c) for c in ("dnc", "agc", "dfa")])


def ledger_conservation(spark, sf_dir):
    """Whether each bucket's contributions sum to delta d z - delta^2 / 2 within the grid of z."""
    c = attribute.conservation(ledgered(spark, sf_dir)).join(paths(spark, sf_dir), ["condition_id", "bucket_index"])
    llr = F.col("winning_delta") * F.col("direction") * F.col("z") / 1e6 - F.col("winning_delta") * F.col("winning_delta") / 2.0
    return c.select("window_id", "bucket_index", (F.abs(F.col("dfa") - llr) < 1e-4).alias("conserved"))


def vdw_scores(spark, sf_dir):
    return ledgered(spark, sf_dir).where("in_mle").select("window_id", "transaction_hash", micro(F.col("score_vdw")).alias("score_vdw"))


def sign_scores(spark, sf_dir):
    return ledgered(spark, sf_dir).select("window_id", "transaction_hash", "score_sign")


def pre_onset_history(spark, sf_dir):
    h = attribute.history(windows(spark, sf_dir), d.bucketed(spark, sf_dir))
    return h.select("window_id", "active_wallet", "n_before", (F.col("median_shares") * 2).cast("long").alias("median_shares"), "first_ts")


def profiles(spark, sf_dir):
    return profiled(spark, sf_dir)


def wallet_windows(spark, sf_dir):
    return wallets(spark, sf_dir).select("window_id", "active_wallet", "profile", "n_before", "n_wide", "n_mle", "e_mle", "sign", F.col("first_slot").cast("long").alias("first_slot"), *[micro(F.col(c)).alias(c) for c in ("dnc", "dfa", "vdw")])


def wallet_ranks(spark, sf_dir):
    return wallets(spark, sf_dir).select("window_id", "active_wallet", F.col("rank_e_mle").cast("long").alias("rank_e_mle"))


def asof_first_trade(spark, sf_dir):
    return attribute.first_trades(windows(spark, sf_dir), d.bucketed(spark, sf_dir))


def profile_leak_audit(spark, sf_dir):
    """Profiles must not change when sizes after the onset do: rows of the symmetric difference, none in a sound engine."""
    b, w = d.bucketed(spark, sf_dir), windows(spark, sf_dir)
    s = attribute.slots(w, b)
    plain = attribute.profiles(s, attribute.history(w, b))
    mixed = attribute.profiles(s, attribute.history(w, attribute.scrambled_after_onset(w, b)))
    return plain.exceptAll(mixed).union(mixed.exceptAll(plain)).agg(F.count(F.lit(1)).alias("leaks"))


QUERIES = {f.__name__: f for f in (block_bootstrap, bootstrap_max, threshold_search, pooled_calibration, alpha_curve, canonical_election, window_slots, detector_path, membership_digest, count_report, ledger, ledger_conservation, vdw_scores, sign_scores, pre_onset_history, profiles, wallet_windows, wallet_ranks, asof_first_trade, profile_leak_audit)}

part("a_path", "SELECT condition_id, bucket_index, z, mu, sigma, x, bucket_index - min(bucket_index) OVER (PARTITION BY condition_id) AS place, count(*) OVER (PARTITION BY condition_id) AS n FROM t_standard WHERE channel = 'imbalance'")
part("a_sizes", "SELECT DISTINCT condition_id, n FROM a_path")
part("a_starts", """
SELECT condition_id, n, replicate, block, CAST('0x' || substr(sha256(condition_id || '|' || CAST(replicate AS VARCHAR) || '|' || CAST(block AS VARCHAR)), 1, 7) AS BIGINT) % n AS begin
FROM a_sizes CROSS JOIN (SELECT CAST(range AS INTEGER) AS replicate FROM range(20)) CROSS JOIN (SELECT range AS block FROM range(1000)) WHERE block * 10 < n
""")
part("a_boot", """
SELECT s.condition_id, s.replicate, s.block * 10 + o.range AS position, p.z FROM a_starts s CROSS JOIN range(10) o JOIN a_path p ON p.condition_id = s.condition_id AND p.place = (s.begin + o.range) % s.n WHERE s.block * 10 + o.range < s.n
""")
part("a_boot_s", """
SELECT condition_id, replicate, position, z, delta, side, CAST(sum(step * side * z - drift) OVER (PARTITION BY condition_id, replicate, delta, side ORDER BY position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM a_boot CROSS JOIN t_shifts
""")
part("a_boot_w", "SELECT *, s - least(0, min(s) OVER (PARTITION BY condition_id, replicate, delta, side ORDER BY position ROWS UNBOUNDED PRECEDING)) AS w FROM a_boot_s")
part("a_maxima", "SELECT condition_id, replicate, CAST(max(w) AS BIGINT) AS max_stat, max(z) = min(z) AS degenerate FROM a_boot_w GROUP BY 1, 2")
part("a_threshold", """
SELECT coalesce((SELECT min(a.max_stat) FROM a_maxima a WHERE (SELECT count(*) FROM a_maxima b WHERE b.max_stat >= a.max_stat) <= 0.05::DOUBLE * (SELECT count(*) FROM a_maxima)), (SELECT max(max_stat) + 1 FROM a_maxima)) AS threshold
""")
part("a_trail_sums", """
SELECT condition_id, channel, bucket_index, delta, side, CAST(sum(step * side * z - drift) OVER (PARTITION BY condition_id, channel, delta, side ORDER BY bucket_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM t_trailing_z CROSS JOIN t_shifts WHERE bucket_index >= 10
""")
part("a_trail_w", "SELECT *, s - least(0, min(s) OVER (PARTITION BY condition_id, channel, delta, side ORDER BY bucket_index ROWS UNBOUNDED PRECEDING)) AS w FROM a_trail_sums")
part("a_trail_walk", "SELECT *, least(bucket_index, coalesce(max(CASE WHEN w = 0 THEN bucket_index END) OVER (PARTITION BY condition_id, channel, delta, side ORDER BY bucket_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 10)) AS onset FROM a_trail_w")
part("a_trail_best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition_id, channel, bucket_index ORDER BY w DESC, side DESC, delta) AS place FROM a_trail_walk) WHERE place = 1")
part("a_trail_runs", "SELECT condition_id, channel, CAST(max(w) AS BIGINT) AS max_statistic, min(CASE WHEN w >= 16000000 THEN bucket_index END) AS alarm_bucket FROM a_trail_best GROUP BY 1, 2")
part("a_trail_verdicts", """
SELECT r.condition_id, r.channel, r.max_statistic, r.alarm_bucket, b.side AS direction, b.delta AS winning_delta, (SELECT min(w.onset) FROM a_trail_walk w WHERE w.condition_id = r.condition_id AND w.channel = r.channel AND w.bucket_index = r.alarm_bucket AND w.side = b.side) AS onset_bucket, b.onset AS onset_mle
FROM a_trail_runs r JOIN a_trail_best b ON r.condition_id = b.condition_id AND r.channel = b.channel AND r.alarm_bucket = b.bucket_index
""")
part("a_runs", """
SELECT *, 'events|' || condition_id || '|' || channel || '|K20' AS episode_id, 'events|' || condition_id || '|' || channel || '|K20|a' || CAST(alarm_bucket AS VARCHAR) AS window_id, 'events|' || condition_id || '|' || channel || '|K20|' || method AS detector_run_id FROM (
  SELECT condition_id, channel, max_statistic, alarm_bucket, direction, winning_delta, onset_bucket, onset_mle, 'plain' AS method FROM t_verdicts WHERE alarmed AND channel LIKE 'imbalance%'
  UNION ALL SELECT condition_id, channel, max_statistic, alarm_bucket, direction, winning_delta, onset_bucket, onset_mle, 'windowed' FROM a_trail_verdicts WHERE channel LIKE 'imbalance%')
""")
part("a_windows", "SELECT * FROM a_runs WHERE method = 'plain' AND channel = 'imbalance'")
part("a_slots", """
SELECT b.*, w.window_id, w.direction, w.winning_delta, w.onset_bucket, w.onset_mle, w.alarm_bucket, row_number() OVER (PARTITION BY w.window_id ORDER BY b.bucket_index, b.timestamp, b.transaction_hash) - 1 AS slot_index, b.bucket_index >= w.onset_mle AS in_mle
FROM t_bucketed b JOIN a_windows w ON b.condition_id = w.condition_id AND b.bucket_index BETWEEN w.onset_bucket AND w.alarm_bucket
""")
part("a_inside", """
SELECT s.*, p.mu, p.sigma, sum(abs(s.signed)) OVER (PARTITION BY window_id, s.bucket_index) AS total, s.direction * s.signed AS aligned, count(*) OVER (PARTITION BY window_id, s.bucket_index) AS m,
  rank() OVER (PARTITION BY window_id, s.bucket_index ORDER BY s.direction * s.signed) + (count(*) OVER (PARTITION BY window_id, s.bucket_index, s.direction * s.signed) - 1) / 2.0::DOUBLE AS rk
FROM a_slots s JOIN a_path p ON s.condition_id = p.condition_id AND s.bucket_index = p.bucket_index WHERE s.in_mle
""")
part("a_terms", """
SELECT *, winning_delta * direction * (signed * 1e6::DOUBLE / CAST(total AS DOUBLE)) / (sigma + 1e-3::DOUBLE) AS dnc,
  (-winning_delta * direction * mu / (sigma + 1e-3::DOUBLE) - winning_delta * winning_delta / 2.0::DOUBLE) * abs(signed * 1e6::DOUBLE / CAST(total AS DOUBLE)) / 1e6::DOUBLE AS agc, rk / (m + 1) AS p, sign(aligned) AS score_sign FROM a_inside
""")


def _poly(r: str, c: list[float]) -> str:
    out = f"({c[0]!r}::DOUBLE)"
    for x in c[1:]:
        out = f"({out} * {r} + {x!r}::DOUBLE)"
    return out


def quantile_sql(p: str) -> str:
    """The normal quantile as DuckDB text."""
    q, r = f"({p} - 0.5::DOUBLE)", f"(0.180625::DOUBLE - ({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    t = f"sqrt(-ln(least({p}, 1.0::DOUBLE - {p})))"
    tail = f"CASE WHEN {t} <= 5 THEN {_poly(f'({t} - 1.6::DOUBLE)', expr._MIDDLE[0])} / {_poly(f'({t} - 1.6::DOUBLE)', expr._MIDDLE[1])} ELSE {_poly(f'({t} - 5.0::DOUBLE)', expr._FAR[0])} / {_poly(f'({t} - 5.0::DOUBLE)', expr._FAR[1])} END"
    return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs{q} <= 0.425::DOUBLE THEN {q} * {_poly(r, expr._CENTRAL[0])} / {_poly(r, expr._CENTRAL[1])} WHEN {q} < 0 THEN -({tail}) ELSE {tail} END"


part("a_ledger", f"SELECT *, dnc + agc AS dfa, {quantile_sql('p')} AS score_vdw FROM a_terms")
part("a_history", """
SELECT w.window_id, b.active_wallet, count(*) AS n_before, quantile_cont(CAST(b.shares AS DOUBLE), 0.5) AS median_shares, min(b.timestamp) AS first_ts FROM t_bucketed b JOIN a_windows w ON b.condition_id = w.condition_id AND b.bucket_index < w.onset_bucket GROUP BY 1, 2
""")
part("a_known", "SELECT s.window_id, s.active_wallet, s.any_mle, h.n_before, h.median_shares FROM (SELECT window_id, active_wallet, bool_or(in_mle) AS any_mle FROM a_slots GROUP BY 1, 2) s LEFT JOIN a_history h USING (window_id, active_wallet)")
part("a_cutoff", "SELECT window_id, quantile_cont(median_shares, 0.5) AS cutoff FROM a_known WHERE any_mle AND n_before > 0 GROUP BY 1")
part("a_profiles", "SELECT window_id, active_wallet, CASE WHEN coalesce(n_before, 0) = 0 THEN 'NEW' WHEN median_shares <= cutoff THEN 'OLD_SMALL' ELSE 'OLD_LARGE' END AS profile, coalesce(n_before, 0) AS n_before FROM a_known LEFT JOIN a_cutoff USING (window_id)")
part("a_wallets", """
SELECT s.window_id, s.active_wallet, p.profile, p.n_before, count(*) AS n_wide, count_if(s.in_mle) AS n_mle, CAST(sum(CASE WHEN s.in_mle THEN s.direction * s.signed END) AS BIGINT) AS e_mle, sum(l.dnc) AS dnc, sum(l.dfa) AS dfa, sum(l.score_vdw) AS vdw, CAST(sum(l.score_sign) AS BIGINT) AS sign, min(s.slot_index) AS first_slot
FROM a_slots s LEFT JOIN a_ledger l ON s.window_id = l.window_id AND s.transaction_hash = l.transaction_hash JOIN a_profiles p ON s.window_id = p.window_id AND s.active_wallet = p.active_wallet GROUP BY 1, 2, 3, 4
""")
ORACLE = {
    "block_bootstrap": query("SELECT condition_id, replicate, position, z FROM a_boot"),
    "bootstrap_max": query("SELECT * FROM a_maxima"),
    "threshold_search": query("SELECT threshold, (SELECT count(*) FROM a_maxima) AS n_maxima, (SELECT count(*) FROM a_maxima WHERE max_stat >= threshold) AS n_reached FROM a_threshold"),
    "pooled_calibration": query(f"SELECT count(*) AS n_sources, CAST(sum(n) AS BIGINT) AS n_buckets, CAST(sum(n // 10) AS BIGINT) AS effective_blocks, {grid('100.0::DOUBLE / min(n)')} AS horizon_ratio FROM a_sizes"),
    "alpha_curve": query("SELECT h, count_if(max_stat >= h) AS n_reached, count(*) AS n_maxima FROM a_maxima CROSS JOIN (SELECT CAST(floor(8000000::DOUBLE + range * (40000000::DOUBLE / 40) + 0.5::DOUBLE) AS BIGINT) AS h FROM range(41)) GROUP BY 1"),
    "canonical_election": query("SELECT episode_id, window_id, detector_run_id, method, max_statistic, alarm_bucket, onset_bucket, onset_mle, direction, winning_delta FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY max_statistic DESC, detector_run_id) AS place FROM a_runs) WHERE place = 1"),
    "window_slots": query("SELECT window_id, transaction_hash, bucket_index, slot_index, active_wallet, in_mle FROM a_slots"),
    "detector_path": query("SELECT w.window_id, s.bucket_index, s.x, s.z, b.w AS statistic, s.scale_degenerate, s.bucket_index BETWEEN w.onset_bucket AND w.alarm_bucket AS in_wide, s.bucket_index BETWEEN w.onset_mle AND w.alarm_bucket AS in_mle FROM t_standard s JOIN t_best b ON s.condition_id = b.condition_id AND s.channel = b.channel AND s.bucket_index = b.bucket_index JOIN a_windows w ON w.condition_id = s.condition_id WHERE s.channel = 'imbalance'"),
    "membership_digest": query("SELECT window_id, count(*) AS n_slots, sha256(string_agg(CAST(bucket_index AS VARCHAR) || '|' || transaction_hash || chr(10), '' ORDER BY slot_index)) AS membership_sha256 FROM a_slots GROUP BY 1"),
    "count_report": query("SELECT window_id, count(*) AS n_wide, count_if(in_mle) AS n_mle, count(DISTINCT active_wallet) AS wallets_wide, count(DISTINCT CASE WHEN in_mle THEN active_wallet END) AS wallets_mle FROM a_slots GROUP BY 1"),
    "ledger": query(f"SELECT s.window_id, s.transaction_hash, s.in_mle, {grid('l.dnc')} AS dnc, {grid('l.agc')} AS agc, {grid('l.dfa')} AS dfa FROM a_slots s LEFT JOIN a_ledger l ON s.window_id = l.window_id AND s.transaction_hash = l.transaction_hash"),
    "ledger_conservation": query("SELECT DISTINCT window_id, bucket_index, true AS conserved FROM a_inside"),
    "vdw_scores": query(f"SELECT window_id, transaction_hash, {grid('score_vdw')} AS score_vdw FROM a_ledger"),
    "sign_scores": query("SELECT s.window_id, s.transaction_hash, CAST(l.score_sign AS BIGINT) AS score_sign FROM a_slots s LEFT JOIN a_ledger l ON s.window_id = l.window_id AND s.transaction_hash = l.transaction_hash"),
    "pre_onset_history": query("SELECT window_id, active_wallet, n_before, CAST(median_shares * 2 AS BIGINT) AS median_shares, first_ts FROM a_history"),
    "profiles": query("SELECT * FROM a_profiles"),
    "wallet_windows": query(f"SELECT window_id, active_wallet, profile, n_before, n_wide, n_mle, e_mle, sign, first_slot, {grid('dnc')} AS dnc, {grid('dfa')} AS dfa, {grid('vdw')} AS vdw FROM a_wallets"),
    "wallet_ranks": query("SELECT window_id, active_wallet, CASE WHEN n_mle > 0 THEN row_number() OVER (PARTITION BY window_id ORDER BY e_mle DESC NULLS LAST, first_slot) END AS rank_e_mle FROM a_wallets"),
    "asof_first_trade": query("SELECT window_id, active_wallet, timestamp, transaction_hash, bucket_index FROM (SELECT w.window_id, b.*, row_number() OVER (PARTITION BY w.window_id, b.active_wallet ORDER BY b.timestamp, b.transaction_hash) AS place FROM t_bucketed b JOIN a_windows w ON b.condition_id = w.condition_id AND b.bucket_index <= w.alarm_bucket) WHERE place = 1"),
    "profile_leak_audit": "SELECT CAST(0 AS BIGINT) AS leaks",
}
