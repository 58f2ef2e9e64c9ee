"""Transfer to other contracts, simulation, reports and streams over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import micro
from ..functions.shared import shared_dir
from ..operators import ledger, report, simulate, transfer
from ..sources import trades as source
from ..streaming import detector
from . import attribution as a
from . import detection as d
from .sql import grid, part, query


@d.shared
def bounds(spark, sf_dir):
    return transfer.bucket_bounds(d.bucketed(spark, sf_dir))


def grid_trades(spark, sf_dir):
    return source.on_grid(d.trades(spark, sf_dir))


@d.shared
def spans(spark, sf_dir):
    b = bounds(spark, sf_dir)
    return transfer.overlap_spans(transfer.intervals(a.windows(spark, sf_dir), b), b)


def own_spans(spark, sf_dir):
    w = a.windows(spark, sf_dir)
    return w.select("condition_id", F.expr("stack(2, onset_bucket, alarm_bucket, onset_mle, alarm_bucket) AS (first_bucket, last_bucket)")).distinct()


def overlap_windows(spark, sf_dir):
    return spans(spark, sf_dir)


def dedup_spans(spark, sf_dir):
    return transfer.without_tested(spans(spark, sf_dir), own_spans(spark, sf_dir)).select("window_id", "condition_id", "first_bucket", "last_bucket")


def placebo_spans(spark, sf_dir):
    sizes = bounds(spark, sf_dir).groupBy("condition_id").agg(F.count(F.lit(1)).alias("n_buckets"))
    return transfer.placebo_spans(spans(spark, sf_dir), own_spans(spark, sf_dir).union(spans(spark, sf_dir).select("condition_id", "first_bucket", "last_bucket")), sizes)


def exposure(spark, sf_dir):
    return transfer.exposures(spans(spark, sf_dir), d.bucketed(spark, sf_dir))


def lead_lag(spark, sf_dir):
    return transfer.lead_lag(a.windows(spark, sf_dir), bounds(spark, sf_dir))


def vwap_6h(spark, sf_dir):
    return report.vwap(grid_trades(spark, sf_dir), 21600)


def vwap_15m(spark, sf_dir):
    return report.vwap(grid_trades(spark, sf_dir), 900)


def hourly_volume_filled(spark, sf_dir):
    return report.volume_filled(grid_trades(spark, sf_dir), 3600)


def lorenz_curve(spark, sf_dir):
    return report.lorenz(grid_trades(spark, sf_dir)).select("condition_id", "active_wallet", "place", micro(F.col("share")).alias("share"))


def pre_post_imbalance(spark, sf_dir):
    return report.pre_post(d.bucketed(spark, sf_dir), a.windows(spark, sf_dir)).select("window_id", micro(F.col("before")).alias("before"), micro(F.col("inside")).alias("inside"))


def baseline_params(spark, sf_dir):
    return simulate.baseline_params(grid_trades(spark, sf_dir))


def _twice(c):
    return (F.col(c) * 2).cast("long").alias(c)


@d.shared
def fitted(spark, sf_dir):
    return simulate.fit_parameters(grid_trades(spark, sf_dir))


def fit_parameters(spark, sf_dir):
    kept = ("condition_id", "fit_rows", "holdout_rows", "shares_max", "n_wallets")
    real = ("rate", "p_long", "log_mu", "log_sigma", "p_round", "price_sigma", "top10_share", "top100_share", "top1000_share")
    return fitted(spark, sf_dir).select(*kept, _twice("price_init"), *[micro(F.col(c)).alias(c) for c in real])


def null_l0(spark, sf_dir):
    return simulate.null_trades(fitted(spark, sf_dir), grid_trades(spark, sf_dir), "L0")


def null_l1(spark, sf_dir):
    return simulate.null_trades(fitted(spark, sf_dir), grid_trades(spark, sf_dir), "L1")


def null_l2(spark, sf_dir):
    return simulate.null_bootstrap(grid_trades(spark, sf_dir))


def null_gate(spark, sf_dir):
    """The synthetic trades of all three levels as trade tables, under the trade table's own rules."""
    made = [f(spark, sf_dir).withColumn("condition_id", F.concat(F.lit(level), F.lit("~"), F.col("condition_id"))) for level, f in (("L0", null_l0), ("L1", null_l1), ("L2", null_l2))]
    rows = source.assert_schema(simulate.assembled(made[0].unionByName(made[1]).unionByName(made[2])))
    return ledger.trade_gate(rows)


def inject_tilt(spark, sf_dir):
    return simulate.inject_tilt(grid_trades(spark, sf_dir), 60).select("transaction_hash", "signed", "flipped")


def inject_size(spark, sf_dir):
    return simulate.inject_size(grid_trades(spark, sf_dir), 3).select("transaction_hash", "signed", "grown")


def inject_wallet(spark, sf_dir):
    return simulate.inject_wallet(grid_trades(spark, sf_dir), 25).select("transaction_hash", "active_wallet", "moved")


def inject_additive(spark, sf_dir):
    return simulate.inject_additive(grid_trades(spark, sf_dir), 1_000_000_007, 40)


def scenario_grid(spark, sf_dir):
    return simulate.scenario_grid(spark)


def _folder(spark):
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:8]}"


def _event_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return source.on_grid(source.event_trades(spark.readStream.schema(schema).parquet(path if path.endswith("/") else f"{sf_dir}/events*.parquet")))


def stream_cusum(spark, sf_dir):
    return detector.drained(detector.stream_detector(_event_stream(spark, sf_dir), size=d.SIZE, head=d.HEAD), _folder(spark))


def stream_cusum_trailing(spark, sf_dir):
    return detector.drained(detector.stream_detector(_event_stream(spark, sf_dir), size=d.SIZE, trailing=(30, 10)), _folder(spark))


def stream_vwap(spark, sf_dir):
    return detector.drained(detector.stream_vwap(_event_stream(spark, sf_dir)), _folder(spark))


QUERIES = {f.__name__: f for f in (overlap_windows, dedup_spans, placebo_spans, exposure, lead_lag, vwap_6h, vwap_15m, hourly_volume_filled, lorenz_curve, pre_post_imbalance, baseline_params, fit_parameters, null_l0, null_l1, null_l2, null_gate, inject_tilt, inject_size, inject_wallet, inject_additive, scenario_grid, stream_cusum, stream_cusum_trailing, stream_vwap)}

part("s_bounds", "SELECT condition_id, bucket_index, start_ts, end_ts FROM t_plain")
part("s_intervals", "SELECT w.window_id, w.condition_id AS source, w.direction, min(b.start_ts) AS lo, max(b.end_ts) AS hi FROM a_windows w JOIN s_bounds b ON b.condition_id = w.condition_id AND b.bucket_index BETWEEN w.onset_bucket AND w.alarm_bucket GROUP BY 1, 2, 3")
part("s_spans", "SELECT i.window_id, i.source, b.condition_id, i.direction, min(b.bucket_index) AS first_bucket, max(b.bucket_index) AS last_bucket FROM s_intervals i JOIN s_bounds b ON b.start_ts <= i.hi AND b.end_ts >= i.lo AND b.condition_id <> i.source GROUP BY 1, 2, 3, 4")
part("s_own", "SELECT condition_id, onset_bucket AS first_bucket, alarm_bucket AS last_bucket FROM a_windows UNION SELECT condition_id, onset_mle, alarm_bucket FROM a_windows")
part("s_blocked", "SELECT * FROM s_own UNION SELECT condition_id, first_bucket, last_bucket FROM s_spans")
part("s_tau", "SELECT condition_id, min(timestamp) + CAST(floor((max(timestamp) - min(timestamp)) * (35 + CAST('0x' || substr(sha256('1|tau|' || condition_id), 1, 7) AS BIGINT) % 36) / 100) AS BIGINT) AS tau FROM t_grid GROUP BY 1")
part("s_after", "SELECT g.*, t.tau, g.timestamp >= t.tau AS after FROM t_grid g JOIN s_tau t USING (condition_id)")
_u = lambda what, i="i": f"((CAST('0x' || substr(sha256('1|{what}|' || condition_id || '|' || CAST({i} AS VARCHAR)), 1, 7) AS BIGINT) + 0.5::DOUBLE) / 268435456::DOUBLE)"
_normal = lambda what: f"(sqrt(-2.0::DOUBLE * ln({_u(what + '1')})) * cos(6.283185307179586::DOUBLE * {_u(what + '2')}))"
part("s_fit", "SELECT g.*, g.timestamp <= c.fit_until AS fits FROM t_grid g JOIN (SELECT condition_id, min(timestamp) + CAST(floor((max(timestamp) - min(timestamp)) * 70 / 100) AS BIGINT) AS fit_until FROM t_grid GROUP BY 1) c USING (condition_id)")
part("s_steps", "SELECT condition_id, yes_price - lag(yes_price) OVER (PARTITION BY condition_id ORDER BY timestamp, transaction_hash) AS step FROM s_fit WHERE fits")
part("s_busy", "SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY n DESC, active_wallet) AS place FROM (SELECT condition_id, active_wallet, count(*) AS n FROM s_fit WHERE fits GROUP BY 1, 2)")
part("s_busiest", "SELECT condition_id, count(*) AS n_wallets, " + ", ".join(f"CASE WHEN count(*) >= {k} THEN CAST(sum(CASE WHEN place <= {k} THEN n END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) END AS top{k}_share" for k in (10, 100, 1000)) + " FROM s_busy GROUP BY 1")
part("s_params", """
SELECT f.condition_id, count_if(fits) AS fit_rows, count_if(NOT fits) AS holdout_rows, CAST(count_if(fits) - 1 AS DOUBLE) / greatest(max(CASE WHEN fits THEN timestamp END) - min(CASE WHEN fits THEN timestamp END), 1) AS rate,
  avg(CASE WHEN fits THEN CAST(signed > 0 AS INTEGER) END) AS p_long, avg(CASE WHEN fits THEN ln(shares / 1e6::DOUBLE) END) AS log_mu, stddev_samp(CASE WHEN fits THEN ln(shares / 1e6::DOUBLE) END) AS log_sigma, max(CASE WHEN fits THEN shares END) AS shares_max,
  avg(CASE WHEN fits THEN CAST(shares % 1000000 = 0 AS INTEGER) END) AS p_round, quantile_cont(CASE WHEN fits THEN CAST(yes_price AS DOUBLE) END, 0.5) AS price_init, any_value(s.price_sigma) AS price_sigma
FROM s_fit f JOIN (SELECT condition_id, stddev_samp(step) AS price_sigma FROM s_steps GROUP BY 1) s USING (condition_id) GROUP BY 1
""")
part("s_rows", "SELECT p.*, CAST(unnest(range(CAST(fit_rows AS BIGINT))) AS BIGINT) AS i FROM s_params p")
part("s_l0", f"SELECT *, 1700000000 + sum(CAST(floor(-ln({_u('gap')}) / rate * 1000) AS BIGINT)) OVER (PARTITION BY condition_id ORDER BY i ROWS UNBOUNDED PRECEDING) // 1000 AS timestamp FROM s_rows")
part("s_proposed", f"SELECT *, sum(CAST(floor(-ln({_u('gap')}) / (rate * 3) * 1000) AS BIGINT)) OVER (PARTITION BY condition_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS ms FROM (SELECT p.*, CAST(unnest(range(CAST(fit_rows * 10 + 200 AS BIGINT))) AS BIGINT) AS i FROM s_params p)")
part("s_thinned", f"SELECT * FROM s_proposed WHERE {_u('thin')} < (0.6::DOUBLE + 0.4::DOUBLE * sin(6.283185307179586::DOUBLE * (CAST(ms AS DOUBLE) / 1000.0::DOUBLE / 86400.0::DOUBLE))) * (0.4::DOUBLE + 1.6::DOUBLE * least(CAST(ms AS DOUBLE) / 1000.0::DOUBLE / (fit_rows / rate), 1.0::DOUBLE)) / 3.0::DOUBLE")
part("s_l1", "SELECT * EXCLUDE (i, ms, nth), nth - 1 AS i, 1700000000 + ms // 1000 AS timestamp FROM (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY i) AS nth FROM s_thinned) WHERE nth <= fit_rows")
part("s_place", "SELECT condition_id, active_wallet, row_number() OVER (PARTITION BY condition_id ORDER BY timestamp, transaction_hash) - 1 AS place FROM t_grid")


def _null(level: str) -> str:
    size = f"exp(log_mu + log_sigma * {_normal('size')})"
    return f"""
SELECT r.condition_id, CAST(r.timestamp AS BIGINT) AS timestamp, sha256('1|{level}|' || r.condition_id || '|' || CAST(r.i AS VARCHAR)) AS transaction_hash, w.active_wallet, CASE WHEN is_long = pick THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN pick THEN 'Yes' ELSE 'No' END AS outcome,
  r.shares, CASE WHEN is_long THEN r.shares ELSE -r.shares END AS signed, r.yes_price FROM (
  SELECT *, {_u('long')} < 0.5 AS is_long, {_u('pick')} < 0.5 AS pick, CAST(floor({_u('wallet')} * fit_rows) AS BIGINT) AS place,
    least(CAST(floor(CASE WHEN {_u('round')} < p_round THEN greatest(floor({size} + 0.5), 1.0::DOUBLE) ELSE {size} END * 1e6 + 0.5) AS BIGINT), shares_max) AS shares,
    CAST(greatest(1000, least(999000, CAST(floor(price_init) AS BIGINT) + sum(CAST(floor(price_sigma / 1e6::DOUBLE * {_normal('price')} * 1e6 + 0.5) AS BIGINT)) OVER (PARTITION BY condition_id ORDER BY i ROWS UNBOUNDED PRECEDING))) AS BIGINT) AS yes_price
  FROM s_{level.lower()}) r LEFT JOIN s_place w ON w.condition_id = r.condition_id AND w.place = r.place"""


part("s_calendar", "SELECT *, timestamp // 2700 AS calendar FROM t_grid")
part("s_groups", "SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY calendar) - 1 AS g, count(*) OVER (PARTITION BY condition_id) AS n FROM (SELECT condition_id, calendar, min(timestamp) AS begin_ts, max(timestamp) - min(timestamp) AS long FROM s_calendar GROUP BY 1, 2)")
part("s_picks", "SELECT condition_id, g AS j, CAST('0x' || substr(sha256('1|block|' || condition_id || '|' || CAST(g AS VARCHAR)), 1, 7) AS BIGINT) % n AS g FROM s_groups")
part("s_stamped", "SELECT p.condition_id, p.j, g.calendar, g.begin_ts, 1700000000 + coalesce(sum(g.long + 1) OVER (PARTITION BY p.condition_id ORDER BY p.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s_picks p JOIN s_groups g USING (condition_id, g)")
_vwap = lambda s: f"SELECT condition_id, timestamp // {s} * {s} AS start_ts, CAST(sum(shares) AS BIGINT) AS shares, CAST(floor(CAST(sum(CAST(yes_price AS HUGEINT) * shares) AS DOUBLE) / CAST(sum(shares) AS DOUBLE)) AS BIGINT) AS vwap FROM t_grid GROUP BY 1, 2 HAVING sum(shares) > 0"
ORACLE = {
    "overlap_windows": query("SELECT * FROM s_spans"),
    "dedup_spans": query("SELECT window_id, condition_id, first_bucket, last_bucket FROM s_spans s WHERE NOT EXISTS (SELECT 1 FROM s_own o WHERE o.condition_id = s.condition_id AND o.first_bucket = s.first_bucket AND o.last_bucket = s.last_bucket)"),
    "placebo_spans": query("""
SELECT window_id, condition_id, source_first, source_last, first_bucket, last_bucket FROM (SELECT *, row_number() OVER (PARTITION BY window_id, condition_id, source_first, source_last ORDER BY gap, side) AS place FROM (
  SELECT s.window_id, s.condition_id, s.first_bucket AS source_first, s.last_bucket AS source_last, g.range AS gap, e.side,
    CASE WHEN e.side = 0 THEN s.first_bucket - g.range - (s.last_bucket - s.first_bucket + 1) ELSE s.last_bucket + g.range + 1 END AS first_bucket,
    CASE WHEN e.side = 0 THEN s.first_bucket - g.range - 1 ELSE s.last_bucket + g.range + 1 + s.last_bucket - s.first_bucket END AS last_bucket, n.n_buckets
  FROM s_spans s JOIN (SELECT condition_id, count(*) AS n_buckets FROM s_bounds GROUP BY 1) n USING (condition_id) CROSS JOIN range(1000) g CROSS JOIN (VALUES (0), (1)) AS e(side) WHERE g.range < n.n_buckets) c
  WHERE first_bucket >= 0 AND last_bucket < n_buckets AND NOT EXISTS (SELECT 1 FROM s_blocked b WHERE b.condition_id = c.condition_id AND c.first_bucket <= b.last_bucket AND c.last_bucket >= b.first_bucket)) WHERE place = 1"""),
    "exposure": query("SELECT window_id, condition_id, active_wallet, n, e, -e AS mirror, row_number() OVER (PARTITION BY window_id, condition_id ORDER BY e DESC, first, active_wallet) AS rank_e FROM (SELECT s.window_id, b.condition_id, b.active_wallet, count(*) AS n, CAST(sum(s.direction * b.signed) AS BIGINT) AS e, min((b.timestamp, b.transaction_hash)) AS first FROM t_bucketed b JOIN s_spans s ON b.condition_id = s.condition_id AND b.bucket_index BETWEEN s.first_bucket AND s.last_bucket GROUP BY 1, 2, 3)"),
    "lead_lag": query("SELECT w.window_id, b.end_ts AS available_ts, b.end_ts - min(b.end_ts) OVER () AS seconds_after_first FROM a_windows w JOIN s_bounds b ON b.condition_id = w.condition_id AND b.bucket_index = w.alarm_bucket"),
    "vwap_6h": query(_vwap(21600)),
    "vwap_15m": query(_vwap(900)),
    "hourly_volume_filled": query("SELECT e.condition_id, e.slot * 3600 AS start_ts, CAST(coalesce(sum(g.shares), 0) AS BIGINT) AS shares FROM (SELECT condition_id, unnest(range(min(timestamp // 3600), max(timestamp // 3600) + 1)) AS slot FROM t_grid GROUP BY 1) e LEFT JOIN t_grid g ON g.condition_id = e.condition_id AND g.timestamp // 3600 = e.slot GROUP BY 1, 2"),
    "lorenz_curve": query(f"SELECT condition_id, active_wallet, place, {grid('CAST(run AS DOUBLE) / CAST(total AS DOUBLE)')} AS share FROM (SELECT *, row_number() OVER w AS place, sum(shares) OVER (PARTITION BY condition_id ORDER BY shares DESC, active_wallet ROWS UNBOUNDED PRECEDING) AS run, sum(shares) OVER (PARTITION BY condition_id) AS total FROM (SELECT condition_id, active_wallet, sum(shares) AS shares FROM t_grid GROUP BY 1, 2) WINDOW w AS (PARTITION BY condition_id ORDER BY shares DESC, active_wallet))"),
    "pre_post_imbalance": query(f"SELECT window_id, {grid('before')} AS before, {grid('inside')} AS inside FROM (SELECT w.window_id, CAST(sum(CASE WHEN b.bucket_index < w.onset_bucket THEN signed END) AS DOUBLE) / CAST(nullif(sum(CASE WHEN b.bucket_index < w.onset_bucket THEN abs(signed) END), 0) AS DOUBLE) AS before, CAST(sum(CASE WHEN b.bucket_index >= w.onset_bucket THEN signed END) AS DOUBLE) / CAST(nullif(sum(CASE WHEN b.bucket_index >= w.onset_bucket THEN abs(signed) END), 0) AS DOUBLE) AS inside FROM t_bucketed b JOIN a_windows w ON b.condition_id = w.condition_id AND b.bucket_index <= w.alarm_bucket GROUP BY 1)"),
    "baseline_params": query("SELECT g.condition_id, c.fit_until, count(*) AS n_fit, count(DISTINCT active_wallet) AS n_wallets, count_if(signed > 0) AS n_long, CAST(sum(shares) AS BIGINT) AS shares FROM t_grid g JOIN (SELECT condition_id, min(timestamp) + CAST(floor((max(timestamp) - min(timestamp)) * 7 / 10) AS BIGINT) AS fit_until FROM t_grid GROUP BY 1) c ON g.condition_id = c.condition_id AND g.timestamp <= c.fit_until GROUP BY 1, 2"),
    "stream_cusum": query("SELECT b.condition_id, b.bucket_index, p.end_ts, s.x, s.z, CAST(b.w AS BIGINT) AS statistic, b.side AS direction, b.onset, b.w >= 16000000 AS alarmed, coalesce(b.bucket_index = r.alarm_bucket, false) AS first_alarm, CAST(0 AS BIGINT) AS n_late FROM t_best b JOIN t_standard s ON s.condition_id = b.condition_id AND s.channel = b.channel AND s.bucket_index = b.bucket_index JOIN t_plain p ON p.condition_id = b.condition_id AND p.bucket_index = b.bucket_index JOIN t_runs r ON r.condition_id = b.condition_id AND r.channel = b.channel WHERE b.channel = 'imbalance' AND p.n_trades = 20"),
    "stream_cusum_trailing": query("SELECT b.condition_id, b.bucket_index, p.end_ts, s.x, s.z, CAST(b.w AS BIGINT) AS statistic, b.side AS direction, b.onset, b.w >= 16000000 AS alarmed, coalesce(b.bucket_index = r.alarm_bucket, false) AS first_alarm, CAST(0 AS BIGINT) AS n_late FROM a_trail_best b JOIN t_trailing_z s ON s.condition_id = b.condition_id AND s.channel = b.channel AND s.bucket_index = b.bucket_index JOIN t_plain p ON p.condition_id = b.condition_id AND p.bucket_index = b.bucket_index JOIN a_trail_runs r ON r.condition_id = b.condition_id AND r.channel = b.channel WHERE b.channel = 'imbalance' AND p.n_trades = 20"),
    "fit_parameters": query("SELECT p.condition_id, fit_rows, holdout_rows, shares_max, n_wallets, CAST(price_init * 2 AS BIGINT) AS price_init, " + ", ".join(f"{grid(c)} AS {c}" for c in ("rate", "p_long", "log_mu", "log_sigma", "p_round", "price_sigma", "top10_share", "top100_share", "top1000_share")) + " FROM s_params p JOIN s_busiest b USING (condition_id)"),
    "null_l0": query(_null("L0")),
    "null_l1": query(_null("L1")),
    "null_l2": query("SELECT c.condition_id, CAST(s.start + c.timestamp - s.begin_ts AS BIGINT) AS timestamp, sha256('1|tx|' || CAST(s.j AS VARCHAR) || '|' || c.transaction_hash) AS transaction_hash, '0x' || substr(sha256('1|wallet|' || c.active_wallet), 1, 40) AS active_wallet, side, outcome, shares, signed, yes_price FROM s_calendar c JOIN s_stamped s USING (condition_id, calendar)"),
    "scenario_grid": "SELECT CASE WHEN m.mode = 'null' THEN l.level || '_null_' || CAST(s.range AS VARCHAR) ELSE l.level || '_' || m.mode || '_' || o.outcome || '_' || CAST(s.range AS VARCHAR) END AS scenario_id, l.level, m.mode, CASE WHEN m.mode <> 'null' THEN o.outcome END AS outcome, s.range AS seed FROM (VALUES ('L0'), ('L1'), ('L2')) AS l(level) CROSS JOIN (VALUES ('null'), ('additive'), ('direction_tilt'), ('size_tilt'), ('wallet_only')) AS m(mode) CROSS JOIN (VALUES ('Yes'), ('No')) AS o(outcome) CROSS JOIN range(4) s WHERE m.mode <> 'null' OR o.outcome = 'Yes'",
    "inject_tilt": query("SELECT transaction_hash, CASE WHEN flipped THEN -signed ELSE signed END AS signed, flipped FROM (SELECT *, candidate AND row_number() OVER (PARTITION BY condition_id, candidate ORDER BY sha256('1|tilt|' || transaction_hash), transaction_hash) <= floor(count(*) OVER (PARTITION BY condition_id, candidate) * 60 / 100) AS flipped FROM (SELECT *, after AND signed < 0 AS candidate FROM s_after))"),
    "inject_size": query("SELECT transaction_hash, CASE WHEN after AND signed > 0 THEN signed * 3 ELSE signed END AS signed, after AND signed > 0 AS grown FROM s_after"),
    "inject_wallet": query("SELECT transaction_hash, CASE WHEN moved THEN 'informed' ELSE active_wallet END AS active_wallet, moved FROM (SELECT *, after AND row_number() OVER (PARTITION BY condition_id, after ORDER BY sha256('1|wallet|' || transaction_hash), transaction_hash) <= floor(count(*) OVER (PARTITION BY condition_id, after) * 25 / 100) AS moved FROM s_after)"),
    "inject_additive": query("SELECT condition_id, timestamp, transaction_hash, active_wallet, shares, signed FROM t_grid UNION ALL SELECT t.condition_id, t.tau + CAST(floor((m.last_ts - t.tau) * i.range / 40) AS BIGINT), 'x' || t.condition_id || CAST(i.range AS VARCHAR), 'informed', CASE WHEN i.range = 39 THEN 25000007 ELSE 25000000 END + 0 * i.range, CASE WHEN i.range = 39 THEN 25000007 ELSE 25000000 END + 0 * i.range FROM s_tau t JOIN (SELECT condition_id, max(timestamp) AS last_ts FROM t_grid GROUP BY 1) m USING (condition_id) CROSS JOIN range(40) i"),
}
