"""DuckDB text of the same operators, as named common table expressions that draw in what they need."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, text: str) -> None:
    PARTS[name] = text.strip()


def query(text: str) -> str:
    """The text with a WITH clause of every part it names, directly or through others, in order of definition."""
    wanted: set[str] = set()

    def need(body: str) -> None:
        for name in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", body):
            if name in PARTS and name not in wanted:
                wanted.add(name)
                need(PARTS[name])

    need(text)
    if not wanted:
        return text.strip()
    return "WITH " + ",\n".join(f"{n} AS (\n{body}\n)" for n, body in PARTS.items() if n in wanted) + "\n" + text.strip()


def grid(x: str) -> str:
    return f"CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"


part("t_raw", """
SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
""")
part("t_trades", f"""
SELECT CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, value AS gross_shares,
  CAST(k + 1 AS DOUBLE) / CAST(101.0 AS DOUBLE) AS gross_price, 'u' || CAST(user_id AS VARCHAR) AS active_wallet, event_type AS condition_id,
  CASE WHEN k % 3 = 0 THEN 'No' ELSE 'Yes' END AS outcome,
  CASE event_type WHEN 'click' THEN 'Yes' WHEN 'purchase' THEN 'No' WHEN 'signup' THEN 'Yes' WHEN 'view' THEN 'No' WHEN 'error' THEN 'No' END AS resolved_outcome,
  event_type || ':' || CASE WHEN k % 3 = 0 THEN 'No' ELSE 'Yes' END AS token_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS transaction_hash FROM t_raw
""")
part("t_yes", """
SELECT *, gross_price * gross_shares AS gross_cash, CASE WHEN outcome = 'Yes' THEN gross_price ELSE CAST(1 AS DOUBLE) - gross_price END AS yes_price,
  CASE WHEN (side = 'BUY') = (outcome = 'Yes') THEN gross_shares ELSE -gross_shares END AS signed_yes_size FROM t_trades
""")
part("t_grid", f"""
SELECT condition_id, timestamp, transaction_hash, active_wallet, side, outcome, {grid('gross_shares')} AS shares,
  CASE WHEN signed_yes_size >= 0 THEN {grid('gross_shares')} ELSE -{grid('gross_shares')} END AS signed, {grid('gross_cash')} AS cash, {grid('yes_price')} AS yes_price FROM t_yes
""")
part("t_bucketed", """
SELECT *, CAST((row_number() OVER (PARTITION BY condition_id ORDER BY timestamp, transaction_hash) - 1) // 20 AS BIGINT) AS bucket_index FROM t_grid
""")
part("t_capped", """
SELECT *, least(shares, CAST(floor(quantile_cont(shares, 0.95) OVER (PARTITION BY condition_id, bucket_index) + 0.475) AS BIGINT)) AS capped FROM t_bucketed
""")
part("t_winsor", """
SELECT condition_id, bucket_index, CAST(sum(CASE WHEN signed >= 0 THEN capped ELSE -capped END) AS DOUBLE) / CAST(nullif(sum(capped), 0) AS DOUBLE) AS imbalance_winsor FROM t_capped GROUP BY 1, 2
""")
part("t_wallet_sums", """
SELECT condition_id, bucket_index, active_wallet, CAST(floor(sum(shares) / 1000) AS BIGINT) AS w FROM t_bucketed GROUP BY 1, 2, 3
""")
part("t_hhi", """
SELECT condition_id, bucket_index, CAST(sum(w * w) AS DOUBLE) / nullif(CAST(sum(w) AS DOUBLE) * CAST(sum(w) AS DOUBLE), 0) AS wallet_hhi FROM t_wallet_sums GROUP BY 1, 2
""")
part("t_plain", """
SELECT condition_id, bucket_index, min(timestamp) AS start_ts, max(timestamp) AS end_ts, max(timestamp) - min(timestamp) AS bucket_duration, count(*) AS n_trades,
  CAST(sum(cash) AS BIGINT) AS gross_cash, CAST(sum(abs(signed)) AS BIGINT) AS abs_signed, CAST(sum(signed) AS DOUBLE) / CAST(nullif(sum(abs(signed)), 0) AS DOUBLE) AS imbalance,
  CAST(sum(CASE WHEN signed >= 0 THEN cash ELSE -cash END) AS DOUBLE) / CAST(nullif(sum(cash), 0) AS DOUBLE) AS imbalance_cash,
  CAST(max(abs(signed)) AS DOUBLE) / CAST(nullif(sum(abs(signed)), 0) AS DOUBLE) AS max_trade_share FROM t_bucketed GROUP BY 1, 2
""")
part("t_features", """
SELECT * FROM t_plain JOIN t_winsor USING (condition_id, bucket_index) JOIN t_hhi USING (condition_id, bucket_index)
""")
part("t_channels", f"""
SELECT condition_id, bucket_index, 'imbalance' AS channel, {grid('imbalance')} AS x FROM t_features
UNION ALL SELECT condition_id, bucket_index, 'imbalance_winsor', {grid('imbalance_winsor')} FROM t_features
UNION ALL SELECT condition_id, bucket_index, 'imbalance_cash', {grid('imbalance_cash')} FROM t_features
UNION ALL SELECT condition_id, bucket_index, 'wallet_hhi', {grid('ln(greatest(wallet_hhi, 1e-9))')} FROM t_features
""")
for name, head in (("t_robust", ""), ("t_burn", "WHERE bucket_index < 20")):
    part(f"{name}_mu", f"SELECT condition_id, channel, quantile_cont(CAST(x AS DOUBLE), 0.5) AS mu FROM t_channels {head} GROUP BY 1, 2")
    part(name, f"SELECT condition_id, channel, any_value(mu) AS mu, quantile_cont(abs(x - mu), 0.5) * CAST(1.4826 AS DOUBLE) AS sigma FROM t_channels JOIN {name}_mu USING (condition_id, channel) {head} GROUP BY 1, 2")
part("t_standard", """
SELECT condition_id, channel, bucket_index, x, mu, sigma, CAST(floor(((x - mu) / (sigma + CAST(1e-3 AS DOUBLE))) * 1e6 + 0.5) AS BIGINT) AS z, false AS imputed, sigma <= 10000 AS scale_degenerate
FROM t_channels JOIN t_burn USING (condition_id, channel)
""")
part("t_frame", """
SELECT a.condition_id, a.channel, a.bucket_index, a.x, b.x AS y FROM t_channels a LEFT JOIN t_channels b
ON a.condition_id = b.condition_id AND a.channel = b.channel AND b.bucket_index BETWEEN a.bucket_index - 30 AND a.bucket_index - 1
""")
part("t_frame_mu", """
SELECT condition_id, channel, bucket_index, any_value(x) AS x, CASE WHEN count(y) >= 10 THEN quantile_cont(CAST(y AS DOUBLE), 0.5) END AS mu FROM t_frame GROUP BY 1, 2, 3
""")
part("t_trailing", """
SELECT f.condition_id, f.channel, f.bucket_index, any_value(f.x) AS x, any_value(m.mu) AS mu, CASE WHEN any_value(m.mu) IS NOT NULL THEN quantile_cont(abs(f.y - m.mu), 0.5) * CAST(1.4826 AS DOUBLE) END AS sigma
FROM t_frame f JOIN t_frame_mu m USING (condition_id, channel, bucket_index) GROUP BY 1, 2, 3
""")
part("t_trailing_z", """
SELECT *, mu IS NULL AS imputed, CASE WHEN mu IS NULL THEN 0 ELSE CAST(floor(((x - mu) / (sigma + CAST(1e-3 AS DOUBLE))) * 1e6 + 0.5) AS BIGINT) END AS z,
  coalesce(sigma <= 10000, true) AS scale_degenerate FROM t_trailing
""")
part("t_shifts", """
SELECT * FROM (VALUES (2, 500000, CAST(0.5 AS DOUBLE), 1), (2, 500000, CAST(0.5 AS DOUBLE), -1), (3, 1125000, CAST(0.75 AS DOUBLE), 1), (3, 1125000, CAST(0.75 AS DOUBLE), -1), (4, 2000000, CAST(1.0 AS DOUBLE), 1), (4, 2000000, CAST(1.0 AS DOUBLE), -1)) AS g(step, drift, delta, side)
""")
part("t_sums", """
SELECT condition_id, channel, bucket_index, delta, side, step * side * z - drift AS inc, CAST(sum(step * side * z - drift) OVER (PARTITION BY condition_id, channel, delta, side ORDER BY bucket_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s
FROM t_standard CROSS JOIN t_shifts WHERE bucket_index >= 20
""")
part("t_w", """
SELECT *, s - least(0, min(s) OVER (PARTITION BY condition_id, channel, delta, side ORDER BY bucket_index ROWS UNBOUNDED PRECEDING)) AS w FROM t_sums
""")
part("t_walk", """
SELECT *, least(bucket_index, coalesce(max(CASE WHEN w = 0 THEN bucket_index END) OVER (PARTITION BY condition_id, channel, delta, side ORDER BY bucket_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 20)) AS onset FROM t_w
""")
part("t_best", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition_id, channel, bucket_index ORDER BY w DESC, side DESC, delta) AS place FROM t_walk) WHERE place = 1
""")
part("t_runs", """
SELECT condition_id, channel, count(*) AS n_buckets, CAST(max(w) AS BIGINT) AS max_statistic, min(CASE WHEN w >= 16000000 THEN bucket_index END) AS alarm_bucket FROM t_best GROUP BY 1, 2
""")
part("t_verdicts", """
SELECT r.condition_id, r.channel, r.n_buckets, r.max_statistic, r.alarm_bucket IS NOT NULL AS alarmed, r.alarm_bucket, b.side AS direction, b.delta AS winning_delta,
  (SELECT min(w.onset) FROM t_walk w WHERE w.condition_id = r.condition_id AND w.channel = r.channel AND w.bucket_index = r.alarm_bucket AND w.side = b.side) AS onset_bucket, b.onset AS onset_mle
FROM t_runs r LEFT JOIN t_best b ON r.condition_id = b.condition_id AND r.channel = b.channel AND r.alarm_bucket = b.bucket_index
""")
