"""Trades, buckets, baselines, walks: queries over the event stream, 20 trades a bucket."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expr import micro
from ..functions.shared import fingerprint, shared_dir
from ..operators import baseline, buckets, ledger, walk
from ..sources import trades as source
from .sql import grid, query

SIZE, HEAD = 20, 20
_SHARED: dict[tuple[str, ...], DataFrame] = {}


CONFIG = walk.WalkConfig(start=HEAD)


def shared(f):
    """Write a table that several queries build on once for every state of the input files, in the shared folder."""

    def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, sf_dir), f"{f.__module__}.{f.__name__}")
        if key not in _SHARED:
            path = f"{shared_dir(spark)}/{f.__name__}-{uuid.uuid4().hex[:12]}"
            f(spark, sf_dir).write.parquet(path)
            _SHARED[key] = spark.read.parquet(path)
        return _SHARED[key]

    kept.__name__ = f.__name__
    return kept


def forget() -> None:
    """Let the next query build its tables anew, as a fresh session would."""
    _SHARED.clear()


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.event_trades(source.read(spark, sf_dir, "events"))


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.assign_buckets(source.on_grid(trades(spark, sf_dir)), SIZE)


@shared
def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.channel_rows(buckets.features(bucketed(spark, sf_dir)))


@shared
def standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.standardized(channels(spark, sf_dir), HEAD)


@shared
def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.reflected_walk(standard(spark, sf_dir), CONFIG)


def verdict_table(spark: SparkSession, sf_dir: str, size: int, head: int, threshold: float = 4.0) -> DataFrame:
    """The chain from events to verdicts as one plan, for any bucket size and burn-in."""
    b = buckets.assign_buckets(source.on_grid(trades(spark, sf_dir)), size)
    rows = baseline.standardized(buckets.channel_rows(buckets.features(b)), head)
    return walk.verdicts(walk.reflected_walk(rows, walk.WalkConfig(start=head)), threshold)


def trades_view(spark, sf_dir):
    t = trades(spark, sf_dir)
    return t.select("timestamp", "side", "active_wallet", "condition_id", "outcome", "resolved_outcome", "token_id", "transaction_hash", *[micro(F.col(c)).alias(c) for c in ("gross_shares", "gross_price", "gross_cash", "yes_price", "signed_yes_size")])


def decode_matches(spark, sf_dir):
    d = ledger.decoded(source.raw_matches(trades(spark, sf_dir)))
    return d.select("transaction_hash", "timestamp", "side", "token_id", "one_cash_leg", micro(F.col("gross_cash")).alias("gross_cash"), micro(F.col("gross_shares")).alias("gross_shares"))


def active_wallet_join(spark, sf_dir):
    t = trades(spark, sf_dir)
    found = ledger.active_wallets(source.raw_fills(t))
    return ledger.decoded(source.raw_matches(t)).join(found, "transaction_hash", "left").select("transaction_hash", "active_wallet", "fills")


def yes_space(spark, sf_dir):
    t = trades(spark, sf_dir)
    built = ledger.built_trades(source.raw_matches(t), source.raw_fills(t), ledger.market_metadata(t))
    return built.select("transaction_hash", "condition_id", "outcome", "resolved_outcome", "active_wallet", micro(F.col("signed_yes_size")).alias("signed_yes_size"))


def token_map(spark, sf_dir):
    return ledger.token_map(ledger.market_metadata(trades(spark, sf_dir)))


def rows_per_market(spark, sf_dir):
    return ledger.market_counts(trades(spark, sf_dir))


def raw_gate(spark, sf_dir):
    return ledger.raw_gate(source.raw_fills(trades(spark, sf_dir)))


def trade_gate(spark, sf_dir):
    return ledger.trade_gate(trades(spark, sf_dir))


def bucket_assign(spark, sf_dir):
    return bucketed(spark, sf_dir).select("condition_id", "transaction_hash", "bucket_index")


def bucket_assign_ties(spark, sf_dir):
    t = source.on_grid(source.order_trades(source.read(spark, sf_dir, "orders")))
    return buckets.assign_buckets(t, 50, 30 * 86400).select("condition_id", "transaction_hash", "bucket_index")


def bucket_features(spark, sf_dir):
    f = buckets.features(bucketed(spark, sf_dir))
    return f.select("condition_id", "bucket_index", "start_ts", "end_ts", "bucket_duration", "n_trades", "gross_cash", "abs_signed", *[micro(F.col(c)).alias(c) for c in ("imbalance", "imbalance_cash", "max_trade_share", "imbalance_winsor", "wallet_hhi")])


def bucket_winsor(spark, sf_dir):
    return buckets.winsorized(bucketed(spark, sf_dir)).select("condition_id", "bucket_index", micro(F.col("imbalance_winsor")).alias("imbalance_winsor"))


def bucket_hhi(spark, sf_dir):
    return buckets.wallet_hhi(bucketed(spark, sf_dir)).select("condition_id", "bucket_index", micro(F.col("wallet_hhi")).alias("wallet_hhi"))


def bucket_bounds(spark, sf_dir):
    return bucketed(spark, sf_dir).groupBy("condition_id", "bucket_index").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count(F.lit(1)).alias("n_trades"))


def top3_share(spark, sf_dir):
    return buckets.top_wallet_share(bucketed(spark, sf_dir)).select("condition_id", micro(F.col("share")).alias("share"))


def _half(c: str):
    """Medians of whole numbers are whole or half."""
    return (F.col(c) * 2).cast("long").alias(c)


def _sigma():
    return F.floor(F.col("sigma") + 0.25).cast("long").alias("sigma")


def baseline_robust(spark, sf_dir):
    return baseline.robust_baseline(channels(spark, sf_dir)).select("condition_id", "channel", _half("mu"), _sigma())


def baseline_burn_in(spark, sf_dir):
    return baseline.robust_baseline(channels(spark, sf_dir), HEAD).select("condition_id", "channel", _half("mu"), _sigma())


def standardize(spark, sf_dir):
    return standard(spark, sf_dir).select("condition_id", "channel", "bucket_index", "x", "z", "imputed", "scale_degenerate")


def trailing_standardize(spark, sf_dir):
    return baseline.trailing_standardized(channels(spark, sf_dir)).select("condition_id", "channel", "bucket_index", "x", "z", "imputed", "scale_degenerate")


def reflected_walk(spark, sf_dir):
    return walked(spark, sf_dir).select("condition_id", "channel", "bucket_index", "delta", "side", "w", "onset")


def folded_walk(spark, sf_dir):
    return walk.folded_walk(standard(spark, sf_dir), CONFIG)


def cusum_verdict(spark, sf_dir):
    return walk.verdicts(walked(spark, sf_dir), 4.0)


def onset_windows(spark, sf_dir):
    v = walk.verdicts(walked(spark, sf_dir), 4.0).where("alarmed")
    return v.select("condition_id", "channel", F.expr("stack(2, 'wide', onset_bucket, alarm_bucket, 'mle', onset_mle, alarm_bucket) AS (kind, first_bucket, last_bucket)"))


def channel_unpivot(spark, sf_dir):
    return channels(spark, sf_dir)


QUERIES = {f.__name__: f for f in (trades_view, decode_matches, active_wallet_join, yes_space, token_map, rows_per_market, raw_gate, trade_gate, bucket_assign, bucket_assign_ties, bucket_features, bucket_winsor, bucket_hhi, channel_unpivot, bucket_bounds, top3_share, baseline_robust, baseline_burn_in, standardize, trailing_standardize, reflected_walk, folded_walk, cusum_verdict, onset_windows)}

ORACLE = {
    "trades_view": query(f"SELECT timestamp, side, active_wallet, condition_id, outcome, resolved_outcome, token_id, transaction_hash, {', '.join(f'{grid(c)} AS {c}' for c in ('gross_shares', 'gross_price', 'gross_cash', 'yes_price', 'signed_yes_size'))} FROM t_yes"),
    "decode_matches": query(f"SELECT transaction_hash, timestamp, side, token_id, true AS one_cash_leg, {grid('gross_cash')} AS gross_cash, {grid('gross_shares')} AS gross_shares FROM t_yes"),
    "active_wallet_join": query("SELECT transaction_hash, active_wallet, CAST(1 AS BIGINT) AS fills FROM t_yes"),
    "yes_space": query(f"SELECT transaction_hash, condition_id, outcome, resolved_outcome, active_wallet, CASE WHEN signed_yes_size >= 0 THEN {grid('gross_shares')} ELSE -{grid('gross_shares')} END AS signed_yes_size FROM t_yes"),
    "token_map": query("SELECT DISTINCT m.condition_id, m.condition_id AS question, m.resolved_outcome, m.condition_id || ':' || o.outcome AS token_id, o.outcome FROM t_trades m CROSS JOIN (VALUES ('Yes'), ('No')) AS o(outcome)"),
    "rows_per_market": query("SELECT condition_id, count(*) AS n_trades, count(DISTINCT active_wallet) AS n_wallets, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM t_trades GROUP BY 1"),
    "raw_gate": query("SELECT name, CAST(0 AS BIGINT) AS violations FROM (VALUES ('one_cash_leg'), ('positive_amounts'), ('fee_not_negative'), ('known_maker')) AS v(name)"),
    "trade_gate": query("""
SELECT 'price_in_unit' AS name, count_if(NOT (yes_price BETWEEN 0 AND 1 AND gross_price BETWEEN 0 AND 1)) AS violations FROM t_yes
UNION ALL SELECT 'shares_positive', count_if(NOT gross_shares > 0) FROM t_yes UNION ALL SELECT 'cash_not_negative', count_if(NOT gross_cash >= 0) FROM t_yes
UNION ALL SELECT 'side_known', count_if(side NOT IN ('BUY', 'SELL')) FROM t_yes UNION ALL SELECT 'outcome_known', count_if(outcome NOT IN ('Yes', 'No')) FROM t_yes
UNION ALL SELECT 'size_is_shares', count_if(abs(signed_yes_size) <> gross_shares) FROM t_yes
UNION ALL SELECT 'transaction_unique', count(*) FROM (SELECT transaction_hash FROM t_yes GROUP BY 1 HAVING count(*) > 1)"""),
    "bucket_assign": query("SELECT condition_id, transaction_hash, bucket_index FROM t_bucketed"),
    "bucket_assign_ties": "SELECT o_orderpriority AS condition_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS transaction_hash, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY floor(epoch(o_orderdate)), lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) - 1) // 50 AS BIGINT) AS bucket_index FROM orders",
    "bucket_features": query(f"SELECT condition_id, bucket_index, start_ts, end_ts, bucket_duration, n_trades, gross_cash, abs_signed, {', '.join(f'{grid(c)} AS {c}' for c in ('imbalance', 'imbalance_cash', 'max_trade_share', 'imbalance_winsor', 'wallet_hhi'))} FROM t_features"),
    "bucket_winsor": query(f"SELECT condition_id, bucket_index, {grid('imbalance_winsor')} AS imbalance_winsor FROM t_winsor"),
    "bucket_hhi": query(f"SELECT condition_id, bucket_index, {grid('wallet_hhi')} AS wallet_hhi FROM t_hhi"),
    "channel_unpivot": query("SELECT * FROM t_channels"),
    "bucket_bounds": query("SELECT condition_id, bucket_index, start_ts, end_ts, n_trades FROM t_plain"),
    "top3_share": query(f"SELECT condition_id, {grid('CAST(sum(CASE WHEN place <= 3 THEN shares END) AS DOUBLE) / CAST(sum(shares) AS DOUBLE)')} AS share FROM (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY shares DESC, active_wallet) AS place FROM (SELECT condition_id, active_wallet, sum(shares) AS shares FROM t_grid GROUP BY 1, 2)) GROUP BY 1"),
    "baseline_robust": query("SELECT condition_id, channel, CAST(mu * 2 AS BIGINT) AS mu, CAST(floor(sigma + CAST(0.25 AS DOUBLE)) AS BIGINT) AS sigma FROM t_robust"),
    "baseline_burn_in": query("SELECT condition_id, channel, CAST(mu * 2 AS BIGINT) AS mu, CAST(floor(sigma + CAST(0.25 AS DOUBLE)) AS BIGINT) AS sigma FROM t_burn"),
    "standardize": query("SELECT condition_id, channel, bucket_index, x, z, imputed, scale_degenerate FROM t_standard"),
    "trailing_standardize": query("SELECT condition_id, channel, bucket_index, x, z, imputed, scale_degenerate FROM t_trailing_z"),
    "reflected_walk": query("SELECT condition_id, channel, bucket_index, delta, side, w, onset FROM t_walk"),
    "folded_walk": query("SELECT condition_id, channel, bucket_index, delta, side, w FROM t_walk"),
    "cusum_verdict": query("SELECT * FROM t_verdicts"),
    "onset_windows": query("SELECT condition_id, channel, 'wide' AS kind, onset_bucket AS first_bucket, alarm_bucket AS last_bucket FROM t_verdicts WHERE alarmed UNION ALL SELECT condition_id, channel, 'mle', onset_mle, alarm_bucket FROM t_verdicts WHERE alarmed"),
}
