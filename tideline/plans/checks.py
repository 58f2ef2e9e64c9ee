"""Smaller operators on their own: policies, raw bootstraps, cross-checks, digests, sets, names and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr, ids
from ..functions.expr import micro
from ..operators import baseline, buckets, calibrate, evaluate, report
from . import attribution as a
from . import detection as d
from . import inference as i
from . import studies as s
from .sql import grid, part, query


def policy_buckets(spark, sf_dir):
    """Buckets of 50 on one contract, one contract excluded, 20 elsewhere."""
    policy = spark.createDataFrame([("click", 50, False), ("error", None, True)], "condition_id string, size int, excluded boolean")
    told = evaluate.with_policy(s.grid_trades(spark, sf_dir), policy, d.SIZE)
    return buckets.assign_buckets(told, F.col("size")).groupBy("condition_id", "bucket_index").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("start_ts"))


def bootstrap_max_raw(spark, sf_dir):
    rows = d.channels(spark, sf_dir).where("channel = 'imbalance'")
    return calibrate.raw_largest_statistics(rows, lambda r: baseline.standardized(r, d.HEAD), d.CONFIG, 10)


def calibration_accounting(spark, sf_dir):
    """What pooling costs: the threshold of N sources at alpha rises as log(N / alpha)."""
    told = calibrate.accounting(a.paths(spark, sf_dir), 100, 10)
    return told.select("n_sources", "n_buckets", "effective_blocks", micro(F.log(F.col("n_sources") / F.lit(0.05))).alias("log_n_over_alpha"))


def crosscheck_vwap(spark, sf_dir):
    t = s.grid_trades(spark, sf_dir)
    sample = t.where(F.conv(F.substring(F.sha2(F.col("transaction_hash").cast("binary"), 256), 1, 2), 16, 10).cast("int") < 64)
    return report.crosscheck(sample, t, 21600)


def p_vector_digest(spark, sf_dir):
    """One digest of every pair's dnc count, in order of keys, by window."""
    line = F.concat_ws("|", "active_wallet", F.col("n_dnc").cast("string"))
    lists = i.tested(spark, sf_dir).groupBy("window_id").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.count(F.lit(1)).alias("n"))
    return lists.select("window_id", "n", F.sha2(F.array_join("lines", "\n").cast("binary"), 256).alias("sha256"))


def smallest_p(spark, sf_dir):
    return i.tested(spark, sf_dir).orderBy("p_dnc", "window_id", "active_wallet").limit(7).select("window_id", "active_wallet", micro(F.col("p_dnc")).alias("p_dnc"))


def wallet_sets(spark, sf_dir):
    """Wallets of the narrow windows that traded the contract before, and those that did not."""
    inside = a.slotted(spark, sf_dir).where("in_mle").select("condition_id", "active_wallet")
    before = s.grid_trades(spark, sf_dir).join(a.windows(spark, sf_dir).select("condition_id", "onset_bucket"), "condition_id", "left_semi")
    early = d.bucketed(spark, sf_dir).join(a.windows(spark, sf_dir).select("condition_id", "onset_bucket"), "condition_id").where("bucket_index < onset_bucket").select("condition_id", "active_wallet")
    both, new = inside.intersect(early), inside.distinct().exceptAll(early.distinct())
    count = lambda df, name: df.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n")).withColumn("set", F.lit(name))
    return count(both, "returning").unionByName(count(new, "new")).unionByName(count(before.select("condition_id", "active_wallet").distinct(), "all"))


def monotone_scores(spark, sf_dir):
    """Within a bucket scores must not fall as the size on the alarm's side grows."""
    rows = a.ledgered(spark, sf_dir).where("in_mle").withColumn("aligned", F.col("direction") * F.col("signed"))
    return evaluate.unmonotone(rows, "score_vdw", ("window_id", "bucket_index"), ("aligned", "transaction_hash"))


def names_and_keys(spark, sf_dir):
    """Names as labels and file names, checked keys, times as text and back, drawn identifiers."""
    b = s.bounds(spark, sf_dir)
    key = ids.window_id(F.lit("events"), F.col("condition_id"), F.lit("imbalance"), F.lit(20), F.col("bucket_index"))
    text = expr.utc_text(F.col("end_ts"))
    wallet = expr.hex_id(20, "1", F.col("condition_id"), F.col("bucket_index").cast("string"))
    return b.select(
        "condition_id", "bucket_index", key.alias("window_id"), ids.cell_id(key, F.col("bucket_index"), F.lit("NEW")).alias("cell_id"), text.alias("end_text"), expr.utc_seconds(text).alias("end_ts"),
        expr.slug(F.concat(F.lit("Out by "), F.col("condition_id"), F.lit(" 30?"))).alias("slug"), wallet.alias("wallet"), expr.shortened(wallet).alias("short"), expr.decimal_id("1", F.col("condition_id")).alias("token"),
    )


QUERIES = {f.__name__: f for f in (policy_buckets, bootstrap_max_raw, calibration_accounting, crosscheck_vwap, p_vector_digest, smallest_p, wallet_sets, monotone_scores, names_and_keys)}

part("c_raw", """
SELECT s.condition_id, s.replicate, s.block * 10 + o.range AS position, p.x FROM a_starts s CROSS JOIN range(10) o JOIN a_path p ON p.condition_id = s.condition_id AND p.place = (s.begin + o.range) % s.n WHERE s.block * 10 + o.range < s.n AND s.replicate < 10
""")
part("c_mu", "SELECT condition_id, replicate, quantile_cont(CAST(x AS DOUBLE), 0.5) AS mu FROM c_raw WHERE position < 20 GROUP BY 1, 2")
part("c_sigma", "SELECT condition_id, replicate, any_value(mu) AS mu, quantile_cont(abs(x - mu), 0.5) * 1.4826::DOUBLE AS sigma FROM c_raw JOIN c_mu USING (condition_id, replicate) WHERE position < 20 GROUP BY 1, 2")
part("c_z", "SELECT condition_id, replicate, position, CAST(floor(((x - mu) / (sigma + 1e-3::DOUBLE)) * 1e6 + 0.5) AS BIGINT) AS z FROM c_raw JOIN c_sigma USING (condition_id, replicate) WHERE position >= 20")
part("c_s", "SELECT condition_id, replicate, position, delta, side, CAST(sum(step * side * z - drift) OVER (PARTITION BY condition_id, replicate, delta, side ORDER BY position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM c_z CROSS JOIN t_shifts")
part("c_w", "SELECT *, s - least(0, min(s) OVER (PARTITION BY condition_id, replicate, delta, side ORDER BY position ROWS UNBOUNDED PRECEDING)) AS w FROM c_s")
part("c_sample", "SELECT * FROM t_grid WHERE CAST('0x' || substr(sha256(transaction_hash), 1, 2) AS INTEGER) < 64")
part("c_busiest", "SELECT condition_id FROM c_sample GROUP BY 1 ORDER BY count(*) DESC, condition_id LIMIT 1")
part("c_early", "SELECT DISTINCT b.condition_id, b.active_wallet FROM t_bucketed b JOIN a_windows w ON b.condition_id = w.condition_id AND b.bucket_index < w.onset_bucket")
part("c_inside", "SELECT DISTINCT condition_id, active_wallet FROM a_slots WHERE in_mle")
_vwap = lambda t: f"SELECT condition_id, timestamp // 21600 * 21600 AS start_ts, CAST(floor(CAST(sum(CAST(yes_price AS HUGEINT) * shares) AS DOUBLE) / CAST(sum(shares) AS DOUBLE)) AS BIGINT) AS vwap FROM {t} WHERE condition_id IN (SELECT condition_id FROM c_busiest) GROUP BY 1, 2 HAVING sum(shares) > 0"
_key = "'events|' || condition_id || '|imbalance|K20|a' || CAST(bucket_index AS VARCHAR)"
_hex = "'0x' || substr(sha256('1|' || condition_id || '|' || CAST(bucket_index AS VARCHAR)), 1, 40)"
ORACLE = {
    "policy_buckets": query("SELECT condition_id, bucket_index, count(*) AS n, min(timestamp) AS start_ts FROM (SELECT *, (row_number() OVER (PARTITION BY condition_id ORDER BY timestamp, transaction_hash) - 1) // CASE condition_id WHEN 'click' THEN 50 ELSE 20 END AS bucket_index FROM t_grid WHERE condition_id <> 'error') GROUP BY 1, 2"),
    "bootstrap_max_raw": query("SELECT condition_id, replicate, CAST(max(w) AS BIGINT) AS max_stat FROM c_w GROUP BY 1, 2"),
    "calibration_accounting": query(f"SELECT count(*) AS n_sources, CAST(sum(n) AS BIGINT) AS n_buckets, CAST(sum(n // 10) AS BIGINT) AS effective_blocks, {grid('ln(count(*) / 0.05::DOUBLE)')} AS log_n_over_alpha FROM a_sizes"),
    "crosscheck_vwap": query(f"SELECT a.condition_id, a.start_ts, a.vwap AS vwap_all, b.vwap AS vwap_sample, b.vwap - a.vwap AS gap FROM ({_vwap('t_grid')}) a LEFT JOIN ({_vwap('c_sample')}) b USING (condition_id, start_ts)"),
    "p_vector_digest": query("SELECT window_id, count(*) AS n, sha256(string_agg(active_wallet || '|' || CAST(n_dnc AS VARCHAR), chr(10) ORDER BY active_wallet || '|' || CAST(n_dnc AS VARCHAR))) AS sha256 FROM i_p GROUP BY 1"),
    "smallest_p": query(f"SELECT window_id, active_wallet, {grid('p_dnc')} AS p_dnc FROM i_p ORDER BY i_p.p_dnc, window_id, active_wallet LIMIT 7"),
    "wallet_sets": query("SELECT condition_id, count(*) AS n, 'returning' AS set FROM (SELECT * FROM c_inside INTERSECT SELECT * FROM c_early) GROUP BY 1 UNION ALL SELECT condition_id, count(*), 'new' FROM (SELECT * FROM c_inside EXCEPT SELECT * FROM c_early) GROUP BY 1 UNION ALL SELECT condition_id, count(DISTINCT active_wallet), 'all' FROM t_grid WHERE condition_id IN (SELECT condition_id FROM a_windows) GROUP BY 1"),
    "monotone_scores": query("SELECT window_id, bucket_index, count_if(step < 0) AS falls, count(*) AS n FROM (SELECT *, score_vdw - lag(score_vdw) OVER (PARTITION BY window_id, bucket_index ORDER BY aligned, transaction_hash) AS step FROM a_ledger) GROUP BY 1, 2"),
    "names_and_keys": query(f"SELECT condition_id, bucket_index, {_key} AS window_id, {_key} || '|b' || CAST(bucket_index AS VARCHAR) || '|NEW' AS cell_id, strftime(make_timestamp(end_ts * 1000000), '%Y-%m-%d %H:%M:%S UTC') AS end_text, end_ts, 'out-by-' || condition_id || '-30' AS slug, {_hex} AS wallet, substr({_hex}, 1, 6) || '…' || right({_hex}, 4) AS short, CAST(CAST('0x' || substr(sha256('1|' || condition_id), 1, 15) AS UBIGINT) AS VARCHAR) AS token FROM t_plain"),
}
