"""Gates 1 to 10 and those of the delivered table, each over the sound tables and over copies with planted faults."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import attribute, gates, permute
from . import attribution as a
from . import detection as d
from . import inference as i
from .sql import part, query

FAULTY = "CAST(substr(active_wallet, 2) AS BIGINT) % 5 = 1"
ODD_BUCKET = "bucket_index % 3 = 1"


def _path(spark, sf_dir):
    """The baseline of every bucket of the narrow windows, with its absolute flow."""
    w = a.windows(spark, sf_dir).select("window_id", "condition_id", "onset_mle", "alarm_bucket")
    s = d.standard(spark, sf_dir).where("channel = 'imbalance'").drop("channel")
    flow = d.bucketed(spark, sf_dir).groupBy("condition_id", "bucket_index").agg(F.sum(F.abs("signed")).alias("total"))
    return s.join(w, "condition_id").where("bucket_index BETWEEN onset_mle AND alarm_bucket").join(flow, ["condition_id", "bucket_index"]).withColumn("in_mle", F.lit(True))


def gate_counts(spark, sf_dir):
    """Gate 2."""
    s = a.slotted(spark, sf_dir)
    told = attribute.count_report(s).join(s.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_slots")), "window_id")
    w = a.windows(spark, sf_dir).select("window_id", "condition_id", "onset_bucket", "alarm_bucket")
    sizes = d.bucketed(spark, sf_dir).groupBy("condition_id", "bucket_index").agg(F.count(F.lit(1)).alias("n"))
    trades = sizes.join(w, "condition_id").where("bucket_index BETWEEN onset_bucket AND alarm_bucket").groupBy("window_id").agg(F.sum("n").alias("n_bucket_trades"))
    return gates.planted(told.join(trades, "window_id"), gates.COUNTS, "n_wide % 2 = 0", {"n_slots": "n_slots + 1", "n_mle": "n_wide + 1"})


def gate_ledger(spark, sf_dir):
    """Gate 3, by trade."""
    rows = a.ledgered(spark, sf_dir)
    by = Window.partitionBy("window_id", "bucket_index")
    told = rows.withColumn("total", F.sum(F.abs("signed")).over(by).cast("double")).withColumn("unit", F.col("winning_delta") * F.col("direction") * 1e6 / (F.col("sigma") + 1e-3))
    return gates.planted(told, gates.LEDGER, FAULTY, {"dfa": "coalesce(dfa, 0) + 0.5", "score_sign": "2", "dnc": "coalesce(dnc, 0) * 1.5"})


def gate_fail_closed(spark, sf_dir):
    """Gate 4."""
    return gates.planted(_path(spark, sf_dir), gates.FAIL_CLOSED, ODD_BUCKET, {"imputed": "true", "sigma": "0", "total": "0", "z": "NULL"})


def untestable(spark, sf_dir):
    """The reason by window, with every third bucket's scale set to the floor in windows of an even alarm bucket."""
    path = _path(spark, sf_dir)
    broken = path.withColumn("scale_degenerate", F.col("scale_degenerate") | F.expr(f"{ODD_BUCKET} AND alarm_bucket % 2 = 0"))
    return gates.untestable(broken)


def gate_p_values(spark, sf_dir):
    """Gate 6."""
    keys = ["window_id", "active_wallet"]
    slots = i.labelled(spark, sf_dir)
    fixed, orbit, floor = permute.fixed_share(slots), permute.orbits(slots).drop("n_slots"), permute.direction_floor(slots)
    rows = i.tested(spark, sf_dir).join(fixed, keys).join(orbit, keys).join(floor, keys)
    return gates.planted(rows, gates.P_VALUES, FAULTY, {"p_mag": "0", "p_dir": "p_dir / 2", "n_dnc": "draws + 1", "log_floor": "1"})


def gate_reproducible(spark, sf_dir):
    """Gate 7: counts by batches of other sizes, other partitionings and another order of rows; and that another seed does differ."""
    slots = i.labelled(spark, sf_dir)
    base = permute.philox_counts(slots, 256)
    again = {"batch": permute.philox_counts(slots, 256, batch=37), "partitions": permute.philox_counts(slots.repartition(13, "active_wallet"), 256), "order": permute.philox_counts(slots.orderBy(F.desc("slot_index")), 256)}
    rows = [gates.differences(base, other).select(F.lit(name).alias("name"), "side", "n") for name, other in again.items()]
    other = gates.differences(base, permute.philox_counts(slots, 256, seed_base=2027)).agg((F.count(F.lit(1)) == 0).cast("long").alias("n")).select(F.lit("seed").alias("name"), F.lit("equal").alias("side"), "n")
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(other).groupBy("name").agg(F.sum("n").alias("violations"))


def gate_resolution(spark, sf_dir):
    """Gate 8."""
    slots = i.labelled(spark, sf_dir)
    by = Window.partitionBy("window_id")
    rows = permute.exact_families(slots).join(permute.orbits(slots).drop("n_slots"), ["window_id", "active_wallet"])
    rows = rows.withColumn("n_family", F.count(F.lit(1)).over(by)).withColumn("n_eligible", F.count_if("eligible").over(by))
    return gates.planted(rows, gates.RESOLUTION, FAULTY, {"reachable": "NOT coalesce(reachable, true)", "log_orbit": "-1", "m_screening": "m_screening + 1"})


def _adjudicated(spark, sf_dir):
    by = Window.partitionBy("window_id")
    rows = i.decided(spark, sf_dir).withColumn("n_eligible", F.count_if("eligible").over(by))
    for leg in gates.LEGS:
        rows = rows.withColumn(f"distinct_{leg}", F.size(F.collect_set(f"holm_{leg}_rank").over(by)).cast("long")).withColumn(f"most_{leg}", F.max(f"holm_{leg}_rank").over(by))
        rows = rows.withColumn(f"alpha_{leg}", F.lit(i.LEGS[leg]))
    return rows


def gate_multiplicity(spark, sf_dir):
    """Gate 9."""
    return gates.planted(_adjudicated(spark, sf_dir), gates.MULTIPLICITY, FAULTY, {"holm_mag_reject": "NOT coalesce(holm_mag_reject, false)", "holm_dnc_p": "NULL", "leg_that_rejected": "'dnc'", "most_dir": "0"})


def gate_statuses(spark, sf_dir):
    return gates.planted(i.decided(spark, sf_dir), gates.STATUSES, FAULTY, {"status": "'confirmed_repeat_active'", "tied_into_top": "true"})


def gate_timing(spark, sf_dir):
    keys = ["window_id", "active_wallet"]
    seen = a.asof_first_trade(spark, sf_dir).select(*keys, F.col("timestamp").alias("first_seen_ts"))
    past = attribute.history(a.windows(spark, sf_dir), d.bucketed(spark, sf_dir)).select(*keys, "n_before", F.col("first_ts").alias("history_ts"))
    rows = i.timing(spark, sf_dir).join(seen, keys, "left").join(past, keys, "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)))
    return gates.planted(rows, gates.TIMING, FAULTY, {"first_ts": "alarm_ts + 1", "seconds_to_alarm": "-1", "history_ts": "alarm_ts + 9"})


def gate_wallets(spark, sf_dir):
    by = Window.partitionBy("window_id")
    rows = a.wallets(spark, sf_dir).withColumn("n_roster", F.count_if(F.col("n_mle") > 0).over(by)).withColumn("distinct_ranks", F.size(F.collect_set("rank_e_mle").over(by)))
    return gates.planted(rows, gates.WALLETS, FAULTY, {"rank_e_mle": "0", "n_before": "0", "n_mle": "0"})


def gate_provenance(spark, sf_dir):
    """Gate 10: membership digests recorded, then built again from slots in which some windows lost a trade."""
    s = a.slotted(spark, sf_dir)
    recorded = attribute.membership_digest(s).select("window_id", F.col("membership_sha256").alias("recorded"))
    now = attribute.membership_digest(s).select("window_id", F.col("membership_sha256").alias("digest"))
    lost = attribute.membership_digest(s.where("NOT (slot_index = 0 AND length(window_id) % 2 = 0)")).select("window_id", F.col("membership_sha256").alias("digest"))
    made = lambda told: recorded.join(told, "window_id", "left").withColumn("n_builds", F.lit(1).cast("long"))
    return gates.checked(made(now), gates.PROVENANCE).unionByName(gates.checked(made(lost), gates.PROVENANCE, "planted"))


QUERIES = {f.__name__: f for f in (gate_counts, gate_ledger, gate_fail_closed, untestable, gate_p_values, gate_reproducible, gate_resolution, gate_multiplicity, gate_statuses, gate_timing, gate_wallets, gate_provenance)}

part("g_path", "SELECT s.*, w.window_id, w.alarm_bucket, f.total FROM t_standard s JOIN a_windows w ON w.condition_id = s.condition_id AND s.bucket_index BETWEEN w.onset_mle AND w.alarm_bucket JOIN (SELECT condition_id, bucket_index, sum(abs(signed)) AS total FROM t_bucketed GROUP BY 1, 2) f ON f.condition_id = s.condition_id AND f.bucket_index = s.bucket_index WHERE s.channel = 'imbalance'")
part("g_counts", "SELECT window_id, count(*) AS n_wide, count(*) AS n_slots, count_if(in_mle) AS n_mle, count(DISTINCT active_wallet) AS wallets_wide, count(DISTINCT CASE WHEN in_mle THEN active_wallet END) AS wallets_mle, count(*) AS n_bucket_trades FROM a_slots GROUP BY 1")
part("g_ledger", "SELECT s.*, l.dnc, l.agc, l.dfa, CAST(l.score_sign AS BIGINT) AS score_sign, l.score_vdw, CAST(sum(abs(s.signed)) OVER (PARTITION BY s.window_id, s.bucket_index) AS DOUBLE) AS total, s.winning_delta * s.direction * 1e6::DOUBLE / (p.sigma + 1e-3::DOUBLE) AS unit FROM a_slots s LEFT JOIN a_ledger l ON l.window_id = s.window_id AND l.transaction_hash = s.transaction_hash LEFT JOIN a_path p ON p.condition_id = s.condition_id AND p.bucket_index = s.bucket_index")
part("g_fixed", "SELECT s.window_id, s.active_wallet, count(*) AS n_slots, count_if(NOT c.movable) AS n_fixed, count_if(NOT c.movable) > 0.2::DOUBLE * count(*) AS low_power, count_if(NOT c.movable) = count(*) AS no_movable_slots FROM i_slots s JOIN i_cells c USING (cell_id) GROUP BY 1, 2")
part("g_floor", "SELECT window_id, active_wallet, sum(fa.value - ft.value - fat.value + fb.value - fu.value - fbu.value + fc.value - fv.value - fcv.value - (fm.value - fk.value - fmk.value)) AS log_floor FROM (SELECT *, k - t - u AS v FROM i_take) z JOIN i_logs fa ON fa.k = z.a JOIN i_logs ft ON ft.k = z.t JOIN i_logs fat ON fat.k = z.a - z.t JOIN i_logs fb ON fb.k = z.b JOIN i_logs fu ON fu.k = z.u JOIN i_logs fbu ON fbu.k = z.b - z.u JOIN i_logs fc ON fc.k = z.c JOIN i_logs fv ON fv.k = z.v JOIN i_logs fcv ON fcv.k = z.c - z.v JOIN i_logs fm ON fm.k = z.m JOIN i_logs fk ON fk.k = z.k JOIN i_logs fmk ON fmk.k = z.m - z.k GROUP BY 1, 2")
part("g_tested", "SELECT p.*, f.* EXCLUDE (window_id, active_wallet), o.log_orbit, z.log_floor FROM i_p p JOIN g_fixed f USING (window_id, active_wallet) JOIN (SELECT window_id, active_wallet, log_orbit FROM i_orbits) o USING (window_id, active_wallet) JOIN g_floor z USING (window_id, active_wallet)")
part("g_adjudicated", "SELECT *, count_if(eligible) OVER (PARTITION BY window_id) AS n_eligible, " + ", ".join(f"(SELECT count(DISTINCT holm_{leg}_rank) FROM i_decided b WHERE b.window_id = i_decided.window_id) AS distinct_{leg}, max(holm_{leg}_rank) OVER (PARTITION BY window_id) AS most_{leg}, {i.LEGS[leg]}::DOUBLE AS alpha_{leg}" for leg in gates.LEGS) + " FROM i_decided")
part("g_timing", "SELECT t.*, s.timestamp AS first_seen_ts, h.first_ts AS history_ts, coalesce(h.n_before, 0) AS n_before FROM (SELECT window_id, active_wallet, arg_min(timestamp, slot_index) AS first_ts, arg_min(CASE WHEN dnc > 0 THEN timestamp END, CASE WHEN dnc > 0 THEN slot_index END) AS first_aligned_ts, any_value(alarm_ts) AS alarm_ts, any_value(alarm_ts) - arg_min(timestamp, slot_index) AS seconds_to_alarm FROM a_ledger JOIN (SELECT window_id, max(timestamp) AS alarm_ts FROM a_slots GROUP BY 1) USING (window_id) GROUP BY 1, 2) t LEFT JOIN (SELECT w.window_id, b.active_wallet, min(b.timestamp) AS timestamp FROM t_bucketed b JOIN a_windows w ON b.condition_id = w.condition_id AND b.bucket_index <= w.alarm_bucket GROUP BY 1, 2) s USING (window_id, active_wallet) LEFT JOIN a_history h USING (window_id, active_wallet)")
part("g_ranked", "SELECT *, CASE WHEN n_mle > 0 THEN row_number() OVER (PARTITION BY window_id ORDER BY e_mle DESC NULLS LAST, first_slot) END AS rank_e_mle FROM a_wallets")
part("g_wallets", "SELECT *, count_if(n_mle > 0) OVER (PARTITION BY window_id) AS n_roster, count(rank_e_mle) OVER (PARTITION BY window_id) AS distinct_ranks FROM g_ranked")
_digest = lambda where: f"SELECT window_id, sha256(string_agg(CAST(bucket_index AS VARCHAR) || '|' || transaction_hash || chr(10), '' ORDER BY slot_index)) AS digest FROM a_slots WHERE {where} GROUP BY 1"
ORACLE = {
    "gate_counts": query(gates.gate_sql("g_counts", gates.COUNTS, "n_wide % 2 = 0", {"n_slots": "n_slots + 1", "n_mle": "n_wide + 1"})),
    "gate_ledger": query(gates.gate_sql("g_ledger", gates.LEDGER, FAULTY, {"dfa": "coalesce(dfa, 0) + 0.5", "score_sign": "2", "dnc": "coalesce(dnc, 0) * 1.5"})),
    "gate_fail_closed": query(gates.gate_sql("g_path", gates.FAIL_CLOSED, ODD_BUCKET, {"imputed": "true", "sigma": "0", "total": "0", "z": "NULL"})),
    "untestable": query(f"SELECT window_id, CASE WHEN bool_or(scale_degenerate OR ({ODD_BUCKET} AND alarm_bucket % 2 = 0)) THEN 'scale_at_floor_in_mle' END AS reason FROM g_path GROUP BY 1"),
    "gate_p_values": query(gates.gate_sql("g_tested", gates.P_VALUES, FAULTY, {"p_mag": "0", "p_dir": "p_dir / 2", "n_dnc": "draws + 1", "log_floor": "1"})),
    "gate_multiplicity": query(gates.gate_sql("g_adjudicated", gates.MULTIPLICITY, FAULTY, {"holm_mag_reject": "NOT coalesce(holm_mag_reject, false)", "holm_dnc_p": "NULL", "leg_that_rejected": "'dnc'", "most_dir": "0"})),
    "gate_statuses": query(gates.gate_sql("i_decided", gates.STATUSES, FAULTY, {"status": "'confirmed_repeat_active'", "tied_into_top": "true"})),
    "gate_timing": query(gates.gate_sql("g_timing", gates.TIMING, FAULTY, {"first_ts": "alarm_ts + 1", "seconds_to_alarm": "-1", "history_ts": "alarm_ts + 9"})),
    "gate_wallets": query(gates.gate_sql("g_wallets", gates.WALLETS, FAULTY, {"rank_e_mle": "0", "n_before": "0", "n_mle": "0"})),
    "gate_provenance": query(f"SELECT state, 'one_build' AS name, CAST(0 AS BIGINT) AS violations FROM (VALUES ('sound'), ('planted')) AS s(state) UNION ALL SELECT 'sound', 'digest_as_recorded', CAST(0 AS BIGINT) UNION ALL SELECT 'planted', 'digest_as_recorded', count_if(a.digest IS DISTINCT FROM b.digest) FROM ({_digest('true')}) a LEFT JOIN ({_digest('NOT (slot_index = 0 AND length(window_id) % 2 = 0)')}) b USING (window_id)"),
}
