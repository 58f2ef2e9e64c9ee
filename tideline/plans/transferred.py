"""Alarms carried to the other contracts: windows and placebos, wallets tested in them, families, contrast, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import micro
from ..operators import attribute, gates, permute, transfer
from . import attribution as a
from . import detection as d
from . import studies as s
from .sql import grid, part, query

DRAWS, ALPHA, BH_Q = 10, 0.4, 0.4  # what 10 draws can reach
KEYS = ["window_id", "active_wallet"]
RULES = {
    "p_on_grid": "p_mag_e > 0 AND p_mag_e <= 1 AND abs(p_mag_e * (draws + 1) - round(p_mag_e * (draws + 1))) <= 1e-9",
    "own_names": "window_id LIKE 'transfer|%' OR window_id LIKE 'placebo|%'",
    "two_tails_cover": "p_mag_e + p_mirror >= 1",
    "arm_fails_closed": "measured OR p_dnc IS NULL",
    "sensitivity_apart": "NOT (secondary_only AND coalesce(reject_primary, false))",
    "placebo_outside_study": "role = 'transfer' OR (reject_primary IS NULL AND screen_q IS NULL)",
}
FAULTY, FAULTS = "CAST(substr(active_wallet, 2) AS BIGINT) % 5 = 1", {"p_mag_e": "0", "reject_primary": "true", "secondary_only": "true"}


@d.shared
def planned(spark, sf_dir):
    fresh = transfer.without_tested(s.spans(spark, sf_dir), s.own_spans(spark, sf_dir))
    placebos = s.placebo_spans(spark, sf_dir).join(fresh.select("window_id", "condition_id"), ["window_id", "condition_id"], "left_semi")
    w = transfer.planned(fresh, placebos, a.windows(spark, sf_dir), d.HEAD)
    return transfer.usable(w, d.standard(spark, sf_dir).where("channel = 'imbalance'").drop("channel"))


@d.shared
def slotted(spark, sf_dir):
    return transfer.target_slots(planned(spark, sf_dir), d.bucketed(spark, sf_dir))


@d.shared
def labelled(spark, sf_dir):
    """Slots with profiles as of the window's start and all weights; dnc and dfa are 0 where the window has no such arm."""
    path = d.standard(spark, sf_dir).where("channel = 'imbalance'")
    starts = planned(spark, sf_dir).withColumnRenamed("first_bucket", "onset_bucket")
    past = attribute.history(starts, d.bucketed(spark, sf_dir))
    ledgered = attribute.ledger(slotted(spark, sf_dir), path)
    rows = permute.labelled(ledgered, attribute.profiles(slotted(spark, sf_dir), past))
    vdw = ledgered.select("window_id", F.col("slot_index").cast("long").alias("slot_index"), micro(F.col("score_vdw")).alias("vdw"))
    arm = planned(spark, sf_dir).select("window_id", F.col("rejected").isNull().alias("measured"))
    told = rows.join(vdw, ["window_id", "slot_index"]).join(arm, "window_id")
    return told.withColumns({c: F.when(F.col("measured"), F.col(c)).otherwise(F.lit(0).cast("long")) for c in ("dnc", "dfa")})


@d.shared
def rows_tested(spark, sf_dir):
    """Every wallet and window pair: statistics, p-values, eligibility, orbit, and whether it traded in the source window too."""
    slots = labelled(spark, sf_dir)
    # The ranked score takes the place of dfa, which has no family here, so that one pass of draws counts all weights.
    counts = permute.p_values(permute.permuted_counts(slots.withColumn("dfa", F.col("vdw")), DRAWS))
    held = slots.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_slots"), F.countDistinct("bucket_index").alias("n_buckets"), F.sum("e").alias("e"), F.sum("vdw").alias("vdw"), F.sum("sign").alias("sign"))
    w = planned(spark, sf_dir).select("window_id", "source_id", "role", F.col("rejected").isNull().alias("measured"))
    inside = a.slotted(spark, sf_dir).select(F.col("window_id").alias("source_id"), "active_wallet").distinct().withColumn("crosses_source", F.lit(True))
    told = counts.select(*KEYS, F.col("p_mag").alias("p_mag_e"), F.col("p_dfa").alias("p_vdw"), "p_dir", "p_mirror", "p_dnc", "draws").join(held, KEYS).join(w, "window_id").join(inside, ["source_id", "active_wallet"], "left")
    told = told.withColumn("crosses_source", F.coalesce("crosses_source", F.lit(False))).withColumn("eligible", F.col("n_slots") >= 3).withColumn("p_dnc", F.when(F.col("measured"), F.col("p_dnc")))
    return told.join(permute.orbits(slots).select(*KEYS, "log_orbit"), KEYS)


@d.shared
def families(spark, sf_dir):
    return transfer.family_decisions(rows_tested(spark, sf_dir), ALPHA)


@d.shared
def decisions(spark, sf_dir):
    return transfer.pair_decisions(rows_tested(spark, sf_dir), families(spark, sf_dir), BH_Q)


def q3_windows(spark, sf_dir):
    return planned(spark, sf_dir).select("window_id", "source_id", "role", "controls", "condition_id", "first_bucket", "last_bucket", "direction", "baseline_available", "rejected", "w_window")


def q3_wallets(spark, sf_dir):
    return rows_tested(spark, sf_dir).select(*KEYS, "role", "n_slots", "n_buckets", "e", "vdw", "sign", "crosses_source", "measured", *[micro(F.col(c)).alias(c) for c in ("p_mag_e", "p_vdw", "p_dir", "p_mirror", "p_dnc", "log_orbit")])


def q3_families(spark, sf_dir):
    return families(spark, sf_dir).select(*KEYS, "family", micro(F.col("holm_p")).alias("holm_p"), "holm_rank", "m", "reject", "reachable")


def q3_decisions(spark, sf_dir):
    return decisions(spark, sf_dir).select(*KEYS, micro(F.col("screen_q")).alias("screen_q"), "screen_reject", "both_tails", "secondary_only")


def placebo_contrast(spark, sf_dir):
    told = transfer.contrast(planned(spark, sf_dir), decisions(spark, sf_dir))
    return told.select("role", "windows", "pairs", "eligible_pairs", "rejections", "windows_with_rejection", micro(F.col("rate")).alias("rate"), micro(F.col("least_p")).alias("least_p"))


def q3_uncontrolled(spark, sf_dir):
    return transfer.uncontrolled(planned(spark, sf_dir))


def q3_gate(spark, sf_dir):
    """Conservation of e over labels, names apart from the other study's, p-values on the grid, the sensitivity never promoting."""
    return gates.planted(decisions(spark, sf_dir), RULES, FAULTY, FAULTS)


QUERIES = {f.__name__: f for f in (q3_windows, q3_wallets, q3_families, q3_decisions, placebo_contrast, q3_uncontrolled, q3_gate)}

part("q_all_placebos", """
SELECT window_id, condition_id, source_first, source_last, first_bucket, last_bucket FROM (SELECT *, row_number() OVER (PARTITION BY window_id, condition_id, source_first, source_last ORDER BY gap, side) AS place FROM (
  SELECT s.window_id, s.condition_id, s.first_bucket AS source_first, s.last_bucket AS source_last, g.range AS gap, e.side,
    CASE WHEN e.side = 0 THEN s.first_bucket - g.range - (s.last_bucket - s.first_bucket + 1) ELSE s.last_bucket + g.range + 1 END AS first_bucket,
    CASE WHEN e.side = 0 THEN s.first_bucket - g.range - 1 ELSE s.last_bucket + g.range + 1 + s.last_bucket - s.first_bucket END AS last_bucket, n.n_buckets
  FROM s_spans s JOIN (SELECT condition_id, count(*) AS n_buckets FROM s_bounds GROUP BY 1) n USING (condition_id) CROSS JOIN range(2000) g CROSS JOIN (VALUES (0), (1)) AS e(side) WHERE g.range < n.n_buckets) c
  WHERE first_bucket >= 0 AND last_bucket < n_buckets AND NOT EXISTS (SELECT 1 FROM s_blocked b WHERE b.condition_id = c.condition_id AND c.first_bucket <= b.last_bucket AND c.last_bucket >= b.first_bucket)) WHERE place = 1
""")
_tested = "NOT EXISTS (SELECT 1 FROM s_own o WHERE o.condition_id = p.condition_id AND o.first_bucket = p.{first} AND o.last_bucket = p.{last})"
part("q_plan", f"""
SELECT 'transfer|' || p.window_id || '|' || p.condition_id || '|b' || CAST(p.first_bucket AS VARCHAR) || '-' || CAST(p.last_bucket AS VARCHAR) AS window_id, p.window_id AS source_id, 'transfer' AS role, CAST(NULL AS VARCHAR) AS controls, p.condition_id, p.first_bucket, p.last_bucket FROM s_spans p WHERE {_tested.format(first='first_bucket', last='last_bucket')}
UNION ALL SELECT 'placebo|' || p.window_id || '|' || p.condition_id || '|b' || CAST(p.first_bucket AS VARCHAR) || '-' || CAST(p.last_bucket AS VARCHAR), p.window_id, 'placebo', 'transfer|' || p.window_id || '|' || p.condition_id || '|b' || CAST(p.source_first AS VARCHAR) || '-' || CAST(p.source_last AS VARCHAR), p.condition_id, p.first_bucket, p.last_bucket FROM q_all_placebos p WHERE {_tested.format(first='source_first', last='source_last')}
""")
part("q_windows", """
SELECT q.*, w.direction, w.winning_delta, q.first_bucket >= 20 AS baseline_available, CASE WHEN q.first_bucket < 20 THEN 'inside_baseline' WHEN l.bad THEN 'imputed_or_degenerate_bucket' END AS rejected,
  CASE WHEN q.first_bucket >= 20 AND NOT l.bad THEN l.llr END AS w_window
FROM q_plan q JOIN a_windows w ON w.window_id = q.source_id JOIN (SELECT q.window_id, CAST(sum(CAST(w.winning_delta * 4 AS BIGINT) * w.direction * p.z - CAST(w.winning_delta * w.winning_delta / 2 * 4000000 AS BIGINT)) AS BIGINT) AS llr, bool_or(p.scale_degenerate) AS bad
  FROM q_plan q JOIN a_windows w ON w.window_id = q.source_id JOIN (SELECT * FROM t_standard WHERE channel = 'imbalance') p ON p.condition_id = q.condition_id AND p.bucket_index BETWEEN q.first_bucket AND q.last_bucket GROUP BY 1) l ON l.window_id = q.window_id
""")
part("q_slots", "SELECT b.*, w.window_id, w.direction, w.winning_delta, w.rejected IS NULL AS measured, row_number() OVER (PARTITION BY w.window_id ORDER BY b.bucket_index, b.timestamp, b.transaction_hash) - 1 AS slot_index FROM t_bucketed b JOIN q_windows w ON b.condition_id = w.condition_id AND b.bucket_index BETWEEN w.first_bucket AND w.last_bucket")
part("q_scored", f"""
SELECT s.*, direction * signed AS aligned, CASE WHEN measured THEN CAST(floor(winning_delta * direction * (signed * 1e6::DOUBLE / CAST(total AS DOUBLE)) / (p.sigma + 1e-3::DOUBLE) * 1e6 + 0.5) AS BIGINT) ELSE 0 END AS dnc, CAST(floor(({a.quantile_sql('(rk / (m + 1))')}) * 1e6 + 0.5) AS BIGINT) AS vdw
FROM (SELECT *, sum(abs(signed)) OVER (PARTITION BY window_id, bucket_index) AS total, count(*) OVER (PARTITION BY window_id, bucket_index) AS m,
  rank() OVER (PARTITION BY window_id, bucket_index ORDER BY direction * signed) + (count(*) OVER (PARTITION BY window_id, bucket_index, direction * signed) - 1) / 2.0::DOUBLE AS rk FROM q_slots) s JOIN (SELECT condition_id, bucket_index, sigma FROM a_path) p ON p.condition_id = s.condition_id AND p.bucket_index = s.bucket_index
""")
part("q_history", "SELECT w.window_id, b.active_wallet, count(*) AS n_before, quantile_cont(CAST(b.shares AS DOUBLE), 0.5) AS median_shares FROM t_bucketed b JOIN q_windows w ON b.condition_id = w.condition_id AND b.bucket_index < w.first_bucket GROUP BY 1, 2")
part("q_known", "SELECT s.window_id, s.active_wallet, h.n_before, h.median_shares FROM (SELECT DISTINCT window_id, active_wallet FROM q_slots) s LEFT JOIN q_history h USING (window_id, active_wallet)")
part("q_profiles", "SELECT k.window_id, k.active_wallet, CASE WHEN coalesce(n_before, 0) = 0 THEN 'NEW' WHEN median_shares <= cutoff THEN 'OLD_SMALL' ELSE 'OLD_LARGE' END AS profile FROM q_known k LEFT JOIN (SELECT window_id, quantile_cont(median_shares, 0.5) AS cutoff FROM q_known WHERE n_before > 0 GROUP BY 1) c USING (window_id)")
part("q_labelled", "SELECT s.window_id, s.bucket_index, s.window_id || '|b' || CAST(s.bucket_index AS VARCHAR) || '|' || p.profile AS cell_id, s.slot_index, s.active_wallet, s.aligned AS e, CAST(sign(s.aligned) AS BIGINT) AS sign, s.dnc, s.vdw FROM q_scored s JOIN q_profiles p USING (window_id, active_wallet)")
part("q_keys", f"SELECT *, draw.range + 1 AS d, sha256('2026|' || cell_id || '|' || CAST(draw.range + 1 AS VARCHAR) || '|' || CAST(slot_index AS VARCHAR)) AS key FROM q_labelled CROSS JOIN range({DRAWS}) draw")
part("q_drawn", "SELECT *, row_number() OVER (PARTITION BY cell_id, d ORDER BY key, slot_index) AS by_key, row_number() OVER (PARTITION BY cell_id, d ORDER BY slot_index) AS by_slot FROM q_keys")
_sums = lambda p: ", ".join(f"CAST(sum({p}{w}) AS BIGINT) AS {w}" for w in ("e", "sign", "dnc", "vdw"))
part("q_totals", f"SELECT w.window_id, w.d, l.active_wallet, {_sums('w.')} FROM q_drawn w JOIN q_drawn l ON w.cell_id = l.cell_id AND w.d = l.d AND w.by_slot = l.by_key GROUP BY 1, 2, 3")
part("q_seen", f"SELECT window_id, active_wallet, count(*) AS n_slots, count(DISTINCT bucket_index) AS n_buckets, {_sums('')} FROM q_labelled GROUP BY 1, 2")
part("q_p", f"SELECT t.window_id, t.active_wallet, {DRAWS} AS draws, " + ", ".join(f"CAST(count_if({c}) + 1 AS DOUBLE) / {DRAWS + 1} AS {p}" for p, c in (("p_mag_e", "t.e >= s.e"), ("p_vdw", "t.vdw >= s.vdw"), ("p_dir", "t.sign >= s.sign"), ("p_mirror", "t.e <= s.e"), ("p_dnc_raw", "t.dnc >= s.dnc"))) + " FROM q_totals t JOIN q_seen s USING (window_id, active_wallet) GROUP BY 1, 2")
part("q_orbits", "SELECT window_id, active_wallet, sum(a.value - b.value - c.value) AS log_orbit FROM (SELECT *, CAST(sum(k) OVER (PARTITION BY cell_id) AS BIGINT) AS m FROM (SELECT cell_id, window_id, active_wallet, count(*) AS k FROM q_labelled GROUP BY 1, 2, 3)) h JOIN i_logs a ON a.k = h.m JOIN i_logs b ON b.k = h.k JOIN i_logs c ON c.k = h.m - h.k GROUP BY 1, 2")
part("q_rows", "SELECT p.* EXCLUDE (p_dnc_raw), s.* EXCLUDE (window_id, active_wallet), w.source_id, w.role, w.rejected IS NULL AS measured, CASE WHEN w.rejected IS NULL THEN p_dnc_raw END AS p_dnc, s.n_slots >= 3 AS eligible, o.log_orbit, EXISTS (SELECT 1 FROM a_slots x WHERE x.window_id = w.source_id AND x.active_wallet = p.active_wallet) AS crosses_source FROM q_p p JOIN q_seen s USING (window_id, active_wallet) JOIN q_windows w USING (window_id) JOIN q_orbits o USING (window_id, active_wallet)")
part("q_members", " UNION ALL ".join(f"SELECT window_id, active_wallet, log_orbit, '{n}' AS family, {p} AS p, {share * ALPHA}::DOUBLE AS level FROM q_rows WHERE eligible AND role = '{role}' AND {needs}" for n, (p, role, needs, share) in transfer.FAMILIES.items()))
part("q_ranked", "SELECT *, row_number() OVER (PARTITION BY family, window_id ORDER BY p, active_wallet) AS holm_rank, count(*) OVER (PARTITION BY family, window_id) AS m FROM q_members")
part("q_families", "SELECT *, holm_p <= level AS reject, ln(level / m) + log_orbit >= 0 AS reachable FROM (SELECT *, least(1.0::DOUBLE, max((m - holm_rank + 1) * p) OVER (PARTITION BY family, window_id ORDER BY holm_rank ROWS UNBOUNDED PRECEDING)) AS holm_p FROM q_ranked)")
part("q_wide", "SELECT window_id, active_wallet, " + ", ".join(f"bool_or(CASE WHEN family = '{n}' THEN reject END) AS reject_{n}" for n in transfer.FAMILIES) + " FROM q_families GROUP BY 1, 2")
part("q_screen", "SELECT window_id, active_wallet, least(1.0::DOUBLE, min(step) OVER (PARTITION BY window_id ORDER BY p_mag_e DESC, active_wallet DESC ROWS UNBOUNDED PRECEDING)) AS screen_q FROM (SELECT *, count(*) OVER (PARTITION BY window_id) * p_mag_e / row_number() OVER (PARTITION BY window_id ORDER BY p_mag_e, active_wallet) AS step FROM q_rows WHERE role = 'transfer')")
part("q_decisions", f"SELECT r.*, w.* EXCLUDE (window_id, active_wallet), s.screen_q, s.screen_q <= {BH_Q}::DOUBLE AS screen_reject, coalesce(reject_primary, false) AND coalesce(reject_mirror, false) AS both_tails, coalesce(reject_secondary_dnc, false) AND NOT coalesce(reject_primary, false) AS secondary_only FROM q_rows r LEFT JOIN q_wide w USING (window_id, active_wallet) LEFT JOIN q_screen s USING (window_id, active_wallet)")
ORACLE = {
    "q3_windows": query("SELECT window_id, source_id, role, controls, condition_id, first_bucket, last_bucket, direction, baseline_available, rejected, w_window FROM q_windows"),
    "q3_wallets": query("SELECT window_id, active_wallet, role, n_slots, n_buckets, e, vdw, sign, crosses_source, measured, " + ", ".join(f"{grid(c)} AS {c}" for c in ("p_mag_e", "p_vdw", "p_dir", "p_mirror", "p_dnc", "log_orbit")) + " FROM q_rows"),
    "q3_families": query(f"SELECT window_id, active_wallet, family, {grid('holm_p')} AS holm_p, holm_rank, m, reject, reachable FROM q_families"),
    "q3_decisions": query(f"SELECT window_id, active_wallet, {grid('screen_q')} AS screen_q, screen_reject, both_tails, secondary_only FROM q_decisions"),
    "placebo_contrast": query(f"SELECT w.role, w.windows, p.pairs, p.eligible_pairs, p.rejections, p.windows_with_rejection, {grid('CASE WHEN p.eligible_pairs > 0 THEN CAST(p.rejections AS DOUBLE) / p.eligible_pairs END')} AS rate, {grid('p.least_p')} AS least_p FROM (SELECT role, count(*) AS windows FROM q_windows GROUP BY 1) w LEFT JOIN (SELECT role, count(*) AS pairs, count_if(eligible) AS eligible_pairs, count_if(rejected) AS rejections, count(DISTINCT CASE WHEN rejected THEN window_id END) AS windows_with_rejection, min(p_mag_e) AS least_p FROM (SELECT *, coalesce(CASE WHEN role = 'transfer' THEN reject_primary ELSE reject_placebo END, false) AS rejected FROM q_decisions) GROUP BY 1) p USING (role)"),
    "q3_uncontrolled": query("SELECT window_id FROM q_windows w WHERE role = 'transfer' AND NOT EXISTS (SELECT 1 FROM q_windows c WHERE c.controls = w.window_id)"),
    "q3_gate": query(gates.gate_sql("q_decisions", RULES, FAULTY, FAULTS)),
}
