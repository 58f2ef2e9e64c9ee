"""Verdicts against known change points, alarm reports without them, and summaries of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import utc_text
from .walk import UNIT

RUN = ("condition_id", "channel")


def tau_buckets(bounds: DataFrame, taus: DataFrame) -> DataFrame:
    """(condition_id, tau, tau_bucket): the first bucket that ends at tau or later; null where the stream ends before."""
    first = bounds.join(taus, "condition_id").where(F.col("end_ts") >= F.col("tau")).groupBy("condition_id").agg(F.min("bucket_index").alias("tau_bucket"))
    return taus.join(first, "condition_id", "left")


def trades_before(trades: DataFrame, taus: DataFrame) -> DataFrame:
    """How many of a stream's trades come strictly before tau."""
    return trades.join(taus.where("tau IS NOT NULL"), "condition_id").groupBy("condition_id", "tau").agg(F.count_if(F.col("timestamp") < F.col("tau")).alias("n_before"), F.count(F.lit(1)).alias("n_trades"))


def around_tau(path: DataFrame, told: DataFrame, reach: int = 15) -> DataFrame:
    """The buckets within `reach` of tau's, with their place relative to it."""
    near = path.join(told.select("condition_id", "tau_bucket"), "condition_id").withColumn("place", F.col("bucket_index") - F.col("tau_bucket"))
    return near.where(F.col("place").between(-reach, reach))


def paired_nulls(streams: DataFrame, keys: tuple[str, ...] = ("level", "base")) -> DataFrame:
    """Streams without injection take the tau of the injected ones with the same keys, where these agree on a single one."""
    taus = streams.where("injection_mode IS NOT NULL").groupBy(*keys).agg(F.collect_set("tau").alias("taus"))
    only = taus.where(F.size("taus") == 1).select(*keys, F.col("taus")[0].alias("paired_tau"))
    return streams.join(only, list(keys), "left").withColumn("reference_tau", F.coalesce("tau", "paired_tau")).drop("paired_tau")


def _at(stats: DataFrame, bounds: DataFrame) -> DataFrame:
    """What is known of a run at each bucket: statistic and bounds."""
    return stats.select(*RUN, F.col("bucket_index").alias("alarm_bucket"), "statistic").join(
        bounds.select("condition_id", F.col("bucket_index").alias("alarm_bucket"), F.col("start_ts").alias("alarm_start"), F.col("end_ts").alias("alarm_available")), ["condition_id", "alarm_bucket"]
    )


def evaluate_sim(verdicts: DataFrame, stats: DataFrame, bounds: DataFrame, streams: DataFrame, method: str, threshold: float) -> DataFrame:
    """One row a run on a simulated stream: what its alarm says of the true change point.

    An alarm in tau's bucket or later detects; one before it, and any on a stream without injection, is false. Times
    are of the bucket's end, when its last trade has come and the alarm can be acted on, so a delay is never negative.
    The onset error is positive where the window starts late; the window covers tau if tau's bucket lies in it.
    """
    sizes = bounds.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n_buckets"))
    told = tau_buckets(bounds, streams)
    rows = verdicts.drop("n_buckets").join(told, "condition_id").join(sizes, "condition_id").join(_at(stats, bounds), [*RUN, "alarm_bucket"], "left")
    a, b, o = F.col("alarm_bucket"), F.col("tau_bucket"), F.col("onset_bucket")
    detected = F.coalesce(a >= b, F.lit(False))
    false = F.when(F.col("tau").isNull(), a.isNotNull()).otherwise(F.coalesce(a < b, F.lit(False)))
    return rows.select(
        "condition_id", "level", "injection_mode", "resolved_outcome", F.lit(method).alias("method"), "channel", "n_buckets",
        "tau", utc_text(F.col("tau")).alias("tau_text"), "tau_bucket",
        "alarm_bucket", "alarm_start", "alarm_available", utc_text(F.col("alarm_available")).alias("alarm_text"), "direction",
        detected.alias("detected"), false.alias("false_alarm"),
        F.when(detected, a - b).alias("delay_buckets"),
        F.when(detected, F.col("alarm_available") - F.col("tau")).alias("delay_seconds"),
        "onset_bucket", "onset_mle", "winning_delta",
        (o - b).alias("onset_error"),
        F.when(o.isNotNull() & b.isNotNull(), b.between(o, a)).alias("covers_tau"),
        F.coalesce("statistic", "max_statistic").alias("statistic"),
        F.lit(int(round(threshold * UNIT))).cast("long").alias("threshold"),
    )


def sim_summary(evaluated: DataFrame) -> DataFrame:
    """Rates and medians by method, channel, level, mode and outcome. Streams without injection are a group of their own,
    whatever their outcome, and have a false-alarm rate alone; medians and coverage are of what was detected."""
    null = F.col("injection_mode").isNull()
    outcome = F.when(~null, F.col("resolved_outcome"))
    rate = lambda c: F.avg(F.col(c).cast("double"))
    seen = lambda c: F.when(F.col("detected"), F.col(c))
    grouped = evaluated.groupBy("method", "channel", "level", F.coalesce("injection_mode", F.lit("null")).alias("mode"), outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_scenarios"),
        rate("detected").alias("power"),
        rate("false_alarm").alias("false_alarm_rate"),
        F.percentile(seen("delay_buckets"), 0.5).alias("median_delay"),
        F.percentile(seen("onset_error"), 0.5).alias("median_onset_error"),
        F.avg(seen("covers_tau").cast("double")).alias("coverage"),
    )
    h1 = lambda c: F.when(F.col("mode") != "null", F.col(c)).alias(c)
    return grouped.select("method", "channel", "level", "mode", "outcome", "n_scenarios", h1("power"), "false_alarm_rate", h1("median_delay"), h1("median_onset_error"), h1("coverage"))


def outcome_class() -> Column:
    """What became of a run, one class each: the classes of a group add up to its runs."""
    null = F.col("injection_mode").isNull()
    return (
        F.when(null & F.col("alarm_bucket").isNull(), "null_quiet")
        .when(null, "null_alarm")
        .when(F.col("alarm_bucket").isNull(), "missed")
        .when(F.col("false_alarm"), "before_tau")
        .when(F.coalesce("covers_tau", F.lit(False)), "covers_tau")
        .otherwise("starts_late")
    )


CLASSES = ("null_quiet", "null_alarm", "missed", "before_tau", "covers_tau", "starts_late")


def outcome_partition(evaluated: DataFrame) -> DataFrame:
    """By level and mode how many runs are in each class, with subtotals by level and in all; `whole` says the classes add up."""
    told = evaluated.withColumn("class", outcome_class()).withColumn("mode", F.coalesce("injection_mode", F.lit("null")))
    counts = [F.count_if(F.col("class") == c).alias(c) for c in CLASSES]
    grouped = told.rollup("level", "mode").agg(F.grouping_id().cast("long").alias("grouping"), F.count(F.lit(1)).alias("runs"), *counts)
    return grouped.withColumn("whole", sum(F.col(c) for c in CLASSES) == F.col("runs"))


def evaluate_real(verdicts: DataFrame, stats: DataFrame, bounds: DataFrame, markets: DataFrame, method: str, threshold: float, size: int, min_buckets: int = 30, n_burn: int | None = 20) -> DataFrame:
    """One row a run on a contract without known change point: the alarm's window in buckets and in time.

    `markets` has question and closed_time by contract. The window goes from the onset's start to the alarm bucket's
    end; the lead is from there to the close. A contract of fewer than min_buckets is shallow; an onset in the first
    n_burn buckets may have spoiled its own baseline.
    """
    sizes = bounds.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n_buckets"))
    onset = bounds.select("condition_id", F.col("bucket_index").alias("onset_bucket"), F.col("start_ts").alias("window_start"))
    rows = verdicts.drop("n_buckets").join(sizes, "condition_id").join(markets, "condition_id").join(_at(stats, bounds), [*RUN, "alarm_bucket"], "left").join(onset, ["condition_id", "onset_bucket"], "left")
    end = F.col("alarm_available")
    burn = F.col("onset_bucket") < n_burn if n_burn is not None else F.lit(None).cast("boolean")
    return rows.select(
        "condition_id", "question", F.lit(method).alias("method"), "channel", F.lit(size).cast("long").alias("bucket_size"), "n_buckets",
        (F.col("n_buckets") < min_buckets).alias("shallow"), "alarmed", "alarm_bucket", "alarm_start", F.col("alarm_available").alias("alarm_end"),
        utc_text(F.col("alarm_start")).alias("alarm_start_text"), utc_text(end).alias("alarm_end_text"), (end - F.col("alarm_start")).alias("bucket_duration"),
        "onset_bucket", "onset_mle", "winning_delta", "window_start", utc_text(F.col("window_start")).alias("window_start_text"),
        (F.col("alarm_bucket") - F.col("onset_bucket") + 1).alias("window_buckets"), (end - F.col("window_start")).alias("window_duration"),
        (F.col("onset_bucket") == 0).alias("onset_at_start"), burn.alias("onset_in_burn_in"), "direction",
        (F.col("closed_time") - end).alias("lead_to_close"), F.coalesce("statistic", "max_statistic").alias("statistic"),
        F.lit(int(round(threshold * UNIT))).cast("long").alias("threshold"), "closed_time", utc_text(F.col("closed_time")).alias("closed_text"),
    )


def with_policy(trades: DataFrame, policy: DataFrame, default: int) -> DataFrame:
    """Trades of contracts that are not excluded, with the bucket size of each: `policy` has size and excluded for some."""
    told = trades.join(policy, "condition_id", "left").where(~F.coalesce("excluded", F.lit(False)))
    return told.withColumn("size", F.coalesce("size", F.lit(default))).drop("excluded")


def replayed(now: DataFrame, frozen: DataFrame, keys: list[str], fields: list[str], tolerance: float | None = None) -> DataFrame:
    """(keys, field, now, frozen) wherever a table built again differs from the frozen one; null equals null.

    A row that only one side has differs in 'row'. With a tolerance, numbers may differ by that much.
    """
    a, b = (df.select(*keys, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias(name)) for df, name in ((now, "a"), (frozen, "b")))
    both = a.join(b, keys, "full")
    differs = lambda f: ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    if tolerance is not None:
        exact, differs = differs, lambda f: exact(f) & F.coalesce(F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) > tolerance, F.lit(True))
    row = lambda name, told, x, y: F.struct(F.lit(name).alias("field"), told.alias("differs"), x.cast("double").alias("now"), y.cast("double").alias("frozen"))
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    rows = [row("row", ~whole, F.col("a").isNotNull().cast("int"), F.col("b").isNotNull().cast("int"))]
    rows += [row(f, whole & differs(f), F.col(f"a.{f}"), F.col(f"b.{f}")) for f in fields]
    return both.select(*keys, F.explode(F.array(*rows)).alias("d")).where("d.differs").select(*keys, "d.field", "d.now", "d.frozen")


def winning_path(walked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The walk of each alarmed run's winning shift and side, bucket by bucket."""
    won = verdicts.where("alarmed").select(*RUN, F.col("winning_delta").alias("delta"), F.col("direction").alias("side"), "alarm_bucket")
    return walked.join(won, [*RUN, "delta", "side"]).select(*RUN, "bucket_index", F.col("w").alias("w_winning"), (F.col("bucket_index") == F.col("alarm_bucket")).alias("at_alarm"))


def unmonotone(rows: DataFrame, value: str, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """By group how often value falls from one row to the next."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_step", step).groupBy(*by).agg(F.count_if(F.col("_step") < 0).alias("falls"), F.count(F.lit(1)).alias("n"))
