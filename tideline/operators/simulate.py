"""Synthetic streams with a known change point: parameters, nulls, injections. All draws are hashes of addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.expr import joined_key, micro
from ..sources.trades import TRADE_COLUMNS, yes_space
from .buckets import assign_buckets
from .calibrate import draw, tasks


def uniform(*address: Column) -> Column:
    """A number in (0, 1) from its address; the same whatever the partitioning."""
    return (draw(*address) + 0.5) / float(1 << 28)


def baseline_params(trades: DataFrame) -> DataFrame:
    """By contract: trades, wallets, span, share of long trades, mean size; first 70 % of the span to fit on."""
    spans = trades.groupBy("condition_id").agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    cut = spans.withColumn("fit_until", F.col("first_ts") + F.floor((F.col("last_ts") - F.col("first_ts")) * 7 / 10).cast("long"))
    fit = trades.join(F.broadcast(cut), "condition_id").where(F.col("timestamp") <= F.col("fit_until"))
    return fit.groupBy("condition_id", "fit_until").agg(F.count(F.lit(1)).alias("n_fit"), F.countDistinct("active_wallet").alias("n_wallets"), F.count_if(F.col("signed") > 0).alias("n_long"), F.sum("shares").alias("shares"))


def change_point(trades: DataFrame, seed: int = 1) -> DataFrame:
    """tau by contract: a place between 35 % and 70 % of the span, drawn by contract."""
    spans = trades.groupBy("condition_id").agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    share = F.lit(35) + F.pmod(draw(F.lit(str(seed)), F.lit("tau"), F.col("condition_id")), F.lit(36))
    return spans.select("condition_id", (F.col("first_ts") + F.floor((F.col("last_ts") - F.col("first_ts")) * share / 100)).cast("long").alias("tau"))


def _after(trades: DataFrame, seed: int, what: str) -> DataFrame:
    """Trades with tau, one a contract, whether they come after it, and their place in a drawn order among those."""
    told = trades.join(F.broadcast(change_point(trades, seed)), "condition_id").withColumn("after", F.col("timestamp") >= F.col("tau"))
    key = F.sha2(joined_key(str(seed), what, F.col("transaction_hash")).cast("binary"), 256)
    return told.withColumn("key", key)


def _first_share(told: DataFrame, flag: str, percent: int, out: str) -> DataFrame:
    """Marks floor(n percent / 100) of a contract's flagged rows: the first by key.

    Rows are ranked within slices of the key, and a slice's start is the sum of the slices before it, so that no task
    ranks a contract.
    """
    sliced = told.withColumn("slice", F.when(F.col(flag), F.substring("key", 1, 2)))
    counts = sliced.where(flag).groupBy("condition_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("condition_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("condition_id", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("condition_id")).alias("n"))
    within = F.row_number().over(Window.partitionBy("condition_id", "slice").orderBy("key", "transaction_hash"))
    placed = sliced.where(flag).withColumn("within", within).join(starts, ["condition_id", "slice"])
    marked = placed.withColumn(out, F.col("start") + F.col("within") <= F.floor(F.col("n") * percent / 100)).drop("within", "start", "n")
    return marked.unionByName(sliced.where(~F.col(flag)).withColumn(out, F.lit(False))).drop("slice")


def inject_tilt(trades: DataFrame, percent: int, seed: int = 1) -> DataFrame:
    """Turns that share of the short trades after tau long: the ones first in a drawn order, exactly floor(n share)."""
    told = _after(trades, seed, "tilt").withColumn("candidate", F.col("after") & (F.col("signed") < 0))
    return _first_share(told, "candidate", percent, "flipped").withColumn("signed", F.when(F.col("flipped"), -F.col("signed")).otherwise(F.col("signed"))).drop("key", "candidate", "after", "tau")


def inject_size(trades: DataFrame, factor: int, seed: int = 1) -> DataFrame:
    """Long trades after tau grow by a factor."""
    told = _after(trades, seed, "size").withColumn("grown", F.col("after") & (F.col("signed") > 0))
    size = lambda c: F.when(F.col("grown"), F.col(c) * factor).otherwise(F.col(c))
    return told.withColumn("signed", size("signed")).withColumn("shares", size("shares")).drop("key", "after", "tau")


def inject_wallet(trades: DataFrame, percent: int, wallet: str = "informed", seed: int = 1) -> DataFrame:
    """A share of the trades after tau change hands to one wallet; sizes and sides stay."""
    return _first_share(_after(trades, seed, "wallet"), "after", percent, "moved").withColumn("active_wallet", F.when(F.col("moved"), F.lit(wallet)).otherwise(F.col("active_wallet"))).drop("key", "after", "tau")


def inject_additive(trades: DataFrame, total: int, pieces: int, wallet: str = "informed", seed: int = 1) -> DataFrame:
    """Adds `pieces` long trades of one wallet evenly from tau to the end, `total` in all: the last takes the remainder."""
    ends = trades.groupBy("condition_id").agg(F.max("timestamp").alias("last_ts"))
    each = total // pieces
    added = change_point(trades, seed).join(ends, "condition_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    shares = F.when(F.col("i") == pieces - 1, F.lit(total - each * (pieces - 1))).otherwise(F.lit(each)).cast("long")
    rows = added.select("condition_id", (F.col("tau") + F.floor((F.col("last_ts") - F.col("tau")) * F.col("i") / pieces)).cast("long").alias("timestamp"), F.concat(F.lit("x"), F.col("condition_id"), F.col("i").cast("string")).alias("transaction_hash"), F.lit(wallet).alias("active_wallet"), shares.alias("shares"), shares.alias("signed"))
    return trades.select("condition_id", "timestamp", "transaction_hash", "active_wallet", "shares", "signed").unionByName(rows)


def scenario_grid(spark: SparkSession, seeds: int = 4) -> DataFrame:
    """Nulls by level and seed, and each injection mode by level, seed and outcome."""
    levels = "VALUES ('L0'), ('L1'), ('L2') AS l(level)"
    modes = "VALUES ('additive'), ('direction_tilt'), ('size_tilt'), ('wallet_only') AS m(mode)"
    return spark.sql(f"SELECT concat_ws('_', level, 'null', cast(seed as string)) AS scenario_id, level, 'null' AS mode, cast(null as string) AS outcome, seed FROM (SELECT * FROM {levels}) CROSS JOIN (SELECT id AS seed FROM range({seeds})) UNION ALL SELECT concat_ws('_', level, mode, outcome, cast(seed as string)), level, mode, outcome, seed FROM (SELECT * FROM {levels}) CROSS JOIN (SELECT * FROM {modes}) CROSS JOIN (SELECT * FROM VALUES ('Yes'), ('No') AS o(outcome)) CROSS JOIN (SELECT id AS seed FROM range({seeds}))")


def place_in_contract(trades: DataFrame, slice_seconds: int = 6 * 3600) -> DataFrame:
    """Adds place, the rank from 0 in the contract's total order by time and hash; many tasks rank one contract."""
    return assign_buckets(trades, 1, slice_seconds).withColumnRenamed("bucket_index", "place")


def price_steps(trades: DataFrame, slice_seconds: int = 6 * 3600) -> DataFrame:
    """(condition_id, step): yes_price less that of the trade before, within time slices and between neighbours of them."""
    sliced = trades.select("condition_id", "timestamp", "transaction_hash", "yes_price", F.floor(F.col("timestamp") / slice_seconds).alias("slice"))
    order = F.struct("timestamp", "transaction_hash")
    inside = sliced.withColumn("step", F.col("yes_price") - F.lag("yes_price").over(Window.partitionBy("condition_id", "slice").orderBy("timestamp", "transaction_hash")))
    ends = sliced.groupBy("condition_id", "slice").agg(F.min_by("yes_price", order).alias("first"), F.max_by("yes_price", order).alias("last"))
    between = ends.withColumn("step", F.col("first") - F.lag("last").over(Window.partitionBy("condition_id").orderBy("slice")))
    return inside.select("condition_id", "step").unionByName(between.select("condition_id", "step")).where("step IS NOT NULL")


def fit_parameters(trades: DataFrame, percent: int = 70) -> DataFrame:
    """What a synthetic stream needs of each contract, from the first `percent` of its span.

    Rows to fit on and held out, arrivals a second, share of long trades, mean and deviation of log sizes, largest
    size, share of whole sizes, median price, deviation of price steps, wallets and the share of trades of the 10, 100
    and 1000 busiest. Deviations have n - 1 below; sizes and prices are on the grid.
    """
    spans = trades.groupBy("condition_id").agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    cut = spans.select("condition_id", (F.col("first_ts") + F.floor((F.col("last_ts") - F.col("first_ts")) * percent / 100)).cast("long").alias("fit_until"))
    told = trades.join(F.broadcast(cut), "condition_id").withColumn("fits", F.col("timestamp") <= F.col("fit_until"))
    fit = told.where("fits")
    logs = F.log(F.col("shares") / 1e6)
    plain = fit.groupBy("condition_id").agg(
        F.count(F.lit(1)).alias("fit_rows"),
        ((F.count(F.lit(1)) - 1) / F.greatest(F.max("timestamp") - F.min("timestamp"), F.lit(1))).alias("rate"),
        F.avg((F.col("signed") > 0).cast("double")).alias("p_long"),
        F.avg(logs).alias("log_mu"),
        F.stddev_samp(logs).alias("log_sigma"),
        F.max("shares").alias("shares_max"),
        F.avg((F.col("shares") % 1_000_000 == 0).cast("double")).alias("p_round"),
        F.percentile("yes_price", 0.5).alias("price_init"),
    )
    held = told.groupBy("condition_id").agg(F.count_if(~F.col("fits")).alias("holdout_rows"))
    steps = price_steps(fit).groupBy("condition_id").agg(F.stddev_samp("step").alias("price_sigma"))
    return plain.join(held, "condition_id").join(steps, "condition_id", "left").join(wallet_concentration(fit), "condition_id")


def wallet_concentration(trades: DataFrame, tops: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """Wallets of each contract and the share of its trades that the busiest of them made; null with fewer wallets than that."""
    counts = trades.groupBy("condition_id", "active_wallet").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("condition_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_wallets"))
    place = F.row_number().over(Window.partitionBy("condition_id").orderBy(F.desc("n"), "active_wallet"))
    top = counts.withColumn("place", place).where(F.col("place") <= max(tops)).groupBy("condition_id").agg(*[F.sum(F.when(F.col("place") <= k, F.col("n"))).alias(f"top{k}") for k in tops])
    share = lambda k: F.when(F.col("n_wallets") >= k, F.col(f"top{k}") / F.col("total")).alias(f"top{k}_share")
    return total.join(top, "condition_id").select("condition_id", "n_wallets", *map(share, tops))


# --- null streams of each contract's own size and parameters ---

BLOCK = 4096


def numbered(params: DataFrame, n: str) -> DataFrame:
    """Rows 0 to n - 1 of every contract, laid out in blocks so that none is one array or one task.

    The number of tasks is given: by their bytes alone the blocks, one row each, would be put together in one.
    """
    blocks = params.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / BLOCK))))
    rows = blocks.repartition(tasks(params), "condition_id", "block").withColumn("i", F.explode(F.sequence(F.col("block") * BLOCK, F.least(F.col(n), (F.col("block") + 1) * BLOCK) - 1)))
    return rows


def running(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the sum of value over rows up to i: within blocks, and over block totals before.

    The totals, one row in BLOCK, are sent to the rows; the rows, whose number the planner does not see, never to them.
    """
    inner = F.sum(value).over(Window.partitionBy("condition_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy("condition_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("condition_id", "block").agg(F.sum(value).alias("_total")).select("condition_id", "block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    return rows.withColumn("_inner", inner).join(F.broadcast(totals), ["condition_id", "block"]).withColumn(out, F.col("_start") + F.col("_inner")).drop("_inner", "_start")


def _u(what: str, seed: int) -> Column:
    return uniform(F.lit(str(seed)), F.lit(what), F.col("condition_id"), F.col("i").cast("string"))


def _normal(what: str, seed: int) -> Column:
    """A standard normal from two uniforms (Box and Muller)."""
    return F.sqrt(-2.0 * F.log(_u(f"{what}1", seed))) * F.cos(F.lit(6.283185307179586) * _u(f"{what}2", seed))


def arrivals(params: DataFrame, level: str, seed: int = 1, start_ts: int = 1_700_000_000) -> DataFrame:
    """Arrival times of each contract's fit_rows trades; gaps in whole milliseconds.

    L0: independent exponential gaps at the contract's rate. L1: proposals at three times the rate, kept with the share
    season x ramp / 3 of them, season a daily sine and ramp a rise towards the end; the first fit_rows that stay.
    """
    if level == "L0":
        rows = numbered(params, "fit_rows").withColumn("gap", F.floor(-F.log(_u("gap", seed)) / F.col("rate") * 1000).cast("long"))
        return running(rows, "gap", "ms").withColumn("timestamp", F.lit(start_ts) + F.floor(F.col("ms") / 1000)).drop("gap", "ms")
    proposals = numbered(params.withColumn("asked", F.col("fit_rows") * 10 + 200), "asked")
    timed = running(proposals.withColumn("gap", F.floor(-F.log(_u("gap", seed)) / (F.col("rate") * 3) * 1000).cast("long")), "gap", "ms")
    t = F.col("ms") / 1000.0
    season = 0.6 + 0.4 * F.sin(F.lit(6.283185307179586) * (t / 86400.0))
    ramp = 0.4 + 1.6 * F.least(t / (F.col("fit_rows") / F.col("rate")), F.lit(1.0))
    kept = timed.withColumn("stays", (_u("thin", seed) < season * ramp / 3.0).cast("long"))
    placed = running(kept, "stays", "nth").where("stays = 1 AND nth <= fit_rows")
    return placed.drop("block", "i").withColumn("i", F.col("nth") - 1).withColumn("block", F.floor(F.col("i") / BLOCK)).withColumn("timestamp", F.lit(start_ts) + F.floor(F.col("ms") / 1000)).drop("gap", "ms", "stays", "nth", "asked")


def null_trades(params: DataFrame, source: DataFrame, level: str = "L0", seed: int = 1, p_long: float = 0.5) -> DataFrame:
    """Streams without informed flow, one of each contract: sides even, sizes lognormal with a spike of whole ones and a cap,
    prices a clamped random walk, wallets as often as in `source`.

    A wallet is that of a drawn trade of the contract: drawing a place evenly draws wallets by their counts.
    """
    rows = arrivals(params, level, seed)
    size = F.exp(F.col("log_mu") + F.col("log_sigma") * _normal("size", seed))
    size = F.when(_u("round", seed) < F.col("p_round"), F.greatest(F.floor(size + 0.5), F.lit(1.0).cast("double"))).otherwise(size)
    step = micro(F.col("price_sigma") / 1e6 * _normal("price", seed))
    walked = running(rows.withColumn("step", step), "step", "moved")
    price = F.greatest(F.lit(1000), F.least(F.lit(999_000), F.floor(F.col("price_init")).cast("long") + F.col("moved")))
    drawn = walked.select(
        "condition_id", "i", "timestamp",
        (_u("long", seed) < p_long).alias("is_long"),
        (_u("pick", seed) < 0.5).alias("pick"),
        F.least(micro(size), F.col("shares_max")).alias("shares"),
        price.alias("yes_price"),
        F.floor(_u("wallet", seed) * F.col("fit_rows")).cast("long").alias("place"),
    )
    wallets = place_in_contract(source).select("condition_id", "place", "active_wallet")
    joined = drawn.join(wallets.hint("shuffle_hash"), ["condition_id", "place"], "left")  # both grow with the trades
    outcome = F.when(F.col("pick"), "Yes").otherwise("No")
    side = F.when(F.col("is_long") == F.col("pick"), "BUY").otherwise("SELL")
    return joined.select(
        "condition_id", "timestamp",
        F.sha2(joined_key(str(seed), level, F.col("condition_id"), F.col("i").cast("string")).cast("binary"), 256).alias("transaction_hash"),
        "active_wallet", side.alias("side"), outcome.alias("outcome"), "shares",
        F.when(F.col("is_long"), F.col("shares")).otherwise(-F.col("shares")).alias("signed"),
        "yes_price",
    )


def null_bootstrap(trades: DataFrame, seed: int = 1, block_seconds: int = 45 * 60, start_ts: int = 1_700_000_000) -> DataFrame:
    """L2: calendar blocks of a contract drawn with replacement, as many as it has, and stamped one after the other.

    Order within a block, sides, sizes and which trades share a wallet stay; wallets and hashes get new names one to one.
    """
    blocked = trades.withColumn("calendar", F.floor(F.col("timestamp") / block_seconds))
    spans = blocked.groupBy("condition_id", "calendar").agg(F.min("timestamp").alias("begin"), (F.max("timestamp") - F.min("timestamp")).alias("long"))
    order = Window.partitionBy("condition_id").orderBy("calendar")
    groups = spans.withColumn("g", F.row_number().over(order).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("condition_id")))
    picks = groups.select("condition_id", F.col("g").alias("j"), F.pmod(draw(F.lit(str(seed)), F.lit("block"), F.col("condition_id"), F.col("g").cast("string")), F.col("n")).alias("g"))
    placed = picks.join(groups, ["condition_id", "g"])
    before = Window.partitionBy("condition_id").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    stamped = placed.withColumn("start", F.lit(start_ts) + F.coalesce(F.sum(F.col("long") + 1).over(before), F.lit(0))).select("condition_id", "calendar", "j", "start", "begin")
    rows = blocked.join(stamped, ["condition_id", "calendar"])
    named = lambda what, *parts: F.sha2(joined_key(str(seed), what, *parts).cast("binary"), 256)
    return rows.select(
        "condition_id",
        (F.col("start") + F.col("timestamp") - F.col("begin")).alias("timestamp"),
        named("tx", F.col("j").cast("string"), F.col("transaction_hash")).alias("transaction_hash"),
        F.concat(F.lit("0x"), F.substring(named("wallet", F.col("active_wallet")), 1, 40)).alias("active_wallet"),
        "side", "outcome", "shares", "signed", "yes_price",
    )


def assembled(core: DataFrame) -> DataFrame:
    """The fourteen trade columns of synthetic trades, with a market of their own each."""
    yes = F.col("outcome") == "Yes"
    price = F.when(yes, F.col("yes_price")).otherwise(1_000_000 - F.col("yes_price")) / 1e6
    rows = core.withColumn("gross_price", price).withColumn("gross_shares", F.col("shares") / 1e6)
    rows = rows.withColumn("gross_cash", F.col("gross_price") * F.col("gross_shares")).withColumn("question", F.col("condition_id")).withColumn("resolved_outcome", F.lit(None).cast("string"))
    return yes_space(rows.withColumn("token_id", F.concat_ws(":", "condition_id", "outcome")).drop("yes_price")).select(*TRADE_COLUMNS)


# --- scenario streams: every contract without and with each injection, known by 'mode~contract' ---

MODES = ("null", "additive", "direction_tilt", "size_tilt", "wallet_only")
TRUTH = "informed"


def scenario_trades(trades: DataFrame, seed: int = 1) -> DataFrame:
    """All scenario streams of all contracts as one table, with the injected trades marked."""
    columns = ("condition_id", "timestamp", "transaction_hash", "active_wallet", "shares", "signed")
    made = {
        "null": trades.withColumn("injected", F.lit(False)),
        "additive": inject_additive(trades, 40_000_000_000, 40, seed=seed).withColumn("injected", F.col("active_wallet") == TRUTH),
        "direction_tilt": inject_tilt(trades, 90, seed).withColumn("injected", F.col("flipped")),
        "size_tilt": inject_size(trades, 3, seed).withColumn("injected", F.col("grown")),
        "wallet_only": inject_wallet(trades, 25, seed=seed).withColumn("injected", F.col("moved")),
    }
    rows = [df.select(F.concat(F.lit(f"{mode}~"), F.col("condition_id")).alias("condition_id"), *columns[1:], "injected") for mode, df in made.items()]
    return reduce(DataFrame.unionByName, rows)


def scenario_truth(trades: DataFrame, levels: dict[str, str], seed: int = 1) -> DataFrame:
    """One row a scenario stream: level, mode, outcome of the contract and tau, null for streams without injection."""
    tau = change_point(trades, seed)
    level = F.lit("L2")
    for name, value in levels.items():
        level = F.when(F.col("base") == name, value).otherwise(level)
    modes = F.explode(F.array(*map(F.lit, MODES)))
    rows = tau.withColumn("mode", modes).withColumnRenamed("condition_id", "base")
    return rows.select(
        F.concat_ws("~", "mode", "base").alias("condition_id"), "base", level.alias("level"),
        F.when(F.col("mode") != "null", F.col("mode")).alias("injection_mode"),
        F.when(F.col("mode") != "null", F.col("tau")).alias("tau"),
    )
