"""Trades from event streams and order books, and the raw ledger layer they can be written back to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.expr import micro

TRADE_COLUMNS = ["timestamp", "side", "gross_shares", "gross_price", "active_wallet", "yes_price", "signed_yes_size", "condition_id", "question", "outcome", "resolved_outcome", "token_id", "gross_cash", "transaction_hash"]
RESOLVED = {"click": "Yes", "purchase": "No", "signup": "Yes", "view": "No", "error": "No"}
EXCHANGE = "exchange"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def yes_space(trades: DataFrame) -> DataFrame:
    """Adds yes_price and signed_yes_size: buying Yes and selling No are long, the price of No is one less that of Yes."""
    yes = F.col("outcome") == "Yes"
    long = (F.col("side") == "BUY") == yes
    return trades.withColumn("yes_price", F.when(yes, F.col("gross_price")).otherwise(1.0 - F.col("gross_price"))).withColumn("signed_yes_size", F.when(long, F.col("gross_shares")).otherwise(-F.col("gross_shares")))


def event_trades(events: DataFrame) -> DataFrame:
    """The fourteen trade columns from an event stream: the property k gives side, outcome and price, the value the size."""
    k = F.get_json_object("props", "$.k").cast("int")
    outcome = F.when(F.col("k") % 3 == 0, "No").otherwise("Yes")
    resolved = F.lit(None).cast("string")
    for condition, result in RESOLVED.items():
        resolved = F.when(F.col("event_type") == condition, result).otherwise(resolved)
    base = events.withColumn("k", k).select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(F.col("k") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.col("value").alias("gross_shares"),
        ((F.col("k") + 1) / F.lit(101.0)).alias("gross_price"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("active_wallet"),
        F.col("event_type").alias("condition_id"),
        F.col("event_type").alias("question"),
        outcome.alias("outcome"),
        resolved.alias("resolved_outcome"),
        F.concat_ws(":", "event_type", outcome).alias("token_id"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("transaction_hash"),
    )
    return yes_space(base.withColumn("gross_cash", F.col("gross_price") * F.col("gross_shares"))).select(*TRADE_COLUMNS)


def order_trades(orders: DataFrame) -> DataFrame:
    """The trade columns from an order book, heavy in equal timestamps."""
    base = orders.select(
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
        F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        (F.col("o_totalprice") / 1000.0).alias("gross_shares"),
        F.lit(0.5).alias("gross_price"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("active_wallet"),
        F.col("o_orderpriority").alias("condition_id"),
        F.col("o_orderpriority").alias("question"),
        F.lit("Yes").alias("outcome"),
        F.lit("Yes").alias("resolved_outcome"),
        F.concat_ws(":", "o_orderpriority", F.lit("Yes")).alias("token_id"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("transaction_hash"),
    )
    return yes_space(base.withColumn("gross_cash", F.col("gross_price") * F.col("gross_shares"))).select(*TRADE_COLUMNS)


def on_grid(trades: DataFrame) -> DataFrame:
    """Sizes and cash in millionths, so that sums and ties are exact whatever the order of rows."""
    return trades.select(
        "condition_id", "timestamp", "transaction_hash", "active_wallet", "side", "outcome",
        micro(F.col("gross_shares")).alias("shares"),
        F.when(F.col("signed_yes_size") >= 0, micro(F.col("gross_shares"))).otherwise(-micro(F.col("gross_shares"))).alias("signed"),
        micro(F.col("gross_cash")).alias("cash"),
        micro(F.col("yes_price")).alias("yes_price"),
    )


def _match_columns(first: str) -> list:
    buys = F.col("side") == "BUY"
    shares, cash = (micro(F.col(c)).cast("string") for c in ("gross_shares", "gross_cash"))
    return [
        F.col("transaction_hash").alias(first),
        F.col("timestamp").cast("string").alias("timestamp"),
        F.when(buys, "0").otherwise(F.col("token_id")).alias("makerAssetID"),
        F.when(buys, F.col("token_id")).otherwise("0").alias("takerAssetID"),
        F.when(buys, cash).otherwise(shares).alias("makerAmountFilled"),
        F.when(buys, shares).otherwise(cash).alias("takerAmountFilled"),
    ]


def raw_matches(trades: DataFrame) -> DataFrame:
    """Trades written as raw matches: amounts as text in millionths, the cash leg's asset is '0'."""
    return trades.select(*_match_columns("id"))


def raw_fills(trades: DataFrame) -> DataFrame:
    """Two fills a trade as a two-sided scan gives them: the active wallet's against the exchange, and a counterparty's; the first comes twice."""
    m = trades.select("active_wallet", *_match_columns("transactionHash"))
    text = lambda c: F.col(c).alias(c)
    one = F.struct(F.concat("transactionHash", F.lit("_a")).alias("fill_id"), F.col("active_wallet").alias("maker"), F.lit(EXCHANGE).alias("taker"), F.col("makerAssetID").alias("makerAssetId"), F.col("takerAssetID").alias("takerAssetId"), text("makerAmountFilled"), text("takerAmountFilled"))
    pool = F.concat(F.lit("pool"), F.substring("transactionHash", -1, 1))
    other = F.struct(F.concat("transactionHash", F.lit("_b")).alias("fill_id"), pool.alias("maker"), F.col("active_wallet").alias("taker"), F.col("takerAssetID").alias("makerAssetId"), F.col("makerAssetID").alias("takerAssetId"), F.col("takerAmountFilled").alias("makerAmountFilled"), F.col("makerAmountFilled").alias("takerAmountFilled"))
    fills = m.select("transactionHash", "timestamp", F.explode(F.array(one, other, one)).alias("f"))
    return fills.select("f.fill_id", "transactionHash", "timestamp", "f.maker", "f.taker", "f.makerAssetId", "f.takerAssetId", "f.makerAmountFilled", "f.takerAmountFilled", F.lit("0").alias("fee"))


TRADE_SCHEMA = T.StructType([T.StructField(c, T.LongType() if c == "timestamp" else T.DoubleType() if c in ("gross_shares", "gross_price", "yes_price", "signed_yes_size", "gross_cash") else T.StringType()) for c in TRADE_COLUMNS])


def assert_schema(df: DataFrame, expected: T.StructType = TRADE_SCHEMA) -> DataFrame:
    """Fail on drift of names or types; nullability is free."""
    got = [(f.name, f.dataType) for f in df.schema]
    if got != [(f.name, f.dataType) for f in expected]:
        raise ValueError(f"schema drift: {got}")
    return df
