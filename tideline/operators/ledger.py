"""From raw fills and matches to trades: dedup, decode, joins, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.trades import EXCHANGE, yes_space


def deduplicated(fills: DataFrame, key: str = "fill_id") -> DataFrame:
    """One row a fill: both sides of a scan return the fills of a pair they share."""
    return fills.dropDuplicates([key])


def decoded(matches: DataFrame) -> DataFrame:
    """Side, token, cash and shares of each match; exactly one leg is cash."""
    buys = F.col("makerAssetID") == "0"
    amount = lambda name: F.col(name).cast("long") / 1e6
    out = matches.select(
        F.col("id").alias("transaction_hash"),
        F.col("timestamp").cast("long").alias("timestamp"),
        F.when(buys, "BUY").otherwise("SELL").alias("side"),
        F.when(buys, F.col("takerAssetID")).otherwise(F.col("makerAssetID")).alias("token_id"),
        F.when(buys, amount("makerAmountFilled")).otherwise(amount("takerAmountFilled")).alias("gross_cash"),
        F.when(buys, amount("takerAmountFilled")).otherwise(amount("makerAmountFilled")).alias("gross_shares"),
        ((F.col("makerAssetID") == "0") != (F.col("takerAssetID") == "0")).alias("one_cash_leg"),
    )
    return out.withColumn("gross_price", F.when(F.col("gross_shares") != 0, F.col("gross_cash") / F.col("gross_shares")))


def active_wallets(fills: DataFrame) -> DataFrame:
    """The maker of the fill that the exchange takes, by transaction; `fills` counts them, one in a sound ledger."""
    taken = deduplicated(fills).where(F.col("taker") == EXCHANGE)
    return taken.groupBy(F.col("transactionHash").alias("transaction_hash")).agg(F.min("maker").alias("active_wallet"), F.count(F.lit(1)).alias("fills"))


def token_map(metadata: DataFrame) -> DataFrame:
    """Two rows a market: its Yes token and its No token."""
    return metadata.select("condition_id", "question", "resolved_outcome", F.expr("stack(2, yes_token_id, 'Yes', no_token_id, 'No') AS (token_id, outcome)"))


def market_metadata(trades: DataFrame) -> DataFrame:
    """Markets as the trades name them."""
    return trades.groupBy("condition_id", "question").agg(
        F.max("resolved_outcome").alias("resolved_outcome"), F.concat(F.first("condition_id"), F.lit(":Yes")).alias("yes_token_id"), F.concat(F.first("condition_id"), F.lit(":No")).alias("no_token_id")
    )


def built_trades(matches: DataFrame, fills: DataFrame, metadata: DataFrame) -> DataFrame:
    """Decoded matches with wallet (one to one) and market (many to one), in Yes space. The market table is small, one row a market; Spark decides by its size."""
    joined = decoded(matches).join(active_wallets(fills), "transaction_hash", "left").join(token_map(metadata), "token_id", "left")
    return yes_space(joined)


def market_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n_trades"), F.countDistinct("active_wallet").alias("n_wallets"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def violations(df: DataFrame, **rules) -> DataFrame:
    """(name, violations): how many rows fail each rule, all rules in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return counts.select(F.expr(f"stack({len(rules)}, {pairs}) AS (name, violations)"))


def raw_gate(fills: DataFrame) -> DataFrame:
    return violations(
        fills,
        one_cash_leg=(F.col("makerAssetId") == "0") != (F.col("takerAssetId") == "0"),
        positive_amounts=(F.col("makerAmountFilled").cast("long") > 0) & (F.col("takerAmountFilled").cast("long") > 0),
        fee_not_negative=F.col("fee").cast("long") >= 0,
        known_maker=F.col("maker").isNotNull(),
    )


def trade_gate(trades: DataFrame) -> DataFrame:
    """Range and uniqueness rules of the trade table."""
    rows = violations(
        trades,
        price_in_unit=F.col("yes_price").between(0, 1) & F.col("gross_price").between(0, 1),
        shares_positive=F.col("gross_shares") > 0,
        cash_not_negative=F.col("gross_cash") >= 0,
        side_known=F.col("side").isin("BUY", "SELL"),
        outcome_known=F.col("outcome").isin("Yes", "No"),
        size_is_shares=F.abs("signed_yes_size") == F.col("gross_shares"),
    )
    keys = trades.groupBy("transaction_hash").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
    return rows.unionByName(keys.select(F.lit("transaction_unique").alias("name"), "violations"))
