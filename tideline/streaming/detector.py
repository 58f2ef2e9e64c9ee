"""The detector on an unbounded stream, and calendar VWAP with a watermark.

A contract's state is what the batch walk needs of the past: trades of the open bucket, the values its baseline rests
on, and by shift and side the walk and the bucket after its last zero. A bucket is emitted on its last trade, so the
stream has whole buckets only. Trades of one micro-batch are taken in order of time and hash; a trade that comes before
the end of the last closed bucket is late: it enters no bucket, and the row after it says how many there were.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.walk import UNIT

OUTPUT = "condition_id string, bucket_index long, end_ts long, x long, z long, statistic long, direction int, onset long, alarmed boolean, first_alarm boolean, n_late long"
STATE = "ts array<long>, hash array<string>, signed array<long>, bucket long, last_ts long, values array<long>, mu double, sigma double, walk array<long>, zero array<long>, alarm long, late long"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def _micro(x: float) -> int:
    return math.floor(x * 1e6 + 0.5)


def _robust(values: list[int]) -> tuple[float, float]:
    held = np.array(values, np.float64)
    mu = float(np.median(held))
    return mu, float(np.median(np.abs(held - mu)) * 1.4826)


def detector(size: int = 20, head: int = 20, deltas: tuple[float, ...] = (0.5, 0.75, 1.0), threshold: float = 4.0, trailing: tuple[int, int] | None = None):
    """The update of one contract's state by new trades.

    The baseline is that of the first `head` buckets, frozen; with `trailing` (reference, least) that of up to
    `reference` buckets before each, never its own, once there are `least`.
    """
    grid = [(round(4 * d) * s, round(d * d / 2 * UNIT), s) for d in deltas for s in (1, -1)]
    start = trailing[1] if trailing else head

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        empty = ([], [], [], 0, -1, [], None, None, [0] * len(grid), [start] * len(grid), None, 0)
        ts, name, signed, bucket, last, values, mu, sigma, walk, zero, alarm, late = state.get if state.exists else empty
        ts, name, signed, values, walk, zero = map(list, (ts, name, signed, values, walk, zero))
        for frame in frames:
            fresh = frame["timestamp"].to_numpy() >= last
            late += int((~fresh).sum())
            ts += frame["timestamp"][fresh].tolist()
            name += frame["transaction_hash"][fresh].tolist()
            signed += frame["signed"][fresh].tolist()
        order = np.lexsort((np.array(name, dtype=str), np.array(ts, np.int64))) if ts else np.zeros(0, np.int64)
        whole = len(order) // size
        times, sizes = (np.array(v, np.int64)[order] for v in (ts, signed))
        nets = sizes[: whole * size].reshape(whole, size).sum(axis=1)
        gross = np.abs(sizes[: whole * size]).reshape(whole, size).sum(axis=1)
        ends = times[: whole * size].reshape(whole, size).max(axis=1)
        out = []
        for net, all_, end in zip(nets.tolist(), gross.tolist(), ends.tolist()):
            x, b = _micro(max(-1.0, min(1.0, net / all_))) if all_ else 0, bucket
            bucket, last = bucket + 1, end
            if trailing:
                mu, sigma = _robust(values) if len(values) >= trailing[1] else (None, None)
                values = [*values, x][-trailing[0] :]
            elif b < head:
                values.append(x)
                if b + 1 == head:
                    mu, sigma = _robust(values)
                continue
            if b < start or mu is None:
                continue
            z = _micro((x - mu) / (sigma + 1e-3))
            onset = list(zero)  # the bucket after the last zero before this one
            walk = [max(0, w + step * z - drift) for w, (step, drift, _) in zip(walk, grid)]
            zero = [b + 1 if w == 0 else o for w, o in zip(walk, zero)]
            best = max(walk)
            side = max(s for w, (_, _, s) in zip(walk, grid) if w == best)
            at = next(k for k, (w, (_, _, s)) in enumerate(zip(walk, grid)) if w == best and s == side)
            alarmed = best >= threshold * UNIT
            first = alarmed and alarm is None
            alarm = b if first else alarm
            out.append((key[0], b, end, x, z, best, side, min(b, onset[at]), alarmed, first, late))
        rest = order[whole * size :].tolist()
        state.update(([ts[i] for i in rest], [name[i] for i in rest], [signed[i] for i in rest], bucket, last, values, mu, sigma, walk, zero, alarm, late))
        yield pd.DataFrame(out, columns=COLUMNS)

    return run


def stream_detector(trades: DataFrame, **parameters) -> DataFrame:
    """One row a completed bucket once there is a baseline, from a stream of trades on the grid."""
    return trades.select("condition_id", "timestamp", "transaction_hash", "signed").groupBy("condition_id").applyInPandasWithState(detector(**parameters), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_vwap(trades: DataFrame, seconds: int = 21600, delay: str = "1 hour") -> DataFrame:
    """VWAP by calendar interval, appended once the watermark has passed it."""
    timed = trades.withColumn("ts", F.timestamp_seconds("timestamp")).withWatermark("ts", delay)
    sums = timed.groupBy("condition_id", F.window("ts", f"{seconds} seconds")).agg(F.sum(F.col("yes_price").cast("decimal(38,0)") * F.col("shares")).alias("paid"), F.sum("shares").alias("shares"))
    return sums.select("condition_id", F.unix_seconds("window.start").alias("start_ts"), "shares", F.floor(F.col("paid").cast("double") / F.col("shares")).cast("long").alias("vwap"))


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what its source holds now and read what it wrote."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
