"""Streams of records: encoded row by row, matched against a table, counted in windows, thinned to first ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmesh.functions import levenshtein, soundex
from lexmesh.functions.distance import damerau


def match_stream(stream: DataFrame, table: DataFrame, stream_on: str, table_on: str, max_distance: int) -> DataFrame:
    """Stream-static join on equal Soundex codes with a capped native distance; keeps no state."""
    coded = table.withColumn("__code", soundex(table_on))
    distance = levenshtein(stream[stream_on], coded[table_on], max_distance)
    joined = stream.withColumn("__stream_code", soundex(stream_on)).join(coded, F.col("__stream_code") == F.col("__code"))
    return joined.withColumn("distance", distance).where(F.col("distance") <= max_distance).drop("__code", "__stream_code")


def code_counts(stream: DataFrame, on: str, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Records by Soundex code and tumbling window of event time; state goes once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), soundex(on).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def first_records(stream: DataFrame, on: str, time: str, max_distance: int = 1, span_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """Of records that are near one another within a time span the first: code, value, time.

    A record is a follower if a first one with its Soundex code, within ``max_distance`` (Damerau) of it, stands at most ``span_ms``
    before it; else it is a first one. Records wait in the state until the watermark has passed them and are
    then taken by event time (equal times by value), so the result does not depend on how they arrive or
    in which batches. A code's state goes with its last span. Rows later than the watermark are dropped and
    counted in the query's progress (numRowsDroppedByWatermark); null values and times are left out.
    """
    known = stream.where(F.col(on).isNotNull() & F.col(time).isNotNull())
    coded = known.select(soundex(on).alias("code"), F.col(on).cast("string").alias("value"), F.col(time).cast("timestamp").alias("time")).withWatermark("time", late)
    coded = coded.withColumn("micros", F.unix_micros("time"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, first_times, firsts = map(list, state.get) if state.exists else ([], [], [], [])
        if not state.hasTimedOut:
            for frame in frames:
                times += frame["micros"].tolist()
                values += frame["value"].tolist()
        now = state.getCurrentWatermarkMs() * 1000
        waiting = sorted(zip(times, values, strict=True))
        ready = [x for x in waiting if x[0] <= now]
        waiting = waiting[len(ready) :]
        out = []
        for t, v in ready:
            near = [w for w, s in zip(firsts, first_times, strict=True) if t - s <= span_ms * 1000]
            if all(d > max_distance for d in damerau([v] * len(near), near, [max_distance] * len(near))):
                out.append((key[0], v, t))
                firsts.append(v)
                first_times.append(t)
        kept = [(t, v) for t, v in zip(first_times, firsts, strict=True) if t + span_ms * 1000 >= now]
        if waiting or kept:
            state.update(([t for t, _ in waiting], [v for _, v in waiting], [t for t, _ in kept], [v for _, v in kept]))
            # The next time at which something is ready, or nothing is left.
            due = waiting[0][0] if waiting else max(t for t, _ in kept) + span_ms * 1000
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["code", "value", "micros"])

    firsts = coded.groupBy("code").applyInPandasWithState(step, "code string, value string, micros long", "times array<long>, values array<string>, first_times array<long>, firsts array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    return firsts.select("code", "value", F.timestamp_micros("micros").alias("time"))
