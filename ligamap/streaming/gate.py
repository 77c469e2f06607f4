"""The version gate: a request older than the newest seen so far is stale.

Requests come in the order of their ids. A request is judged by the requests of lesser ids alone, so requests that share
an id are judged alike, whatever order they stand in; those without an id come after all others and are judged alike too.
A request without a version is accepted and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ligamap.operators.ranges import range_of, splitters

#: The state store that value states need; a session names it in spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

JUDGED = "key string, request_id bigint, version bigint, accepted boolean"

#: Parts into which the requests of one id, which need no order, are dealt.
SALTS = 64


def gated(requests: DataFrame) -> DataFrame:
    """``requests`` (request_id, version) -> with ``accepted``: no request of a lesser id has a higher version.

    A running maximum is sequential. It is taken in ranges of request_id that hold about as many requests each, wherever
    the ids lie, and the ranges' maxima are run on, so that no task holds all requests. An id that very many requests share
    begins a range; what begins a range is judged by the ranges before it alone and needs no order.
    """
    _, splits = splitters(requests, "request_id")
    starts = F.split(F.lit(",".join(map(str, splits))), ",").cast("array<bigint>") if splits else F.array().cast("array<bigint>")
    dealt = requests.withColumn("_range", range_of(F.col("request_id"), splits))
    first = F.col("request_id").isNull() | F.coalesce(F.try_element_at(starts, F.greatest("_range", F.lit(1))) == F.col("request_id"), F.lit(False))
    dealt = dealt.withColumn("_first", first)
    ranges = dealt.groupBy("_range").agg(F.max(F.when(F.col("_first"), F.col("version"))).alias("_head"), F.max("version").alias("_high"))
    before = F.max("_high").over(Window.orderBy(F.asc_nulls_last("_range")).rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(F.col("_range").alias("_of"), before.alias("_before"), F.greatest(before, "_head").alias("_with_head"))  # greatest skips nulls
    salt = F.when(F.col("_first"), 1 + F.pmod(F.xxhash64("request_id", "version"), F.lit(SALTS))).otherwise(0)
    own = F.max("version").over(Window.partitionBy("_range", "_salt").orderBy("request_id").rangeBetween(Window.unboundedPreceding, -1))
    met = dealt.withColumn("_salt", salt).withColumn("_own", own).join(F.broadcast(ranges), F.col("_range").eqNullSafe(F.col("_of")))  # a row a range
    highest = F.when(F.col("_first"), F.col("_before")).otherwise(F.greatest("_own", "_with_head"))
    return met.select("request_id", "version", F.coalesce(F.col("version") >= highest, F.lit(True)).alias("accepted"))


def judged(frame: pd.DataFrame, high: int | None) -> tuple[pd.DataFrame, int | None]:
    """A key's requests of a batch with ``accepted``, after those that had ``high`` at most; and the highest version now."""
    most = frame.groupby("request_id", dropna=False)["version"].max()  # by id, those without at the end
    before = most.cummax().ffill().shift()
    if high is not None:
        before = before.fillna(high).clip(lower=high)
    at = frame["request_id"].map(before[before.index.notna()])
    at[frame["request_id"].isna()] = before[before.index.isna()].iloc[0] if before.index.hasnans else None
    accepted = frame["version"].isna() | at.isna() | (frame["version"] >= at).fillna(True)
    newest = pd.Series([high, frame["version"].max()], dtype="Int64").max()
    return frame.assign(accepted=accepted.astype(bool)), None if pd.isna(newest) else int(newest)


class Gate(StatefulProcessor):
    """Keeps a key's highest version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high", "high bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).astype({"request_id": "Int64", "version": "Int64"})
        found, high = judged(frame, self.high.get()[0] if self.high.exists() else None)
        if high is not None:
            self.high.update((high,))
        yield found[["key", "request_id", "version", "accepted"]]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        high = initialState["high"].max()
        if not pd.isna(high):
            self.high.update((int(high),))

    def close(self) -> None:
        pass


def gated_stream(requests: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The same over a stream of (key, request_id, version): each key has its own highest version, kept as state.

    The requests of a batch come after those of the batches before. ``seen`` (key, high) is what a key's stream starts from,
    as after requests that were judged in batch. A key's requests of one batch meet in one task; the source's trigger bounds them.
    """
    state = seen.groupBy("key") if seen is not None else None
    return requests.groupBy("key").transformWithStateInPandas(statefulProcessor=Gate(), outputStructType=JUDGED, outputMode="Append", timeMode="None", initialState=state)
