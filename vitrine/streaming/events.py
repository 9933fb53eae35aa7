"""Run events as streams: deduplication, windows, sessions and the state of runs.

Each function takes and returns a streaming (or, where said, batch) DataFrame of event_id, ts,
user_id (the run), event_type, value. `finished` runs a stream over what is there and returns
its result as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import load

TERMINAL = "purchase"
STALE_MINUTES = 42


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = load(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, late: str = "31 days") -> DataFrame:
    """The first event of each idempotency key; keys are kept as long as events may be late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and their sum by type in tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a run: events with no longer gap between them."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), "n")


def run_states(events: DataFrame) -> DataFrame:
    """user_id, state, attempt events, last_id: the state machine of runs.

    Events take effect in order of their ids within a batch; a terminal state absorbs all
    later events, and an id that is not larger than the last one seen is rejected as late.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last, applied, rejected = state.get if state.exists else ("new", -1, 0, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for i, kind in zip(rows["event_id"].tolist(), rows["event_type"].tolist()):
            if status == TERMINAL or i <= last:
                rejected += 1
                continue
            status, last, applied = kind, i, applied + 1
        state.update((status, last, applied, rejected))
        yield pd.DataFrame([(key[0], status, last, applied, rejected)], columns=["user_id", "state", "last_id", "applied", "rejected"])

    return (
        events.select("user_id", "event_id", "event_type")
        .groupBy("user_id")
        .applyInPandasWithState(
            step, "user_id long, state string, last_id long, applied long, rejected long", "state string, last_id long, applied long, rejected long", "update", GroupStateTimeout.NoTimeout
        )
    )


def interrupted_runs(events: DataFrame, late: str = "1 minute", minutes: int = STALE_MINUTES) -> DataFrame:
    """user_id, heartbeat: runs whose next event did not come within `minutes` of the one at `heartbeat`.

    A timer of event time tells of runs that fall silent; a gap between two events tells of
    those that spoke again too late, whose later events are of no effect. Each run is told
    once, and a terminal event ends it without.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, closed = state.get if state.exists else (0, False)
        wait, told = minutes * 60_000_000, None
        if state.hasTimedOut:
            told, closed = last, True
        elif not closed:
            rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
            for at, kind in zip(rows["at"].tolist(), rows["event_type"].tolist()):
                if closed:
                    break
                if last and at - last > wait:
                    told, closed = last, True
                elif kind == TERMINAL:
                    closed = True
                else:
                    last = max(last, at)
        state.update((last, closed))
        if not closed:
            state.setTimeoutTimestamp(max((last + wait) // 1000, state.getCurrentWatermarkMs() + 1))
        if told is not None:
            yield pd.DataFrame({"user_id": [key[0]], "heartbeat": pd.to_datetime([told], unit="us")})

    return (
        events.withWatermark("ts", late)
        .select("user_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("at"))
        .groupBy("user_id")
        .applyInPandasWithState(step, "user_id long, heartbeat timestamp", "last long, closed boolean", "append", GroupStateTimeout.EventTimeTimeout)
    )


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns its rows.

    In complete mode the last batch is the result; in append and update mode all batches are,
    with `batch` to tell later rows of a key from earlier ones.
    """
    from ..sources.shared import shared_folder

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/vitrine-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        path = f"{base}/out" if mode == "complete" else f"{base}/out/b={batch}"
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(path)

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(write).start()
    q.awaitTermination()
    fields = [*stream.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", batch int"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


def stale_runs(events: DataFrame, as_of) -> DataFrame:
    """user_id and heartbeat of runs (batch table) without a heartbeat for STALE_MINUTES as of a time."""
    h = events.groupBy("user_id").agg(F.max("ts").alias("heartbeat"))
    return h.filter(as_of - F.col("heartbeat") > F.expr(f"INTERVAL {STALE_MINUTES} MINUTES"))
