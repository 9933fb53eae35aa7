"""What a store's triggers do, as a stream of changes with state per evaluation.

A change row inserts or updates an evaluation, or inserts a receipt for its feedback. In the
order of their numbers: an insert of a known id is refused; an evaluation that was closed can't
be updated; the change that closes one writes its outbox row and a pending row, once; a receipt
takes the pending row away, once, and is refused without one. A pending row that no receipt
took within `overdue` of event time is told of once, by a timer. All state is of one
evaluation, so changes of different ones run in parallel; feedback is
pending once at most, so the one receipt that took it is kept by its idempotency key, and a
replayed receipt is no second one.

`written` keeps the effects of each micro-batch in a folder named by its number: a batch that is
run again after a failure replaces its own rows and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: states in which an evaluation is closed.
CLOSED = ["complete", "agent_rejected", "needs_human_review", "call_outcome_unknown", "insufficient_facts", "rubric_unavailable", "failed"]
EFFECTS = "id long, seq long, effect string, detail string, ms long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Triggers(StatefulProcessor):
    """Takes rows, not pandas: an evaluation has few changes at once, and a frame for each costs more than they do."""

    def __init__(self, overdue_minutes: int):
        self.wait = overdue_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: status, number of the last change, state of the feedback ('', pending, done), the change that made it pending, and the receipt that took it.
        self.row = handle.getValueState("row", "status string, last long, feedback string, since long, taken string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, last, feedback, since, taken = self.row.get() or (None, -1, "", -1, None)
        timed, due = feedback == "pending", None
        out = []
        for r in sorted(rows, key=lambda r: r["seq"]):
            seq, what, new, receipt, at = r["seq"], r["change"], r["status"], r["receipt"], r["ms"]
            tell = lambda effect, detail="", seq=seq, at=at: out.append(Row(id=key[0], seq=seq, effect=effect, detail=detail, ms=at))
            if seq <= last:
                tell("refused", "late")
                continue
            last = seq
            if what == "receipt":
                if feedback == "done" and receipt == taken:
                    tell("refused", "repeated receipt")
                elif feedback != "pending":
                    tell("refused", "nothing pending")
                else:
                    feedback, taken = "done", receipt
                    tell("acknowledged", receipt)
                continue
            if what == "insert" and status is not None:
                tell("refused", "exists")
            elif what == "update" and status is None:
                tell("refused", "unknown")
            elif what == "update" and status in CLOSED:
                tell("refused", "immutable")
            else:
                closes = new in CLOSED
                tell("applied", new)
                status = new
                if closes and feedback == "":
                    feedback, since, due = "pending", seq, at + self.wait
                    tell("outbox", new)
        # The state and the timer are written once, as they are after all changes.
        if due is not None and feedback == "pending":
            self.handle.registerTimer(due)
        if timed and feedback == "done":
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.row.update((status, last, feedback, since, taken))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, last, feedback, since, taken = self.row.get()
        if feedback == "pending":
            yield Row(id=key[0], seq=since, effect="overdue", detail=status, ms=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def effects(changes: DataFrame, late: str = "1 minute", overdue_minutes: int = 60) -> DataFrame:
    """id, seq, effect, detail, at of a stream of id, seq, change (insert, update, receipt), status, receipt, at.

    effect is applied, refused, outbox, acknowledged or overdue; at is the change's time in milliseconds, or when the pending
    row became overdue. seq tells an evaluation's changes apart; rows with a null id are left out. Needs a state store with
    column families (PROVIDER).
    """
    rows = changes.filter("id IS NOT NULL").withWatermark("at", late).select("id", "seq", "change", "status", "receipt", "at", F.unix_millis("at").alias("ms"))
    told = rows.groupBy("id").transformWithState(Triggers(overdue_minutes), EFFECTS, "Append", "EventTime")
    return told.withColumn("at", F.timestamp_millis("ms")).drop("ms")


def written(effects: DataFrame, folder: str, checkpoint: str):
    """A started query that keeps each batch's effects in folder/batch=n, once however often the batch runs."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return effects.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def run(changes: DataFrame, folder: str, **options) -> DataFrame:
    """The effects of all changes that are there, read back."""
    spark = changes.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        written(effects(changes, **options), f"{folder}/effects", f"{folder}/state").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema("id long, seq long, effect string, detail string, at timestamp, batch long").parquet(f"{folder}/effects")
