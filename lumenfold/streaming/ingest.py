"""Structured Streaming: continuous ingest with exact deduplication, rolling rates, liveness, progress changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.ingest import new_rows
from lumenfold.operators.store import Conflict, Table, UnknownDataset


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files as they arrive, so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(source: DataFrame, target: Table, key: str, order: list[str], checkpoint: str, score: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None):
    """Starts a query that appends every new key to a versioned table, one commit a micro-batch.

    Keys are checked against the whole table by an anti-join, so no state grows with history. A batch that was committed before a
    crash is recognised by its id in the manifest and skipped: replays change nothing.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        rows = score(batch) if score else batch
        cols = [F.col(c) for c in order]
        try:
            last = target.manifest()
        except UnknownDataset:
            first = new_rows(rows, rows.limit(0), key, cols)
            target.create(first, {"batch": batch_id})
            return
        if last.get("batch", -1) >= batch_id:
            return
        target.append(new_rows(rows, rows.limit(0), key, cols), key, note={"batch": batch_id})

    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(commit)
    return writer.trigger(**(trigger or {"processingTime": "1500 milliseconds"})).start()


def rate(events: DataFrame, ts: str, key: str, seconds: int = 10, slide: int = 1, late: str = "1 minute") -> DataFrame:
    """Events per sliding window and key; the watermark bounds the state."""
    e = events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    w = F.window("__t", f"{seconds} seconds", f"{slide} seconds")
    return e.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (F.col("n") / seconds).alias("rate"))


def first_seen(events: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark: state is dropped as time goes on."""
    return events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark([key]).drop("__t")


def liveness(events: DataFrame, key: str, grace_s: int = 45) -> DataFrame:
    """One row when a key is first seen and one when it has been silent for grace_s of processing time: (key, state, seen)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()

    def f(k, frames, state):
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "state": ["stale"], "seen": [n]})
            return
        n = state.get[0] if state.exists else 0
        new = n == 0
        n += sum(len(x) for x in frames)
        state.update((n,))
        state.setTimeoutDuration(grace_s * 1000)
        if new:
            yield pd.DataFrame({key: [k[0]], "state": ["live"], "seen": [n]})

    return events.groupBy(key).applyInPandasWithState(f, f"{key} {kind}, state string, seen long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def dead_letters(rows: DataFrame, checks: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(good rows, refused rows with a reason): the first check that fails, or is null, names the reason."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(list(checks.items())):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


__all__ = ["Conflict", "dead_letters", "first_seen", "ingest", "liveness", "rate", "stream"]
