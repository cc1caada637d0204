"""Streaming jobs; each has a batch twin among the operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyra.operators.ingest import ingest_to
from papyra.sources.scratch import shared_folder
from papyra.streaming.ordered import state_store


def limit_calls_stream(calls: DataFrame, most: int, window_s: float, delay: str | None = None) -> DataFrame:
    """The sliding-window limiter on a stream of calls (session_id, tool, ts, event_id). A key's state is the times of
    its allowed calls in the window, at most `most`. A key's calls of one trigger are taken in order of ts, in however many
    Arrow batches they come: their times and ids (no other columns) are held together, so triggers should be bounded.

    With a `delay`, calls that come later than that are dropped, and the state of a key is let go of when the watermark
    has passed its last call by the window; without one it is kept for good."""
    timeout = GroupStateTimeout.NoTimeout if delay is None else GroupStateTimeout.EventTimeTimeout
    if delay is not None:
        calls = calls.withWatermark("ts", delay)

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat([pdf[["ts", "event_id"]] for pdf in batches]).sort_values(["ts", "event_id"])
        out = []
        for ts in pdf["ts"].astype("datetime64[us]").astype("int64"):
            held = [t for t in held if ts - t <= window_s * 1e6]
            out.append(len(held) < most)
            if out[-1]:
                held.append(int(ts))
        yield pd.DataFrame({"session_id": key[0], "tool": key[1], "event_id": pdf["event_id"], "allowed": out})
        state.update((held,))
        if delay is not None:
            last = int(pdf["ts"].iloc[-1].timestamp() * 1000)
            state.setTimeoutTimestamp(max(last + int(window_s * 1000), state.getCurrentWatermarkMs()) + 1)

    return calls.groupBy("session_id", "tool").applyInPandasWithState(step, "session_id long, tool string, event_id long, allowed boolean", "held array<long>", "append", timeout)


def usage_stream(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by user's event type and day; rows later than `delay` are dropped by the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def run_available(df: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a streaming DataFrame over what is there now, into Parquet in the shared folder, and returns its rows. With
    a folder from before it goes on where it stopped."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    with state_store(spark):
        query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def ingest_stream(source: DataFrame, folder: str | None = None, **hooks) -> str:
    """Streaming ingest of documents (doc_id, file_path, text) into all tables of the staged ingest; returns the folder, which
    `papyra.operators.ingest.tables` reads. A trigger is a batch with Spark's number: one that is run again after a
    failure replaces its own rows. Calling it again with the same folder goes on where it stopped."""
    folder = folder or shared_folder(source.sparkSession)

    def add(batch: DataFrame, batch_id: int) -> None:
        ingest_to(folder, batch_id, batch.dropDuplicates(["doc_id"]), **hooks)

    query = source.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/_state").trigger(availableNow=True).start()
    query.awaitTermination()
    return folder


def append_new_stream(spark: SparkSession, source: DataFrame, key: str, build) -> DataFrame:
    """Each trigger's rows not yet known by key are built by `build` and kept in one table, a directory a trigger, which a
    repeated trigger replaces. A null key is a key like others."""
    folder = shared_folder(spark)
    schema = build(spark.createDataFrame([], source.schema)).schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/out/batch=-1")

    def add(batch: DataFrame, batch_id: int) -> None:
        known = batch.sparkSession.read.parquet(f"{folder}/out").where(F.col("batch") < batch_id).select(F.col(key).alias("_known"))
        build(batch.dropDuplicates([key]).join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = source.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out").select(schema.names)
