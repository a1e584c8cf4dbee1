"""Structured Streaming forms of the job, chat and quota operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from foliant.operators import chunking
from foliant.sources.ingest import scratch
from foliant.sources.keyed import KeyedTable
from foliant.sources.tables import SCHEMAS


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder as a stream of its files, whether it is one file or a folder of parts."""
    # A pattern, since a stream takes a plain path for a folder.
    return spark.readStream.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parque[t]")


def event_stream(spark: SparkSession, folder: str, watermark: str = "1 hour", closing: str | None = None) -> DataFrame:
    """Events as a stream of files, with a time that watermarks accept.

    ``closing`` is a folder for an end mark (see ``end_mark``), which closes windows and bursts that are still open.
    """
    rows = table_stream(spark, folder, "events")
    if closing:
        rows = rows.unionByName(spark.readStream.schema(SCHEMAS["events"]).parquet(closing))
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def end_folder(spark: SparkSession) -> str:
    """An empty folder for an end mark."""
    folder = scratch(spark, "stream-end")
    spark.createDataFrame([], SCHEMAS["events"]).write.parquet(folder)
    return folder


def end_mark(spark: SparkSession, folder: str, at: str = "2200-01-01") -> None:
    """One event without a user or id, far in the future: the watermark passes everything that came before it.

    One far in the past lets the stream go on once, so that timers which the watermark has passed by now go off.
    """
    mark = spark.range(1).select(F.lit(None).cast("long").alias("event_id"), F.lit(at).cast("timestamp_ntz").alias("ts"))
    rest = [F.lit(None).cast(t).alias(c) for c, t in (("user_id", "long"), ("event_type", "string"), ("value", "double"), ("props", "string"))]
    mark.select("*", *rest).write.mode("append").parquet(folder)


def drain(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None] | None = None, closing: str | None = None, at: str = "2200-01-01") -> DataFrame | None:
    """Run a stream over what is there and return what it put out, from a table in the shared folder.

    With ``closing``, the stream is ended after that: it goes on from its checkpoint with an end mark.
    """
    spark = stream.sparkSession
    checkpoint, out = scratch(spark, "stream-state"), scratch(spark, "stream-out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    def go() -> None:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).queryName(f"q{uuid.uuid4().hex}")
        writer.trigger(availableNow=True).foreachBatch(sink or keep).start().awaitTermination()

    go()
    if closing:
        end_mark(spark, closing, at)
        go()
    return None if sink else spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).option("recursiveFileLookup", True).parquet(out)


def rate_limit(events: DataFrame, limit: int, window: str = "15 minutes") -> DataFrame:
    """(user_id, started, n): tumbling windows in which a user is over the limit."""
    n = events.groupBy("user_id", F.window("ts", window)).agg(F.count("*").alias("n"))
    return n.where(F.col("n") > limit).select("user_id", F.col("window.start").alias("started"), "n")


def daily_quota(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("used")).select("user_id", F.col("window.start").alias("day"), "used")


def session_windows(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("started"), "n")


def once(events: DataFrame) -> DataFrame:
    """Events without those that are delivered again within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def bursts(events: DataFrame, seconds: int = 120) -> DataFrame:
    """(user_id, started, n): bursts anchored on their first message, put out when their time is over.

    The state is the open burst; messages of a micro-batch are taken in order of time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, n = state.get if state.exists else (None, 0)
        done = []
        if state.hasTimedOut:
            done.append((key[0], pd.Timestamp(started, unit="us"), n))
            state.remove()
        else:
            times = sorted(int(t.value // 1000) for batch in batches for t in batch["ts"])
            for t in times:
                if started is not None and t < started + seconds * 1_000_000:
                    n += 1
                else:
                    if started is not None:
                        done.append((key[0], pd.Timestamp(started, unit="us"), n))
                    started, n = t, 1
            state.update((started, n))
            state.setTimeoutTimestamp(max(started // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["user_id", "started", "n"]).astype({"started": "datetime64[us]"})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, started timestamp, n long", "started long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def job_states(events: DataFrame, most: int = 3, silence: int = 150) -> DataFrame:
    """(job, status, timed_out): each move of a job, from its events (event_type, props.k as the job).

    A running job has a timer that each of its events sets anew: ``silence`` seconds without one, and it waits again
    (PENDING), or is DEAD if it has been started ``most`` times; those rows are timed_out. Time is the watermark, so
    what an event stream says is the same however it is cut into batches.
    """
    states = {"click": "RUNNING", "view": "PENDING", "purchase": "DONE", "error": "FAILED"}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, number, kind, starts = state.get if state.exists else (-1, -1, "", 0)
        timed_out = state.hasTimedOut
        if timed_out:
            status = "DEAD" if starts >= most else "PENDING"
            state.update((seen, number, status, starts))
        else:
            for batch in batches:
                for us, n, event in zip((t.value // 1000 for t in batch["ts"]), batch["event_id"], batch["event_type"], strict=True):
                    starts += event == "click"
                    if (us, n) > (seen, number):
                        seen, number, kind = int(us), int(n), event
            status = states.get(kind, "DEAD")
            state.update((seen, number, kind, starts))
            if status == "RUNNING":
                due = -(-seen // 1000) + silence * 1000
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "timed_out": [timed_out]})

    rows = events.where("event_id is not null").select(F.get_json_object("props", "$.k").cast("int").alias("job"), "event_id", "event_type", "ts")
    held = "seen long, number long, kind string, starts long"
    return rows.groupBy("job").applyInPandasWithState(step, "job int, status string, timed_out boolean", held, "update", GroupStateTimeout.EventTimeTimeout)


class ChunkSink:
    """The chunks of a stream of documents (doc_id, text) as a table by document."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.table = KeyedTable(spark, root, "doc_id", "doc_id long, chunk_index int, text string, start int")

    def sink(self, source: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch replaces the chunks of its documents; a batch of this source that comes again does nothing."""

        def replace(batch: DataFrame, number: int) -> None:
            docs = batch.select("doc_id", "text").where("doc_id is not null")
            self.table.replace(chunking.explode(docs, chunking.structural(F.col("text"))), (source, number), keys=docs)

        return replace
