"""Incremental, idempotent ingest and stateful counters as Structured Streaming jobs.

Every stream keeps its checkpoint in the shared folder, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memloom.session import shared_dir


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs a stream over all that is there now, batch by batch, and ends."""
    where = checkpoint or f"{shared_dir(stream.sparkSession)}/memloom-stream/{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()


def classified(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages with ``state``: ``present`` (its id is stored), ``skipped`` (older than the newest stored message of its
    session; ties are kept) or ``added``. Both: session, id, ts. Ids delivered several times count once."""
    cursor = stored.groupBy("session").agg(F.max("ts").alias("cursor"))
    have = stored.select("id").distinct().withColumn("there", F.lit(True))
    m = messages.dropDuplicates(["id"]).join(have, "id", "left").join(cursor, "session", "left")
    state = F.when(F.col("there"), "present").when(F.col("ts") < F.col("cursor"), "skipped").otherwise("added")
    return m.withColumn("state", state).drop("there", "cursor")


def sweep_stream(spark: SparkSession, source: str, schema, to_messages: Callable[[DataFrame], DataFrame], stored: DataFrame, files_per_batch: int = 64) -> str:
    """Sweeps the parquet files at ``source`` into a table of messages and returns its path. The cursor of a session is
    read once, from ``stored``, as a sweep begins; what a batch adds is not added again by a replay of the batch,
    since each batch overwrites its own folder."""
    out = f"{shared_dir(spark)}/memloom-sweep/{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        classified(to_messages(batch), stored).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run_available(stream, sink)
    return out


def saves(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, every: int = 15) -> Iterator[pd.DataFrame]:
    """Counts the messages of a session; says how many checkpoints its count is worth."""
    seen, saved = state.get if state.exists else (0, 0)
    seen += sum(len(p) for p in parts)
    due = seen // every
    state.update((seen, due))
    if due > saved:
        yield pd.DataFrame({"session": [key[0]], "saves": [due]})


def checkpoints(messages: DataFrame) -> DataFrame:
    """(session, saves) as a stream: a row whenever a session has fifteen more messages. ``messages``: a stream with
    session BIGINT."""
    return messages.select("session").groupBy("session").applyInPandasWithState(saves, "session long, saves long", "seen long, saved long", "update", GroupStateTimeout.NoTimeout)
