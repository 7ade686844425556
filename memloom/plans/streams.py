"""Queries of incremental ingest and event windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.plans.base import registry
from memloom.session import shared_dir, table
from memloom.streaming import sweep as W

QUERIES, SQL, query = registry()
CUT = "2024-01-15 00:00:00"


def messages(events: DataFrame) -> DataFrame:
    """Events as messages: session, id, ts, role."""
    return events.select(F.col("user_id").alias("session"), F.concat(F.lit("sweep_"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_id").cast("string")).alias("id"), "ts", F.col("event_type").alias("role"))


def stored(spark: SparkSession, d: str) -> DataFrame:
    return messages(table(spark, d, "events").where(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"))).where("role IN ('view', 'click')")


_M = f"m AS (SELECT user_id AS session, 'sweep_' || user_id || '_' || event_id AS id, ts, event_type AS role FROM events), st AS (SELECT * FROM m WHERE ts < TIMESTAMP '{CUT}' AND role IN ('view', 'click')), c AS (SELECT m.id, m.session, CASE WHEN m.id IN (SELECT id FROM st) THEN 'present' WHEN m.ts < cursor THEN 'skipped' ELSE 'added' END AS state FROM m LEFT JOIN (SELECT session, max(ts) AS cursor FROM st GROUP BY 1) u USING (session))"


@query(f"WITH {_M} SELECT id, session, state FROM c")
def sweep_cursor_batch(spark: SparkSession, d: str) -> DataFrame:
    return W.classified(messages(table(spark, d, "events")), stored(spark, d)).select("id", "session", "state")


@query(f"WITH {_M} SELECT state, count(*) AS n FROM c GROUP BY state")
def sweep_stream(spark: SparkSession, d: str) -> DataFrame:
    out = W.sweep_stream(spark, f"{d}/events*.parquet", table(spark, d, "events").schema, messages, stored(spark, d))
    return spark.read.parquet(out).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS session, count(*) // 15 AS saves FROM events GROUP BY 1 HAVING count(*) >= 15")
def checkpoint_every_15(spark: SparkSession, d: str) -> DataFrame:
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet").select(F.col("user_id").alias("session"))
    out = f"{shared_dir(spark)}/memloom-saves/{uuid.uuid4().hex}"
    W.run_available(W.checkpoints(stream), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), "update")
    return spark.read.schema("session long, saves long").parquet(f"{out}/*").groupBy("session").agg(F.max("saves").alias("saves"))


_HOUR = "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query(_HOUR)
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return table(spark, d, "events").groupBy(w.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    # A watermark bounds the state; its delay is longer than the files are out of order, so nothing is late.
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    counted = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "90 days").groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = f"{shared_dir(spark)}/memloom-windows/{uuid.uuid4().hex}"
    W.run_available(counted, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), "update")
    rows = spark.read.parquet(out).groupBy("w", "event_type").agg(F.max("n").alias("n"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query(
    """SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
)
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n"))
    return s.select("user_id", "started", "n")


@query("SELECT e.event_type, r.r_name AS region, count(*) AS n FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL")
def events_by_region(spark: SparkSession, d: str) -> DataFrame:
    # Counted by customer before anything is joined.
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    j = e.join(c, e["user_id"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("event_type", F.col("r_name").alias("region")).agg(F.sum("n").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
