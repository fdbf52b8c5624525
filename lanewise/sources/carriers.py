"""Memory-log views over the relational test tables.

`events` carries a log of puts and tombstones and the object listing of its lanes; `documents` carries texts with
metadata; `embeddings` carries vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators import history


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores if they come in fewer partitions, as those of a small file do; others stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def agent(number: str) -> F.Column:
    return F.concat(F.lit("agent_"), (F.col(number) % 8).cast("string"))


def log_of(events: DataFrame) -> DataFrame:
    """agent, fid, ts, event_id, op: errors are tombstones (a fifth) or puts of what clicks put."""
    kind = F.when(F.col("event_type") == "error", "click").otherwise(F.col("event_type"))
    fid = F.sha2(F.concat(kind, F.lit("|"), F.floor(F.col("value") * 10).cast("bigint").cast("string")), 256)
    forget = (F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)
    return events.select(agent("user_id").alias("agent"), fid.alias("fid"), "ts", "event_id", F.when(forget, "forget").otherwise("put").alias("op"))


def mem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(table(spark, sf_dir, "events"))


def numbered(events: DataFrame) -> DataFrame:
    """Each event's place in its lane and epoch (a day)."""
    rows = events.select(agent("user_id").alias("agent"), F.dayofmonth("ts").alias("epoch"), "event_id", "ts")
    return history.numbered(rows, ["agent", "epoch"], "ts", "event_id").withColumnRenamed("n", "seq")


def lane_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent, epoch, lo, hi, level: one object an event, a few missing, and compacted ones over the first eight."""
    rows = numbered(table(spark, sf_dir, "events"))
    single = rows.where("event_id % 97 <> 0").select("agent", "epoch", F.col("seq").alias("lo"), F.col("seq").alias("hi"), F.lit(0).alias("level"))
    wide = rows.where("seq = 7 AND epoch % 3 = 0").select("agent", "epoch", F.lit(0).cast("bigint"), F.lit(7).cast("bigint"), F.lit(1))
    return single.unionAll(wide)


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", agent("vec_id").alias("agent"), "label", "embedding")


def commits(spark: SparkSession, sf_dir: str, size: int = 10) -> DataFrame:
    """agent, epoch, seq, created_at, added, removed: every `size` records of a lane and epoch are one commit."""
    log = history.placed(mem_log(spark, sf_dir), size)
    return log.groupBy("agent", "epoch", "seq").agg(F.max("ts").alias("created_at"), F.count_if(F.col("op") == "put").alias("added"), F.count_if(F.col("op") == "forget").alias("removed"))


#: The same views for DuckDB, as common table expressions.
SQL = {
    "mem_log": """mem_log AS (SELECT concat('agent_', CAST(user_id % 8 AS VARCHAR)) AS agent,
 sha256(concat(CASE WHEN event_type = 'error' THEN 'click' ELSE event_type END, '|', CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR))) AS fid,
 ts, event_id, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'forget' ELSE 'put' END AS op FROM events)""",
    "lane_objects": """numbered AS (SELECT concat('agent_', CAST(user_id % 8 AS VARCHAR)) AS agent, CAST(day(ts) AS INT) AS epoch, event_id,
 CAST(row_number() OVER (PARTITION BY user_id % 8, day(ts) ORDER BY ts, event_id) - 1 AS BIGINT) AS seq FROM events),
lane_objects AS (SELECT agent, epoch, seq AS lo, seq AS hi, 0 AS level FROM numbered WHERE event_id % 97 <> 0
 UNION ALL SELECT agent, epoch, CAST(0 AS BIGINT), CAST(7 AS BIGINT), 1 FROM numbered WHERE seq = 7 AND epoch % 3 = 0)""",
    "vecs": "vecs AS (SELECT vec_id, concat('agent_', CAST(vec_id % 8 AS VARCHAR)) AS agent, label, embedding FROM embeddings)",
    "commits": """placed AS (SELECT *, CAST(day(ts) AS INT) AS epoch,
 CAST(floor((row_number() OVER (PARTITION BY agent, day(ts) ORDER BY ts, event_id) - 1) / 10) AS BIGINT) AS seq FROM mem_log),
commits AS (SELECT agent, epoch, seq, max(ts) AS created_at, count(*) FILTER (op = 'put') AS added, count(*) FILTER (op = 'forget') AS removed
 FROM placed GROUP BY agent, epoch, seq)""",
}
