"""Sharding by jump consistent hashing (operator 4).

The law is `key`: a document's shard is the jump hash of its doc_id among `shards` buckets, without any table, so
that one more shard takes about 1 / (shards + 1) of the rows and moves no other. Within a shard rows are numbered
without gaps: they are dealt by hash into PARTS parts, whose counts (a table of shards * PARTS rows, broadcast)
give each part its first number; no task holds a shard.

Cases: a null text has no bytes and the checksum 0; all rows of one doc_id, or of none, share a shard; repeated rows
get slots of their own; an empty table gives an empty result; other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, PARTS = 24, 1024
OVERHEAD = 8


def jump(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key, as Lamping and Veach define it: jumps with a probability that falls as 1 / bucket."""
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    reach = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = reach[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1
        reach[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[reach[live] < buckets]
    return at


def sharded(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("key"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.crc32(F.coalesce(text, F.lit("")))), F.lit(parts)).cast("int").alias("part"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            own = [pa.array(jump(key, n).astype(np.int32)) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "part")), *own], ["doc_id", "size", "text_crc32", "part", "shard", "grown_shard"])

    placed = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, part int, shard int, grown_shard int")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("own", F.row_number().over(order) - 1).join(F.broadcast(first), ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("own")).alias("slot"), "grown_shard")
