"""Exact similarity search: filters before scoring, one top-k, many queries at once in blocks, and search over codes
with proven bounds, where only rows that may be among the best are scored by their vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import vectors
from lanewise.sources.files import checkpointed

DIGITS = 6
#: Query vectors that are broadcast at a time.
BLOCK = 4096
#: Rows that a task of a search over codes holds back, to drop them once it has seen better ones.
HELD = 1 << 16


def recall(rows: DataFrame, query: list[float], k: int, where: Column | str | None = None) -> DataFrame:
    """vec_id, score of the k rows most like query; equal scores in the order of vec_id; none for k <= 0."""
    if where is not None:
        rows = rows.where(where)
    score = F.round(vectors.dot(F.col("embedding"), F.array(*map(F.lit, map(float, query)))), DIGITS)
    return rows.select("vec_id", score.alias("score")).where(~F.isnan("score")).orderBy(F.desc("score"), "vec_id").limit(max(k, 0))


def recall_many(rows: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, score, rank of each query's k rows, for queries (query_id, embedding) of any number.

    Blocks of query vectors are broadcast, one at a time; each task keeps k rows a query, so what is shuffled depends on the
    numbers of tasks and queries and not on the rows.
    """
    blocks = max(1, -(-queries.count() // block))
    found = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        table = part.select("query_id", "embedding").toArrow()
        ids = table.column("query_id").to_numpy()
        vectors_ = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sent = rows.sparkSession.sparkContext.broadcast((ids, vectors_.reshape(len(ids), -1) if len(ids) else np.empty((0, 0))))
        best = rows.select("vec_id", "embedding").mapInArrow(_best(sent, k), "query_id long, vec_id long, score double")
        if blocks > 1:  # one block after the other, so that the driver and the workers never hold more than one
            best = checkpointed(best)
            sent.destroy()
        found = best if found is None else found.unionAll(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _kept(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k greatest scores and their ids, in order; of equal scores the smaller ids."""
    if k < score.shape[1] and k > 0:
        # those above the k-th score, and of those equal to it the smallest ids: all others are out
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        width = max(int((score >= edge).sum(1).max()), k)
        part = np.argpartition(-score, min(width, score.shape[1]) - 1, axis=1)[:, :width]
        score, ids = np.take_along_axis(score, part, 1), np.take_along_axis(ids, part, 1)
    order = np.lexsort((ids, -score))[:, : max(k, 0)]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _best(sent, k: int):
    """Each task's k best rows of each query, held over all of its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        best = [(np.empty((len(part), 0)), np.empty((len(part), 0), np.int64)) for part in (matrix[lo : lo + 256] for lo in range(0, len(ids), 256))]
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
            for b, (score, found) in enumerate(best):
                new = np.round(matrix[256 * b : 256 * b + 256] @ rows.T, DIGITS)
                best[b] = _kept(np.hstack([score, new]), np.hstack([found, np.broadcast_to(own, new.shape)]), k)
        for b, (score, found) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[256 * b : 256 * b + 256], score.shape[1])), pa.array(found.ravel()), pa.array(score.ravel())], ["query_id", "vec_id", "score"])

    return run


def survivors(codes: DataFrame, query: list[float], k: int) -> DataFrame:
    """vec_id, lower, upper of all rows (vec_id, payload) that may be among the k most like a query, by the bounds that
    their codes give; rounding to DIGITS is allowed for.

    A task drops what lies below the k-th greatest lower bound of the rows that it has read; what is left of all tasks is
    held against the k-th of all. No row is dropped for any other reason, however many are left.
    """
    vector, slack = np.asarray(query, np.float64), 10.0**-DIGITS
    turned = vectors.rotation(len(vector)) @ vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = np.empty((2, 0)), np.empty(0)
        ids = np.empty(0, np.int64)

        def good() -> np.ndarray:
            return held[1] >= best[0] if len(best) == k else np.ones(len(ids), bool)

        def rows(keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(held[0][keep]), pa.array(held[1][keep])], ["vec_id", "lower", "upper"])

        for batch in batches:
            near, most = vectors.estimates(batch.column(1), vector, turned)
            ids = np.append(ids, batch.column(0).to_numpy())
            held = np.hstack([held, [near - most - slack, near + most + slack]])
            best = np.sort(np.append(best, near - most - slack))[-k:]
            keep = good()
            ids, held = ids[keep], held[:, keep]
            if len(ids) > HELD:
                yield rows(good())
                ids, held = ids[:0], held[:, :0]
        yield rows(good())

    if k <= 0:
        return codes.select("vec_id", F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper")).limit(0)
    found = checkpointed(codes.where("vec_id IS NOT NULL").select("vec_id", "payload").mapInArrow(run, "vec_id long, lower double, upper double"))
    kth = found.orderBy(F.desc("lower")).limit(k).agg(F.min("lower").alias("kth"), F.count("*").alias("n")).first()
    return found.where(F.col("upper") >= kth.kth) if kth.n == k else found


def recall_packed(codes: DataFrame, rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """What recall(rows, query, k) gives, with few of the rows (vec_id, embedding) scored: those that their payloads in
    codes (vec_id, payload) don't rule out."""
    return recall(rows.join(survivors(codes, query, k).select("vec_id"), "vec_id", "left_semi"), query, k)
