"""Held-out folds and bounded training samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 30
#: Share of a sample that a rare kind gets, if it has so many rows.
RARE = 1 / 8


def remainder(folds: int) -> Column:
    """crc32(doc_id as text) mod folds; null without a doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(remainder(folds) == fold, F.lit(False))


def drawn(share: Column, *key: str) -> Column:
    """Whether a row is among a share of all, by a hash of key."""
    return F.pmod(F.xxhash64(*key), F.lit(SCALE)) < share * SCALE


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, n: int) -> tuple[DataFrame, float]:
    """doc_id, label and text of a sample of about n labelled documents outside the held-out fold, and by how much the
    log-odds of label 1 among all of them exceed those in the sample, in which the rarer label gets at least RARE."""
    known = labels.select(F.col("doc_id").cast("long"), (F.col(label) > 0).cast("int").alias("label")).where((F.col("label").isNotNull()) & (remainder(folds) != fold))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    share = {k: min(1.0, max(n / total, n * RARE / c)) for k, c in counts.items()}
    chosen = known.where(drawn(F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)), "doc_id"))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found, math.log(share[0] / share[1]) if len(share) == 2 else 0.0
