"""Exact dedup (operator 13), in DataFrame operations only.

Documents are grouped by a 128-bit hash of their text and, within a hash, by the text itself, so that bytes decide and
texts whose hashes collide stay apart. Equal texts of one task are combined before anything is shuffled: a group of copies
sends one text for each task, however large it is. Rows carry two digests to the groups and never their texts; should
both agree for different texts, the query fails rather than mixes them.

Cases: a null text counts as empty. A null doc_id counts as smaller than every other. Of rows that have both text and
doc_id in common (repeated rows, or rows without doc_id) one stays. An empty table gives an empty result. removed_copies
drops other columns of the input, whatever their names, and unique_rows keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows with equal text and doc_id that are made from one count at a time.
CHUNK = 1 << 16


def md5_bytes(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text.cast("binary")))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def groups(docs: DataFrame, digest: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """key, sha, keep_id, group_size for each different text; sha is the binary SHA-256 of it."""
    texts = docs.select(F.col("doc_id").cast("long"), _text().alias("text")).withColumn("key", digest(F.col("text")))
    by_bytes = texts.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    one = by_bytes.select("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "keep_id", "group_size").groupBy("key", "sha")
    found = one.agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    alone = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts have both digests in common")).cast("long"))
    return found.select("key", "sha", "keep_id", alone.alias("group_size"))


def removed_copies(docs: DataFrame, digest: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row.

    Rows with equal doc_id and text can't be told apart: they are counted, meet their group once, and are made again from
    the count, in chunks dealt over all tasks; the first of them is the one that stays.
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long"), _text().alias("text")).select("doc_id", digest(text).alias("key"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    rows = rows.groupBy("doc_id", "key", "sha").agg(F.count("*").alias("n"))
    found = rows.join(groups(docs, digest), ["key", "sha"])
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("first")
    chunks = found.select("doc_id", "sha", "keep_id", "group_size", "n", first).repartition("doc_id", "sha", "first")
    made = chunks.withColumn("ordinal", F.explode(F.sequence("first", F.least(F.col("first") + CHUNK, "n") - 1)))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("ordinal") == 0)
    return made.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def unique_rows(docs: DataFrame, digest: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """One whole row for each different text, that of the largest doc_id, with all columns of docs as they are. Among rows
    of equal doc_id the one with the largest hash of its columns stays, so that a task run again keeps the same."""
    key, plain = digest(F.col("#text")), [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(_text().alias("#text"), F.struct(*plain).alias("#row"), F.struct(F.col("doc_id").cast("long"), F.xxhash64(F.to_json(F.struct(*plain)))).alias("#order"))
    best = rows.withColumn("#key", key).groupBy("#key", "#text").agg(F.max_by("#row", "#order").alias("#row"))
    return best.select("`#row`.*")
