"""Catching up on a log as it grows: the merge as a streaming aggregation, and incremental refresh of a saved state.

The merge doesn't depend on the order of rows, so late data needs no watermark; tombstones are never dropped from the
state. What a reader has seen is the file source's own log in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lanewise.operators import merge
from lanewise.sources.files import Files

FOLD = 8


def source(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def followed(log: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Hands each batch of changed ids, with their merged state, to apply; once: until all that is there is read."""
    query = merge.partial(log).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (query.trigger(availableNow=True) if once else query).start()


def spans(n: int) -> list[tuple[int, int]]:
    """The parts that hold n batches: as many of FOLD**k batches each as the digits of n say, largest first."""
    out, at, size = [], 0, 1
    while size * FOLD <= n:
        size *= FOLD
    while at < n:
        while at + size > n:
            size //= FOLD
        out.append((at, at + size))
        at += size
    return out


def _name(span: tuple[int, int]) -> str:
    return f"{span[0]:012d}-{span[1]:012d}"


def refreshed(spark: SparkSession, log: DataFrame, checkpoint: str, folder: str) -> int:
    """Adds what is new to the state saved under folder and returns how many rows were new.

    The state is held in parts of 1, FOLD, FOLD**2, ... batches. A batch writes one part: its own rows' states, together
    with the parts that make a larger one with it. So a row is written anew as often as the number of batches has digits,
    and a batch costs on average as much as its own rows times that, however large the state is. Which parts a batch takes follows
    from its number, so one that is run again after a failure writes the same from the same: parts that were taken go with
    the next batch.
    """
    seen, files = 0, Files(spark, folder)

    def fold(rows: DataFrame, batch: int) -> None:
        nonlocal seen
        before, part = spans(batch), spans(batch + 1)[-1]
        kept = {_name(x) for x in before}
        for x in files.names(""):
            if x not in kept:
                files.delete(x)
        count = Observation()
        states = merge.partial(rows.observe(count, F.count(F.lit(1)).alias("n")))
        if taken := [f"{folder}/{_name(x)}" for x in before if x[0] >= part[0]]:
            states = merge.combined(states.unionByName(spark.read.parquet(*taken)))
        states.write.mode("overwrite").parquet(f"{folder}/{_name(part)}")
        seen += count.get["n"]

    log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return seen


def _parts(files: Files) -> list[str]:
    """The parts of the last batch that is whole."""
    names = set(files.names(""))
    done = [n for n in {int(x.split("-")[1]) for x in names} if all(_name(x) in names and files.any(f"{_name(x)}/_SUCCESS") for x in spans(n))]
    return [_name(x) for x in spans(max(done, default=0))]


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """The refreshed state."""
    return merge.combined(spark.read.parquet(*(f"{folder}/{x}" for x in _parts(Files(spark, folder)))))
