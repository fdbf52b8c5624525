"""Order-independent merging of lanes: the earliest put of an id wins, authors are united, tombstones always win.

All of it is one aggregation by id with partial aggregates on the map side: no join, and the same result for rows in
any order. Equal times are told apart by author and then by record number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def put() -> Column:
    return F.col("op") == "put"


def tombstones(log: DataFrame) -> DataFrame:
    return log.where(~put()).select("fid").distinct()


def partial(log: DataFrame) -> DataFrame:
    """fid, origin (ts, agent, event_id), authors, dead: what further rows can still be merged into."""
    origin = F.min(F.when(put(), F.struct("ts", "agent", "event_id")))
    return log.groupBy("fid").agg(origin.alias("origin"), F.collect_set(F.when(put(), F.col("agent"))).alias("authors"), F.max(~put()).alias("dead"))


def combined(states: DataFrame) -> DataFrame:
    """States of the same ids merged; partial() of a union of logs is combined() of the union of their states."""
    return states.groupBy("fid").agg(F.min("origin").alias("origin"), F.array_distinct(F.flatten(F.collect_list("authors"))).alias("authors"), F.max("dead").alias("dead"))


def live(states: DataFrame) -> DataFrame:
    """fid, created_at, author, authors of ids that have a put and no tombstone."""
    kept = states.where(~F.col("dead") & F.col("origin").isNotNull())
    return kept.select("fid", F.col("origin.ts").alias("created_at"), F.col("origin.agent").alias("author"), F.array_join(F.array_sort("authors"), ",").alias("authors"))


def live_state(log: DataFrame) -> DataFrame:
    return live(partial(log))


def origins(log: DataFrame) -> DataFrame:
    """The earliest put of each id, tombstones or not."""
    return partial(log).where("origin is not null").select("fid", F.col("origin.ts").alias("created_at"), F.col("origin.agent").alias("author"), F.col("origin.event_id").alias("event_id"))


def authors(log: DataFrame) -> DataFrame:
    return log.where(put()).groupBy("fid").agg(F.array_join(F.array_sort(F.collect_set("agent")), ",").alias("authors"), F.count_distinct("agent").alias("n_authors"))


def effective_forgets(log: DataFrame) -> DataFrame:
    """Tombstones of ids that anyone put."""
    return log.where(~put()).join(log.where(put()).select("fid").distinct(), "fid", "left_semi")


def repeats(log: DataFrame) -> DataFrame:
    """Puts that their own lane already has: all but the first of each lane and id."""
    puts = log.where(put())
    first = puts.groupBy("agent", "fid").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return puts.join(first, ["agent", "fid"]).where(F.struct("ts", "event_id") > F.col("first")).drop("first")


def next_revisions(gone: DataFrame) -> DataFrame:
    """fid, revision: the least revision of each content that none of its tombstones (fid, revision) has. Numbered in
    order, revisions from 0 on equal their places up to the first that is missing."""
    order = Window.partitionBy("fid").orderBy("revision")
    placed = gone.distinct().withColumn("place", F.row_number().over(order) - 1)
    return placed.groupBy("fid").agg(F.count_if(F.col("revision") == F.col("place")).cast("int").alias("revision"))


def revisions(log: DataFrame) -> DataFrame:
    """Each put's revision: how many times its content had been forgotten and was put again, this time included.

    Turns from forget to put are counted within days, then over the days of an id, so that no task sorts all of an id.
    """
    when, up_to = F.struct("ts", "event_id"), (Window.unboundedPreceding, 0)
    within = Window.partitionBy("fid", "day").orderBy("ts", "event_id")
    turn = F.coalesce(put() & (F.lag("op").over(within) == "forget"), F.lit(False)).cast("int")
    rows = log.withColumn("day", F.to_date("ts")).withColumn("turn", turn).withColumn("inside", F.sum("turn").over(within.rowsBetween(*up_to)))
    days = rows.groupBy("fid", "day").agg(F.max("inside").alias("turns"), F.min_by("op", when).alias("opens"), F.max_by("op", when).alias("closes"))
    over = Window.partitionBy("fid").orderBy("day")
    meets = F.coalesce((F.col("opens") == "put") & (F.lag("closes").over(over) == "forget"), F.lit(False)).cast("int")
    before = F.coalesce(F.sum("turns").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("meets", meets).select("fid", "day", (F.sum("meets").over(over.rowsBetween(*up_to)) + before).alias("offset"))
    # a put that a tombstone came before, but no put, is no revision
    late = F.coalesce((F.min(F.when(~put(), when)) < F.min(F.when(put(), when))).cast("int"), F.lit(0))
    first = log.groupBy("fid").agg(late.alias("late"))
    numbered = rows.where(put()).join(days, ["fid", "day"]).join(first, "fid")
    return numbered.withColumn("revision", F.col("inside") + F.col("offset") - F.col("late")).select(*log.columns, "revision")
