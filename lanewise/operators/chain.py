"""Chains of a lane's objects: what is contiguous from position 0 on, in the newest epoch that begins there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lanewise.sources.files import checkpointed

LANE = ["agent", "epoch"]
#: Positions of a lane within which single objects are folded to runs; a run ends where these do.
SLICE = 1 << 16


def newest_epochs(objects: DataFrame, below: int | None = None) -> DataFrame:
    """agent, epoch: the newest epoch with an object from 0 on, perhaps below a bound."""
    begun = objects.where("lo = 0")
    return (begun if below is None else begun.where(F.col("epoch") < below)).groupBy("agent").agg(F.max("epoch").alias("epoch"))


def single_chains(objects: DataFrame) -> DataFrame:
    """The single objects up to the first gap of each lane and epoch."""
    order = Window.partitionBy(*LANE).orderBy("lo")
    return objects.where("level = 0").withColumn("n", F.row_number().over(order) - 1).where("lo = n").drop("n")


def _stretches(objects: DataFrame) -> DataFrame:
    """The widest object from each position on, and the stretch that it is in: a compacted object, which a chain enters
    at its start only, or a run of single objects, which it may enter anywhere. node and stop are the stretch's first and
    last position."""
    widest = objects.groupBy(*LANE, "lo").agg(F.max(F.struct("hi", "level")).alias("widest")).select(*LANE, "lo", "widest.*")
    rows = widest.withColumn("wide", F.col("hi") > F.col("lo")).withColumn("slice", F.floor(F.col("lo") / SLICE))
    own = [*LANE, "slice", "wide"]
    rows = rows.withColumn("island", F.when(F.col("wide"), F.col("lo")).otherwise(F.col("lo") - F.row_number().over(Window.partitionBy(*own).orderBy("lo"))))
    run = Window.partitionBy(*own, "island")
    return rows.select(*LANE, "lo", "hi", "level", "wide", F.min("lo").over(run).alias("node"), F.max("hi").over(run).alias("stop"))


def _entered(stop: str, entry: str, wide: str) -> Column:
    """How many objects of a stretch a chain has that enters it there."""
    return F.when(F.col(wide), 1).otherwise(F.col(stop) - F.col(entry) + 1)


def chains(objects: DataFrame, until: int | None = None) -> DataFrame:
    """agent, epoch, lo, hi, n, level: each lane's chain, n counting from 0. Of objects with one range the compacted one
    counts.

    Each stretch points to the one that holds the position after its end. What a chain reaches is found by doubling:
    in round k everything within 2**k steps of what is reached is added, by equi-joins, so there are as many rounds as the
    logarithm of the stretches in the longest chain, and no task holds a lane.
    """
    members = checkpointed(_stretches(objects if until is None else objects.where(F.col("hi") <= until)))
    reached = members.where("lo = 0").select(*LANE, "node", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("before"), "stop", "wide")
    after = members.select(*LANE, F.col("lo").alias("entry"), F.col("node").alias("to"), F.col("stop").alias("to_stop"), F.col("wide").alias("to_wide"))
    jumps = members.where("lo = node").select(*LANE, "node", (F.col("stop") + 1).alias("entry")).join(after, [*LANE, "entry"]).withColumn("between", F.lit(0).cast("long"))
    jumps = jumps.select(*LANE, "node", "to", F.col("entry").alias("at"), "to_stop", "to_wide", "between")
    while True:
        steps = reached.join(jumps, [*LANE, "node"])
        before = F.col("before") + _entered("stop", "entry", "wide") + F.col("between")
        count = Observation()
        steps = steps.select(*LANE, F.col("to").alias("node"), F.col("at").alias("entry"), before.alias("before"), F.col("to_stop").alias("stop"), F.col("to_wide").alias("wide"))
        new = checkpointed(steps.observe(count, F.count(F.lit(1)).alias("n")))
        if not count.get["n"]:
            break
        reached = reached.unionByName(new)  # of as many parts as rounds
        then = jumps.select(*LANE, F.col("node").alias("to"), *(F.col(c).alias(f"then_{c}") for c in ("to", "at", "to_stop", "to_wide", "between")))
        between = F.col("between") + _entered("to_stop", "at", "to_wide") + F.col("then_between")
        jumps = checkpointed(jumps.join(then, [*LANE, "to"]).select(*LANE, "node", F.col("then_to").alias("to"), F.col("then_at").alias("at"), F.col("then_to_stop").alias("to_stop"), F.col("then_to_wide").alias("to_wide"), between.alias("between")))
    chosen = members.select(*LANE, "node", "lo", "hi", "level").join(reached.select(*LANE, "node", "entry", "before"), [*LANE, "node"]).where("lo >= entry")
    return chosen.select(*LANE, "lo", "hi", (F.col("before") + F.col("lo") - F.col("entry")).alias("n"), "level")


def lost(objects: DataFrame) -> DataFrame:
    """agent, epoch, gap, beyond: where a chain ends though its lane goes on, and how many objects lie beyond."""
    ends = objects.groupBy(*LANE).agg(F.max("hi").alias("last"))
    reached = chains(objects).groupBy(*LANE).agg((F.max("hi") + 1).alias("gap"))
    broken = ends.join(reached, LANE, "left").select(*LANE, "last", F.coalesce("gap", F.lit(0)).alias("gap")).where("last >= gap").drop("last")
    return objects.join(broken, LANE).where("lo > gap").groupBy(*LANE, "gap").agg(F.count("*").alias("beyond"))


def islands(objects: DataFrame) -> DataFrame:
    """agent, epoch, lo, hi of the maximal stretches that single objects fill."""
    order = Window.partitionBy(*LANE).orderBy("lo")
    rows = objects.where("level = 0").withColumn("island", F.col("lo") - F.row_number().over(order))
    return rows.groupBy(*LANE, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def covered(objects: DataFrame) -> DataFrame:
    """Compacted objects, and whether the lane's single objects fill their range: as islands don't overlap, only the last
    one that begins at or before an object's start can, so one pass in order finds it."""
    filled = islands(objects).select(*LANE, F.col("lo").alias("at"), F.lit(0).alias("kind"), F.col("hi").alias("to"), F.lit(None).cast("long").alias("hi"))
    wide = objects.where("level = 1").select(*LANE, F.col("lo").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("to"), "hi")
    order = Window.partitionBy(*LANE).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = filled.unionByName(wide).withColumn("filled", F.last("to", ignorenulls=True).over(order)).where("kind = 1")
    return rows.select(*LANE, F.col("at").alias("lo"), "hi", F.coalesce(F.col("filled") >= F.col("hi"), F.lit(False)).alias("covered"))


def gc_candidates(objects: DataFrame, keep: int = 1) -> DataFrame:
    """Objects nothing needs: of epochs older than the newest `keep` up to the newest valid chain, and single ones of
    kept epochs under a compacted one. A lane without a valid chain loses nothing."""
    valid = newest_epochs(objects).withColumnRenamed("epoch", "newest")
    rows = objects.join(valid, "agent")
    old = rows.where(F.col("epoch") <= F.col("newest") - keep)
    kept = rows.where((F.col("epoch") > F.col("newest") - keep) & (F.col("level") == 0))
    # a single object is under a compacted one if one that begins at or before it ends at or after it
    wide = objects.where("level = 1").join(valid, "agent").select(*LANE, "lo", F.col("hi").alias("reach"), F.lit(None).cast("long").alias("hi"))
    order = Window.partitionBy(*LANE).orderBy("lo").rangeBetween(Window.unboundedPreceding, 0)
    rows = kept.select(*LANE, "lo", F.lit(None).cast("long").alias("reach"), "hi").unionByName(wide)
    under = rows.withColumn("reach", F.max("reach").over(order)).where("hi IS NOT NULL AND reach >= hi").select(*LANE, "lo", "hi", F.lit(0).alias("level"))
    return old.select(*LANE, "lo", "hi", "level").unionByName(under).distinct()
