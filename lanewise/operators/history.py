"""The commit log, positions in it, and state at a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.sources.files import checkpointed

ORDER = ["created_at", "agent", "epoch", "seq"]


def history(commits: DataFrame, limit: int, by: str | None = None) -> DataFrame:
    """The last commits, newest first, perhaps of one agent; none for limit <= 0."""
    rows = commits if by is None else commits.where(F.col("agent") == by)
    return rows.orderBy(*[F.desc(c) for c in ORDER]).limit(max(limit, 0))


def head(commits: DataFrame) -> DataFrame:
    """agent, epoch, seq of each lane's last commit."""
    last = F.max(F.struct("created_at", "epoch", "seq")).alias("last")
    return commits.groupBy("agent").agg(last).select("agent", "last.epoch", "last.seq")


def back(commits: DataFrame, n: int) -> DataFrame:
    """The positions n commits before the head; of an empty rest, of the first commit.

    Commits are counted by second; the second that the n-th newest falls in is found through sums over ever finer spans of
    these counts, and only its own commits are put in order.
    """
    rows = checkpointed(commits.select(*ORDER).withColumn("second", F.date_trunc("second", _time(commits))))
    counts = checkpointed(rows.groupBy("second").agg(F.count("*").alias("many")))
    total = counts.agg(F.sum("many")).first()[0] or 0
    left, span = min(n, max(total - 1, 0)), F.lit(True)
    if not left:
        return head(rows)
    for unit in ("day", "hour", "second"):  # as many rows as there are days, and then 24 and 3,600 at most
        inside = counts.where(span).groupBy(F.date_trunc(unit, "second").alias("at")).agg(F.sum("many").alias("many")).orderBy(F.desc("at"))
        for at, many in inside.collect():
            if many >= left:
                break
            left -= many
        span = F.date_trunc(unit, "second") == F.lit(at)
    # the oldest of the commits that are left out
    newest = rows.where(F.col("second") == F.lit(at)).orderBy(*[F.desc(c) for c in ORDER]).limit(left)
    edge, kinds = newest.orderBy(*ORDER).first(), dict(rows.dtypes)
    return head(rows.where(F.struct(*ORDER) < F.struct(*(F.lit(edge[c]).cast(kinds[c]).alias(c) for c in ORDER))))


def _time(commits: DataFrame) -> Column:
    return F.col("created_at") if dict(commits.dtypes)["created_at"].startswith("timestamp") else F.timestamp_micros(F.round(F.col("created_at") * 1_000_000).cast("long"))


def cut_text(positions: DataFrame) -> DataFrame:
    """One row with the positions as text: agent:e<epoch>:<seq>, in order of agents."""
    each = F.format_string("%s:e%d:%d", "agent", "epoch", "seq")
    return positions.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("agent", each.alias("text")))), lambda x: x["text"]), ",").alias("cut"))


def parse_cut(text: str) -> list[tuple[str, int, int]]:
    """The positions that a text names; ValueError for anything else."""
    out = {}
    for part in filter(str.strip, text.split(",")):
        try:
            agent, epoch, seq = part.strip().rsplit(":", 2)
            out[agent] = (int(epoch.lstrip("e")), int(seq))
        except ValueError as error:
            raise ValueError(f"not a cut: {part.strip()!r}") from error
    return sorted((agent, *position) for agent, position in out.items())


def until(placed_log: DataFrame, cut: DataFrame) -> DataFrame:
    """The records of each lane's cut epoch up to its position; other lanes have none."""
    bounds = cut.select("agent", F.col("epoch").alias("at_epoch"), F.col("seq").alias("at_seq"))
    return placed_log.join(bounds, "agent").where("epoch = at_epoch AND seq <= at_seq").drop("at_epoch", "at_seq")


def numbered(rows: DataFrame, by: list[str], when: str, *then: str) -> DataFrame:
    """rows with n, each one's place from 0 on among those equal in `by`, in the order of when and then.

    Rows are numbered within minutes, to which the rows of the minutes before are added, so no task sorts all of a
    group; a group's minutes, and not its rows, meet in one.
    """
    rows = rows.withColumn("minute", F.date_trunc("minute", when))
    slice_ = [*by, "minute"]
    inside = rows.withColumn("inside", F.row_number().over(Window.partitionBy(*slice_).orderBy(when, *then)) - 1)
    before = Window.partitionBy(*by).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*slice_).agg(F.count("*").alias("many")).select(*slice_, F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"))
    joined = inside.join(counts, slice_).withColumn("n", (F.col("inside") + F.col("before")).cast("bigint"))
    return joined.drop("minute", "inside", "before")


def placed(log: DataFrame, size: int = 10) -> DataFrame:
    """The log with each record's epoch (its day) and commit."""
    rows = numbered(log.withColumn("epoch", F.dayofmonth("ts")), ["agent", "epoch"], "ts", "event_id")
    return rows.withColumn("seq", F.floor(F.col("n") / size).cast("bigint")).drop("n")
