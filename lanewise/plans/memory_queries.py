"""Queries of the memory log: ids and keys, merging, chains, history, time travel and maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.functions import ids, keys
from lanewise.functions.metadata import equal_to
from lanewise.operators import chain, history, merge
from lanewise.sources import carriers as C
from lanewise.sources.files import shared_folder
from lanewise.streaming import refresh

ME, BACK, UNTIL, KEEP, LIMIT = "agent_0", 50, 5, 2, 20
PREFIX = "00"


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(C.SQL[n] for n in names)


LOG, OBJECTS, COMMITS = _with("mem_log"), _with("lane_objects"), _with("mem_log", "commits")

_CHAINS = """, RECURSIVE_widest AS (SELECT agent, epoch, lo, max(hi) AS hi FROM lane_objects WHERE {bound} GROUP BY ALL),
 walked AS (SELECT agent, epoch, lo, hi, CAST(0 AS BIGINT) AS n FROM RECURSIVE_widest WHERE lo = 0
 UNION ALL SELECT w.agent, w.epoch, w.lo, w.hi, c.n + 1 FROM walked c JOIN RECURSIVE_widest w ON w.agent = c.agent AND w.epoch = c.epoch AND w.lo = c.hi + 1)
SELECT agent, epoch, lo, hi, n FROM walked"""


def _recursive(bound: str) -> str:
    return (OBJECTS.replace("WITH ", "WITH RECURSIVE ", 1) + _CHAINS.format(bound=bound)).replace("RECURSIVE_widest", "widest")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents")


def content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", ids.content_id(F.col("text"), lang=F.col("lang"), source=F.col("source")).alias("fid"))


_CONTENT = """SELECT doc_id, sha256(concat('{"metadata":{"lang":', to_json(lang), ',"source":', to_json(source), '},"parents":[],"text":', to_json(text), '}')) AS fid FROM documents"""


def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_id(spark, sf_dir).groupBy("fid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def _key() -> Column:
    return keys.object_key("team", *(F.col(c) for c in ("agent", "epoch", "lo", "hi", "level")))


def key_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lane_objects(spark, sf_dir).select(_key().alias("key"))


_KEY = """concat('spaces/team/lanes/', agent, '/e', lpad(CAST(epoch AS VARCHAR), 10, '0'), '/',
 CASE WHEN level = 1 THEN concat('L1-', lpad(CAST(lo AS VARCHAR), 12, '0'), '-', lpad(CAST(hi AS VARCHAR), 12, '0')) ELSE lpad(CAST(lo AS VARCHAR), 12, '0') END, '.tqs')"""


def key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_format(spark, sf_dir).select("key", keys.parsed("team", F.col("key")).alias("p")).select("key", "p.*")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mem_log(spark, sf_dir)


def peer_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where(F.col("agent") != ME).groupBy("agent").agg(F.count("*").alias("records"))


def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = log(spark, sf_dir).where("event_id % 100 = 0").select("fid").distinct()
    return merge.live_state(log(spark, sf_dir).join(wanted, "fid", "left_semi"))


def resolve_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of the live view that begins so; callers take one row for a hit and more for an ambiguity."""
    return merge.live_state(log(spark, sf_dir).where(F.col("fid").startswith(PREFIX))).select("fid")


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("agent").union(spark.createDataFrame([("reader",)], "agent string")).distinct()


def live_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.live_state(log(spark, sf_dir)).agg(F.count("*").alias("n"))


def commit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.commits(spark, sf_dir).groupBy("agent", "epoch").agg(F.count("*").alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def cut_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.cut_text(history.head(C.commits(spark, sf_dir)))


def state_at_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live view as it was BACK commits before the head."""
    cut = history.back(C.commits(spark, sf_dir), BACK)
    return merge.live_state(history.until(history.placed(log(spark, sf_dir)), cut))


def restore_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain a lane is restored from: of its newest epoch with one."""
    own = C.lane_objects(spark, sf_dir).where(F.col("agent") == ME)
    return chain.chains(own.join(chain.newest_epochs(own), chain.LANE, "left_semi")).drop("level")


def chain_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects of each level the chains have, if every fifth epoch's first object is compacted alone."""
    objects = C.lane_objects(spark, sf_dir)
    alone = objects.where("level = 0 AND lo = 0 AND epoch % 5 = 0").withColumn("level", F.lit(1))
    return chain.chains(objects.unionByName(alone)).groupBy("agent", "epoch", "level").agg(F.count("*").alias("objects"))


def where_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose metadata has the number 2, not the text, and no other value."""
    number = F.col("doc_id") % 3
    kinds = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(number.alias("n")))).otherwise(F.to_json(F.struct(number.cast("string").alias("n"))))
    return docs(spark, sf_dir).select("doc_id", kinds.alias("metadata")).where(equal_to("metadata", {"n": 2, "absent": None})).select("doc_id", "metadata")


def revision_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision under which forgotten content would come back: the least that no tombstone has."""
    gone = log(spark, sf_dir).where("op = 'forget'").select("fid", (F.col("event_id") % 4).cast("int").alias("revision"))
    return merge.next_revisions(gone)


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and times as text: what file names, entity tags and the commands' output are made of."""
    rows = C.table(spark, sf_dir, "events").select("event_id", F.concat_ws("|", F.col("event_id").cast("string"), F.col("event_type")).alias("t"), "ts")
    return rows.select("event_id", ids.entity_tag(F.col("t")).alias("tag"), ids.lock_name(F.col("t")).alias("lock"), ids.time_text(F.col("ts")).alias("time"))


def refresh_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the newest chains that a reader who has seen positions 0 to UNTIL of each lane still needs."""
    objects = C.lane_objects(spark, sf_dir)
    newest = objects.join(chain.newest_epochs(objects), chain.LANE, "left_semi")
    wanted = chain.chains(newest)
    seen = wanted.where(F.col("hi") <= UNTIL)
    return wanted.join(seen, ["agent", "epoch", "lo", "hi"], "left_anti").select("agent", "epoch", "lo", "hi")


def compact_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one compacted object of a lane holds: its ids' first puts, or tombstones, which win."""
    own = merge.partial(log(spark, sf_dir).where(F.col("agent") == ME))
    return own.select("fid", F.when(F.col("dead"), "forget").otherwise("put").alias("op"), F.when(~F.col("dead"), F.col("origin.event_id")).alias("event_id"))


def epoch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lane_objects(spark, sf_dir).groupBy("agent", "epoch").agg(F.count("*").alias("objects"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("level").alias("compacted"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = merge.partial(log(spark, sf_dir))
    alive = ~F.col("dead") & F.col("origin").isNotNull()
    mine = alive & F.array_contains("authors", ME)
    return states.agg(F.count_if(alive).alias("fragments"), F.count_if(mine).alias("mine"), F.count_if(alive & ~mine).alias("from_others"), F.count_if("dead").alias("tombstones"))


def lru_victim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent whose last record is the oldest, but for ME."""
    used = log(spark, sf_dir).where(F.col("agent") != ME).groupBy("agent").agg(F.max("ts").alias("last_used"))
    return used.orderBy("last_used", "agent").limit(1)


def live_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live ids by the day of their first put and author: the merged view under a further aggregation."""
    return merge.live_state(log(spark, sf_dir)).groupBy(F.to_date("created_at").cast("string").alias("day"), "author").agg(F.count("*").alias("n"))


def stream_live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live view from the log read as a stream, its state folded batch by batch."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    events = spark.readStream.schema(C.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    refresh.refreshed(spark, C.log_of(events), f"{folder}/seen", f"{folder}/state")
    return merge.live(refresh.saved(spark, f"{folder}/state"))


_LIVE = """, puts AS (SELECT fid, min((ts, agent, event_id)) AS o, string_agg(DISTINCT agent, ',' ORDER BY agent) AS authors FROM {log} WHERE op = 'put' GROUP BY fid),
live AS (SELECT fid, o[1] AS created_at, o[2] AS author, authors FROM puts WHERE fid NOT IN (SELECT fid FROM {log} WHERE op = 'forget'))
"""
LIVE = _LIVE.format(log="mem_log")
_BACK = f""", newest AS (SELECT agent, epoch, seq FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, agent DESC, epoch DESC, seq DESC) AS r FROM commits) WHERE r <= {BACK}),
cut AS (SELECT agent, max((created_at, epoch, seq)) AS p FROM commits c WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.agent = c.agent AND n.epoch = c.epoch AND n.seq = c.seq) GROUP BY agent)
"""
_HEAD = ", heads AS (SELECT agent, max((created_at, epoch, seq)) AS p FROM commits GROUP BY agent)\n"
_LAST = f"ORDER BY created_at DESC, agent DESC, epoch DESC, seq DESC LIMIT {LIMIT}"

QUERIES = {
    "content_id": (content_id, _CONTENT),
    "content_dedupe": (content_dedupe, f"SELECT fid, min(doc_id) AS doc_id, count(*) AS copies FROM ({_CONTENT}) GROUP BY fid"),
    "key_format": (key_format, f"{OBJECTS} SELECT {_KEY} AS key FROM lane_objects"),
    "key_parse": (key_parse, f"{OBJECTS} SELECT {_KEY} AS key, agent, CAST(epoch AS BIGINT) AS epoch, lo, hi, level FROM lane_objects"),
    "merge_origin": (lambda s, d: merge.origins(log(s, d)), f"{LOG}{LIVE} SELECT fid, o[1] AS created_at, o[2] AS author, o[3] AS event_id FROM puts"),
    "authors": (lambda s, d: merge.authors(log(s, d)), f"{LOG} SELECT fid, string_agg(DISTINCT agent, ',' ORDER BY agent) AS authors, count(DISTINCT agent) AS n_authors FROM mem_log WHERE op = 'put' GROUP BY fid"),
    "tombstones": (lambda s, d: merge.tombstones(log(s, d)), f"{LOG} SELECT DISTINCT fid FROM mem_log WHERE op = 'forget'"),
    "live_state": (lambda s, d: merge.live_state(log(s, d)), f"{LOG}{LIVE} SELECT * FROM live"),
    "stream_live_state": (stream_live_state, f"{LOG}{LIVE} SELECT * FROM live"),
    "live_count": (live_count, f"{LOG}{LIVE} SELECT count(*) AS n FROM live"),
    "live_by_day": (live_by_day, f"{LOG}{LIVE} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, author, count(*) AS n FROM live GROUP BY ALL"),
    "forget_effective": (lambda s, d: merge.effective_forgets(log(s, d)), f"{LOG} SELECT fid, agent, ts, event_id, op FROM mem_log WHERE op = 'forget' AND fid IN (SELECT fid FROM mem_log WHERE op = 'put')"),
    "remember_repeat": (lambda s, d: merge.repeats(log(s, d)), f"{LOG} SELECT agent, fid, ts, event_id, op FROM (SELECT *, row_number() OVER (PARTITION BY agent, fid ORDER BY ts, event_id) AS n FROM mem_log WHERE op = 'put') WHERE n > 1"),
    "revision_bump": (
        lambda s, d: merge.revisions(log(s, d)).select("agent", "fid", "ts", "event_id", F.col("revision").cast("long")),
        f"""{LOG}, marked AS (SELECT *, CASE WHEN op = 'put' AND lag(op) OVER w = 'forget' AND coalesce(sum(CASE WHEN op = 'put' THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 1 ELSE 0 END AS again FROM mem_log WINDOW w AS (PARTITION BY fid ORDER BY ts, event_id)),
numbered AS (SELECT *, CAST(sum(again) OVER (PARTITION BY fid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision FROM marked)
SELECT agent, fid, ts, event_id, revision FROM numbered WHERE op = 'put'""",
    ),
    "get_by_id": (get_by_id, f"{LOG}{LIVE} SELECT * FROM live WHERE fid IN (SELECT fid FROM mem_log WHERE event_id % 100 = 0)"),
    "resolve_prefix": (resolve_prefix, f"{LOG}{LIVE} SELECT fid FROM live WHERE fid LIKE '{PREFIX}%'"),
    "peer_lanes": (peer_lanes, f"{LOG} SELECT agent, count(*) AS records FROM mem_log WHERE agent <> '{ME}' GROUP BY agent"),
    "agents": (agents, f"{LOG} SELECT agent FROM mem_log UNION SELECT 'reader'"),
    "commit_counts": (commit_counts, f"{COMMITS} SELECT agent, epoch, count(*) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM commits GROUP BY agent, epoch"),
    "history": (lambda s, d: history.history(C.commits(s, d), LIMIT), f"{COMMITS} SELECT * FROM commits {_LAST}"),
    "history_by": (lambda s, d: history.history(C.commits(s, d), LIMIT, ME), f"{COMMITS} SELECT * FROM commits WHERE agent = '{ME}' {_LAST}"),
    "head_cut": (lambda s, d: history.head(C.commits(s, d)), f"{COMMITS}{_HEAD} SELECT agent, p[2] AS epoch, p[3] AS seq FROM heads"),
    "head_minus_n": (lambda s, d: history.back(C.commits(s, d), BACK), f"{COMMITS}{_BACK} SELECT agent, p[2] AS epoch, p[3] AS seq FROM cut"),
    "cut_format": (cut_format, f"{COMMITS}{_HEAD} SELECT string_agg(concat(agent, ':e', p[2], ':', p[3]), ',' ORDER BY agent) AS cut FROM heads"),
    "state_at_cut": (state_at_cut, f"{COMMITS}{_BACK}, bounded AS (SELECT l.* FROM placed l JOIN cut c ON l.agent = c.agent AND l.epoch = c.p[2] AND l.seq <= c.p[3]){_LIVE.format(log='bounded')} SELECT * FROM live"),
    "chain_l0": (
        lambda s, d: chain.single_chains(C.lane_objects(s, d)),
        f"{OBJECTS} SELECT agent, epoch, lo, hi, level FROM (SELECT *, row_number() OVER (PARTITION BY agent, epoch ORDER BY lo) - 1 AS n FROM lane_objects WHERE level = 0) WHERE lo = n",
    ),
    "chain_l1": (lambda s, d: chain.chains(C.lane_objects(s, d)).drop("level"), _recursive("true")),
    "chain_until": (lambda s, d: chain.chains(C.lane_objects(s, d), UNTIL).drop("level"), _recursive(f"hi <= {UNTIL}")),
    "chain_level": (
        chain_level,
        OBJECTS.replace("WITH ", "WITH RECURSIVE ", 1)
        + """, more AS (SELECT * FROM lane_objects UNION ALL SELECT agent, epoch, lo, hi, 1 FROM lane_objects WHERE level = 0 AND lo = 0 AND epoch % 5 = 0),
widest AS (SELECT agent, epoch, lo, max((hi, level)) AS w FROM more GROUP BY ALL),
walked AS (SELECT agent, epoch, w[1] AS hi, w[2] AS level FROM widest WHERE lo = 0 UNION ALL SELECT w.agent, w.epoch, w.w[1], w.w[2] FROM walked c JOIN widest w ON w.agent = c.agent AND w.epoch = c.epoch AND w.lo = c.hi + 1)
SELECT agent, epoch, CAST(level AS INT) AS level, count(*) AS objects FROM walked GROUP BY ALL""",
    ),
    "where_typed": (where_typed, """SELECT doc_id, concat('{"n":', CAST(doc_id % 3 AS VARCHAR), '}') AS metadata FROM documents WHERE doc_id % 3 = 2 AND doc_id % 2 = 0"""),
    "revision_next": (
        revision_next,
        f"""{LOG}, gone AS (SELECT DISTINCT fid, CAST(event_id % 4 AS INT) AS r FROM mem_log WHERE op = 'forget'), tried AS (SELECT f.fid, CAST(n AS INT) AS r FROM (SELECT DISTINCT fid FROM gone) f, range(5) t(n))
SELECT fid, min(r) AS revision FROM tried WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.fid = tried.fid AND g.r = tried.r) GROUP BY fid""",
    ),
    "digests": (digests, """SELECT event_id, concat('"', md5(concat(event_id, '|', event_type)), '"') AS tag, sha1(concat(event_id, '|', event_type)) AS lock, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time FROM events"""),
    "select_epoch": (lambda s, d: chain.newest_epochs(C.lane_objects(s, d)), f"{OBJECTS} SELECT agent, max(epoch) AS epoch FROM lane_objects WHERE lo = 0 GROUP BY agent"),
    "spans_cover": (
        lambda s, d: chain.covered(C.lane_objects(s, d)),
        f"""{OBJECTS}, islands AS (SELECT agent, epoch, min(lo) AS a, max(hi) AS b FROM (SELECT *, lo - row_number() OVER (PARTITION BY agent, epoch ORDER BY lo) AS i FROM lane_objects WHERE level = 0) GROUP BY agent, epoch, i)
SELECT w.agent, w.epoch, w.lo, w.hi, EXISTS (SELECT 1 FROM islands i WHERE i.agent = w.agent AND i.epoch = w.epoch AND i.a <= w.lo AND i.b >= w.hi) AS covered FROM lane_objects w WHERE level = 1""",
    ),
    "lost_object": (
        lambda s, d: chain.lost(C.lane_objects(s, d)),
        f"""{_recursive("true").replace("SELECT agent, epoch, lo, hi, n FROM walked", "")}, ends AS (SELECT o.agent, o.epoch, coalesce(max(w.hi) + 1, 0) AS gap FROM lane_objects o LEFT JOIN walked w ON w.agent = o.agent AND w.epoch = o.epoch GROUP BY o.agent, o.epoch)
SELECT o.agent, o.epoch, gap, count(*) AS beyond FROM lane_objects o JOIN ends e ON e.agent = o.agent AND e.epoch = o.epoch WHERE o.lo > gap GROUP BY o.agent, o.epoch, gap""",
    ),
    "restore_lane": (restore_lane, f"SELECT * FROM ({_recursive(f"agent = '{ME}'")}) WHERE epoch = (SELECT max(day(ts)) FROM (SELECT ts FROM (SELECT ts, event_id, row_number() OVER (PARTITION BY day(ts) ORDER BY ts, event_id) AS r FROM events WHERE user_id % 8 = 0) WHERE (r = 1 AND event_id % 97 <> 0) OR (r = 8 AND day(ts) % 3 = 0)))"),
    "refresh_delta": (refresh_delta, f"{_recursive('true').replace('SELECT agent, epoch, lo, hi, n FROM walked', '')} SELECT agent, epoch, lo, hi FROM walked WHERE (agent, epoch) IN (SELECT (agent, max(epoch)) FROM lane_objects WHERE lo = 0 GROUP BY agent) AND hi > {UNTIL}"),
    "compact_fold": (compact_fold, f"{LOG} SELECT fid, CASE WHEN bool_or(op = 'forget') THEN 'forget' ELSE 'put' END AS op, CASE WHEN bool_or(op = 'forget') THEN NULL ELSE (min((ts, agent, event_id)) FILTER (op = 'put'))[3] END AS event_id FROM mem_log WHERE agent = '{ME}' GROUP BY fid"),
    "gc_candidates": (
        lambda s, d: chain.gc_candidates(C.lane_objects(s, d), KEEP),
        f"""{OBJECTS}, valid AS (SELECT agent, max(epoch) AS newest FROM lane_objects WHERE lo = 0 GROUP BY agent), t AS (SELECT o.*, newest FROM lane_objects o JOIN valid USING (agent))
SELECT agent, epoch, lo, hi, level FROM t WHERE epoch <= newest - {KEEP} UNION SELECT t.agent, t.epoch, t.lo, t.hi, t.level FROM t JOIN lane_objects w ON w.agent = t.agent AND w.epoch = t.epoch AND w.level = 1 AND w.hi > w.lo AND t.lo >= w.lo AND t.hi <= w.hi WHERE t.epoch > newest - {KEEP} AND t.level = 0""",
    ),
    "epoch_groups": (epoch_groups, f"{OBJECTS} SELECT agent, epoch, count(*) AS objects, min(lo) AS lo, max(hi) AS hi, CAST(sum(level) AS BIGINT) AS compacted FROM lane_objects GROUP BY agent, epoch"),
    "stats": (
        stats,
        f"""{LOG}{LIVE} SELECT count(*) AS fragments, count(*) FILTER (list_contains(string_split(authors, ','), '{ME}')) AS mine, count(*) FILTER (NOT list_contains(string_split(authors, ','), '{ME}')) AS from_others,
(SELECT count(DISTINCT fid) FROM mem_log WHERE op = 'forget') AS tombstones FROM live""",
    ),
    "lru_victim": (lru_victim, f"{LOG} SELECT agent, max(ts) AS last_used FROM mem_log WHERE agent <> '{ME}' GROUP BY agent ORDER BY last_used, agent LIMIT 1"),
}
