"""A shared memory space: writers commit records to lanes of a Parquet log, readers merge and search all lanes.

Layout under the root: log/agent=/epoch=/level=/lo=/hi=/ holds the records of one commit or compacted object as
Parquet, in order of their ids, with Bloom filters of these; commits/ and manifests/ say which objects there are (see
catalog), and only what has a marker is visible; owners/, checkpoints/ and attachments/ hold create-once files. A handle
takes a new epoch of its lane with its first write and begins it with all that its lane holds, so that readers need the
newest epoch alone.

A write is acknowledged only if the lane is still ours after its marker is there: whoever takes the lane over later begins
with what has markers, so that no acknowledged write is lost. Objects and payloads of other lanes that can't be read are left
out (broken() and quarantined() name them); of the own lane they are errors, and a lane that has lost records is never
begun anew without them. Writes that wait for a commit are kept by staging, as tables and not as plans.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager, suppress
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from lanewise import catalog
from lanewise.catalog import OBJECT, Catalog
from lanewise.errors import ChainBroken, Fenced, Unreadable
from lanewise.functions import vectors
from lanewise.functions.embed import embed
from lanewise.functions.ids import canonical, content_id_of_json, record_id
from lanewise.functions.keys import check_name
from lanewise.functions.metadata import equal_to
from lanewise.operators import chain, history, merge
from lanewise.operators.lease import Lease, held
from lanewise.sources.files import Files, checkpointed
from lanewise.staging import NAMES, Ledger

RECORD = f"fid string, base string, revision int, op string, text string, metadata string, parents array<string>, created_at double, author string, payload {vectors.PAYLOAD}"
RECORD_NAMES = ["fid", "base", "revision", "op", "text", "metadata", "parents", "created_at", "author", "payload"]
PLACE = "agent string, epoch int, level int, lo long, hi long"
COMPACT_EVERY, DIM = 32, 256
#: Ids or contents that are sought by value, so that files' statistics and filters apply; more of them are joined.
SOUGHT = 50
#: What lets readers skip files and pages that don't have an id.
INDEXED = {f"parquet.bloom.filter.{k}#{c}": v for c in ("fid", "base") for k, v in (("enabled", "true"), ("adaptive.enabled", "true"))} | {"parquet.page.row.count.limit": "2000"}
FIELDS = ["text", "metadata", "parents", "revision", "base", "payload"]


def _best(rows: DataFrame, k: int) -> DataFrame:
    return rows.where("NOT isnan(score)").orderBy(F.desc("score"), "fid").limit(max(k, 0))


def each_or_all(name: str, value, n: int, kind: type, one: Callable = lambda x: True) -> list:
    """A value for each of n texts: the given one for all, or one of a list that has as many."""
    if value is None or isinstance(value, kind) and one(value) and kind is not list:
        return [value] * n
    if isinstance(value, (str, bytes)) or not isinstance(value, (list, tuple)):
        raise TypeError(f"{name} must be one {kind.__name__} or a list of them, not {type(value).__name__}")
    if kind is list and value and one(value):
        return [list(value)] * n
    if len(value) != n:
        raise ValueError(f"{len(value)} {name} for {n} texts")
    return list(value)


class Space:
    """One agent's handle, or a read-only one without an agent.

    flush_every: after how many writes they are committed (one by default; None: with flush() or close()). refresh_every:
    for how many seconds a listing of commits may be used again (none by default; None: until refresh()).
    compact_every: after how many commits of an epoch the lane is compacted (None: never).
    """

    def __init__(self, spark: SparkSession, root: str, agent: str | None = None, dim: int | None = None, width: int = 4, embedder: Callable[[Column], Column] | None = None, ttl: float = 60.0, flush_every: int | None = 1, refresh_every: float | None = 0.0, compact_every: int | None = COMPACT_EVERY, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.catalog = Catalog(spark, self.files)
        self.agent = check_name(agent, "agent") if agent is not None else None
        config = self.files.load("config.json")
        if config is None:
            config = {"version": 3, "dim": dim or DIM, "width": width, "seed": vectors.SEED}
            if agent is not None:  # a reader never writes
                self.files.save("config.json", config)
                config = self.files.load("config.json")
        if dim is not None and config["dim"] != dim:
            raise ValueError(f"the space has {config['dim']} dimensions, not {dim}")
        self.dim, self.width = config["dim"], config["width"]
        self.embed, self.clock = embedder or embed(self.dim), clock
        self.lease = Lease(self.files, f"lanes/{agent}", ttl=ttl, clock=clock) if agent is not None else None
        self.flush_every, self.refresh_every, self.compact_every = flush_every, refresh_every, compact_every
        self.next, self.depth, self.staged = 0, 0, Ledger(spark)
        self._at, self._listing, self._commits, self._log = None, None, None, None

    @property
    def pending(self) -> int:
        """Writes that wait for a commit."""
        return self.staged.writes

    # reading

    def refresh(self) -> None:
        """Look for new commits with the next read."""
        self._at = None

    def commits(self) -> DataFrame:
        """Every visible object with its counts and note. If a new listing equals the last one, nothing else is read."""
        now = self.clock()
        if self._at is None or self.refresh_every is not None and now - self._at >= self.refresh_every:
            listing, self._at = self.catalog.listing(), now
            if listing != self._listing:
                self._listing, self._commits, self._log = listing, self.catalog.rows(listing), None
        return self._commits

    def _read(self, objects: DataFrame) -> DataFrame:
        """The records of some objects as they are stored, by the paths of these alone; of other lanes' objects those
        that can be read."""
        parts = []
        chosen: dict[bool, list[str]] = {True: [], False: []}
        for x in objects.select(*OBJECT).collect():  # names, as many as paths are read
            chosen[x.agent == self.agent].append(catalog.folder_of(*x))
        for mine, names in chosen.items():
            gone = set(self.files.missing(names))
            if mine and gone:
                raise Unreadable(f"the own lane has lost {sorted(gone)}")
            paths = [f"{self.root}/{x}" for x in names if x not in gone]
            if paths:
                lenient = {"ignoreCorruptFiles": str(not mine).lower(), "ignoreMissingFiles": str(not mine).lower()}
                parts.append(self.spark.read.schema(f"{RECORD}, {PLACE}").options(basePath=f"{self.root}/log", **lenient).parquet(*paths))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{RECORD}, {PLACE}")

    def _good(self) -> Column:
        return (F.col("op") != "put") | vectors.valid(F.col("payload"), self.dim)

    def _records(self, objects: DataFrame) -> DataFrame:
        """The records of some objects, without other lanes' puts whose payloads are damaged."""
        damaged = F.raise_error(F.concat(F.lit("damaged payload in the own lane: "), "fid")).cast("boolean")
        mine = F.col("agent") == F.lit(self.agent or "")
        return self._read(objects).where(F.when(self._good(), True).when(mine, damaged).otherwise(False))

    def _newest(self, at: str | None = None) -> DataFrame:
        """The objects that count: of each lane's newest epoch, or up to a position."""
        objects = self.commits()
        if at is None:
            return chain.chains(objects.join(chain.newest_epochs(objects), chain.LANE, "left_semi"))
        cut = self.spark.createDataFrame(self.resolve(at), "agent string, epoch int, at long")
        chosen = chain.chains(objects.join(cut, chain.LANE).where("hi <= at"))
        reached = cut.join(chosen.groupBy("agent").agg(F.max("hi").alias("hi")), "agent", "left").where("hi is null or hi < at")
        if broken := reached.first():
            raise ChainBroken(f"{broken['agent']} has no chain up to e{broken['epoch']}:{broken['at']}")
        return chosen

    def broken(self) -> DataFrame:
        """Objects of the newest chains of which fewer records can be read than were committed."""
        chosen = self._newest().join(self.commits(), OBJECT).select(*OBJECT, (F.col("added") + F.col("removed")).alias("records"))
        found = self._read(chosen).groupBy(*OBJECT).agg(F.count("*").alias("found"))
        return chosen.join(found, OBJECT, "left").where("coalesce(found, 0) < records").select(*OBJECT)

    def quarantined(self) -> DataFrame:
        """The puts that reads leave out because their payloads are damaged: where they are, fid, and payload."""
        return self._read(self._newest()).where(~self._good() & (F.col("agent") != F.lit(self.agent or ""))).select(*OBJECT, "fid", "payload")

    def log(self, at: str | None = None) -> DataFrame:
        """The records that count: of each lane's newest epoch, or up to a position."""
        if at is not None:
            return self._records(self._newest(at))
        self.commits()
        if self._log is None:
            self._log = self._records(self._newest())
        return self._log

    def live(self, at: str | None = None) -> DataFrame:
        """fid, text, metadata, parents, revision, base, payload, created_at, authors: the earliest put of each id that
        no lane has forgotten, and all who put it."""
        return self._merged(self.log(at), FIELDS)

    def _merged(self, log: DataFrame, fields: list[str]) -> DataFrame:
        put = F.col("op") == "put"
        order = F.struct("created_at", "author", -F.col("payload.width"))
        first = F.min_by(F.struct("created_at", *fields), F.when(put, order))
        states = log.groupBy("fid").agg(first.alias("first"), F.collect_set(F.when(put, F.col("author"))).alias("authors"), F.max(~put).alias("dead"), F.max(put).alias("known"))
        return states.where("known AND NOT dead").select("fid", "first.*", F.array_sort("authors").alias("authors"))

    def get(self, fid: str, at: str | None = None) -> Row | None:
        """The live record of an id, perhaps at a position; None if there is none."""
        return self._merged(self.log(at).where(F.col("fid") == fid), FIELDS).first()

    def recall(self, query: str | Iterable[float], k: int = 5, where: dict | Column | str | None = None, by: str | None = None, at: str | None = None) -> DataFrame:
        """The k live records most like a text or vector: all columns and score. A dict's keys must equal metadata's
        (a missing key equals None), value and kind; filters come before scoring."""
        log, score = self.log(at), vectors.score(self._vector(query))
        if isinstance(where, dict):
            # equal ids have equal metadata: all records of an id pass, or none (tombstones always do)
            log, where = log.where((F.col("op") != "put") | equal_to("metadata", where)), None
        if where is not None:
            rows = self._merged(log, FIELDS).where(where)
            rows = rows if by is None else rows.where(F.array_contains("authors", by))
            return _best(rows.withColumn("score", score("payload")), k)
        # puts are scored where they are read: ids and scores are merged, and the k texts fetched
        scored = log.withColumn("score", F.when(F.col("op") == "put", score("payload")))
        rows = self._merged(scored, ["score"])
        rows = rows if by is None else rows.where(F.array_contains("authors", by))
        found = F.broadcast(_best(rows, k).select("fid", "score"))
        return _best(self._merged(log.join(found.select("fid"), "fid", "left_semi"), FIELDS).join(found, "fid"), k)

    def _vector(self, query: str | Iterable[float]) -> np.ndarray:
        if not isinstance(query, str):
            return np.asarray(list(query), np.float64)
        return np.array(self.spark.createDataFrame([(query,)], "text string").select(self.embed(F.col("text"))).first()[0])

    def resolve_id(self, prefix: str) -> str:
        found = [r.fid for r in self.live().where(F.col("fid").startswith(prefix)).select("fid").limit(2).collect()]
        if len(found) != 1 and prefix not in found:
            raise KeyError(f"{prefix!r} is {'ambiguous' if found else 'unknown'}")
        return prefix if prefix in found else found[0]

    def agents(self) -> list[str]:
        """Lanes with a commit or an owner, and this handle's own; as many as there are writers."""
        return sorted({*self.catalog.agents(), *self.files.names("owners/lanes"), *([self.agent] if self.agent else [])})

    def _entries(self) -> DataFrame:
        return self.commits().where("level = 0").withColumn("seq", F.col("hi"))

    def history(self, limit: int = 20, by: str | None = None) -> DataFrame:
        return history.history(self._entries(), limit, by)

    def head(self, back: int = 0) -> list[tuple[str, int, int]]:
        """Each lane's last position, perhaps `back` commits ago."""
        found = history.back(self._entries(), back) if back else history.head(self._entries())
        return sorted(map(tuple, found.collect()))

    def resolve(self, at: str) -> list[tuple[str, int, int]]:
        """HEAD, HEAD~n, the name of a checkpoint, or positions as text."""
        if at.startswith("HEAD"):
            return self.head(int(at[5:] or 0) if at.startswith("HEAD~") else 0)
        saved = self.files.load(f"checkpoints/{at}.json") if ":" not in at else None
        if saved is None and ":" not in at:
            raise KeyError(f"no checkpoint {at!r}")
        return history.parse_cut(saved["cut"] if saved else at)

    def checkpoints(self) -> list[str]:
        return [x.removesuffix(".json") for x in self.files.names("checkpoints")]

    def checkpoint(self, name: str) -> str:
        """Name the present position, once and for all."""
        cut = ",".join(f"{a}:e{e}:{s}" for a, e, s in self.head())
        if not cut:
            raise ValueError("nothing to name yet")
        if not self.files.save(f"checkpoints/{check_name(name, 'checkpoint')}.json", {"cut": cut}):
            raise ValueError(f"there is a checkpoint {name!r} already")
        return cut

    def stats(self) -> DataFrame:
        """One row: live records, mine, others', tombstones, packed bytes, plain ones and their ratio, agents, objects of the
        newest chains, and writes that wait for a commit."""
        put, mine = F.col("op") == "put", F.array_contains("authors", self.agent or "")
        objects = self._newest()
        gone = self.log().where(~put).agg(F.count_distinct("fid")).first()[0]
        packed = F.coalesce(F.sum(F.octet_length("payload.codes")), F.lit(0))
        live = self.live().agg(F.count("*").alias("fragments"), F.count_if(mine).alias("mine"), F.count_if(~mine).alias("from_others"), packed.alias("packed"), (F.count("*") * self.dim * 4).alias("plain"))
        return live.withColumns({"tombstones": F.lit(gone), "ratio": F.round(F.try_divide("plain", "packed"), 1), "agents": F.lit(len(self.agents())), "objects": F.lit(objects.count()), "pending": F.lit(self.pending)})

    # writing

    def _writable(self) -> None:
        if self.agent is None:
            raise PermissionError("a read-only handle doesn't write")

    def remember(self, rows: DataFrame | Iterable[str], note: str = "") -> DataFrame:
        """base, fid for each of the texts (text, perhaps metadata as JSON, parents, embedding), repeats included; they are
        committed at once unless in a batch or flush_every says otherwise. Forgotten content comes back as its next revision; what this
        lane has isn't written again."""
        self._writable()
        if isinstance(rows, DataFrame):
            return self._remember_frame(rows, note)
        return self.spark.createDataFrame(self._remember_list([(t, "{}", [], None) for t in rows], note), "base string, fid string")

    def remember_many(self, texts: list[str], metadata: dict | list[dict | None] | None = None, embeddings: list | None = None, parents: list[str] | list[list[str]] | None = None, note: str = "") -> list[str]:
        """The ids of texts in their order, repeats included, after one commit. metadata and parents are one for all or
        one for each; nothing is written if their numbers don't match."""
        self._writable()
        texts = list(texts)
        each = each_or_all("metadata", metadata, len(texts), dict)
        above = each_or_all("parents", parents, len(texts), list, one=lambda x: all(isinstance(p, str) for p in x))
        if embeddings is not None and len(embeddings) != len(texts):
            raise ValueError(f"{len(embeddings)} embeddings for {len(texts)} texts")
        own = [[float(x) for x in e] for e in embeddings] if embeddings is not None else [None] * len(texts)
        if wrong := {len(e) for e in own if e is not None} - {self.dim}:
            raise ValueError(f"embeddings of {sorted(wrong)} dimensions in a space of {self.dim}")
        return [fid for _, fid in self._remember_list([(t, canonical(m or {}), list(p or []), e) for t, m, p, e in zip(texts, each, above, own)], note)]

    def _remember_list(self, texts: list[tuple], note: str) -> list[tuple[str, str]]:
        """base and fid of each (text, metadata, parents, embedding); what is new is staged."""
        bases = [record_id(*x[:3]) for x in texts]
        gone, have = self._known(set(bases))
        now, out, new = self.clock(), [], []
        for base, (text, metadata, parents, embedding) in zip(bases, texts):
            revision = next(r for r in range(len(gone.get(base, ())) + 1) if r not in gone.get(base, ()))
            fid = base if not revision else record_id(text, metadata, parents, revision)
            out.append((base, fid))
            if fid not in have:
                have.add(fid)
                new.append((fid, base, revision, "put", text, metadata, parents, now, embedding))
        self.staged.add(new)
        self._staged(note)
        return out

    def _known(self, bases: set[str]) -> tuple[dict[str, set[int]], set[str]]:
        """Of some contents, the revisions that were forgotten, in any lane or waiting, and the ids that this lane has."""
        gone, have = self.staged.known(bases)
        sought = [self._sought(x, "base", bases) for x in ([self.log()] if any(self._listed()) else []) + ([self.staged.written().withColumn("author", F.lit(self.agent))] if self.staged.parts else [])]
        for rows in sought:
            mine = F.when((F.col("op") == "put") & (F.col("author") == self.agent), F.col("fid"))
            for x in rows.groupBy("base").agg(F.collect_set(F.when(F.col("op") == "forget", F.col("revision"))).alias("gone"), F.collect_set(mine).alias("mine")).collect():
                gone.setdefault(x.base, set()).update(x.gone)
                have.update(x.mine)
        return gone, have

    def _listed(self) -> tuple:
        self.commits()
        return self._listing

    def _sought(self, rows: DataFrame, column: str, values: set[str]) -> DataFrame:
        if len(values) <= SOUGHT:
            return rows.where(F.col(column).isin(*values))
        return rows.join(F.broadcast(self.spark.createDataFrame([(x,) for x in values], f"{column} string")), column, "left_semi")

    def _remember_frame(self, rows: DataFrame, note: str) -> DataFrame:
        for name, kind in (("metadata", "string"), ("parents", "array<string>"), ("embedding", "array<double>")):
            rows = rows.withColumn(name, F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind))
        rows = rows.withColumn("metadata", F.coalesce("metadata", F.lit("{}"))).withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
        rows = rows.withColumn("base", content_id_of_json("text", "metadata", "parents", F.lit(0)))
        # the next revision of forgotten content is the least that no tombstone has
        gone = self.log().where("op = 'forget'").select("base", "revision")
        gone = gone.unionByName(self.staged.frame().where("op = 'forget'").select("base", "revision")) if self.staged else gone
        again = merge.next_revisions(gone.withColumnRenamed("base", "fid")).select(F.col("fid").alias("base"), F.col("revision").alias("next"))
        rows = rows.join(again, "base", "left").withColumn("revision", F.coalesce("next", F.lit(0)))
        rows = rows.withColumn("fid", F.when(F.col("revision") == 0, F.col("base")).otherwise(content_id_of_json("text", "metadata", "parents", "revision")))
        # written columns are fixed here: a task that is run again must not read a later clock
        rows = rows.withColumn("op", F.lit("put")).withColumn("created_at", F.lit(self.clock()))
        if self.depth or self.flush_every != 1 or self.staged:
            self.staged.add_frame(rows)
            ids = self.spark.read.parquet(self.staged.parts[-1]).select("base", "fid")
            self._staged(note)
            return ids
        self._commit(self._new(rows.select(*NAMES)), note)
        self._after_commit()
        return rows.select("base", "fid")

    def _new(self, staged: DataFrame) -> DataFrame:
        """Of staged records each once, without puts that this lane has."""
        mine = self.log().where((F.col("op") == "put") & (F.col("author") == self.agent)).select("fid", "op").distinct()
        return self._completed(staged.dropDuplicates(["fid", "op"]).join(mine, ["fid", "op"], "left_anti"))

    def _completed(self, staged: DataFrame) -> DataFrame:
        """Staged records with their payloads: one call of the embedder, for texts without an embedding."""
        vector = F.coalesce("embedding", self.embed(F.when(F.col("embedding").isNull(), F.col("text"))))
        rows = staged.withColumn("payload", vectors.encode(self.width)(F.when(F.col("op") == "put", vector))).withColumn("author", F.lit(self.agent))
        return rows.select(*RECORD_NAMES)

    def forget(self, ids: DataFrame | Iterable[str], note: str = "") -> DataFrame:
        """fid of those that were live; their tombstones win over all puts, in any lane."""
        self._writable()
        now = self.clock()
        if isinstance(ids, DataFrame):
            known = self._merged(self.log(), ["base", "revision"]).select("fid", "base", "revision")
            known = known.unionByName(self.staged.frame().where("op = 'put'").select("fid", "base", "revision")).distinct() if self.staged else known
            found = known.join(ids.select("fid").distinct(), "fid", "left_semi")
            self.staged.add_frame(found.selectExpr("fid", "base", "revision", "'forget' AS op", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS metadata", "CAST(NULL AS ARRAY<STRING>) AS parents", f"{now!r}D AS created_at", "CAST(NULL AS ARRAY<DOUBLE>) AS embedding"))
            out = self.spark.read.parquet(self.staged.parts[-1]).select("fid")
            out = out if self.depth or self.flush_every != 1 else checkpointed(out)  # the part goes with the commit
        else:
            wanted = set(ids)
            known = {r[0]: tuple(r[1:3]) for r in self.staged.rows if r[0] in wanted and r[3] == "put"}
            frames = [self._merged(self._sought(self.log(), "fid", wanted), ["base", "revision"])] if any(self._listed()) else []
            frames += [self._sought(self.staged.written().where("op = 'put'"), "fid", wanted)] if self.staged.parts else []
            for rows in frames:
                known |= {r.fid: (r.base, r.revision) for r in rows.select("fid", "base", "revision").distinct().collect()}
            self.staged.add([(fid, base, revision, "forget", None, None, None, now, None) for fid, (base, revision) in sorted(known.items())])
            out = self.spark.createDataFrame([(x,) for x in sorted(known)], "fid string")
        self._staged(note)
        return out

    @contextmanager
    def batch(self, note: str = ""):
        """One commit for all writes within, those of batches inside included; none at all if an exception ends it."""
        mark = self.staged.mark()
        self.depth += 1
        try:
            yield self
        except BaseException:
            self.staged.back_to(mark)
            raise
        finally:
            self.depth -= 1
        if not self.depth:
            self._flush_due(note)

    def _staged(self, note: str) -> None:
        self.staged.writes += 1
        if not self.depth:
            self._flush_due(note)

    def _flush_due(self, note: str) -> None:
        if self.flush_every is not None and self.pending >= self.flush_every:
            self.flush(note)

    def flush(self, note: str = "") -> tuple[int, int] | None:
        """Commit what waits; its epoch and position, or None if there was nothing to write."""
        if not self.staged:
            self.staged.clear()
            return None
        records = self._completed(self.staged.local())  # looked for in the log before they were staged
        if self.staged.parts:
            written = self.staged.written().join(self.staged.local().select("fid", "op"), ["fid", "op"], "left_anti") if self.staged.rows else self.staged.written()
            records = self._new(written.select(*NAMES)).unionByName(records) if self.staged.rows else self._new(written)
        written = self._commit(records, note)
        self.staged.clear()
        if written:
            self._after_commit()
        return written

    def _after_commit(self) -> None:
        if self.compact_every and self.next and self.next % self.compact_every == 0:
            self.compact()
        if self.next and self.next % catalog.EVERY == 0:
            self.catalog.write_manifest(self.agent, self.lease.epoch, self.next)

    def _hold(self) -> None:
        if self.lease.hold():
            self.next = 0
            self.refresh()

    def _commit(self, records: DataFrame, note: str, level: int = 0) -> tuple[int, int] | None:
        """Write the records, make them visible, and then make sure that the lane is still ours. An epoch that can't be
        begun is given up, so that this session or another can begin the next."""
        self._hold()
        if level and self.next == 0:
            raise Fenced("the lane's epoch ended before it was compacted")
        lo, hi, epoch = (0, self.next - 1, self.lease.epoch) if level else (self.next, self.next, self.lease.epoch)
        try:
            if self.next == 0:
                records = self._base().unionByName(records)  # a new epoch begins with all that the lane holds
            counts = self._write(records, catalog.folder_of(self.agent, epoch, level, lo, hi))
        except Exception:
            if self.next == 0:
                with suppress(Fenced):
                    self.lease.release()
                self.lease.epoch = None
            raise
        if counts is None:
            return None
        marker = {"agent": self.agent, "epoch": epoch, "level": level, "lo": lo, "hi": hi, "created_at": self.clock(), "note": note} | counts | {"width": counts["width"] or self.width}
        if not self.catalog.add(marker):
            raise Fenced(f"position {lo} of epoch {epoch} is taken")
        self.refresh()
        self.lease.verify()  # Fenced: not acknowledged, whether or not the new owner has taken it over
        if not level:
            self.next += 1
        self.lease.maybe_renew()
        return epoch, hi

    def _write(self, records: DataFrame, folder: str) -> dict | None:
        """How many records were put and forgotten, and their greatest width; None, and nothing written, if there are none."""
        seen = Observation()
        counts = F.count_if(F.col("op") == "put").alias("added"), F.count_if(F.col("op") == "forget").alias("removed"), F.max("payload.width").alias("width")
        # a writer that was fenced may have left files under the same key: each write replaces them
        records.select(*RECORD_NAMES).observe(seen, *counts).sortWithinPartitions("fid").write.options(**INDEXED).mode("overwrite").parquet(f"{self.root}/{folder}")
        if not seen.get["added"] + seen.get["removed"]:
            self.files.delete(folder)
            return None
        return seen.get

    def _own(self) -> DataFrame:
        """This lane's puts and tombstones, each id once, tombstones first."""
        rows = self.log().where(F.col("agent") == self.agent)
        order = F.struct(F.when(F.col("op") == "forget", 0).otherwise(1), "created_at")
        return rows.groupBy("fid").agg(F.min_by(F.struct(*RECORD_NAMES), order).alias("r")).select("r.*")

    def _base(self) -> DataFrame:
        """What a new epoch begins with; Unreadable if the lane has fewer records than were committed, as they would be
        lost for good."""
        own = self._newest().where(F.col("agent") == self.agent)
        committed = own.join(self.commits(), OBJECT).agg(F.coalesce(F.sum(F.col("added") + F.col("removed")), F.lit(0))).first()[0]
        if committed and self.log().where(F.col("agent") == self.agent).count() < committed:
            raise Unreadable(f"the lane {self.agent} has lost records")
        return self._own()

    def compact(self, width: int | None = None) -> None:
        """One object for the lane's commits of this epoch, its vectors perhaps narrowed."""
        self._writable()
        self._hold()
        self.flush()
        if self.next == 0:
            self._commit(self.spark.createDataFrame([], RECORD), "base")
        if self.next == 0:
            return
        rows = self._own()
        self._commit(rows if width is None else rows.withColumn("payload", vectors.requantize(width)("payload")), "compacted", level=1)

    def gc(self, keep: int = 1) -> int:
        """Delete this lane's objects that nothing needs; the lane must be ours and keeps its last valid chain."""
        self._writable()
        self._hold()
        self.lease.verify()
        own = self.catalog.rows(self.catalog.listing([self.agent]))
        gone = checkpointed(chain.gc_candidates(own, keep))  # before anything is deleted that it is made from
        if gone.isEmpty():
            return 0
        # from here on readers don't see them, and only then do they go
        self.catalog.write_manifest(self.agent, self.lease.epoch, self.next, without=gone)
        n = self.catalog.remove(gone.toLocalIterator())
        self.refresh()
        return n

    def attach(self, name: str, data: bytes) -> str:
        key = f"attachments/{hashlib.sha256(data).hexdigest()}/{name}"
        self.files.create(key, data)
        return key

    def attachment(self, key: str) -> bytes | None:
        return self.files.read(key)

    def task(self, name: str, ttl: float = 30.0):
        """A lease on a named task, as a context."""
        return held(self.files, f"tasks/{check_name(name, 'lease')}", f"{self.agent}-{uuid.uuid4().hex[:8]}", ttl)

    def close(self) -> None:
        """Hand the lane back; its next session has a new epoch."""
        if self.lease is not None:
            with suppress(Fenced):
                self.flush()
                self.lease.release()

    def __enter__(self) -> Space:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is not None:  # what waits for a commit is dropped with the error
            self.staged.clear()
        self.close()
