"""A space from the first commit to garbage collection, seen by two writers and a reader."""

from __future__ import annotations

import json
import shutil
import time

import pytest
from pyspark.sql import functions as F

from lanewise import catalog, staging
from lanewise.errors import Fenced, Held, Unreadable
from lanewise.functions.ids import canonical
from lanewise.operators.lease import Lease
from lanewise.space import Space

FACTS = ["the deploy runs on fridays", "the database is postgres", "retries use exponential backoff", "the cache expires hourly"]


def ids(df):
    return sorted(r.fid for r in df.select("fid").collect())


def test_life(spark, tmp_path):
    root = str(tmp_path / "team")
    rows = spark.createDataFrame([(t, json.dumps({"kind": "fact", "n": i})) for i, t in enumerate(FACTS)], "text string, metadata string")
    ann, ben, reader = Space(spark, root, "ann", ttl=3600), Space(spark, root, "ben", ttl=3600), Space(spark, root)
    first = ids(ann.remember(rows, "seed"))
    assert len(first) == 4 and ids(reader.live()) == first
    ben.remember(rows.limit(1))
    assert reader.live().where("text = 'the deploy runs on fridays'").first().authors == ["ann", "ben"]
    assert reader.agents() == ["ann", "ben"]
    # search
    hit = reader.recall("which database is it, postgres?", 1).first()
    assert hit.text == FACTS[1] and hit.score > 0
    assert [r.text for r in reader.recall("database", 5, where={"n": 2}).collect()] == [FACTS[2]]
    assert reader.recall("database", 5, where={"absent": None}).count() == 4
    assert reader.recall("deploy", 5, by="ben").count() == 1 and reader.recall("deploy", 0).count() == 0
    # time travel
    assert ann.checkpoint("before") == "ann:e0:0,ben:e0:0"
    with pytest.raises(ValueError):
        ann.checkpoint("before")
    gone = ids(ben.forget([hit.fid, "unknown"]))
    assert gone == [hit.fid] and hit.fid not in ids(reader.live()) and hit.fid in ids(reader.live("before"))
    assert ids(reader.live("HEAD~1")) == first and ids(reader.live("ann:e0:0")) == first
    assert [r.removed for r in reader.history(1).collect()] == [1]
    # forgotten content comes back under another id
    again = ids(ann.remember(rows.where("text like '%postgres'")))
    assert again != gone and again[0] in ids(reader.live())
    assert ids(ann.remember(rows.where("text like '%postgres'"))) == again and reader.commits().where("agent = 'ann'").count() == 2
    # a batch is one commit, and none after an error
    with ann.batch("both"):
        ann.remember(["one more"])
        ann.remember(["and another"])
    with pytest.raises(RuntimeError), ann.batch():
        ann.remember(["never"])
        raise RuntimeError
    assert {"one more", "and another"} <= {r.text for r in reader.live().collect()} and reader.live().where("text = 'never'").count() == 0
    # compaction and garbage collection change nothing that is live
    before = ids(reader.live())
    ann.compact(width=2)
    assert ids(reader.live()) == before and reader.recall("backoff retries", 1).first().text == FACTS[2]
    assert ann.gc() == 3 and ids(reader.live()) == before
    # the next session has a new epoch, which begins with all of the lane
    ann.close()
    with Space(spark, root, "ann") as later:
        later.remember(["a new session"])
        assert later.lease.epoch == 1 and len(ids(reader.live())) == len(before) + 1
        assert later.gc() == 1 and len(ids(reader.live())) == len(before) + 1
    row = reader.stats().first()
    assert row.fragments == len(before) + 1 and row.packed * 7 < row.plain
    assert reader.resolve_id(again[0][:12]) == again[0]
    with pytest.raises(KeyError):
        reader.resolve_id("zz")
    with pytest.raises(PermissionError):
        reader.remember(["x"])
    key = ann.attach("note.txt", b"bytes")
    assert reader.attachment(key) == b"bytes"


def test_leases(spark, tmp_path):
    from lanewise.sources.files import Files

    files, now = Files(spark, str(tmp_path / "l")), [100.0]
    a, b = (Lease(files, "x", s, ttl=10, clock=lambda: now[0]) for s in "ab")
    assert a.acquire() == 0 and a.holder() == "a"
    with pytest.raises(Held):
        b.acquire()
    now[0] += 5
    a.maybe_renew()
    now[0] += 11
    assert a.holder() is None and b.acquire() == 1
    with pytest.raises(Fenced):
        a.verify()
    b.release()
    assert a.acquire() == 2


def test_canonical_ids(spark):
    import hashlib

    from pyspark.sql import functions as F

    from lanewise.functions.ids import content_id, content_id_of_json

    texts = ["plain", 'quote " and \\ slash /', "tab\tline\nbell\x07 é 語", ""]
    rows = spark.createDataFrame([(t, '{"k": [1, {"b": null, "a": "ü"}]}') for t in texts], "text string, m string")
    want = [hashlib.sha256(canonical({"text": t, "metadata": {"lang": "en"}, "parents": []}).encode()).hexdigest() for t in texts]
    assert [r[0] for r in rows.select(content_id(F.col("text"), lang=F.lit("en"))).collect()] == want
    deep = [hashlib.sha256(('{"metadata":{"k":[1,{"a":"ü","b":null}]},"parents":["p"],"revision":2,"text":' + json.dumps(t, ensure_ascii=False) + "}").encode()).hexdigest() for t in texts]
    assert [r[0] for r in rows.select(content_id_of_json("text", "m", F.array(F.lit("p")), F.lit(2))).collect()] == deep


def texts(space, *where):
    return sorted(r.text for r in space.live().select("text").collect())


def test_no_acknowledged_write_is_lost_on_takeover(spark, tmp_path):
    root, now = str(tmp_path / "s"), [1000.0]
    old = Space(spark, root, "ann", ttl=10, clock=lambda: now[0])
    old.remember(["first"])
    verify = old.lease.verify

    def taken_over():
        # another session takes the lane while the write is on its way
        now[0] += 20
        with Space(spark, root, "ann", ttl=10, clock=lambda: now[0]) as new:
            new.remember(["by the new owner"])
        return verify()

    old.lease.verify = taken_over
    with pytest.raises(Fenced):
        old.remember(["not acknowledged"])
    assert "by the new owner" in texts(Space(spark, root)) and "first" in texts(Space(spark, root))


def test_own_time_that_ran_out_is_taken_again(spark, tmp_path):
    root, now = str(tmp_path / "s"), [1000.0]
    ann = Space(spark, root, "ann", ttl=10, clock=lambda: now[0])
    ann.remember(["one"])
    now[0] += 60
    assert ann.lease.self_fenced
    ann.remember(["two"])
    assert ann.lease.epoch == 1 and texts(Space(spark, root)) == ["one", "two"]
    now[0] += 60
    other = Space(spark, root, "ann", ttl=100, clock=lambda: now[0])
    other.remember(["three"])
    with pytest.raises(Fenced):
        ann.remember(["four"])


def test_nested_batches_and_policies(spark, tmp_path):
    root = str(tmp_path / "s")
    ann = Space(spark, root, "ann", flush_every=3)
    for t in "abcd":
        ann.remember([t])
    assert texts(Space(spark, root)) == ["a", "b", "c"] and ann.pending == 1
    with ann.batch("outer"):
        ann.remember(["e"])
        with ann.batch("inner"):
            ann.remember(["f"])
        ann.remember(["g"])
        with pytest.raises(KeyError), ann.batch():
            ann.remember(["never"])
            raise KeyError
    assert texts(Space(spark, root)) == list("abcdefg") and ann.commits().count() == 2 and ann.pending == 0
    late = Space(spark, root, "ben", flush_every=None)
    late.remember(["h"])
    assert "h" not in texts(Space(spark, root)) and late.flush() == (0, 0) and "h" in texts(Space(spark, root))
    assert late.flush() is None


def test_many_ids_in_order(spark, tmp_path):
    ann = Space(spark, str(tmp_path / "s"), "ann", dim=4)
    got = ann.remember_many(["b", "a", "b"], {"k": 1}, [[1, 0, 0, 0], [0, 1, 0, 0], [1, 0, 0, 0]])
    assert got[0] == got[2] != got[1] and ann.live().count() == 2 and ann.commits().count() == 1
    each = ann.remember_many(["x", "y"], [{"k": 1}, None], [[1, 0, 0, 0]] * 2, parents=[got[0]])
    assert ann.get(each[0]).parents == [got[0]] and ann.get("unknown") is None and json.loads(ann.get(each[1]).metadata) == {}
    for wrong in ({"metadata": [{}]}, {"embeddings": [[1, 2, 3, 4]]}, {"parents": [["p"]]}):
        with pytest.raises(ValueError):
            ann.remember_many(["x", "y"], **wrong)
    with pytest.raises(TypeError):
        ann.remember_many(["x", "y"], "text")
    assert ann.commits().count() == 2


def test_where_tells_kinds_apart(spark, tmp_path):
    ann = Space(spark, str(tmp_path / "s"), "ann")
    values = [2, "2", 2.0, True, None, {"a": [1, "é"]}, [1, 2], "true", 1]
    ann.remember_many([f"t{i}" for i in range(len(values))], [{"n": v} if v is not None else {} for v in values])
    found = lambda v: sorted(int(r.text[1:]) for r in ann.recall("t", 99, where={"n": v}).collect())
    for v in values:
        assert found(v) == [i for i, x in enumerate(values) if x == v], v


def test_compacting_one_object(spark, tmp_path):
    root = str(tmp_path / "s")
    ann = Space(spark, root, "ann")
    ann.remember(["only one"])
    wide = Space(spark, root).live().first().payload
    ann.compact(width=1)
    narrow = Space(spark, root).live().first().payload
    assert len(narrow.codes) < len(wide.codes) and narrow.width == 1
    assert ann.gc() == 1 and ann.commits().count() == 1 and texts(Space(spark, root)) == ["only one"]


def test_compaction_by_itself(spark, tmp_path):
    ann = Space(spark, str(tmp_path / "s"), "ann", compact_every=2)
    for t in "abc":
        ann.remember([t])
    assert [r.level for r in ann.commits().orderBy("created_at").collect()] == [0, 0, 1, 0] and texts(ann) == ["a", "b", "c"]
    assert ann.stats().first().objects == 2


def test_unreadable_objects_of_others(spark, tmp_path):
    root = tmp_path / "s"
    ann, ben = Space(spark, str(root), "ann"), Space(spark, str(root), "ben")
    ben.remember(["good"])
    ben.remember(["bad"])
    ann.remember(["mine"])
    for part in (root / "log" / "agent=ben" / "epoch=0" / "level=0" / "lo=1" / "hi=1").glob("part-*"):
        part.write_bytes(b"not parquet at all")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    zoe = root / "commits" / "zoe" / "0000000000" / "0000000000"
    zoe.mkdir(parents=True)
    (zoe / "0-000000000000-000000000000.json").write_text("{broken")
    for space in (Space(spark, str(root)), ann):
        assert texts(space) == ["good", "mine"]
        assert [(r.agent, r.lo) for r in space.broken().collect()] == [("ben", 1)]
    with pytest.raises(Exception):
        texts(ben)


def test_listings_within_a_budget(spark, tmp_path):
    root, now = str(tmp_path / "s"), [0.0]
    ann, reader = Space(spark, root, "ann"), Space(spark, root, refresh_every=5.0, clock=lambda: now[0])
    ann.remember(["a"])
    assert texts(reader) == ["a"]
    ann.remember(["b"])
    assert texts(reader) == ["a"]
    now[0] = 6.0
    assert texts(reader) == ["a", "b"]
    ann.remember(["c"])
    reader.refresh()
    assert texts(reader) == ["a", "b", "c"]


def test_forgotten_revisions(spark, tmp_path):
    ann = Space(spark, str(tmp_path / "s"), "ann")
    seen = []
    for _ in range(3):
        (fid,) = ann.remember_many(["again"])
        seen.append(fid)
        ann.forget([fid])
    assert len(set(seen)) == 3 and ann.get(ann.remember_many(["again"])[0]).revision == 3


def test_roots(spark, tmp_path):
    from lanewise.sources.files import Files, scheme_of

    assert scheme_of("s3a://x") == "s3a" and scheme_of("C:\\data") is None and scheme_of("/a:b") is None and scheme_of("file:/x") == "file"
    with pytest.raises(TypeError):
        Files(spark, tmp_path)
    for wrong in ("s3a://bucket/x", "ftp://x"):
        with pytest.raises(ValueError):
            Files(spark, wrong)
    files = Files(spark, str(tmp_path / "f"))
    assert files.create("a/b.json", b"1") and not files.create("a/b.json", b"2") and files.read("a/b.json") == b"1" and files.names("a") == ["b.json"]
    with pytest.raises(ValueError):
        files.read("../x")


def plan_of(df) -> int:
    return len(df._jdf.queryExecution().logical().toString().splitlines())


def test_many_staged_writes(spark, tmp_path):
    """Plans don't grow with what waits, and a write costs no Spark job where nothing is in the log."""
    ann = Space(spark, str(tmp_path / "s"), "ann", flush_every=None)
    sizes, began = [], time.monotonic()
    for i in range(200):
        ann.remember([f"text {i}", f"text {i // 2}"])
        sizes.append(plan_of(ann.staged.frame()))
    assert len(set(sizes)) == 1 and time.monotonic() - began < 120 and ann.pending == 200
    assert ann.flush("all") == (0, 0) and ann.live().count() == 200 and ann.commits().count() == 1
    # with a log, and writes of DataFrames: one scan of all parts
    ann.remember(["text 7", "more"])
    sizes = []
    for i in range(6):
        ids = ann.remember(spark.createDataFrame([(f"frame {i}",), ("text 3",), ("more",), (f"frame {i}",)], "text string"))
        assert ids.count() == 4 and ids.distinct().count() == 3
        sizes.append(plan_of(ann._new(ann.staged.written())))
    assert len(set(sizes)) == 1 and len(ann.staged.rows) == 1
    assert ann.flush() == (0, 1) and ann.live().count() == 207 and ann.history(1).first().added == 7


def test_objects_of_thirty_writes(spark, tmp_path):
    ann = Space(spark, str(tmp_path / "s"), "ann", flush_every=10)
    for i in range(30):
        ann.remember_many([f"t{i}"])
    assert ann.commits().count() == 3 and ann.live().count() == 30


def test_staged_contents_come_and_go(spark, tmp_path):
    """Puts and tombstones of one content in one batch, in lists and DataFrames."""
    ann, frame = Space(spark, str(tmp_path / "s"), "ann"), lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    with ann.batch():
        one = ann.remember_many(["x"])[0]
        assert ids(ann.forget([one, "unknown"])) == [one]
        two = ann.remember_many(["x", "y"])
        assert two[0] != one
        assert ids(ann.remember(frame("x", "z"))) == sorted([two[0], *ids(ann.remember(["z"]))])
        gone = ann.forget(frame("a").selectExpr(f"'{two[1]}' AS fid"))
        assert ids(gone) == [two[1]]
        again = ann.remember_many(["y"])[0]
        assert again != two[1]
        with pytest.raises(KeyError), ann.batch():
            ann.remember(frame("never"))
            ann.remember(["nor this"])
            raise KeyError
    assert texts(ann) == ["x", "y", "z"] and ann.commits().count() == 1
    assert {r.fid: r.revision for r in ann.live().where("text <> 'z'").collect()} == {two[0]: 1, again: 1}


def test_more_than_fits_on_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "INLINE", 3)
    ann = Space(spark, str(tmp_path / "s"), "ann")
    with ann.batch():
        for part in ("ab", "cd", "ae", "cf"):
            ann.remember(list(part))
        assert len(ann.staged.rows) == 3 and len(ann.staged.parts) == 2
    assert texts(ann) == list("abcdef") and ann.history(1).first().added == 6


def test_lost_objects_of_the_own_lane(spark, tmp_path):
    root = tmp_path / "s"
    ann = Space(spark, str(root), "ann", ttl=3600)
    for t in "abc":
        ann.remember([t])
    ann.close()
    lost = root / "log" / "agent=ann" / "epoch=0" / "level=0" / "lo=1"
    shutil.move(lost, tmp_path / "aside")
    # others do without; the owner neither reads on nor begins an epoch that would lack it, and the lane stays free
    assert texts(Space(spark, str(root))) == ["a", "c"]
    later = Space(spark, str(root), "ann")
    for _ in range(2):
        with pytest.raises(Unreadable):
            later.remember(["d"])
    assert later.lease.epoch is None and Lease(later.files, "lanes/ann").holder() is None
    shutil.move(tmp_path / "aside", lost)
    later.refresh()
    later.remember(["d"])
    assert texts(Space(spark, str(root))) == ["a", "b", "c", "d"]
    later.close()
    # a file of an object that is there
    part = next((root / "log" / "agent=ann" / "epoch=1").rglob("part-*.parquet"))
    part.unlink()
    with pytest.raises(Unreadable):
        Space(spark, str(root), "ann").remember(["e"])


def test_a_failed_start_gives_the_lane_back(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    ann = Space(spark, root, "ann", ttl=3600)
    monkeypatch.setattr(ann, "_write", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ann.remember(["x"])
    monkeypatch.undo()
    with Space(spark, root, "ann") as other:
        other.remember(["y"])
    ann.staged.clear()
    ann.remember(["z"])
    assert texts(Space(spark, root)) == ["y", "z"]


def test_readers_write_nothing(spark, tmp_path):
    reader = Space(spark, str(tmp_path / "nowhere"))
    assert reader.live().count() == 0 and reader.commits().count() == 0 and not (tmp_path / "nowhere").exists()
    Space(spark, str(tmp_path / "s"), "ann", dim=16).remember(["x"])
    assert Space(spark, str(tmp_path / "s")).dim == Space(spark, str(tmp_path / "s"), "ben").dim == 16
    with pytest.raises(ValueError):
        Space(spark, str(tmp_path / "s"), dim=32)


def test_damaged_payloads(spark, tmp_path):
    root = str(tmp_path / "s")
    ann, ben = Space(spark, root, "ann", dim=8), Space(spark, root, "ben")
    ann.remember(["mine"])
    write = ben._write
    bad = F.struct(*(F.lit(9).alias("width") if c == "width" else F.col(f"payload.{c}").alias(c) for c in ("width", "dim", "norm", "cosine", "length", "spread", "codes")))
    ben._write = lambda records, folder: write(records.withColumn("payload", F.when(F.col("text") == "bad", bad).otherwise(F.col("payload"))), folder)
    ben.remember(["good", "bad"])
    for space in (Space(spark, root), ann):
        assert texts(space) == ["good", "mine"] and {r.text for r in space.recall("good", 9).collect()} == {"good", "mine"}
        assert [r.agent for r in space.quarantined().collect()] == ["ben"]
    with pytest.raises(Exception, match="damaged payload"):
        texts(ben)


def test_manifests(spark, tmp_path, monkeypatch):
    """A reader lists those since the last manifest alone, and reads the chosen objects' paths."""
    root = str(tmp_path / "s")
    monkeypatch.setattr(catalog, "EVERY", 5)
    monkeypatch.setattr(catalog, "SLICE", 4)
    ann = Space(spark, root, "ann", dim=4, compact_every=None)
    for i in range(2 * catalog.EVERY + 3):
        ann.remember_many([f"t{i}"], embeddings=[[1.0, 0, 0, 0]])
    reader = Space(spark, root)
    tables, markers = reader.catalog.listing()
    assert len(tables) == 1 and len(markers) == 3 and reader.files.listed < 60
    assert reader.commits().count() == 2 * catalog.EVERY + 3 and reader.live().count() == 2 * catalog.EVERY + 3
    # all markers say the same as the manifest and those after it
    whole = reader.catalog.rows(((), tuple(reader.catalog._after("ann", None))))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, reader.commits().collect()))
    # nothing new: the same rows, without another read
    before = reader.commits(), reader.log()
    assert reader.commits() is before[0] and reader.log() is before[1]
    ann.compact()
    ann.remember_many(["after"], embeddings=[[0, 1.0, 0, 0]])
    assert reader.live().count() == 2 * catalog.EVERY + 4
    files = {"log/" + x.rsplit("/log/", 1)[1].rsplit("/", 1)[0] for x in reader.log().inputFiles()}
    assert files == {catalog.folder_of("ann", 0, 1, 0, 2 * catalog.EVERY + 2), catalog.folder_of("ann", 0, 0, 2 * catalog.EVERY + 3, 2 * catalog.EVERY + 3)}
    assert ann.gc() == 2 * catalog.EVERY + 3
    late = Space(spark, root)
    assert late.live().count() == 2 * catalog.EVERY + 4 and late.commits().count() == 2
    # an unreadable manifest: all markers are listed
    last = sorted((tmp_path / "s" / "manifests" / "ann").glob("*.json"))[-1]
    last.write_text("{")
    assert Space(spark, root).live().count() == 2 * catalog.EVERY + 4


def test_ids_are_indexed(spark, tmp_path):
    """Files are in order of ids and have Bloom filters, and the search for one id is pushed down to them."""
    import pyarrow.parquet as pq

    ann = Space(spark, str(tmp_path / "s"), "ann", dim=4)
    got = ann.remember_many([f"text {i}" for i in range(400)], embeddings=[[1.0, 0, 0, 0]] * 400)
    for file in (tmp_path / "s" / "log").rglob("*.parquet"):
        rows = pq.read_table(file, partitioning=None)["fid"].to_pylist()
        assert rows == sorted(rows)
    plan = ann._sought(ann.log(), "fid", {got[5]})._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(fid,{got[5]})" in plan and "PushedFilters" in plan
    assert ann.get(got[5]).text == "text 5" and ann.resolve_id(got[9][:20]) == got[9]
    prefix = ann.log().where(F.col("fid").startswith("ab"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(fid,ab)" in prefix


def test_a_block_keeps_its_own_error(spark, tmp_path):
    ann = Space(spark, str(tmp_path / "s"), "ann")
    with pytest.raises(KeyError), ann.task("t") as lease:
        lease.epoch = 99  # lost meanwhile
        raise KeyError
    with pytest.raises(Fenced), ann.task("u") as lease:
        lease.epoch = 99
