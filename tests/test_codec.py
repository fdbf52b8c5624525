"""The vector codec's accuracy, chains' golden cases and incremental merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanewise.functions import vectors as V
from lanewise.functions.embed import embed
from lanewise.operators import chain, merge, recall
from lanewise.operators.history import parse_cut
from lanewise.sources import carriers
from lanewise.streaming import refresh

DATA = "/root/testdata/sf0.001"


def scores(query, payloads):
    return V.estimates(payloads, np.asarray(query, float))[0]


def decoded(payloads):
    return np.stack(V.decoded(payloads))


@pytest.mark.parametrize("width, least", [(4, 0.6), (8, 0.8)])
def test_recall_at_ten(width, least):
    rng = np.random.default_rng(0)
    rows, queries = rng.standard_normal((400, 64)), rng.standard_normal((20, 64))
    codes = V.encode_rows(rows, width)
    shared = [len(set(np.argsort(-scores(q, codes))[:10]) & set(np.argsort(-rows @ q)[:10])) for q in queries]
    assert np.mean(shared) / 10 >= least


@pytest.mark.parametrize("width, to, least", [(4, 4, 0.9), (8, 4, 0.5), (4, 2, 0.5), (4, 1, 0.5), (2, 1, 0.5)])
def test_reconstruction(width, to, least):
    rows = np.random.default_rng(1).standard_normal((30, 128))
    near = decoded(V.narrowed(V.encode_rows(rows, width), to))
    cosine = (rows * near).sum(1) / np.linalg.norm(rows, axis=1) / np.linalg.norm(near, axis=1)
    assert cosine.mean() > least


@pytest.mark.parametrize("width", V.WIDTHS)
@pytest.mark.parametrize("dim", [5, 8, 33, 64])
def test_packing(width, dim):
    codes = np.random.default_rng(2).integers(0, 1 << width, (7, dim))
    assert (V.unpacked(V.packed(codes, width), width, dim) == codes).all()
    zero = V.encode_rows(np.zeros((1, dim)), width)
    assert scores(np.ones(dim), zero)[0] == 0 and not decoded(zero).any()


def damaged(payloads, **columns):
    """The payloads with some of their columns set to a value."""
    fields = [pa.array([columns[f.name]] * len(payloads), f.type) if f.name in columns else payloads.field(f.name) for f in V.KIND]
    return pa.StructArray.from_arrays(fields, fields=list(V.KIND))


BAD = [{"width": 3}, {"dim": 9}, {"dim": -8}, {"codes": b""}, {"codes": None}, {"width": None}]


@pytest.mark.parametrize("bad", BAD)
def test_bad_payloads(bad):
    with pytest.raises(ValueError):
        scores(np.ones(8), damaged(V.encode_rows(np.ones((3, 8)), 4), **bad))


def test_which_payloads_are_valid(spark):
    good = V.encode_rows(np.ones((1, 8)), 4)
    rows = pa.concat_arrays([good, *(damaged(good, **x) for x in [*BAD, {"norm": float("nan")}, {"length": float("inf")}]), pa.nulls(1, V.KIND)])
    df = spark.createDataFrame(pa.table({"payload": rows}))
    assert [r[0] for r in df.select(V.valid(F.col("payload"), 8)).collect()] == [True] + [False] * (len(rows) - 1)
    assert not df.select(V.valid(F.col("payload"), 9)).first()[0] and df.select(V.valid(F.col("payload"))).first()[0]


def test_null_payloads():
    rows = np.random.default_rng(8).standard_normal((4, 8))
    some = V.encode_rows(rows, 4).take(pa.array([0, None, 1, None]))
    near, most = V.estimates(some, np.ones(8))
    assert near[1] == near[3] == 0 and np.isinf(most[[1, 3]]).all() and (near[[0, 2]] == scores(np.ones(8), V.encode_rows(rows[:2], 4))).all()
    assert V.narrowed(some, 1).is_valid().to_pylist() == [True, False, True, False] and V.decoded(some)[1] is None


@pytest.mark.parametrize("width", V.WIDTHS)
@pytest.mark.parametrize("dim", [3, 8, 33, 64])
def test_byte_tables_are_the_plain_score(width, dim):
    rng = np.random.default_rng(9)
    codes, query = rng.integers(0, 1 << width, (5000, dim)), rng.standard_normal(dim)
    plain = (V.codebook(width, dim)[0][codes] * query).sum(1)
    assert np.allclose(V.table_sums(V.byte_tables(query, width), V.packed(codes, width)), plain, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("width, to", [(w, w) for w in V.WIDTHS] + [(8, 4), (8, 1), (4, 2), (2, 1)])
@pytest.mark.parametrize("scale", [1e-20, 1.0, 1e12])
def test_no_score_is_beyond_its_bounds(width, to, scale):
    rng = np.random.default_rng(10)
    rows = rng.standard_normal((500, 33)) * scale
    rows[:20] = rng.integers(-1, 2, (20, 33))
    rows[20] = 0
    payloads = V.narrowed(V.encode_rows(rows, width), to)
    for query in (rng.standard_normal(33), rows[3], -rows[40], np.eye(33)[5]):
        near, most = V.estimates(payloads, query)
        assert (np.abs(rows @ query - near) <= most).all()
        if width == to == 8:
            assert (most <= 0.05 * np.linalg.norm(rows, axis=1) * np.linalg.norm(query) + 1e-9).all()


@pytest.mark.parametrize("k", [0, 1, 10, 600])
def test_search_over_codes_is_exact(spark, k, monkeypatch):
    rng = np.random.default_rng(11)
    rows = rng.standard_normal((500, 16))
    rows[100:200] = rows[0]  # ties at the edge of the best
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
    codes = df.select("vec_id", V.encode(4)("embedding").alias("payload"))
    monkeypatch.setattr(recall, "HELD", 50)
    for query in (rows[0].tolist(), rows[7].tolist()):
        want = [tuple(r) for r in recall.recall(df, query, k).collect()]
        assert [tuple(r) for r in recall.recall_packed(codes, df, query, k).collect()] == want
    if k == 1:
        assert recall.survivors(codes, rows[7].tolist(), k).count() < 20


@pytest.mark.parametrize(
    "objects, until, want",
    [
        ([(2, 2), (0, 0), (1, 1)], None, [(0, 0), (1, 1), (2, 2)]),
        ([(0, 0), (1, 1), (3, 3), (4, 4)], None, [(0, 0), (1, 1)]),
        ([(1, 1), (2, 2)], None, []),
        ([(i, i) for i in range(6)] + [(0, 4)], None, [(0, 4), (5, 5)]),
        ([(i, i) for i in range(6)] + [(0, 4)], 2, [(0, 0), (1, 1), (2, 2)]),
        ([(i, i) for i in range(6)] + [(0, 4)], 4, [(0, 4)]),
        ([(0, 0), (1, 1), (2, 6), (4, 4), (7, 7), (8, 9), (8, 8)], None, [(0, 0), (1, 1), (2, 6), (7, 7), (8, 9)]),
    ],
)
def test_chains(spark, objects, until, want):
    rows = spark.createDataFrame([("a", 1, lo, hi, int(hi > lo)) for lo, hi in objects], "agent string, epoch int, lo long, hi long, level int")
    assert [(r.lo, r.hi, r.n) for r in chain.chains(rows, until).orderBy("n").collect()] == [(*x, n) for n, x in enumerate(want)]


def test_cuts():
    assert parse_cut("b:e2:5, a:e10:0") == [("a", 10, 0), ("b", 2, 5)]
    with pytest.raises(ValueError):
        parse_cut("nonsense")


def test_embedding(spark):
    texts = ["The Cat  sat", "the cat sat", "", "a dog ran far away"]
    a, b, c, d = (np.array(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "text string").select(embed()(F.col("text"))).collect())
    assert np.allclose(a, b) and abs(a @ a - 1) < 1e-9 and not c.any() and a @ d < 0.5


def test_incremental_merge_equals_whole(spark, tmp_path):
    log = carriers.mem_log(spark, DATA)
    for part in range(3):
        log.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    assert refresh.refreshed(spark, refresh.source(spark, str(tmp_path / "log"), log.schema, 1), str(tmp_path / "c"), str(tmp_path / "state")) == log.count()
    states = refresh.saved(spark, str(tmp_path / "state"))
    assert sorted(map(tuple, merge.live(states).collect())) == sorted(map(tuple, merge.live_state(log).collect()))
    assert refresh.refreshed(spark, refresh.source(spark, str(tmp_path / "log"), log.schema), str(tmp_path / "c"), str(tmp_path / "state")) == 0


def test_followed_states(spark, tmp_path):
    log = carriers.mem_log(spark, DATA)
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    seen = {}
    refresh.followed(refresh.source(spark, str(tmp_path / "log"), log.schema), str(tmp_path / "c"), lambda rows, _: seen.update({r.fid: tuple(r) for r in merge.live(rows).collect()})).awaitTermination()
    assert seen == {r.fid: tuple(r) for r in merge.live_state(log).collect()}


def test_levels():
    # published by J. Max, 1960
    for n, want in ((2, [0.798]), (4, [0.4528, 1.510]), (16, [0.1284, 0.3881, 0.6568, 0.9424, 1.256, 1.618, 2.069, 2.733])):
        assert np.allclose(V.normal_levels(n)[n // 2 :], want, atol=6e-4)
    for n in (4, 16, 256):
        levels = V.normal_levels(n)
        assert (np.diff(levels) > 0).all() and np.allclose(levels, -levels[::-1])
        # each level is the mean of the cell between the midpoints, by the trapezoidal rule
        edges = np.concatenate([[-9], (levels[1:] + levels[:-1]) / 2, [9]])
        for a, b, level in zip(edges, edges[1:], levels):
            x = np.linspace(a, b, 20_001)
            p = np.exp(-x * x / 2)
            p[[0, -1]] /= 2
            assert abs((p * x).sum() / p.sum() - level) < 1e-6


@pytest.mark.parametrize("dim", [1, 5, 8, 33, 64, 100])
def test_rotations(dim):
    turn = V.rotation(dim)
    assert np.allclose(turn @ turn.T, np.eye(dim)) and (dim < 8 or np.abs(turn).max() < 0.95)


@pytest.mark.parametrize("width", V.WIDTHS)
def test_codes_are_the_plain_ones(width):
    rows = np.random.default_rng(6).standard_normal((5, 33)) * 3
    query = np.random.default_rng(7).standard_normal(33)
    levels, turn = V.normal_levels(1 << width) / np.sqrt(33), V.rotation(33)
    got = V.encode_rows(rows, width)
    for at, (row, payload) in enumerate(zip(rows, got.to_pylist())):
        norm = float(np.sqrt(sum(x * x for x in row)))
        turned = [sum(turn[i][j] * row[j] / norm for j in range(33)) for i in range(33)]
        codes = [int(np.argmin(np.abs(levels - x))) for x in turned]
        assert len(payload["codes"]) == -(-33 * width // 8) and payload["width"] == width and payload["dim"] == 33
        bits = "".join(f"{b:08b}"[::-1] for b in payload["codes"])
        assert [int(bits[i * width : (i + 1) * width][::-1], 2) for i in range(33)] == codes
        near = [levels[c] for c in codes]
        length = float(np.sqrt(sum(x * x for x in near)))
        cosine = sum(a * b for a, b in zip(turned, near)) / length
        estimate = sum(a * sum(turn[i][j] * query[j] for j in range(33)) for i, a in enumerate(near)) * norm * cosine / length
        assert np.allclose([payload[c] for c in ("norm", "cosine", "length")], [norm, cosine, length], rtol=1e-6)
        assert np.allclose(payload["spread"], np.sqrt(1 - cosine**2), rtol=1e-5) and np.allclose(scores(query, got)[at], estimate, rtol=1e-5)


def test_golden_payloads():
    row = np.array([[3.0, -4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 12.0]])
    assert [V.encode_rows(row, w).to_pylist()[0]["codes"].hex() for w in V.WIDTHS] == GOLDEN


GOLDEN = ["b9", "c6de", "7ad3cac6", "9f7240d3acc36dc3"]


def test_embedding_is_the_plain_one():
    import hashlib

    from lanewise.functions import embed as E

    texts = ["The Cat  sat", "", "naïve 語 text\twith  tabs", "aaaa aaaa", "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))]
    for text, got in zip(texts, embed(64).func(pd.Series(texts))):
        padded, v = E.normal(text), np.zeros(64)
        for n in (3, 4, 5):
            for i in range(len(padded) - n + 1):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + n].encode(), digest_size=8).digest(), "little")
                v[h % 64] += 1 if h >> 63 else -1
        assert np.allclose(got, v / np.linalg.norm(v) if v.any() else v)
    counts = E.gram_counts.func(pd.Series(texts))
    for text, row in zip(texts, counts.itertuples()):
        grams = [text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)]
        assert (row.n_grams, row.n_distinct) == (len(grams), len(set(grams)))


def test_many_queries_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = []
    for q, v in rows[::20]:
        best = sorted((-round(float(np.dot(v, w)), 6), i) for i, w in rows)[:7]
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(best)]
    for block in (4096, 4):
        assert sorted(map(tuple, recall.recall_many(df, queries, 7, block).select("query_id", "vec_id", "score", "rank").collect())) == sorted(want)
