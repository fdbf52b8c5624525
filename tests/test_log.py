"""Chains, coverage, positions and states of the log, held against plain versions on drawn cases."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lanewise.operators import chain, history
from lanewise.streaming import refresh

OBJECT = "agent string, epoch int, lo long, hi long, level int"


def plain_chain(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    widest: dict[int, int] = {}
    for lo, hi in spans:
        widest[lo] = max(hi, widest.get(lo, -1))
    out, at = [], 0
    while at in widest:
        out.append((at, widest[at]))
        at = widest[at] + 1
    return out


def lanes(rng: random.Random) -> dict[tuple[str, int], list[tuple[int, int]]]:
    """Lanes of single objects with gaps, of compacted ones that jump over gaps or overlap, and of both in turn."""
    out = {}
    for k in range(30):
        n = rng.choice([0, 1, 5, 40])
        spans = [(i, i) for i in range(n) if rng.random() > 0.03]
        spans += [(lo, lo + rng.randrange(6)) for lo in (rng.randrange(n + 1) for _ in range(n // 3))]
        out[f"a{k % 7}", k] = spans
    out["long", 0] = [(2 * i, 2 * i + 1) for i in range(300)] + [(i, i) for i in range(600, 640)]
    out["turns", 0] = [x for i in range(0, 300, 3) for x in ((i, i), (i + 1, i + 2))]
    return out


@pytest.mark.parametrize("slice_", [4, 1 << 16])
def test_chains_of_drawn_lanes(spark, monkeypatch, slice_):
    monkeypatch.setattr(chain, "SLICE", slice_)
    drawn = lanes(random.Random(slice_))
    rows = spark.createDataFrame([(a, e, lo, hi, int(hi > lo)) for (a, e), spans in drawn.items() for lo, hi in spans], OBJECT)
    want = {(a, e, lo, hi, n) for (a, e), spans in drawn.items() for n, (lo, hi) in enumerate(plain_chain(spans))}
    assert Counter(tuple(r) for r in chain.chains(rows).select("agent", "epoch", "lo", "hi", "n").collect()) == Counter(want)
    gaps = {}
    for (a, e), spans in drawn.items():
        end = max((hi + 1 for _, hi in plain_chain(spans)), default=0)
        if beyond := sum(lo > end for lo, _ in spans):
            gaps[a, e] = (end, beyond)
    assert {(r.agent, r.epoch): (r.gap, r.beyond) for r in chain.lost(rows).collect()} == gaps


def test_coverage_and_garbage(spark):
    drawn = lanes(random.Random(6))
    drawn = {k: sorted({(lo, hi) for lo, hi in v if hi > lo} | {(lo, hi) for lo, hi in v if hi == lo}) for k, v in drawn.items()}
    rows = spark.createDataFrame([(a, e, lo, hi, int(hi > lo)) for (a, e), spans in drawn.items() for lo, hi in spans], OBJECT)
    single = {k: {lo for lo, hi in v if lo == hi} for k, v in drawn.items()}
    want = Counter((a, e, lo, hi, all(i in single[a, e] for i in range(lo, hi + 1))) for (a, e), v in drawn.items() for lo, hi in v if hi > lo)
    assert Counter(map(tuple, chain.covered(rows).collect())) == want
    for keep in (1, 3):
        newest = {a: max((e for (b, e), v in drawn.items() if b == a and any(lo == 0 for lo, _ in v)), default=None) for a, _ in drawn}
        gone = set()
        for (a, e), v in drawn.items():
            wide = [x for x in v if x[1] > x[0]]
            for lo, hi in v:
                if newest[a] is not None and (e <= newest[a] - keep or lo == hi and any(x <= lo and hi <= y for x, y in wide)):
                    gone.add((a, e, lo, hi, int(hi > lo)))
        assert set(map(tuple, chain.gc_candidates(rows, keep).collect())) == gone


@pytest.mark.parametrize("kind", ["double", "timestamp"])
def test_positions_back(spark, kind):
    """Many commits in one second, and seconds, hours and years apart."""
    rng = random.Random(8)
    times = sorted(1_700_000_000 + rng.choice([0, 0, 0, 1, 61, 4000, 90_000, 40_000_000]) * rng.randrange(4) + rng.choice([0.0, 0.25, 0.5]) for _ in range(60))
    commits = [(t, f"a{rng.randrange(3)}", rng.randrange(2), i) for i, t in enumerate(times)]
    rows = spark.createDataFrame([(a, e, s, t) for t, a, e, s in commits], "agent string, epoch int, seq long, created_at double")
    rows = rows if kind == "double" else rows.selectExpr("agent", "epoch", "seq", "timestamp_micros(CAST(created_at * 1000000 AS BIGINT)) AS created_at")
    for n in (0, 1, 7, 20, 41, 58, 59, 60, 500):
        left = sorted(commits)[: max(len(commits) - n, 1)]
        heads = {}
        for t, a, e, s in left:
            heads[a] = max(heads.get(a, (-1.0, 0, 0)), (t, e, s))
        assert sorted(map(tuple, history.back(rows, n).collect())) == sorted((a, e, s) for a, (_, e, s) in heads.items()), n
    assert history.back(rows.limit(0), 3).collect() == []


def test_parts_of_a_state():
    for n in range(2 * refresh.FOLD**2 + 3):
        parts = refresh.spans(n)
        assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])][: len(parts)] and (not parts or parts[-1][1] == n)
        assert len(parts) <= 3 * (refresh.FOLD - 1)
        # a batch replaces the parts that its own begins with, and touches no other
        new = refresh.spans(n + 1)
        assert new[:-1] == [x for x in parts if x[1] <= new[-1][0]]
    # what is written in all, for each batch: its number's digits at most
    written = sum(b - a for a, b in (refresh.spans(n + 1)[-1] for n in range(512)))
    assert written <= 512 * 4


def test_states_over_many_batches(spark, tmp_path):
    from lanewise.operators import merge
    from lanewise.sources import carriers

    log = carriers.mem_log(spark, "/root/testdata/sf0.001")
    folder, state = str(tmp_path / "log"), str(tmp_path / "state")
    for part in range(10):
        log.where(f"event_id % 10 = {part}").coalesce(1).write.mode("append").parquet(folder)
    read = lambda: refresh.refreshed(spark, refresh.source(spark, folder, log.schema, 1), str(tmp_path / "c"), state)
    assert read() == log.count()
    whole = sorted(map(tuple, merge.live_state(log).collect()))
    assert sorted(map(tuple, merge.live(refresh.saved(spark, state)).collect())) == whole
    # a batch that hadn't ended: readers keep to the one before
    (tmp_path / "state" / "000000000010-000000000011").mkdir()
    assert sorted(map(tuple, merge.live(refresh.saved(spark, state)).collect())) == whole
