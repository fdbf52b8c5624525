"""Minimisers with more bytes than a task may hold: the edges of passages that many documents share."""

from __future__ import annotations

import random

import brute
import corpus

from lanewise.llm import _blocks as B
from lanewise.llm import queries as Q
from lanewise.llm import _text as T
from lanewise.llm import suffixes, superkmers

LIMIT = 3000


def shared(seed: int = 5) -> list[tuple[int, str]]:
    """Texts around two passages, some of them again with one word changed, and some copies."""
    rng = random.Random(seed)
    one, two = corpus.prose(rng, 90), corpus.prose(rng, 40)
    out = [f"{corpus.prose(rng, 25)} {one} {corpus.prose(rng, 30)}" for _ in range(60)]
    out += [f"{corpus.prose(rng, 3)} {two} {t}" for t in out[:20]] + [t.replace(one[-30:-20], "otherwise") for t in out[20:40]]
    out += out[:5] + ["ab" * 300, "ab" * 300 + "c", "é" * 400]
    return list(zip(range(3, 3 + len(out)), out))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def watched(monkeypatch, check):
    """Every bucket's messages go through check before they are solved."""
    inner = B.answered

    def answered(messages, n, solve):
        def checked(got):
            check(got)
            return solve(got)

        return inner(messages, n, checked)

    monkeypatch.setattr(B, "answered", answered)


def test_suffix_arrays_are_bounded(spark, tmp_path, monkeypatch):
    limit = LIMIT

    def check(got):
        (found, _) = B.letters(got, suffixes.STRINGS, suffixes.STRETCHES)
        raw, offs = found["bytes"]
        different = {(low, raw[a:b].tobytes()) for low, a, b in zip(found["low"].tolist(), offs, offs[1:])}
        size = {}
        for low, x in different:
            size[low] = size.get(low, 0) + len(x)
        if max(size.values(), default=0) > limit:
            raise AssertionError(f"{max(size.values())} bytes of one minimiser")

    watched(monkeypatch, check)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", limit)
    monkeypatch.setattr(B, "block_count", lambda docs: 7)
    docs = shared()
    assert rows(Q.op1_suffix_dedup(spark, corpus.write(tmp_path, docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op1(docs))


def test_all_stretches_dealt_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 1)
    monkeypatch.setattr(B, "block_count", lambda docs: 5)
    docs = shared() + [(1000 + i, t) for i, t in corpus.texts()]
    assert rows(Q.op1_suffix_dedup(spark, corpus.write(tmp_path, docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op1(docs))


def test_super_k_mers_are_bounded(spark, tmp_path, monkeypatch):
    limit = LIMIT

    def check(got):
        size = {}
        raw, offs = B.letters(got, superkmers.STRINGS, superkmers.WINDOWS)[0]["words"]
        w = T.Words(raw, offs)
        grams = w.grams(3)
        for k in range(len(offs) - 1):
            low = int(grams[w.first[k] : w.first[k + 1] - 2].min())
            size[low] = size.get(low, 0) + int(offs[k + 1] - offs[k])
        if max(size.values(), default=0) > limit:
            raise AssertionError(f"{max(size.values())} bytes of one minimiser")

    watched(monkeypatch, check)
    monkeypatch.setattr(superkmers, "HEAVY", limit, raising=False)
    monkeypatch.setattr(B, "block_count", lambda docs: 7)
    docs = shared()
    assert rows(Q.op10_superkmer_dedup(spark, corpus.write(tmp_path, docs)), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op10(docs))


def test_all_windows_dealt_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(superkmers, "HEAVY", 1, raising=False)
    monkeypatch.setattr(B, "block_count", lambda docs: 5)
    docs = shared() + [(1000 + i, t) for i, t in corpus.texts()]
    assert rows(Q.op10_superkmer_dedup(spark, corpus.write(tmp_path, docs)), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op10(docs))
