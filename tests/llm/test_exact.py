"""Operators with one right result, held against plain versions over small tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import brute
import corpus
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanewise.llm import _blocks as B
from lanewise.llm import _text as T
from lanewise.llm import decontam, fingerprints, sharding
from lanewise.llm import queries as Q

DOCS = corpus.texts()
ITEMS = corpus.items(DOCS)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return corpus.write(tmp_path_factory.mktemp("tables"), DOCS, benchmark=ITEMS)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return corpus.write(tmp_path_factory.mktemp("empty"), [])


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_suffix_dedup(spark, folder):
    assert rows(Q.op1_suffix_dedup(spark, folder), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op1(DOCS))


def test_suffix_dedup_inside_one_document(spark, tmp_path):
    docs = [(1, "ab" * 300), (2, "x" * 199), (3, "x" * 200), (4, "q" + "z" * 201), (5, ("lorem ipsum " * 40)[:399])]
    assert rows(Q.op1_suffix_dedup(spark, corpus.write(tmp_path, docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op1(docs))


def test_decontamination(spark, folder):
    assert rows(Q.op2_decontamination(spark, folder), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.op2(DOCS, ITEMS))


def test_bpe(spark, folder):
    tool = Tokenizer.from_file(Q.TOKENIZER)
    tool.no_truncation()
    tool.no_padding()
    want = []
    for i, text in DOCS:
        ids = tool.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tool.decode(ids, skip_special_tokens=False))))
    assert rows(Q.op3_bpe(spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_sharding(spark, folder):
    got = Q.op4_jump_sharding(spark, folder).collect()
    texts = dict(DOCS)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    slots = defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_depend_on_the_key_alone(spark, folder, tmp_path):
    one = dict(rows(Q.op4_jump_sharding(spark, folder), "doc_id", "shard"))
    two = dict(rows(Q.op4_jump_sharding(spark, corpus.write(tmp_path, [(i, "other") for i, _ in DOCS[::2]])), "doc_id", "shard"))
    assert all(one[i] == s for i, s in two.items())


def test_fingerprints(spark, folder):
    got = {r.doc_id: r for r in Q.op6_fingerprints(spark, folder).collect()}
    order = sorted(DOCS, key=lambda x: -x[0])
    prints = {}
    for k, (i, text) in enumerate(order):
        own, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        for text, mark in ((own, got[i].fingerprint), (edited, got[i].edited_fingerprint)):
            assert prints.setdefault(text, mark) == mark
        if own == edited:
            assert got[i].near_edited == 1
        if len(own) > 2000 and own != after:
            assert got[i].near_edited > got[i].near_next


def test_jaccard_join(spark, folder):
    assert rows(Q.op9_jaccard_join(spark, folder), "doc_id", "n_shingles", "component_id") == sorted(brute.op9(DOCS))


def test_jaccard_boundary(spark, tmp_path):
    words = [f"w{k}" for k in range(60)]
    docs = [(1, " ".join(words[:46])), (2, " ".join(words[:40])), (3, " ".join(words[4:40])), (4, " ".join(words[:30])), (5, "a b c d e"), (6, "A b c d E"), (7, "a b c"), (8, "a b C"), (9, "a b c a b c a b c a b c")]
    assert rows(Q.op9_jaccard_join(spark, corpus.write(tmp_path, docs)), "doc_id", "n_shingles", "component_id") == sorted(brute.op9(docs))


def test_superkmers(spark, folder):
    assert rows(Q.op10_superkmer_dedup(spark, folder), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op10(DOCS))


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_decontamination", "op3_bpe", "op4_jump_sharding", "op5_language_id", "op6_fingerprints", "op7_quality", "op8_toxicity", "op9_jaccard_join", "op10_superkmer_dedup"])
def test_empty_tables(spark, empty, name):
    assert Q.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_decontamination", "op3_bpe", "op4_jump_sharding", "op6_fingerprints", "op9_jaccard_join", "op10_superkmer_dedup"])
def test_repeated_rows_and_null_ids(spark, tmp_path, name):
    docs = [(1, "a b c d e f g " * 40), (1, "a b c d e f g " * 40), (None, "a b c d e f g " * 40), (None, None), (2, "x")]
    got = Q.QUERIES[name](spark, corpus.write(tmp_path, docs, benchmark=[(1, "a b c d e f g a b c d e f g")])).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in docs)


@pytest.mark.parametrize("block_bytes", [400, 1 << 20])
def test_a_benchmark_of_any_size(spark, folder, block_bytes):
    docs, items = Q.table(spark, folder, "documents").withColumn("contaminated_row", F.lit(1)).withColumn("bad", F.lit(2)), Q.table(spark, folder, "benchmark")
    want = sorted(brute.op2(DOCS, ITEMS))
    assert rows(decontam.contamination(docs, items, block_bytes=block_bytes), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    clean = decontam.clean(docs, items, block_bytes=block_bytes)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in want if not x[-1])


def test_jump_is_the_plain_one():
    def plain(key: int, buckets: int) -> int:
        b, j = -1, 0
        while j < buckets:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(4).integers(0, 2**64, 3000, dtype=np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, n).tolist() == [plain(int(k), n) for k in keys]
    before, after = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert ((after == before) | (after == 24)).all() and 0.025 < (after == 24).mean() < 0.055


def test_phrases_are_found_wherever_they_stand():
    rng = random.Random(3)
    whole = corpus.prose(rng, 900)
    texts = [whole] + [corpus.prose(rng, k) + " " + whole for k in (1, 2, 7, 40)]
    own = [fingerprints.sketches(*T.strings(pa.array([t]))) for t in texts]
    for k, other in enumerate(own[1:]):
        assert fingerprints.likeness(own[0], other)[0] > (0.85 if k < 3 else 0.7)
    # names are those of the text alone, whatever else is in the batch
    both = fingerprints.sketches(*T.strings(pa.array(texts)))
    assert all((both[k] == x[0]).all() for k, x in enumerate(own))
    assert fingerprints.likeness(own[0], fingerprints.sketches(*T.strings(pa.array([corpus.prose(rng, 900, 5000)]))))[0] < 0.3


def test_parsing_is_the_plain_one():
    """A plain parser of one level: runs, coin tosses, phrases at local maxima."""

    def parsed(names: list[int]) -> list[tuple]:
        runs = [(x, len(list(g))) for x, g in itertools.groupby(names)]
        named = [int(T.mix(np.array([(x + 0x2545F4914F6CDD1D * n) % 2**64], np.uint64))[0]) for x, n in runs]
        label = named
        for _ in range(fingerprints.TOSSES):
            new = []
            for i, x in enumerate(label):
                before = label[i - 1] if i else x ^ (2**64 - 1)
                bit = next((b for b in range(64) if (x ^ before) >> b & 1), 64)
                new.append(2 * bit + (x >> min(bit, 63) & 1))
            label = new
        cuts = [0] + [i for i in range(1, len(label) - 1) if label[i] > label[i - 1] and label[i] > label[i + 1]]
        return [tuple(named[a:b]) for a, b in zip(cuts, cuts[1:] + [len(named)])]

    rng = random.Random(9)
    for _ in range(5):
        raw = np.array([rng.randrange(4) for _ in range(300)], np.uint64)
        want = parsed([int(x) for x in raw])
        got, _ = fingerprints._parsed(raw, np.array([0, len(raw)]))
        assert len(got) == len(want) and len({*zip(got.tolist(), want)}) == len(set(want)) == len(set(got.tolist()))


@pytest.mark.parametrize("parts", [1, 9])
def test_next_documents_of_hot_ids(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(B, "block_count", lambda docs: parts)
    rng = random.Random(6)
    docs = [(rng.choice([None, None, 7, 7, -3, k]), corpus.prose(rng, rng.randint(0, 9))) for k in range(200)]
    folder = corpus.write(tmp_path, docs)
    order = [(r.doc_id, r.text or "") for r in Q.table(spark, folder, "documents").orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text"))).select("doc_id", "text").collect()]
    want = Counter()
    for k, (i, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        want[i, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in Q.op6_fingerprints(spark, folder).collect()) == want
