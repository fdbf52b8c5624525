"""Many blocks, messages between them, and words that plain polynomial hashes can't tell apart."""

from __future__ import annotations

import hashlib

import brute
import corpus
import numpy as np
import pytest
from tokenizers import Tokenizer

from lanewise.llm import _blocks as B
from lanewise.llm import _text as T
from lanewise.llm import queries as Q

DOCS = corpus.texts(7)
ITEMS = corpus.items(DOCS)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def bpe(docs):
    tool = Tokenizer.from_file(Q.TOKENIZER)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for i, text in docs:
        ids = tool.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(tool.decode(ids, skip_special_tokens=False))))
    return out


PLAIN = {
    "op1_suffix_dedup": (brute.op1, ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")),
    "op3_bpe": (bpe, ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")),
    "op9_jaccard_join": (brute.op9, ("doc_id", "n_shingles", "component_id")),
    "op10_superkmer_dedup": (brute.op10, ("doc_id", "n_words", "n_removed", "kept_sha256")),
}


@pytest.mark.parametrize("blocks", [5, 50])
@pytest.mark.parametrize("name", PLAIN)
def test_any_number_of_blocks(spark, tmp_path, monkeypatch, name, blocks):
    monkeypatch.setattr(B, "block_count", lambda docs: blocks)
    plain, columns = PLAIN[name]
    assert rows(Q.QUERIES[name](spark, corpus.write(tmp_path, DOCS)), *columns) == sorted(plain(DOCS))


@pytest.mark.parametrize("name", PLAIN)
def test_tasks_with_several_blocks(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(B, "block_count", lambda docs: 40)
    monkeypatch.setattr(B, "PARTITIONS", 3)
    plain, columns = PLAIN[name]
    assert rows(Q.QUERIES[name](spark, corpus.write(tmp_path, DOCS)), *columns) == sorted(plain(DOCS))


def test_rows_without_text_fill_blocks(spark):
    assert B.block_count(spark.range(1_000_000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")) == 16
    assert B.block_count(spark.range(0).selectExpr("id AS doc_id", "'' AS text")) == 1


def twins(n: int) -> tuple[str, str]:
    """A word of n letters and another: the Thue-Morse word and its complement, which collide modulo 2**64 at any odd base."""
    bits = [k.bit_count() % 2 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_twins(spark, tmp_path, n):
    one, two = twins(n)
    tail = " ".join(f"w{k}" for k in range(12))
    docs = [(1, one), (2, two), (3, f"{one} {tail}"), (4, f"{two} {tail}"), (5, f"{tail} {one}"), (6, f"{tail} {two}"), (7, f"{one} a b c d"), (8, f"{two} a b c d")]
    items = [(1, f"{two} {tail}"), (2, two), (3, f"{two} unseen")]
    folder = corpus.write(tmp_path, docs, benchmark=items)
    for name, (plain, columns) in PLAIN.items():
        assert rows(Q.QUERIES[name](spark, folder), *columns) == sorted(plain(docs)), name
    assert rows(Q.op2_decontamination(spark, folder), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.op2(docs, items))


def test_messages_are_no_more_than_strings():
    form = B.Form(0, a="i8", words="[u1]")
    raw, offs = np.frombuffer(b"onetwothreefour", np.uint8), np.array([0, 3, 6, 11, 15])
    bucket = np.array([1, 1, 4, 900_000])
    sent = list(B.mail(form, bucket, {"a": np.arange(4), "words": (raw, offs)}))
    assert [b for b, _ in sent] == [1, 4, 900_000] and all(len(x) < 48 for _, x in sent)


@pytest.mark.parametrize("length", [3, 5000])
def test_messages_come_back(length):
    import pyarrow as pa

    form = B.Form(3, a="u8", words="[u1]", n="u1")
    raw = np.frombuffer(("word" * length).encode(), np.uint8)
    offs = np.array([0, 0, 4, len(raw)])
    columns = {"a": np.array([5, 2**63, 7], np.uint64), "words": (raw, offs), "n": np.array([1, 2, 255])}
    got = [(block, pa.py_buffer(form.pack(10 * block, lo, hi, columns))) for block, lo, hi in ((0, 0, 1), (1, 1, 3))]
    (found,) = B.letters(got, form)
    assert found["a"].tolist() == columns["a"].tolist() and found["n"].tolist() == [1, 2, 255] and found.at.tolist() == [0, 10, 11]
    assert found["words"][0].tobytes() == raw.tobytes() and found["words"][1].tolist() == offs.tolist()
    assert [(b, own.tolist()) for b, own in found.by_sender(np.array([0, 2]))] == [(0, [0]), (1, [2])]


def test_hashes_of_stretches():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 4, 5000).astype(np.uint8)
    for points in T.POINTS:
        roll = T.Rolling(raw, points)
        start = rng.integers(0, 4900, 2000)
        end = start + rng.integers(0, 12, 2000)
        name = roll.stretches(start, end)
        text = [raw[a:b].tobytes() for a, b in zip(start, end)]
        assert len({(x, y) for x, y in zip(text, name.tolist())}) == len(set(text)) == len(set(name.tolist()))


def test_a_tokenizer_of_another_kind_is_refused(tmp_path, spark):
    import json
    from pathlib import Path

    from lanewise.llm import bpe as module

    whole = json.loads(Path(Q.TOKENIZER).read_text())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "ab", "id": 1}, {"content": "bc", "id": 2}]}, {"added_tokens": [{"content": "ab", "id": 1, "lstrip": True}]}):
        with pytest.raises(ValueError):
            module.checked(whole | change)


def test_a_block_is_the_same_in_any_order_of_its_payloads():
    import pyarrow as pa

    docs = [(3, "c"), (None, "b"), (1, "z"), (1, "a"), (2, None), (None, None)]
    payloads = [B.dumps(pa.table({"doc_id": pa.array([i], pa.int64()), "text": pa.array([t], pa.string()), "c2": pa.array([f"{i} {t}"])})) for i, t in docs]
    rng = np.random.default_rng(2)
    seen = set()
    for _ in range(20):
        table = pa.table({"payload": pa.array([payloads[k] for k in rng.permutation(len(docs))], pa.binary())})
        ids, text = B.unpack(table)
        found = tuple(zip(ids.to_pylist(), text.to_pylist()))
        assert tuple(B.restored(table, ["doc_id", "text", "more"]).column("more").to_pylist()) == tuple(f"{i} {t}" for i, t in found)
        seen.add(found)
    assert len(seen) == 1 and sorted(seen.pop(), key=str) == sorted(docs, key=str)
