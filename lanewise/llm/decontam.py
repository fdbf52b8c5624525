"""Benchmark decontamination by a prefix-filtered set join (operator 2).

A window of an item occurs in a document only if all its shingles do, so one necessary shingle finds it: the rarest,
counted over all documents. Documents are probed with those prefix shingles alone; a match gives the window's place
(positional bound), must leave room for the whole window in the document (length bound), and is then verified word
by word, by hashes and then by bytes. The benchmark is read in blocks of at most `block_bytes` of text; each block, and nothing that grows with
it or with the documents, is broadcast, and a larger benchmark takes more passes.

Cases: words are those of lower-cased text, digits, a-z and everything beyond ASCII; null or empty texts have no
words and hit nothing; an item of fewer words than a window is one window, one without words has none; items with a
null item_id are left out; an item_id in several rows counts once; repeated documents give a row each; of a text of any
length all words are probed; of equally rare shingles the first is the prefix; empty tables and further columns, whatever
their names, are fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

WINDOW, SHINGLE = 13, 3
#: Bytes of benchmark text of which the windows are broadcast at a time: some 40 times as much.
BLOCK_BYTES = 2 << 20
BATCH = 4 << 20


def words_of(raw: np.ndarray, offs: np.ndarray) -> T.Words:
    return T.Words(raw, offs, T.NON_ALNUM, lower=True)


class Lookup:
    """Positions of 64-bit keys among a small sorted set; a bit table turns most misses away."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.shift = T.U64(64 - 20)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a key stands in hashes, and which."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        ok = self.keys[key] == hashes[at]
        return at[ok], key[ok]


@dataclass
class Windows:
    """The different windows of some items."""

    hashes: np.ndarray  # a row of word hashes for each window, zeros after its length
    length: np.ndarray
    size: np.ndarray  # words in a shingle of this window
    word_size: np.ndarray  # bytes of each of its words, a row for each window
    bytes: tuple[np.ndarray, np.ndarray]  # of its words, one after another, and the windows' offsets
    names: list[str]  # of items, in order
    items: tuple[np.ndarray, np.ndarray]  # places of the names of each window's items, and the windows' offsets

    def shingles(self, shingle: int) -> np.ndarray:
        """Hashes, in the window's order; as many as length - size + 1 mean something."""
        out = np.zeros(self.hashes.shape, T.U64)
        for k in range(1, shingle + 1):
            own = self.size == k
            for j in range(self.hashes.shape[1] - k + 1):
                out[own, j] = T.gram_of(self.hashes[own, j : j + k])
        return out

    def items_of(self, window: int) -> list[str]:
        flat, offs = self.items
        return [self.names[i] for i in flat[offs[window] : offs[window + 1]]]


def windows_of(items: pa.Table, window: int, shingle: int) -> Windows:
    raw, offs = T.strings(items.column("text"))
    raw = T.LOWER[raw]
    words = words_of(raw, offs)
    names, name = np.unique(np.array(items.column("item_id").to_pylist(), object).astype(str), return_inverse=True)
    long = np.flatnonzero(words.whole(window))
    short = np.flatnonzero((words.counts > 0) & (words.counts < window))
    start = np.concatenate([long, words.first[short]])
    row = np.concatenate([np.searchsorted(words.first, long, "right") - 1, short])
    length = np.minimum(window, words.counts[row])
    at = np.minimum(start[:, None] + np.arange(window), max(len(words) - 1, 0))
    inside = np.arange(window) < length[:, None]
    word_size = np.where(inside, (words.end - words.start)[at], 0) if len(start) else np.zeros((0, window), np.int64)
    # windows are told apart by their words, which are joined by spaces
    spaced, begin = T.spaced(raw, words)
    _, of = T.distinct(*T.gathered(spaced, begin[start], begin[start + length] - begin[start])) if len(start) else (None, np.empty(0, np.int64))
    _, first = np.unique(of, return_index=True)
    flat = (at[first])[inside[first]]
    data, _ = T.gathered(raw, words.start[flat], (words.end - words.start)[flat]) if len(flat) else (raw[:0], None)
    pairs = np.unique(np.stack([of, name[row]], 1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
    return Windows(
        np.where(inside, words.hash[at], 0)[first].astype(T.U64) if len(start) else np.zeros((0, window), T.U64),
        length[first],
        np.minimum(length[first], shingle),
        word_size[first],
        (data, np.append(0, np.cumsum(word_size[first].sum(1)))),
        names.tolist(),
        (pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))),
    )


def _batches(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, T.Words]]:
    """Rows of batches, and the lower-cased bytes and words of their texts."""
    for batch in batches:
        raw, offs = T.strings(batch.column(text))
        for lo, hi in T.pieces(offs, BATCH):
            part = T.LOWER[raw[offs[lo] : offs[hi]]]
            yield batch.slice(lo, hi - lo), part, words_of(part, offs[lo : hi + 1] - offs[lo])


def shingle_counts(docs: DataFrame, lookups: dict[int, Lookup]) -> dict[int, np.ndarray]:
    """How often each shingle of the benchmark block starts in the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(len(x.keys), np.int64) for k, x in lookups.items()}
        for _, _, words in _batches(batches):
            for k, lookup in lookups.items():
                at, key = lookup.find(words.grams(k))
                sums[k] += np.bincount(key[words.whole(k)[at]], minlength=len(sums[k]))
        for k, x in sums.items():
            key = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key), pa.array(x[key])], ["size", "key", "n"])

    counts = {k: np.zeros(len(x.keys), np.int64) for k, x in lookups.items()}
    for r in docs.mapInArrow(T.lean(count), "size int, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n")).collect():
        counts[r.size][r.key] = r.n
    return counts


@dataclass
class Probe:
    """What is broadcast of a benchmark block: its windows, and by shingle size the prefix shingles and their windows."""

    windows: Windows
    place: np.ndarray  # of the prefix shingle in each window
    by_size: dict[int, tuple[Lookup, np.ndarray, np.ndarray]]

    def find(self, raw: np.ndarray, words: T.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words any window covers, and the items that have windows in each row."""
        hashes, length = self.windows.hashes, self.windows.length
        edge = np.zeros(len(words) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for k, (lookup, first, own) in self.by_size.items():
            at, key = lookup.find(words.grams(k))
            many = first[key + 1] - first[key]
            at = np.repeat(at, many)
            win = own[np.repeat(first[key] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())] if len(key) else key
            start = at - self.place[win]
            row = np.searchsorted(words.first, at, "right") - 1
            ok = (start >= words.first[row]) & (start + length[win] <= words.first[row + 1])
            win, start, row = win[ok], start[ok], row[ok]
            for j in range(hashes.shape[1]):
                ok = (j >= length[win]) | (words.hash[np.minimum(start + j, len(words) - 1)] == hashes[win, j])
                win, start, row = win[ok], start[ok], row[ok]
            ok = self._same(raw, words, start, win)
            win, start, row = win[ok], start[ok], row[ok]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length[win], -1)
            for r, w in zip(row.tolist(), win.tolist()):
                items.setdefault(r, set()).update(self.windows.items_of(w))
        return np.cumsum(edge)[: len(words)] > 0, items

    def _same(self, raw: np.ndarray, words: T.Words, start: np.ndarray, win: np.ndarray) -> np.ndarray:
        """Whether the words from each start on are those of the window, byte by byte."""
        out = np.ones(len(win), bool)
        data, offs = self.windows.bytes
        for lo in range(0, len(win), 1 << 14):
            w, first = win[lo : lo + (1 << 14)], start[lo : lo + (1 << 14)]
            length = self.windows.length[w]
            match = np.repeat(np.arange(len(w)), length)
            place = np.arange(len(match)) - np.repeat(np.append(0, np.cumsum(length)[:-1]), length)
            word = first[match] + place
            size = words.end[word] - words.start[word]
            ok = np.bincount(match[size != self.windows.word_size[w[match], place]], minlength=len(w)) == 0
            word, total = word[ok[match]], self.windows.word_size[w[ok]].sum(1)
            own, cut = T.gathered(raw, words.start[word], words.end[word] - words.start[word])
            theirs, _ = T.gathered(data, offs[w[ok]], total)
            differs = np.append(0, np.cumsum(own != theirs))
            at = np.append(0, np.cumsum(total))
            ok[ok] = differs[at[1:]] == differs[at[:-1]]
            out[lo : lo + (1 << 14)] = ok
        return out


def probe_of(docs: DataFrame, items: pa.Table, window: int, shingle: int) -> Probe:
    """A benchmark block's probe; each window's prefix is its shingle that is rarest in all documents."""
    wins = windows_of(items, window, shingle)
    n = len(wins.length)
    sizes = [int(k) for k in np.unique(wins.size)]
    shingles = wins.shingles(shingle)
    in_use = np.arange(window)[None, :] < (wins.length - wins.size + 1)[:, None]
    lookups = {k: Lookup(shingles[in_use & (wins.size == k)[:, None]]) for k in sizes}
    counts = shingle_counts(docs, lookups) if n else {}
    # the rarest shingle of each window, the first among equals
    place, prefix = np.zeros(n, np.int64), np.zeros(n, T.U64)
    by_size = {}
    for k in sizes:
        own = np.flatnonzero(wins.size == k)
        count = counts[k][np.minimum(np.searchsorted(lookups[k].keys, shingles[own]), len(lookups[k].keys) - 1)]
        place[own] = np.argmin(np.where(in_use[own], count, np.iinfo(np.int64).max), axis=1)
        prefix[own] = shingles[own, place[own]]
        own = own[np.argsort(prefix[own], kind="stable")]
        lookup = Lookup(prefix[own])
        by_size[k] = (lookup, np.append(np.searchsorted(prefix[own], lookup.keys), len(own)), own)
    return Probe(wins, place, by_size)


def hits(docs: DataFrame, items: pa.Table, window: int, shingle: int, key: str = "long") -> DataFrame:
    """doc_id, n_words, hit (packed bits of words), items: of each document against one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(probe_of(docs, items, window, shingle))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, words in _batches(batches):
            ids = batch.column(0)
            hit, own = sent.value.find(raw, words)
            rows = range(len(ids))
            bits = [np.packbits(hit[words.first[r] : words.first[r + 1]]).tobytes() if r in own else b"" for r in rows]
            yield pa.RecordBatch.from_arrays([ids, pa.array(words.counts), pa.array(bits, pa.binary()), pa.array([sorted(own.get(r, ())) for r in rows], pa.list_(pa.string()))], ["doc_id", "n_words", "hit", "items"])

    return docs.mapInArrow(T.lean(probe), f"doc_id {key}, n_words long, hit binary, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items, n = _items(benchmark, block_bytes)
    if n == 1:
        found = hits(docs, items.toArrow(), window, shingle)
    else:
        block, n = F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n)), 2 * n
        found = _merged(docs, [items.where(block == k) for k in range(n)], window, shingle)
    return found.mapInArrow(T.lean(_digest), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _items(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The items that count, and the blocks that they fill."""
    items = benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    return items, max(1, -(-size // block_bytes))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items, n = _items(benchmark, block_bytes)
    if n > 1:
        name = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        bad = contamination(own.select(name.alias("doc_id"), "text"), benchmark, window, shingle, block_bytes).where("contaminated")
        bad = bad.select("doc_id").distinct()
        return docs.alias("own").join(bad.alias("bad"), F.xxhash64(F.col("own.doc_id").cast("long"), F.col("own.text").cast("string")) == F.col("bad.doc_id"), "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(probe_of(own, items.toArrow(), window, shingle))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, words in _batches(batches, at):
            hit = np.diff(np.append(0, np.cumsum(sent.value.find(raw, words)[0]))[words.first])
            yield batch.filter(pa.array(~contaminated(hit, words.counts)))

    return docs.mapInArrow(T.lean(keep), docs.schema)


def contaminated(hit: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (hit > 0) & (20 * hit >= words)


def _merged(docs: DataFrame, blocks: list[DataFrame], window: int, shingle: int) -> DataFrame:
    """The hits of all blocks: bits and items of a (doc_id, text) are united, and equal rows stay as many."""
    passes = None
    keyed = docs.select(F.struct("doc_id", F.xxhash64("doc_id", "text").alias("row")).alias("doc_id"), "text")
    for k, block in enumerate(blocks):
        one = hits(keyed, block.toArrow(), window, shingle, "struct<doc_id: long, row: long>").withColumn("pass", F.lit(k))
        passes = one if passes is None else passes.unionAll(one)

    def unite(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bits, items = 0, set()
        for x, names in zip(table.column("hit").to_pylist(), table.column("items").to_pylist()):
            bits |= int.from_bytes(x, "big") << 8 * (-(-table.column("n_words")[0].as_py() // 8) - len(x))
            items.update(names)
        n = int((table.column("pass").to_numpy() == 0).sum())
        words = table.column("n_words")[0].as_py()
        ids = [x["doc_id"] for x in table.column("doc_id").slice(0, 1).to_pylist()] * n
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([words] * n, pa.int64()), "hit": pa.array([bits.to_bytes(-(-words // 8), "big")] * n, pa.binary()), "items": pa.array([sorted(items)] * n, pa.list_(pa.string()))})

    return passes.groupBy(F.col("doc_id.doc_id").alias("own_id"), F.col("doc_id.row").alias("own_row")).applyInArrow(unite, "doc_id long, n_words long, hit binary, items array<string>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(1).to_numpy()
        hit = np.array([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8)).sum() for x in batch.column(2)], np.int64)
        items = batch.column(3).to_pylist()
        shas = [T.sha256(",".join(x).encode()) for x in items]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(shas, pa.string()), pa.array(contaminated(hit, words), pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
