"""Document fingerprints by locally consistent parsing (operator 6).

A text's bytes are parsed into phrases, these into longer phrases, and so on. At each level runs of one name become
one name; deterministic coin tossing, repeated until few labels are left, gives each name a label that differs from
its neighbour's and depends on a few names before it alone; a phrase begins at each local maximum of the labels and
is named by a hash of its content. So equal stretches of text are parsed alike but for their ends, wherever they
stand. The fingerprint is the bottom-k sketch of the names at LEVELS (phrases of some 10 and 30 bytes), and the likeness of
two fingerprints estimates the Jaccard similarity of their name sets.

The edited text of a document needs the next one, in descending doc_id: documents are dealt into ranges by the
quantiles of doc_id (and by a hash of the text, where one doc_id or none fills several) and sorted; a copy of the first
document of the following range ends each.

Cases: null is an empty text, whose fingerprint is empty and like itself only; repeated doc_ids are ordered by a
hash of their texts; documents without doc_id come last, ordered likewise; a text of any length is parsed whole, by one task; the only document is its own next one; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from . import _text as T

LEVELS, SKETCH = (2, 3), 64
TOSSES = 4
#: Most ranges of doc_id: the driver holds their bounds.
RANGES = 1 << 16
U64 = T.U64


def _tossed(names: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Small labels, neighbours' different: twice the lowest bit in which a name differs from the one before, and that bit."""
    label = names
    for _ in range(TOSSES):
        before = np.empty_like(label)
        before[0], before[1:] = 0, label[:-1]
        before[edge] = ~label[edge]
        differs = label ^ before
        bit = np.bitwise_count((differs & (~differs + U64(1))) - U64(1)).astype(U64)
        label = (bit << U64(1)) | ((label >> np.minimum(bit, U64(63))) & U64(1))
    return label


def _parsed(names: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of each row and their offsets."""
    if not len(names):
        return names, offs
    edge = np.zeros(len(names) + 1, bool)
    edge[offs] = True
    new = edge[:-1].copy()
    new[1:] |= names[1:] != names[:-1]
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(names)))
    names = T.mix(names[head] + U64(0x2545F4914F6CDD1D) * run.astype(U64))
    offs = np.searchsorted(head, offs)
    first = np.zeros(len(names) + 1, bool)
    first[offs] = True
    label = _tossed(names, np.flatnonzero(first[:-1]))
    begin = first[:-1].copy()
    # a row's last name never begins a phrase, so that what follows in the batch makes no difference
    begin[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:-1]
    begin = np.flatnonzero(begin)
    whole = T.phrases(names, begin, np.append(begin[1:], len(names)))
    return whole, np.searchsorted(begin, offs)


def sketches(raw: np.ndarray, offs: np.ndarray, levels: tuple[int, ...] = LEVELS, size: int = SKETCH) -> np.ndarray:
    """A row for each text: the size smallest different 32-bit names in order, then 2**32 for each that is missing."""
    names, at, keys = raw.astype(U64), offs, []
    for level in range(1, max(levels) + 1):
        names, at = _parsed(names, at)
        if level in levels:
            row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
            keys.append((row.astype(U64) << U64(32)) | (T.mix(names + U64(level)) >> U64(32)))
    key = np.unique(np.concatenate(keys))
    row = (key >> U64(32)).astype(np.int64)
    rank = np.arange(len(key)) - np.searchsorted(row, row)
    out = np.full((len(offs) - 1, size), 1 << 32, U64)
    keep = rank < size
    out[row[keep], rank[keep]] = key[keep] & U64(0xFFFFFFFF)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row: the share of the smallest names of both that are in both; 1 for two empty ones."""
    size, top = a.shape[1], U64(1 << 32)
    both = np.sort(np.concatenate([a, b], 1), axis=1)
    real = both < top
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)
    union = np.minimum(rank[:, -1], size)
    shared = (again & (rank <= size)).sum(1)
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def text_of(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch[sketch < 1 << 32].astype("<u4").tobytes()).decode()


def _in_pieces(texts: list[str]) -> np.ndarray:
    raw, offs = T.strings(pa.array(texts, pa.string()))
    parts = [sketches(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in T.pieces(offs)]
    return np.concatenate(parts) if parts else np.empty((0, SKETCH), U64)


class _Ranges:
    """Ranges of (doc_id, hash of the text). A doc_id that fills several quantiles is split at equal steps of the hash,
    and so are the documents without one, which come first in ascending order."""

    def __init__(self, bounds: np.ndarray, missing: int):
        # equal steps of a hash are only in order for a doc_id that a float tells apart from others
        self.at, self.many = np.unique(bounds, return_counts=True)
        self.many = np.where(np.abs(self.at) < 1 << 53, self.many, 1)
        self.base, self.missing = np.append(0, np.cumsum(self.many)), missing

    def of(self, doc_id: pa.Array, h: np.ndarray) -> np.ndarray:
        step = (h.view(np.uint64) ^ np.uint64(1 << 63)).astype(np.float64) / 2.0**64  # 0 to 1, in the order of h
        own = doc_id.fill_null(0).to_numpy()
        last = np.searchsorted(self.at, own, "right")
        part = self.base[last]
        hit = np.flatnonzero((last > 0) & (self.at[np.maximum(last - 1, 0)] == own)) if len(self.at) else np.empty(0, np.int64)
        many = self.many[last[hit] - 1] if len(hit) else hit
        part[hit] += np.minimum((step[hit] * many).astype(np.int64), many - 1) - many + 1
        none = doc_id.is_null().to_numpy(zero_copy_only=False)
        return np.where(none, np.minimum((step * self.missing).astype(np.int64), self.missing - 1), part + self.missing).astype(np.int32)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = min(RANGES, B.block_count(docs))
    bounds = np.array(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else [], np.float64)
    total, missing = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first() if n > 1 else (1, 0)
    deal = _Ranges(bounds, max(1, round(n * missing / max(total, 1))))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deal.of(batch.column(0), batch.column(2).to_numpy()))], ["doc_id", "text", "h", "part"])

    d = F.coalesce("doc_id", F.lit(int(np.iinfo(np.int64).min))).alias("d")
    rows = docs.withColumn("h", F.xxhash64("text")).mapInArrow(T.lean(ranges), "doc_id long, text string, h long, part int").select("part", "doc_id", "text", d, "h")
    heads = rows.groupBy("part").agg(F.max(F.struct("d", "h")).alias("head")).select("part", "head.*").collect()
    if not heads:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    parts = sorted(r.part for r in heads)
    # the first row of a range also ends the range before it in descending order; the first of all ends the last
    ends = dict(zip(parts, parts[1:] + parts[:1]))
    found = docs.sparkSession.createDataFrame([(r.part, r.d, r.h, ends[r.part]) for r in heads], "part int, d long, h long, ends int")
    ghosts = rows.join(F.broadcast(found), ["part", "d", "h"]).dropDuplicates(["part"]).select(F.col("ends").alias("part"), "doc_id", "text", "d", "h", F.lit(True).alias("ghost"))
    dealt = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts).repartition(n, "part")
    in_order = dealt.sortWithinPartitions("part", "ghost", F.desc("d"), F.desc("h")).select("part", "ghost", "doc_id", "text")
    return in_order.mapInArrow(T.lean(_compared), SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        texts, ghost = whole.column("text").to_pylist(), whole.column("ghost").to_pylist()
        held = whole.slice(len(texts) - 1)
        ids = whole.column("doc_id")
        sketch = _in_pieces(texts)
        own = [i for i in range(len(texts) - 1) if not ghost[i]]
        for at in range(0, len(own), 1000):
            part = np.array(own[at : at + 1000], np.int64)
            edited = [edit(texts[i], texts[i + 1]) for i in part]
            other = _in_pieces(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(part)).combine_chunks(),
                    pa.array([len(texts[i]) for i in part], pa.int64()),
                    pa.array([T.sha256(x.encode()) for x in edited], pa.string()),
                    pa.array([text_of(sketch[i]) for i in part], pa.string()),
                    pa.array([text_of(x) for x in other], pa.string()),
                    pa.array(likeness(sketch[part], other)),
                    pa.array(likeness(sketch[part], sketch[part + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first, or by all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]
