"""Quality scores from supervised subword embeddings (operator 7).

A document is the average of the learned vectors of its hashed features, all of case-folded text: words, pairs of
neighbouring words, n-grams of GRAM characters (code points), and a constant. A pair's hash is the exclusive or of its
words' hashes, whatever their order; so a word beside itself is the same pair for all words. A softmax layer over the average gives the probabilities of
labels 0 and 1. Vectors and layer are trained by stochastic gradient descent in numpy, in one task, on about `sample`
labelled documents, chosen by hash of doc_id for each label, at most KINDS different features of each. For scoring, the layer
is multiplied into the vectors, which leaves one number for each feature.

Cases: null and empty texts have the constant alone and get its score; without labels every score is 0.5; repeated
rows give a row each; a doc_id labelled more than once counts with its largest label; a null doc_id is not held out;
a text of any length is averaged whole, by one task; equal texts have equal scores; empty tables give empty results;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._learn import held_out, labelled

FOLDS, FOLD, THRESHOLD = 4, 2, 0.7
SAMPLE, KINDS = 6_000, 5_000
WORDS, PAIRS, GRAMS, GRAM = 1 << 14, 1 << 14, 1 << 15, 3
CONSTANT, FIRST_WORD = 0, 1
FEATURES = FIRST_WORD + WORDS + PAIRS + GRAMS
DIMENSIONS, EPOCHS, RATE, SEED = 8, 8, 0.5, 7


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes >> T.U64(65 - slots.bit_length())).astype(np.int64)


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of case-folded texts, and their offsets."""
    return T.strings(pc.utf8_lower(column))


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All features of some rows and each one's row."""
    n = len(offs) - 1
    words = T.Words(raw, offs)
    own, pair = words.rows(), np.flatnonzero(words.whole(2))
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(T.U64)
    at = np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), offs)
    row = np.repeat(np.arange(n), np.diff(at))
    k = max(len(points) - GRAM + 1, 0)
    gram = np.zeros(k, T.U64)
    for j in range(GRAM):
        gram = (gram << T.U64(21)) | points[j : j + k]
    inside = row[:k] == row[GRAM - 1 :] if k else np.empty(0, bool)
    found = [np.full(n, CONSTANT), FIRST_WORD + _slot(words.hash, WORDS), FIRST_WORD + WORDS + _slot(T.mix(words.hash[pair] ^ words.hash[pair + 1]), PAIRS), FIRST_WORD + WORDS + PAIRS + _slot(T.mix(gram[inside]), GRAMS)]
    return np.concatenate(found), np.concatenate([np.arange(n), own, own[pair], row[:k][inside]])


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> np.ndarray:
    """For each feature its contribution to label 1's log-odds. docs: different features and how often each."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / dimensions, (FEATURES, dimensions))
    layer = np.zeros((dimensions, 2))
    share = [count[:, None] / count.sum() for _, count in docs]
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            step = rate * (1 - done / steps)
            done += 1
            rows = docs[i][0]
            mean = (vectors[rows] * share[i]).sum(0)
            logits = mean @ layer
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = layer @ error
            layer -= step * np.outer(mean, error)
            # a feature moves by its share, scaled up so that rare ones learn as well
            vectors[rows] -= step * np.sqrt(share[i]) * back
    return vectors @ (layer[:, 1] - layer[:, 0])


def learned(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The contributions of all features, trained by one task on the bounded sample, and what is added to their mean."""
    chosen, offset = labelled(docs, labels, "quality", FOLDS, FOLD, n)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = folded(batch.column("text"))
            for lo, hi in T.pieces(offs):
                found, row = features(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                key, count = np.unique(row * FEATURES + found, return_counts=True)
                # of a document with more than KINDS features, those with the least hashes
                order = np.lexsort((T.mix((key % FEATURES).astype(T.U64)), key // FEATURES))
                first = np.searchsorted(key[order] // FEATURES, np.arange(hi - lo))
                keep = np.sort(order[np.arange(len(key)) - first[key[order] // FEATURES] < KINDS])
                key, count = key[keep], count[keep]
                cut = pa.array(np.searchsorted(key, np.arange(hi - lo + 1) * FEATURES).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), *(pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (key % FEATURES, count))], ["doc_id", "label", "found", "count"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        rows = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("found", kind), ("count", kind)])).sort_by("doc_id").combine_chunks()
        if rows.num_rows:
            docs_ = [(a.values.to_numpy(), b.values.to_numpy().astype(np.float64)) for a, b in zip(rows.column("found"), rows.column("count"))]
            table = train(docs_, (rows.column("label").to_numpy() > 0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([table.astype("<f8").tobytes()], pa.binary())], ["weights"])

    parts = chosen.select("doc_id", "label", "text").mapInArrow(T.lean(gather), "doc_id long, label int, found array<int>, count array<int>")
    found = next(iter(parts.repartition(1).mapInArrow(T.lean(fit), "weights binary").collect()), None)
    return (np.zeros(FEATURES), 0.0) if found is None else (np.frombuffer(found.weights, "<f8"), offset)


def scored(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, n))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held_out(FOLDS, FOLD))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offset = sent.value
        for batch in batches:
            raw, offs = folded(batch.column("text"))
            odds = []
            for lo, hi in T.pieces(offs):
                found, row = features(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                odds.append(np.bincount(row, weights[found], hi - lo) / np.bincount(row, minlength=hi - lo) + offset)
            p = 1 / (1 + np.exp(-np.concatenate(odds))) if odds else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts.mapInArrow(T.lean(score), "doc_id long, held_out boolean, score double, predicted int")
