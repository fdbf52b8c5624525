"""Language identification with language-bitmask n-gram filters (operator 5).

One bit-sliced Bloom filter holds the n-grams of all languages: each of its slots has a bit for every language, in as
many 64-bit words as they need, and the bitwise and of an n-gram's slots is the set of languages that have it. A text's n-grams are looked up, each
language's bits are counted, the count is corrected by that language's false-positive rate (its share of set slots,
to the power of the number of hashes), and the largest share of the n-grams decides.

N-grams are GRAM bytes of lower-cased text with non-letters as spaces, at most a word each. A language has an n-gram
if at least two of its sampled documents do (one, of a language with fewer than FEW documents), at no less than KEEP times
the rate of the language where it is most common. Learning reads about `sample` documents, chosen by hash for each
language, rare ones at a higher rate; the filter's size follows from their n-grams.

Cases: null text or text without a letter is `und` with score 0; a text with letters but no n-gram, or none known,
gets the most frequent learned language with score 0; without anything learned, as in an empty table, all are `und`;
ties go to the language first in order; a text of any length is looked up whole, by one task; a null doc_id is not held
out and not learned from; repeated rows give a row each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._learn import RARE, drawn, held_out, remainder

FOLDS, FOLD = 4, 2
GRAM, HASHES, KEEP = 4, 3, 0.2
SAMPLE = 20_000
#: Slots for each n-gram, and most slots.
ROOM, SLOTS = 12, 1 << 24
#: Sampled documents up to which a language is learned from single ones.
FEW = 8
WORD = 64  # languages in a word of a mask

LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some rows, packed, and each one's row."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs))
    text = np.full(len(raw) + n + 1, 0x20, np.uint8)
    at = np.arange(len(raw)) + row + 1
    text[at] = LETTERS[raw]
    rows = np.zeros(len(text), np.int32)
    rows[at] = row
    rows[offs[1:] + np.arange(n) + 1] = np.arange(n)
    wide = text.astype(np.uint64)
    if len(text) < GRAM:
        return np.empty(0, T.U64), np.empty(0, np.int32)
    packed = wide[: len(text) - GRAM + 1].copy()
    inner = np.ones(len(packed), bool)
    for j in range(1, GRAM):
        packed |= wide[j : j + len(packed)] << T.U64(8 * j)
        if j < GRAM - 1:
            inner &= text[j : j + len(packed)] != 0x20
    return packed[inner], rows[1 : len(packed) + 1][inner]


class Filter:
    """The bit-sliced Bloom filter of some languages' n-grams."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], usual: int):
        self.languages, self.usual = languages, usual
        most = max([len(x) for x in grams], default=1)
        slots = 1 << min(SLOTS.bit_length() - 1, max(10, (ROOM * most).bit_length()))
        kind = np.min_scalar_type((1 << min(len(languages), WORD)) - 1)
        self.masks = np.zeros((-(-len(languages) // WORD), slots), kind)
        for i, own in enumerate(grams):
            for slot in self._slots(own):
                self.masks[i // WORD, slot] |= kind.type(1 << i % WORD)
        self.false = [float(np.mean(self._bit(self.masks[i // WORD], i))) ** HASHES for i in range(len(languages))]

    @staticmethod
    def _bit(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks >> masks.dtype.type(i % WORD)) & masks.dtype.type(1)

    def _slots(self, packed: np.ndarray) -> Iterator[np.ndarray]:
        h = T.mix(packed)
        for k in range(HASHES):
            yield (T.mix(h + T.U64(k)) & T.U64(self.masks.shape[1] - 1)).astype(np.int64)

    def having(self, packed: np.ndarray) -> np.ndarray:
        """Masks of the languages that have each n-gram, or seem to: a row of them for each WORD languages."""
        first, *others = self._slots(packed)
        out = self.masks[:, first]
        for slot in others:
            out &= self.masks[:, slot]
        return out

    def predict(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the likeliest language of each row, and its share among all."""
        packed, row = grams(raw, offs)
        rows = len(offs) - 1
        masks = self.having(packed)
        n = np.maximum(np.bincount(row, minlength=rows), 1)
        shares = np.zeros((rows, len(self.languages)))
        for i, false in enumerate(self.false):
            hits = np.bincount(row, self._bit(masks[i // WORD], i), rows)
            shares[:, i] = np.maximum((hits / n - false) / max(1 - false, 1e-9), 0)
        best, total = shares.argmax(1), shares.sum(1)
        best[total == 0] = self.usual
        return best, np.where(total > 0, shares.max(1) / np.maximum(total, 1e-12), 0.0)


def learned(docs: DataFrame, n: int = SAMPLE) -> Filter | None:
    """The filter of the languages of docs (doc_id, text, lang) outside the held-out fold."""
    known = docs.where((remainder(FOLDS) != FOLD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n_known"))
    total, many = counts.agg(F.sum("n_known"), F.count("*")).first()
    if not many:
        return None
    share = F.greatest(F.lit(n / total), F.lit(n * RARE / many) / F.col("n_known"))
    # documents of languages with few of them count twice, and so for two
    kinds = counts.select("lang", share.alias("share"), F.when(F.col("n_known") < FEW, 2).otherwise(1).alias("times"))
    chosen = known.join(kinds, "lang").where(drawn(F.col("share"), "doc_id", "text")).select("doc_id", "text", "lang", "times").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = T.strings(batch.column("text"))
            names = pc.dictionary_encode(batch.column("lang"))
            lang, times = names.indices.to_numpy(), batch.column("times").to_numpy()
            for lo, hi in T.pieces(offs):
                packed, row = grams(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                both = np.unique(packed | (row.astype(T.U64) << T.U64(8 * GRAM)))
                key, own = both & T.U64((1 << 8 * GRAM) - 1), lang[lo:hi][(both >> T.U64(8 * GRAM)).astype(np.int64)]
                for k in np.unique(lang[lo:hi]):
                    twice = int(times[lang == k][0])
                    found, many = np.unique(key[own == k], return_counts=True)
                    many, docs_of = many * twice, int((lang[lo:hi] == k).sum()) * twice
                    yield pa.RecordBatch.from_arrays([pa.array([names.dictionary[int(k)].as_py()] * (len(found) + 1), pa.string()), pa.array(np.append(found.astype(np.int64), -1)), pa.array(np.append(many, docs_of).astype(np.int64))], ["lang", "gram", "n"])

    counts = chosen.mapInArrow(T.lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n >= 2 or gram = -1").toArrow()
    lang, gram, n_docs = counts.column("lang").to_pylist(), counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    languages = sorted(set(lang))
    place = {x: i for i, x in enumerate(languages)}
    which = np.array([place[x] for x in lang])
    totals = np.zeros(len(languages))
    totals[which[gram == -1]] = n_docs[gram == -1]
    rate = n_docs / totals[which]
    keys, of = np.unique(gram, return_inverse=True)
    best = np.zeros(len(keys))
    np.maximum.at(best, of, rate)
    keep = (rate >= KEEP * best[of]) & (gram >= 0)
    return Filter(languages, [gram[keep & (which == i)].astype(T.U64) for i in range(len(languages))], int(totals.argmax()))


def identified(docs: DataFrame, n: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, n))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            text = batch.column("text")
            raw, offs = T.strings(text)
            letter = pc.match_substring_regex(text, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            found, score = [], []
            for lo, hi in T.pieces(offs):
                if model is None:
                    break
                best, share = model.predict(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                found += [model.languages[i] for i in best]
                score.append(share)
            score = np.concatenate(score) if score else np.zeros(len(text))
            names = [x if ok else "und" for x, ok in zip(found, letter)] if found else ["und"] * len(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "text").mapInArrow(T.lean(predict), "doc_id long, held_out boolean, lang_pred string, score double")
