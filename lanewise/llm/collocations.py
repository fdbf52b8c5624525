"""Phrase collocation mining (operator 12): frequent phrases by passes with hashed pruning, scored by their weakest cut.

Pass k over the texts counts phrases of k words. What is counted was pruned before, in the ways of PCY and DHP:
each pass also adds up, in a fixed number of hash buckets, how many phrases of k + 1 words there are; a phrase whose
bucket stays below the least count can't be frequent, so only a bitmap of buckets is broadcast to the next pass. And as
all parts of a frequent phrase are frequent (Apriori), both its halves of k words must be marked in a second bitmap,
of the phrases that the pass found frequent. Both bitmaps have a fixed size (BUCKETS and MARKS bits) whatever the input; where they
fill up, they prune less, and nothing else changes. What passes is counted exactly, by its bytes, so neither bitmap can
lose a phrase or change a count. Buckets of phrases are only counted where both halves passed this pass's own pruning.

A task adds counts up before it sends them: a phrase or bucket that every document has costs one row for each task.

Scores are exact: products in 38-digit decimals, which hold 1000 * a * n for any counts below 10**17.

Cases: null and empty texts have no words; a null language is "und". Repeated rows count each time. Very long texts are
read in whole, in one task. Equal scores are ordered by count and then by the phrase's bytes. An empty table gives an empty result.
Other columns of the input are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._graph import checkpointed

LONGEST, LEAST, TOP, COVERED = 5, 100, 2000, 100
#: Buckets of phrases to come, and bits that mark the frequent phrases of a pass; powers of two.
BUCKETS, MARKS = 1 << 22, 1 << 24
#: Buckets in a row of counts, and rows of counted phrases that a task holds before it adds them up.
SEGMENT, HELD = 1 << 12, 200_000
#: Parts of a language in which candidates are ranked before the rest of it.
PARTS = 128
PUNCTUATION, SEPARATORS = np.zeros(256, bool), np.zeros(256, bool)
PUNCTUATION[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATORS[[0x20, 0x09]] = True
SEPARATORS |= PUNCTUATION
NONE = "und"
FOUND = "lang string, phrase string, n long, segment int, payload binary"
NAMES = ["lang", "phrase", "n", "segment", "payload"]
COUNTED = pa.schema([("lang", pa.large_string()), ("phrase", pa.large_binary()), ("n", pa.int64())])


class Bits:
    """A bitmap of a power of two of bits, each by its number."""

    def __init__(self, data: np.ndarray, size: int):
        self.data, self.size = data, size

    def has(self, at: np.ndarray) -> np.ndarray:
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def __bool__(self) -> bool:
        return bool(self.data.any())


def _places(h: np.ndarray, size: int, turn: int = 0) -> np.ndarray:
    return ((h >> T.U64(7 + 24 * turn)) & T.U64(size - 1)).astype(np.int64)


class Phrases:
    """Words of some lower-cased texts, numbered by their bytes, and phrases by the number of the word they begin with."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, language: np.ndarray):
        """language: a hash for each text."""
        start, end, first = T.spans(raw, offs, SEPARATORS)
        self.bytes, self.offs = T.gathered(raw, start, end - start)
        self.first, self.id = T.distinct(self.bytes, self.offs)
        own, cut = T.gathered(self.bytes, self.offs[self.first], (self.offs[1:] - self.offs[:-1])[self.first])
        self.hash = T.names(own, cut)[self.id]
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        self.salt = language[self.row]
        # a piece ends with a punctuation mark or with its text
        marks = np.append(0, np.cumsum(PUNCTUATION[raw], dtype=np.int64))[start] if len(start) else start
        self.joined = (marks[1:] == marks[:-1]) & (self.row[1:] == self.row[:-1])

    def __len__(self) -> int:
        return len(self.id)

    def whole(self, k: int) -> np.ndarray:
        """Whether k words of one piece begin at each word."""
        out = np.zeros(len(self), bool)
        n = len(self) - k + 1
        if n > 0:
            out[:n] = True
            for j in range(k - 1):
                out[:n] &= self.joined[j : n + j]
        return out

    def names(self, k: int) -> np.ndarray:
        return T.mix(T.grams(self.hash, k) ^ self.salt)

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each of these on, with a space between two."""
        word = (at[:, None] + np.arange(k)).ravel()
        blank = len(self.bytes)
        size = np.stack([self.offs[word + 1] - self.offs[word], np.ones(len(word), np.int64)], 1).ravel()
        size[2 * k - 1 :: 2 * k] = 0  # no space after the last word
        start = np.stack([self.offs[word], np.full(len(word), blank)], 1).ravel()
        out, cuts = T.gathered(np.append(self.bytes, np.uint8(0x20)), start, size)
        return T.string_array(out, cuts[:: 2 * k])


def _counts(texts: Phrases, at: np.ndarray, k: int, lang: np.ndarray, names: pa.Array) -> pa.Table:
    """How often each phrase of k words that begins at one of these occurs, by language; told apart by word numbers."""
    key = lang[texts.row[at]]
    for j in range(k):  # a number for each different pair of what was so far and the next word
        pair = key * np.int64(len(texts.first)) + texts.id[at + j]
        _, first, key = np.unique(pair, return_index=True, return_inverse=True)
    if not len(at):
        return COUNTED.empty_table()
    n = np.bincount(key)
    return pa.Table.from_arrays([names.take(pa.array(lang[texts.row[at[first]]])), texts.texts(at[first], k), pa.array(n.astype(np.int64))], schema=COUNTED)


def _added(parts: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
    return got.rename_columns({"n_sum": "n"}).select(["lang", "phrase", "n"]).cast(COUNTED)


def _count_rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.to_batches(max_chunksize=1 << 15):
        nothing = [pa.nulls(batch.num_rows, kind) for kind in (pa.int32(), pa.binary())]
        phrase = batch.column(1).cast(pa.large_string()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), phrase, batch.column(2), *nothing], NAMES)


def _segment_rows(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of SEGMENT values each, where any isn't 0."""
    size = min(SEGMENT, len(values))
    values = values.reshape(-1, size)
    for lo in range(0, len(values), 256):
        used = lo + np.flatnonzero(values[lo : lo + 256].any(1))
        data = [pa.compress(values[s].tobytes(), "zstd", asbytes=True) for s in used]
        nothing = [pa.nulls(len(used), kind) for kind in (pa.string(), pa.string(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(used, pa.int32()), pa.array(data, pa.binary())], NAMES)


def _kind(least: int) -> np.dtype:
    """A type that holds counts up to `least`: more than that needs not be told apart."""
    return np.min_scalar_type(least)


def _pass(docs: DataFrame, k: int, least: int, longest: int, buckets: int, marked: Bits | None, full: Bits | None) -> DataFrame:
    """Counts of the phrases of k words, a row for each task and phrase, and of the buckets of those of k + 1 words."""
    share = docs.sparkSession.sparkContext.broadcast
    shared = share((marked, full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, full = shared.value
        held, rows, sums = [], 0, np.zeros(buckets if k < longest else 0, np.uint32)
        for batch in batches:
            raw, offs = T.strings(batch.column("text"))
            coded = batch.column("lang").dictionary_encode()
            names, lang = coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy().astype(np.int64)
            salt = T.names(*T.strings(coded.dictionary))
            for lo, hi in T.pieces(offs):
                texts = Phrases(T.LOWER[raw[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], salt[lang[lo:hi]])
                if not len(texts):
                    continue
                good = texts.whole(k)
                if k > 1:
                    part = texts.whole(k - 1)
                    name = texts.names(k - 1)
                    for turn in (0, 1):
                        part &= marked.has(_places(name, marked.size, turn))
                    good[:-1] &= part[:-1] & part[1:]
                    good &= full.has(_places(texts.names(k), full.size))
                found = _counts(texts, np.flatnonzero(good), k, lang[lo:hi], names)
                held.append(found)
                rows += found.num_rows
                if rows > HELD:
                    held = [_added(held)]
                    rows = held[0].num_rows
                    if 2 * rows > HELD:
                        yield from _count_rows(held[0])
                        held, rows = [], 0
                if k < longest:
                    after = texts.whole(k + 1)
                    after[:-1] &= good[:-1] & good[1:]
                    sums += np.bincount(_places(texts.names(k + 1)[after], buckets), minlength=buckets).astype(np.uint32)
        if held:
            yield from _count_rows(_added(held))
        if k < longest:
            yield from _segment_rows(np.minimum(sums, least).astype(_kind(least)))

    return docs.mapInArrow(T.lean(run), FOUND)


def _bitmap(segments: DataFrame, size: int, most: int, kind: np.dtype) -> Bits:
    """The bits of those places whose values come to `most` or more. Rows of a segment are added up as they come, so a
    task holds its segments' sums alone, and the driver gets size / 8 bytes at most."""
    width = min(SEGMENT, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(pa.decompress(data.as_buffer(), width * kind.itemsize, "zstd"), kind)
                have = sums.get(segment)
                sums[segment] = np.minimum(own if have is None else have + own.astype(np.uint32), most).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(x >= most, bitorder="little").tobytes() for x in sums.values()], pa.binary())], ["segment", "payload"])

    n = max(1, min(size // width, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    got = segments.select("segment", "payload").repartition(n, "segment").mapInArrow(T.lean(run), "segment int, payload binary").toArrow()
    out = np.zeros((size // width, max(width // 8, 1)), np.uint8)
    for segment, data in zip(got.column(0).to_pylist(), got.column(1)):
        out[segment] = np.frombuffer(data.as_buffer(), np.uint8)
    return Bits(out.ravel(), size)


def _marks(frequent: DataFrame, k: int, size: int) -> Bits:
    """Two bits for each frequent phrase of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.uint8)
        for batch in batches:
            words = T.Words(*T.strings(batch.column("phrase")), ONLY_SPACE)
            name = T.mix(words.grams(k)[words.first[:-1]] ^ T.names(*T.strings(batch.column("lang")))) if batch.num_rows else np.empty(0, T.U64)
            for turn in (0, 1):
                seen[_places(name, size, turn)] = 1
        yield from _segment_rows(seen)

    return _bitmap(frequent.mapInArrow(T.lean(run), FOUND), size, 1, np.dtype(np.uint8))


ONLY_SPACE = np.zeros(256, bool)
ONLY_SPACE[0x20] = True


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS, marks: int = MARKS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size (words), n of all phrases of up to `longest` words that occur `least` times in a language; and
    lang, words: how many words each language has."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), F.col("text").cast("string").alias("text"))
    marked = full = words = None
    out = []
    for k in range(1, longest + 1):
        found = checkpointed(_pass(texts, k, least, longest, buckets, marked, full))
        counts = found.where("segment IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if k == 1:
            words = checkpointed(found.where("segment IS NULL").groupBy("lang").agg(F.sum("n").alias("words")))
        out.append(checkpointed(counts.where(F.col("n") >= least).select("lang", "phrase", F.lit(k).alias("size"), "n")))
        if k == longest:
            break
        full = _bitmap(found.where("segment IS NOT NULL"), buckets, least, _kind(least))
        marked = _marks(out[-1], k, marks)
        if not full or not marked:  # no longer phrase can be frequent
            break
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole, words


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(17,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, buckets: int = BUCKETS, marks: int = MARKS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words that occur `least`
    times, by their weakest cut; without those that a longer one contains and that occur in it `covered` of a hundred times."""
    phrases, words = frequent(docs, least, longest, buckets, marks)
    candidates = phrases.where("size > 1").withColumnRenamed("n", "a")
    # a phrase within a much longer one is also within one that is longer by a word and occurs at least as often
    split = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(split, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(split, F.lit(2), F.col("size") - 1), " ")))
    outer = candidates.where("size > 2").select("lang", inner.alias("phrase"), F.col("a").alias("outer")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = candidates.join(outer, ["lang", "phrase"], "left").where(f"outer IS NULL OR 100 * outer < {int(covered)} * a")
    # every cut of every candidate, with the counts of its parts
    parts = phrases.select("lang", "phrase", "n")
    cuts = kept.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(split, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(words.withColumnRenamed("words", "n"), "lang")
    cuts = cuts.withColumn("up", F.lit(1000).cast("decimal(4,0)") * (_wide("a") * _wide("n"))).withColumn("down", _wide("l") * _wide("r")).withColumn("score", F.expr("up div down"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # no task ranks a language: each of its parts keeps what may be among the first of all
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = worst.withColumn("own", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).where(F.col("own") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
