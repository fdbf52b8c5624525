"""Substring dedup of word sequences by super-k-mer partitioning (operator 10).

A window is `window` consecutive words. Its minimiser is the least hash among its m-word grams; consecutive
windows with the same minimiser form a super-k-mer, which travels once, as one packed string, to the bucket of
that minimiser. Equal windows have equal minimisers, so a bucket sees all occurrences of its windows; it sorts them
and finds for each the least doc_id in which it starts. Equal super-k-mers of a block travel once, with their least
doc_id, so thousands of copies cost a bucket one string a block. Strings are told apart by their bytes, and windows
with equal hashes are compared byte by byte.

Minimisers with more bytes than HEAVY in all documents (a frequent gram, the edges of a passage that very many share)
are counted out first. Their windows are dealt one by one, by 128-bit hashes of the whole window with the least doc_id
of the block, so no minimiser's bytes outgrow a task.

Cases: null text has no words; an empty text or one of fewer words than a window loses nothing; rows with the same
doc_id are not smaller than each other; a null doc_id counts as larger than every other; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _blocks as B
from . import _text as T

WINDOW, GRAM, LONGEST = 13, 3, 64
#: Most bytes of one minimiser's super-k-mers in a bucket.
HEAVY = 2 << 20


#: What travels: super-k-mers and heavy minimisers' windows to buckets; what these know of them back.
STRINGS, WINDOWS = B.Form(0, doc="i8", words="[u1]"), B.Form(1, a="u8", b="u8", doc="i8")
LEASTS, LEAST = B.Form(2, at="u4", least="[i8]"), B.Form(3, at="u4", least="i8")


class _Runs:
    """The super-k-mers of a block's documents; of tells which of the different ones (by their bytes) each is."""

    def __init__(self, table: pa.Table, window: int, gram: int, heavy: np.ndarray):
        self.ids, text = B.unpack(table)
        self.text = text
        self.raw, self.offs = T.strings(text)
        self.words = w = T.Words(self.raw, self.offs)
        self.key = B.ids(self.ids)
        self.word, self.size, low = _parted(w, window, gram)
        self.doc = self.key[np.searchsorted(w.first, self.word, "right") - 1]
        self.spaced, self.begin = T.spaced(self.raw, w)
        self.stop = self.word + self.size + window - 1
        self.first, self.of = T.distinct(*self.strings(slice(None)))
        self.least = np.full(len(self.first), B.NULL_ID)
        np.minimum.at(self.least, self.of, self.doc)
        self.bucket = T.mix(low[self.first] + T.U64(1))
        self.heavy = B.among(self.bucket, heavy)

    def strings(self, which: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Some super-k-mers' words with one space between, and their offsets."""
        start, stop = self.begin[self.word[which]], self.begin[self.stop[which]]
        return T.gathered(self.spaced, start, stop - 1 - start)


class _Windows:
    """The different windows of the heavy minimisers' super-k-mers in a block, each with its least doc_id."""

    def __init__(self, runs: _Runs, window: int):
        self.string = np.flatnonzero(runs.heavy)
        own = runs.first[self.string]
        self.size = runs.size[own]
        raw, offs = runs.strings(own)
        one, two = (T.Words(raw, offs, points=points) for points in T.POINTS)
        at = np.flatnonzero(one.whole(window))
        a, b = one.grams(window)[at], two.grams(window)[at]
        order, head, self.of = B.classes(a, b)
        self.a, self.b = a[order[head]], b[order[head]]
        doc = np.repeat(runs.least[self.string], self.size)
        self.least = np.minimum.reduceat(doc[order], head) if len(head) else doc


def _equal(raw: np.ndarray, words: T.Words, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows from words a and b on are the same bytes. Pairs that go on one another are compared together."""
    start, end = words.start, words.end

    def same(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        size = end[a1 + window - 1] - start[a0]
        out = size == end[b1 + window - 1] - start[b0]
        out[out] = T.alike(raw, start[a0[out]], start[b0[out]], size[out])
        return out

    if not len(a):
        return np.empty(0, bool)
    order = np.lexsort((a, b - a))
    x, y = a[order], b[order]
    head = np.flatnonzero(np.append(True, (np.diff(x) != 1) | (np.diff(y) != 1)))
    tail = np.append(head[1:], len(x)) - 1
    ok = np.repeat(same(x[head], x[tail], y[head], y[tail]), tail + 1 - head)
    odd = np.flatnonzero(~ok)  # one of a run's windows differs, or more: each on its own
    ok[odd] = same(x[odd], x[odd], y[odd], y[odd])
    out = np.empty(len(a), bool)
    out[order] = ok
    return out


def _by_bytes(raw: np.ndarray, words: T.Words, valid: np.ndarray, hashes: np.ndarray, order: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """order, sorted by hash and bytes, and the places in it whose window is the next one's as well."""
    size = words.end[valid + window - 1] - words.start[valid]
    _, name = T.distinct(*T.gathered(raw, words.start[valid], size))
    order = np.lexsort((name, hashes))
    return order, np.flatnonzero((name[order][1:] == name[order][:-1]))


def _parted(w: T.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and least hash of each super-k-mer."""
    valid = np.flatnonzero(w.whole(window))
    lows = T.sliding_min(w.grams(gram), window - gram + 1)
    low = lows[valid] if len(valid) else np.empty(0, T.U64)
    new = np.ones(len(valid), bool)
    new[1:] = (valid[1:] != valid[:-1] + 1) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    # a run of more than LONGEST windows is cut, which repeats no window
    since = np.arange(len(valid)) - np.repeat(at, np.diff(np.append(at, len(valid))))
    at = np.flatnonzero(new | (since % LONGEST == 0))
    return valid[at], np.diff(np.append(at, len(valid))), low[at]


def removed_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row; with texts, docs with the words removed instead.

    A text that loses nothing stays as it is, another becomes the kept words joined by spaces (perhaps none); n_chars,
    if there is such a column, is counted anew.
    """
    columns = docs.columns
    n = -(-4 * B.block_count(docs) // 3)  # blocks of 3 MiB: a word takes more of a task's memory here than elsewhere

    def weigh(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        raw, offs = T.strings(text)
        for lo, hi in T.pieces(offs):
            w = T.Words(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            word, size, low = _parted(w, window, gram)
            at = np.append(0, np.cumsum(w.end - w.start + 1))
            key = T.mix(low + T.U64(1))
            yield key, key, at[word + size + window - 1] - at[word]

    sent_heavy = docs.sparkSession.sparkContext.broadcast(B.heavy(docs, weigh, HEAVY))

    def place(runs: _Runs) -> tuple[np.ndarray, np.ndarray]:
        bucket = (runs.bucket % T.U64(n)).astype(np.int64)
        light = np.flatnonzero(~runs.heavy)
        return bucket, light[np.argsort(bucket[light], kind="stable")]

    def place_windows(each: _Windows) -> tuple[np.ndarray, np.ndarray]:
        bucket = (T.mix(each.a ^ each.b) % T.U64(n)).astype(np.int64)
        return bucket, np.argsort(bucket, kind="stable")

    def send(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        runs = _Runs(table, window, gram, sent_heavy.value)
        if runs.heavy.any():
            each = _Windows(runs, window)
            bucket, order = place_windows(each)
            yield from B.mail(WINDOWS, bucket[order], {"a": each.a[order], "b": each.b[order], "doc": each.least[order]})
            del each
        bucket, order = place(runs)
        yield from B.mail(STRINGS, bucket[order], {"doc": runs.least[order], "words": runs.strings(runs.first[order])})

    def solve(got: list[tuple[int, pa.Buffer]]) -> Iterator[tuple[int, bytes]]:
        strings, windows = B.letters(got, STRINGS, WINDOWS)
        got.clear()
        yield from solve_windows(windows)
        yield from solve_strings(strings)

    def solve_windows(got: B.Letters) -> Iterator[tuple[int, bytes]]:
        if not len(got):
            return
        order, head, of = B.classes(got["a"], got["b"])
        least = np.minimum.reduceat(got["doc"][order], head)[of]
        for block, own in got.by_sender(np.flatnonzero(least < got["doc"])):
            yield block, LEAST.pack(0, 0, len(own), {"at": got.at[own], "least": least[own]})

    def solve_strings(got: B.Letters) -> Iterator[tuple[int, bytes]]:
        if not len(got):
            return
        raw, doc = got["words"][0], got["doc"]
        words = T.Words(*got["words"])
        valid = np.flatnonzero(words.whole(window))
        string = np.searchsorted(words.first, valid, "right") - 1
        hashes = words.grams(window)[valid]
        order = np.argsort(hashes, kind="stable")
        same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
        equal = _equal(raw, words, valid[order[same]], valid[order[same + 1]], window)
        if not equal.all():  # equal hashes of different windows: these are sorted by their bytes
            order, same = _by_bytes(raw, words, valid, hashes, order, window)
            equal = np.ones(len(same), bool)
        new = np.ones(len(order), bool)
        new[same[equal] + 1] = False
        head = np.flatnonzero(new)
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[string][order], head), np.diff(np.append(head, len(order))))
        first = np.searchsorted(string, np.arange(len(got) + 1))
        for block, own in got.by_sender(np.unique(string[least < doc[string]])):
            yield block, LEASTS.pack(0, 0, len(own), {"at": got.at[own], "least": T.gathered(least, first[own], first[own + 1] - first[own])})

    def apply(table: pa.Table, answers: list[tuple[int, pa.Buffer]]) -> pa.Table:
        runs = _Runs(table, window, gram, sent_heavy.value)
        _, order = place(runs)
        size = runs.size[runs.first]
        offs = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offs[1:])
        least = np.repeat(runs.least, size)
        strings, windows = B.letters(answers, LEASTS, LEAST)
        if runs.heavy.any():
            each = _Windows(runs, window)
            _, to_window = place_windows(each)
            each.least[to_window[windows["at"]]] = windows["least"]
            least[np.repeat(runs.heavy, size)] = each.least[each.of]
            del each
        to, (low, cut) = order[strings["at"]], strings["least"]
        least[np.arange(len(low)) + np.repeat(offs[to] - cut[:-1], size[to])] = low
        low, at = T.gathered(least, offs[runs.of], runs.size)
        word = np.arange(len(low)) + np.repeat(runs.word - at[:-1], runs.size)
        gone = word[low < np.repeat(runs.doc, runs.size)]
        edge = np.zeros(len(runs.words) + window + 1, np.int32)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + window, -1)
        keep = np.cumsum(edge)[: len(runs.words)] == 0
        del low, at, word, gone, edge, least
        return B.restored(table, columns, text=_texts(runs, keep)) if texts else _digests(runs, keep)

    schema = B.schema_of(docs) if texts else "doc_id long, n_words long, n_removed long, kept_sha256 string"
    blocks = B.packed(docs, n, whole=texts)
    return B.settled(blocks, B.answered(B.sent(blocks, n, send), n, solve), apply, schema)


def _kept(runs: _Runs, keep: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """How many words each row keeps, and these joined by spaces."""
    kept, offs = T.gathered(runs.spaced, runs.begin[:-1][keep], np.diff(runs.begin)[keep])
    count = np.append(0, np.cumsum(keep))[runs.words.first]
    data, where = kept.tobytes(), offs[count]
    return np.diff(count), [data[a : max(a, b - 1)] for a, b in zip(where, where[1:])]


def _digests(runs: _Runs, keep: np.ndarray) -> pa.Table:
    left, texts = _kept(runs, keep)
    n = runs.words.counts
    return pa.table({"doc_id": runs.ids, "n_words": pa.array(n), "n_removed": pa.array(n - left), "kept_sha256": pa.array([T.sha256(x) for x in texts], pa.string())})


def _texts(runs: _Runs, keep: np.ndarray) -> pa.Array:
    left, texts = _kept(runs, keep)
    same = left == runs.words.counts
    return pa.array([a if ok else b.decode() for a, b, ok in zip(runs.text.to_pylist(), texts, same)], pa.string())
