"""Exact substring dedup of bytes with sharded suffix arrays (operator 1).

Equal stretches of `length` bytes have equal minimisers (the least hash among their `gram`-byte grams), so a shard of
the corpus's suffixes is what one minimiser bucket holds: each run of consecutive stretches with the same minimiser,
as one string. In a bucket, strings that only copy each other (byte by byte) are repeated as a whole. All others that
share a minimiser are joined, their suffix array is built by induced sorting, and the permuted common prefixes of
neighbours tell which stretches also start elsewhere. Equal strings of a block of documents travel once.

Minimisers with more different strings than one suffix array may hold (the edges of a passage that very many documents
share), or with very many copies, are counted out first. Their stretches are dealt one by one, by 128-bit hashes of the
whole stretch, and counted; equal stretches of a block travel once. So no minimiser's bytes outgrow a task.

Cases: null is an empty text; a text shorter than a stretch loses nothing; repeated rows and rows of one doc_id are
documents of their own; a text of any length is one document, all of whose stretches count, but is held by one task;
a null doc_id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _blocks as B
from . import _text as T
from ._suffix import repeated

LENGTH, GRAM = 200, 32
#: Most stretches in a run, and bytes of one suffix array.
LONGEST, SHARD_BYTES = 4096, 2 << 20
#: Most bytes of one minimiser's strings in a bucket, copies included, in suffix arrays' bytes.
COPIES = 16
#: What travels: strings and heavy minimisers' stretches to buckets; ranges and places of what is repeated back.
STRINGS, STRETCHES = B.Form(0, low="u8", flags="u1", bytes="[u1]"), B.Form(1, a="u8", b="u8", many="u1")
RANGES, PLACES = B.Form(2, at="u4", ranges="[i4]"), B.Form(3, at="u4")


class _Runs:
    """Runs of stretches with one minimiser in a block's documents."""

    def __init__(self, table: pa.Table, length: int, gram: int, heavy: np.ndarray):
        self.ids, text = B.unpack(table)
        self.raw, self.offs = T.strings(text)
        parts = [_part(self.raw, self.offs, lo, hi, length, gram) for lo, hi in T.pieces(self.offs)]
        self.start, self.size, low, self.inner = (np.concatenate(x) for x in zip(*parts)) if parts else [np.empty(0, k) for k in (np.int64, np.int64, T.U64, bool)]
        self.first, self.of = T.distinct(*T.gathered(self.raw, self.start, self.size + length - 1))
        self.many = np.bincount(self.of, minlength=len(self.first)) > 1
        self.low = low[self.first]
        self.heavy = B.among(self.low, heavy)


class _Stretches:
    """The different stretches of the heavy minimisers' strings in a block."""

    def __init__(self, runs: _Runs, length: int):
        self.string = np.flatnonzero(runs.heavy)
        own = runs.first[self.string]
        size = runs.size[own]
        raw, offs = T.gathered(runs.raw, runs.start[own], size + length - 1)
        keys = [_keys(raw[offs[a] : offs[b]], offs[a:b] - offs[a], size[a:b], length) for a, b in T.pieces(offs)]
        a, b = (np.concatenate(x) for x in zip(*keys)) if keys else (np.empty(0, T.U64), np.empty(0, T.U64))
        order, head, self.of = B.classes(a, b)
        self.a, self.b = a[order[head]], b[order[head]]
        copies = 1 + np.repeat(runs.many[self.string], size)
        self.many = np.add.reduceat(copies[order], head) > 1 if len(head) else np.empty(0, bool)
        self.offs = np.append(0, np.cumsum(size))

    def ranges(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The string of each range of stretches that are hit, and the ranges."""
        last = np.zeros(self.offs[-1] + 1, bool)
        last[self.offs] = True
        found = hit[self.of]
        at = np.arange(len(found))
        a = at[found & (~np.append(False, found[:-1]) | last[:-1])]
        b = at[found & (~np.append(found[1:], False) | last[1:])] + 1
        string = np.searchsorted(self.offs, a, "right") - 1
        return self.string[string], np.stack([a - self.offs[string], b - self.offs[string]], 1)


def _keys(raw: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each stretch of some strings: from each start, as many as its size."""
    at = np.arange(size.sum()) + np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size)
    one, two = (T.Rolling(raw, points).stretches(at, at + length) for points in T.POINTS)
    return one, two


def _part(raw: np.ndarray, offs: np.ndarray, lo: int, hi: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    base = offs[lo]
    raw, offs = raw[base : offs[hi]], offs[lo : hi + 1] - base
    hashes = T.byte_grams(raw, gram)
    lows = T.sliding_min(hashes, length - gram + 1) if len(raw) >= length else np.empty(0, T.U64)
    room = np.maximum(np.diff(offs) - length + 1, 0)
    valid = np.arange(room.sum()) + np.repeat(offs[:-1] - np.append(0, np.cumsum(room)[:-1]), room)
    low = lows[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (valid[1:] != valid[:-1] + 1) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    since = np.arange(len(valid)) - np.repeat(at, np.diff(np.append(at, len(valid))))
    at = np.flatnonzero(new | (since % LONGEST == 0))
    start, size, low = valid[at], np.diff(np.append(at, len(valid))), low[at]
    # a run in which the minimiser stands twice may repeat a stretch within itself
    inner = np.zeros(len(at), bool)
    if len(at):
        # only a gram that is the least of some stretch's can be one: the greatest minimiser of all stretches around it
        width = length - gram + 1
        around = np.zeros(len(lows) + 2 * (width - 1), T.U64)
        around[width - 1 : width - 1 + len(lows)] = lows
        spot = np.flatnonzero(hashes == ~T.sliding_min(~around, width))
        keys, name = np.unique(hashes[spot], return_inverse=True)
        spots = np.sort(name * len(raw) + spot)
        own = np.searchsorted(keys, low) * len(raw)
        inner = np.searchsorted(spots, own + start + size - 1 + length - gram, "right") - np.searchsorted(spots, own + start) > 1
    return start + base, size, low, inner


def removed_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    n, limit = B.block_count(docs), SHARD_BYTES

    def weigh(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        raw, offs = T.strings(text)
        for lo, hi in T.pieces(offs):
            start, size, low, _ = _part(raw, offs, lo, hi, length, gram)
            own = start - offs[lo]
            yield low, T.Rolling(raw[offs[lo] : offs[hi]]).stretches(own, own + size + length - 1), size + length - 1

    sent_heavy = docs.sparkSession.sparkContext.broadcast(B.heavy(docs, weigh, COPIES * limit, limit))

    def place(runs: _Runs) -> tuple[np.ndarray, np.ndarray]:
        bucket = (T.mix(runs.low + T.U64(1)) % T.U64(n)).astype(np.int64)
        light = np.flatnonzero(~runs.heavy)
        return bucket, light[np.argsort(bucket[light], kind="stable")]

    def place_stretches(each: _Stretches) -> tuple[np.ndarray, np.ndarray]:
        bucket = (T.mix(each.a ^ each.b) % T.U64(n)).astype(np.int64)
        return bucket, np.argsort(bucket, kind="stable")

    def send(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        runs = _Runs(table, length, gram, sent_heavy.value)
        if runs.heavy.any():
            each = _Stretches(runs, length)
            bucket, order = place_stretches(each)
            yield from B.mail(STRETCHES, bucket[order], {"a": each.a[order], "b": each.b[order], "many": each.many[order]})
            del each
        bucket, order = place(runs)
        own = runs.first[order]
        strings = T.gathered(runs.raw, runs.start[own], runs.size[own] + length - 1)
        yield from B.mail(STRINGS, bucket[order], {"low": runs.low[order], "flags": runs.many[order] + 2 * runs.inner[own].astype(np.uint8), "bytes": strings})

    def solve(got: list[tuple[int, pa.Buffer]]) -> Iterator[tuple[int, bytes]]:
        strings, stretches = B.letters(got, STRINGS, STRETCHES)
        got.clear()
        yield from solve_stretches(stretches)
        yield from solve_strings(strings)

    def solve_stretches(got: B.Letters) -> Iterator[tuple[int, bytes]]:
        if not len(got):
            return
        order, head, of = B.classes(got["a"], got["b"])
        many = got["many"] > 0
        copies = np.add.reduceat(1 + many[order], head) > 1
        for block, own in got.by_sender(np.flatnonzero(copies[of] & ~many)):
            yield block, PLACES.pack(0, 0, len(own), {"at": got.at[own]})

    def solve_strings(got: B.Letters) -> Iterator[tuple[int, bytes]]:
        if not len(got):
            return
        low, flags, (raw, offs) = got["low"], got["flags"], got["bytes"]
        size = np.diff(offs) - length + 1
        _, name = T.distinct(raw, offs)
        order = np.lexsort((name, low))
        new_low = np.append(True, low[order][1:] != low[order][:-1])
        new = new_low | np.append(True, name[order][1:] != name[order][:-1])
        head, of = np.flatnonzero(new), np.cumsum(new) - 1
        copies = np.add.reduceat(1 + (flags[order] & 1).astype(np.int64), head) > 1
        inner = np.maximum.reduceat(flags[order], head) > 1
        group = np.cumsum(new_low[head]) - 1
        alike = np.bincount(group)[group] > 1
        first = order[head]
        ranges: dict[int, np.ndarray] = {}
        hard = np.flatnonzero(alike | inner & ~copies)
        # a minimiser's strings stay together
        opens = np.flatnonzero(np.diff(group[hard], prepend=-1))
        shard = np.repeat((np.cumsum(np.diff(offs)[first[hard]]) // limit)[opens], np.diff(np.append(opens, len(hard))))
        for k in np.unique(shard):
            own = hard[shard == k]
            part, poffs = T.gathered(raw, offs[first[own]], np.diff(offs)[first[own]])
            found = repeated(part, poffs, length)
            edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            string = np.searchsorted(poffs, a, "right") - 1
            cut = np.searchsorted(string, np.arange(len(own) + 1))
            pairs = np.stack([a - poffs[string], b - poffs[string]], 1)
            ranges.update((int(u), pairs[cut[j] : cut[j + 1]]) for j, u in enumerate(own) if cut[j] < cut[j + 1])
        for u in np.flatnonzero(copies):
            ranges[int(u)] = np.array([[0, size[first[u]]]])
        hit = np.zeros(len(head), bool)
        hit[list(ranges)] = True
        rows = np.sort(order[hit[of]])
        to = np.empty(len(order), np.int64)
        to[order] = of
        for block, own in got.by_sender(rows):
            found = [ranges[int(u)].ravel() for u in to[own]]
            cut = np.append(0, np.cumsum([len(x) for x in found]))
            yield block, RANGES.pack(0, 0, len(own), {"at": got.at[own], "ranges": (np.concatenate(found), cut)})

    def apply(table: pa.Table, answers: list[tuple[int, pa.Buffer]]) -> pa.Table:
        runs = _Runs(table, length, gram, sent_heavy.value)
        _, order = place(runs)
        ranges: list[np.ndarray] = []
        count = np.zeros(len(runs.first), np.int64)
        place_of = []
        found, places = B.letters(answers, RANGES, PLACES)
        if runs.heavy.any():
            each = _Stretches(runs, length)
            _, to_stretch = place_stretches(each)
            hit = each.many.copy()
            hit[to_stretch[places["at"]]] = True
            string, pairs = each.ranges(hit)
            count += np.bincount(string, minlength=len(count))
            place_of.append(np.unique(string))
            ranges.append(pairs)
            del each
        if len(found):
            to, (pairs, cut) = order[found["at"]], found["ranges"]
            count[to] = np.diff(cut) // 2
            place_of.append(to)
            ranges.append(pairs.reshape(-1, 2))
        edge = np.zeros(len(runs.raw) + 1, np.int64)
        if ranges:
            to, pairs = np.concatenate(place_of), np.concatenate(ranges)
            begin = np.zeros(len(count), np.int64)
            begin[to] = np.append(0, np.cumsum(count[to])[:-1])
            many = count[runs.of]
            at = np.arange(many.sum()) + np.repeat(begin[runs.of] - np.append(0, np.cumsum(many)[:-1]), many)
            start = np.repeat(runs.start, many)
            np.add.at(edge, start + pairs[at, 0], 1)
            np.add.at(edge, start + pairs[at, 1] + length - 1, -1)
        gone = np.cumsum(edge)[: len(runs.raw)] > 0
        inside = np.zeros(len(gone) + 1, bool)
        inside[runs.offs] = True
        opens = gone & (~np.append(False, gone[:-1]) | inside[:-1]) if len(gone) else gone
        removed, spans = (np.diff(np.append(0, np.cumsum(x))[runs.offs]) for x in (gone, opens))
        shas = [T.sha256(runs.raw[a:b][~gone[a:b]] if r else runs.raw[a:b]) for a, b, r in zip(runs.offs, runs.offs[1:], removed)]
        return pa.table({"doc_id": runs.ids, "n_bytes": pa.array(np.diff(runs.offs)), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept_sha256": pa.array(shas, pa.string())})

    blocks = B.packed(docs, n)
    return B.settled(blocks, B.answered(B.sent(blocks, n, send), n, solve), apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
