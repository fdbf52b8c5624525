"""BPE encoding and decoding over a distinct-word table (operator 3).

Each block of documents splits its texts into the tokenizer's words (byte-level pre-tokenization) and sends each
different word once, as its bytes, to a bucket of the word table, chosen by hash. The bucket encodes each distinct word
once and answers with its ids, which the block joins back by position. Decoding joins ids to pieces (a table as large as the
vocabulary, broadcast) and concatenates them. Only byte-level BPE tokenizers whose words are encoded on their own
are supported, which is what such a pre-tokenizer means; others are refused.

Cases: null is an empty text, which has no tokens; special tokens' strings in a text are those tokens; text of any
length or script is cut at word ends only; repeated rows give a row each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _blocks as B
from . import _text as T

SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
SLICE = 1 << 13  # code points that are probed at a time
#: What travels: a block's different words, and their ids back, in two bytes if the vocabulary allows it.
WORDS, IDS, SMALL_IDS = B.Form(0, word="[u1]"), B.Form(1, ids="[i4]"), B.Form(1, ids="[u2]")
BATCH = 1 << 12  # words that are encoded at a time, as each has an object of its own meanwhile


def code_point_kinds(tokenizer) -> np.ndarray:
    """What each code point is to the pre-tokenizer's pattern, found by probing: it joins the run that it follows.

    From 0x40000 on there are only unassigned code points, tags and private ones, none of them letters.
    """
    out = np.full(0x110000, SPACE, np.uint8)
    out[0x40000:] = OTHER
    for lo in range(0, 0x40000, SLICE):
        chars = [c for c in range(lo, lo + SLICE) if not 0xD800 <= c < 0xE000]
        for kind, probe in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if chars else ():
            text = probe + "".join(chr(c) + probe for c in chars)
            begins = np.zeros(len(text) + 1, bool)
            begins[[a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]] = True
            out[np.array(chars)[~begins[1:-1:2]]] = kind
    return out


def checked(definition: dict) -> None:
    """ValueError for a tokenizer whose words this module doesn't cut, or whose ids and pieces it doesn't join, right."""
    model, before = definition["model"], definition.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or definition.get("normalizer") is not None or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or (definition.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("only byte-level BPE is supported: no normaliser, a ByteLevel pre-tokenizer without added space, a ByteLevel decoder")
    added = [t["content"] for t in definition.get("added_tokens", [])]
    if any(t.get(k) for t in definition.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take spaces, or single words alone, aren't supported")
    if any(a != b and (a in b or any(a.endswith(b[:k]) for k in range(1, len(b)))) for a in added for b in added):
        raise ValueError("added tokens that overlap aren't supported")


def word_starts(points: np.ndarray, offs: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where words of the byte-level pattern begin in code points; no word crosses an offset."""
    n = len(points)
    kind = kinds[points]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.where(edge[:-1], EDGE, np.append(EDGE, kind[:-1]))
    after = np.where(edge[1:], EDGE, np.append(kind[1:], EDGE))
    opens = kind != before
    blank = points == 32
    attached = (before == SPACE) & np.append(False, blank[:-1])
    white = kind == SPACE
    start = np.where(white, opens | (after != SPACE) & (after != EDGE), opens & ~attached)
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        text = np.append(points, [0, 0, 0])
        stop = np.searchsorted(offs, quote, "right")
        room = offs[np.minimum(stop, len(offs) - 1)] - quote
        one, two = text[quote + 1], text[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (room > 1)
        long = ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (room > 2)
        start[quote[short | long] + 1] = False
        start[quote[long] + 2] = False
        past = np.concatenate([quote[short] + 2, quote[long] + 3])
        start[past[past < n]] = True
    return start


class Vocabulary:
    """A tokenizer's pieces and ids as bytes, one after another, and its special tokens."""

    def __init__(self, definition: str):
        whole = json.loads(definition)
        checked(whole)
        self.special = [t["content"] for t in whole.get("added_tokens", [])]
        vocab = whole["model"]["vocab"] | {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        # a byte-level piece writes each byte as one printable character: itself, or the next free one from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            pieces[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        self.pieces = self._joined(pieces)
        self.decimals = self._joined([b"%d," % i for i in range(len(pieces))])

    @staticmethod
    def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(x) for x in parts]))


@lru_cache(1)
def _encoder(definition: str):
    """One for each worker process."""
    return tokenizer_of(definition)


def tokenizer_of(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(definition)
    found.no_truncation()
    found.no_padding()
    return found


class _Split:
    """The words of a block's documents; of tells which of the block's different words each is."""

    def __init__(self, table: pa.Table, special: list[str], kinds: np.ndarray):
        self.ids, text = B.unpack(table)
        self.raw, self.offs = T.strings(text)
        starts = []
        for lo, hi in T.pieces(self.offs):
            base = self.offs[lo]
            raw, offs = self.raw[base : self.offs[hi]], self.offs[lo : hi + 1] - base
            data = raw.tobytes()
            first = np.flatnonzero((raw & 0xC0) != 0x80)
            cuts = [offs]
            inside = []
            for token in special:
                sought, at = token.encode(), -1
                while (at := data.find(sought, at + 1)) >= 0:
                    if offs[np.searchsorted(offs, at, "right")] >= at + len(sought):
                        inside.append((at, at + len(sought)))
                        at += len(sought) - 1
            cuts.extend(np.array(x) for x in inside)
            edges = np.unique(np.concatenate(cuts))
            points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
            start = word_starts(points, np.searchsorted(first, edges), kinds) if len(points) else np.empty(0, bool)
            for a, b in inside:
                start[np.searchsorted(first, a) + 1 : np.searchsorted(first, b)] = False
            starts.append(first[start] + base)
        self.start = np.concatenate([*starts, self.offs[-1:]])
        self.head, self.of = T.distinct(self.raw, self.start)
        self.first = np.searchsorted(self.start[:-1], self.offs)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return T.gathered(self.raw, self.start[self.head], self.start[self.head + 1] - self.start[self.head])


def encoded(docs: DataFrame, tokenizer: str, tokens: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with tokens, ids and decoded, for each row.

    tokenizer is the path of a byte-level BPE definition on the driver.
    """
    n = B.block_count(docs)
    context, text = docs.sparkSession.sparkContext, Path(tokenizer).read_text()
    known = Vocabulary(text)
    # whoever encodes needs the definition alone, and whoever decodes the pieces alone
    definition, vocabulary, special = context.broadcast(text), context.broadcast(known), known.special
    form = SMALL_IDS if len(known.decimals[1]) <= 1 << 16 else IDS
    kinds = context.broadcast(code_point_kinds(tokenizer_of(text)))

    def bucketed(split: _Split) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words, and their buckets and order by bucket."""
        raw, offs = split.words()
        bucket = (T.names(raw, offs) % T.U64(n)).astype(np.int64)
        return raw, offs, bucket, np.argsort(bucket, kind="stable")

    def send(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        raw, offs, bucket, order = bucketed(_Split(table, special, kinds.value))
        yield from B.mail(WORDS, bucket[order], {"word": T.gathered(raw, offs[order], np.diff(offs)[order])})

    def solve(got: list[tuple[int, pa.Buffer]]) -> Iterator[tuple[int, bytes]]:
        (words,) = B.letters(got, WORDS)
        got.clear()
        raw, offs = words["word"]
        head, of = T.distinct(raw, offs)
        data = raw.tobytes()
        distinct = [data[a:b].decode() for a, b in zip(offs[head].tolist(), offs[head + 1].tolist())]
        ids = [x.ids for lo in range(0, len(distinct), BATCH) for x in _encoder(definition.value).encode_batch(distinct[lo : lo + BATCH], add_special_tokens=False)]
        cut = np.append(0, np.cumsum([len(x) for x in ids]))
        flat = np.fromiter((i for x in ids for i in x), np.int32, cut[-1])
        for block, own in words.by_sender(np.arange(len(words))):
            yield block, form.pack(int(words.at[own[0]]), 0, len(own), {"ids": T.gathered(flat, cut[of[own]], np.diff(cut)[of[own]])})

    def apply(table: pa.Table, answers: list[tuple[int, pa.Buffer]]) -> pa.Table:
        vocab, split = vocabulary.value, _Split(table, special, kinds.value)
        *_, order = bucketed(split)
        (found,) = B.letters(answers, form)
        flat, begin = found["ids"]
        many, at = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        many[order[found.at]], at[order[found.at]] = np.diff(begin), begin[:-1]
        ids, cut = T.gathered(flat.astype(np.int32), at, many)
        count = np.append(0, np.cumsum(many[split.of]))[split.first]
        shas, plain_shas, found, plain = [], [], [], []
        spelled, pieces = _spelled(vocab.decimals, ids, cut), _spelled(vocab.pieces, ids, cut)
        for lo, hi in T.pieces(split.offs):
            own = split.of[split.first[lo] : split.first[hi]]
            where = split.first[lo : hi + 1] - split.first[lo]
            shas += [T.sha256(x[:-1]) for x in _rows(*spelled, own, where)]
            texts = [x.tobytes().decode(errors="replace") for x in _rows(*pieces, own, where)]
            plain_shas += [T.sha256(x.encode()) for x in texts]
            if tokens:
                plain += texts
                found += _rows(ids, cut, own, where)
        columns = {"doc_id": split.ids, "n_tokens": pa.array(np.diff(count)), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(plain_shas, pa.string())}
        return pa.table(columns | ({"ids": pa.array(found, pa.list_(pa.int32())), "decoded": pa.array(plain, pa.string())} if tokens else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * tokens
    blocks = B.packed(docs, n)
    return B.settled(blocks, B.answered(B.sent(blocks, n, send), n, solve), apply, schema)


def _spelled(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The join of ids to their bytes, and where each word's begin."""
    raw, offs = table
    out, at = T.gathered(raw, offs[ids], np.diff(offs)[ids])
    return out, at[cut]


def _rows(flat: np.ndarray, offs: np.ndarray, words: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
    """What the words of each row, words[where[r]:where[r + 1]], are in flat."""
    part, cuts = T.gathered(flat, offs[words], np.diff(offs)[words])
    cuts = cuts[where]
    return [part[a:b] for a, b in zip(cuts, cuts[1:])]
