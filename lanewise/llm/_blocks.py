"""Documents dealt into blocks, and packed messages between blocks and buckets.

Operators that compare every stretch of text with all others work in three steps: each block of documents sends
its stretches, packed and compressed, to buckets chosen by content; each bucket answers the blocks; each block
applies the answers. A block is a hash class of (doc_id, text), so a task that is run again after an executor was
lost makes the same block. The packed texts cross the network once: both uses share one exchange.

A message holds all that one block has for one bucket, without a header of its own, and none is empty. So there are at
most as many as stretches are sent, however many blocks there are: with few blocks a message has thousands of
stretches, with very many it is a row with one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import _text as T

#: Bytes of text in a block: what one task holds at a time.
BLOCK_BYTES = 4 << 20
#: What a row counts besides its text, so that rows without text fill blocks too.
ROW_BYTES = 64
#: Tasks of an exchange at most: with more blocks than that a task has several, one after the other.
PARTITIONS = 8192
NULL_ID = np.iinfo(np.int64).max
BLOCKS = "block int, payload binary"
MAIL = "bucket int, block int, payload binary"
CODEC = pa.Codec("zstd", 3)
#: Bytes of a message from which it is compressed.
SMALL = 256
OPTIONS = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))


def dumps(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=OPTIONS) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def loads(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about block_bytes of text and rows each."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)) + ROW_BYTES * F.count("*")).first()[0]
    return max(1, -(-total // block_bytes))


def dealt(rows: DataFrame, n: int, column: str) -> DataFrame:
    """rows dealt by block or bucket, of which there are n."""
    return rows.repartition(min(n, PARTITIONS), column)


def heavy(docs: DataFrame, weigh: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], most: int, different: int | None = None) -> np.ndarray:
    """Upper halves of keys, in order, whose strings take more than `most` bytes in all documents, or more than
    `different` bytes if equal strings are counted once. weigh gives key, name and bytes of each string of some texts.
    Halves of keys and names are counted, which halves what is shuffled; keys with equal halves count together."""
    half = T.U64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, name, size in weigh(batch.column(0)):
                pair = (key >> half << half) | (name >> half if different else T.U64(0))
                pair, first, of = np.unique(pair, return_index=True, return_inverse=True)
                total = np.bincount(of, size, len(pair)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(size[first].astype(np.int64)), pa.array(total)], ["pair", "size", "total"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(T.lean(run), "pair long, size long, total long")
    over = F.sum("total") > most
    if different:
        found = found.groupBy("pair").agg(F.first("size").alias("size"), F.sum("total").alias("total"))
        over = over | (F.sum("size") > different)
    found = found.groupBy(F.shiftrightunsigned("pair", 32).alias("key")).agg(over.alias("over")).where("over").select("key").toArrow()
    return np.sort(found.column("key").to_numpy().astype(np.uint64))


def classes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (a, b), where in it each different pair begins, and each place's pair."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), of


def among(keys: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Whether the upper half of each key is in heavy."""
    if not len(heavy):
        return np.zeros(len(keys), bool)
    upper = keys >> T.U64(32)
    return heavy[np.minimum(np.searchsorted(heavy, upper), len(heavy) - 1)] == upper


def packed(docs: DataFrame, n: int, whole: bool = False) -> DataFrame:
    """doc_id and text in n blocks, as compressed payloads dealt by block; with whole, all columns after these two."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")

    rest = {f"c{k}": c for k, c in enumerate(docs.columns) if whole and c not in ("doc_id", "text")}
    names = ["doc_id", "text", *rest]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            order = np.argsort(own, kind="stable")
            own, batch = own[order], batch.take(pa.array(order))
            at = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
            for lo, hi in zip(at, at[1:]):
                row = pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in batch.columns[1:]], names)
                yield pa.RecordBatch.from_arrays([pa.array([own[lo]], pa.int32()), pa.array([dumps(row)], pa.binary())], ["block", "payload"])

    rows = docs.select(block, F.col("doc_id").cast("long"), F.col("text").cast("string"), *(docs[c].alias(k) for k, c in rest.items())).mapInArrow(T.lean(pack), BLOCKS)
    return dealt(rows, n, "block")


def _whole(table: pa.Table) -> pa.Table:
    """A block's documents from its payloads, ordered by their contents: payloads come in another order each time."""
    return pa.concat_tables([loads(x.as_buffer()) for x in table.column("payload")]).combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def unpack(table: pa.Table) -> tuple[pa.ChunkedArray, pa.ChunkedArray]:
    """doc_id and text of a block, from its payloads."""
    if not table.num_rows:
        return pa.chunked_array([], pa.int64()), pa.chunked_array([], pa.string())
    whole = _whole(table)
    return whole.column("doc_id"), whole.column("text")


def restored(table: pa.Table, columns: list[str], text: pa.Array | None = None, keep: np.ndarray | None = None) -> pa.Table:
    """All columns of a whole block's documents, as packed; with text, that instead and n_chars counted anew."""
    whole = _whole(table)
    out = {c: whole.column(c if c in ("doc_id", "text") else f"c{k}") for k, c in enumerate(columns)}
    if text is not None:
        out["text"] = text
        if "n_chars" in out and pa.types.is_integer(out["n_chars"].type):
            out["n_chars"] = pc.utf8_length(text).cast(out["n_chars"].type)
    made = pa.table(out)
    return made if keep is None else made.filter(pa.array(keep))


def schema_of(docs: DataFrame) -> StructType:
    """The columns of docs as restored: doc_id is a long and text a string, and any may be null."""
    kinds = {"doc_id": LongType(), "text": StringType()}
    return StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in docs.schema])


def ids(column: pa.ChunkedArray) -> np.ndarray:
    """doc_id for comparison: null comes after every other."""
    return column.fill_null(NULL_ID).to_numpy()


class Form:
    """The columns of a kind of message: numbers of some type, or lists of them ("[u1]"), as sizes and then all values."""

    def __init__(self, kind: int, **columns: str):
        self.kind = kind
        self.columns = {c: (np.dtype(f"<{t.strip('[]')}"), t[0] == "[") for c, t in columns.items()}

    def pack(self, first: int, lo: int, hi: int, columns: dict) -> bytes:
        """Rows lo to hi; first is the number that the receiver gets for the first of them."""
        parts = [np.array([first, hi - lo], "<u4").tobytes()]
        for c, (kind, listed) in self.columns.items():
            if listed:
                flat, offs = columns[c]
                # sizes byte by byte, as their upper ones are nearly always the same
                parts += [np.diff(offs[lo : hi + 1]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), flat[offs[lo] : offs[hi]].astype(kind, copy=False).tobytes()]
            else:
                parts.append(columns[c][lo:hi].astype(kind, copy=False).tobytes())
        data = b"".join(parts)
        if len(data) < SMALL:
            return bytes([2 * self.kind]) + data
        return bytes([2 * self.kind + 1]) + len(data).to_bytes(4, "little") + CODEC.compress(data, asbytes=True)

    def unpack(self, data: bytes) -> dict:
        first, n = np.frombuffer(data, "<u4", 2).tolist()
        out, at = {"#first": first, "#n": n}, 8
        for c, (kind, listed) in self.columns.items():
            size = n
            if listed:
                sizes = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()
                out[f"#{c}"], size, at = sizes, int(sizes.sum()), at + 4 * n
            out[c] = np.frombuffer(data, kind, size, at)
            at += size * kind.itemsize
        return out


def opened(payload: pa.Buffer) -> tuple[int, bytes]:
    """A message's kind and its data."""
    data = payload.to_pybytes()
    if data[0] % 2 == 0:
        return data[0] // 2, data[1:]
    return data[0] // 2, CODEC.decompress(data[5:], int.from_bytes(data[1:5], "little"), asbytes=True)


class Letters:
    """Messages of one form that a task has got, and whom each is from; columns of all, one after another."""

    def __init__(self, form: Form, got: list[tuple[int, bytes]]):
        self.form, self.blocks = form, [b for b, _ in got]
        parts = [form.unpack(x) for _, x in got]
        self.counts = np.array([x["#n"] for x in parts], np.int64)
        self.source = np.repeat(np.arange(len(parts)), self.counts)
        self.at = np.concatenate([np.arange(x["#first"], x["#first"] + x["#n"]) for x in parts]) if parts else np.empty(0, np.int64)
        self.columns = {}
        for c, (kind, listed) in form.columns.items():
            flat = np.concatenate([x[c] for x in parts]) if parts else np.empty(0, kind)
            self.columns[c] = (flat, np.append(0, np.cumsum(np.concatenate([x[f"#{c}"] for x in parts]), dtype=np.int64)) if parts else np.zeros(1, np.int64)) if listed else flat

    def __getitem__(self, column: str):
        return self.columns[column]

    def __len__(self) -> int:
        return len(self.source)

    def by_sender(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each sender some of whose rows are among these (in ascending order): its block, and these."""
        cut = np.searchsorted(rows, np.append(0, np.cumsum(self.counts)))
        for block, lo, hi in zip(self.blocks, cut, cut[1:]):
            if lo < hi:
                yield block, rows[lo:hi]


def letters(got: list[tuple[int, pa.Buffer]], *forms: Form) -> list[Letters]:
    """The messages by form."""
    own: dict[int, list[tuple[int, bytes]]] = {f.kind: [] for f in forms}
    for block, payload in got:
        kind, data = opened(payload)
        own[kind].append((block, data))
    return [Letters(f, own[f.kind]) for f in forms]


def mail(form: Form, bucket: np.ndarray, columns: dict) -> Iterator[tuple[int, bytes]]:
    """One message for each bucket; bucket must be sorted and columns in its order, which numbers the rows."""
    at = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    for lo, hi in zip(at, at[1:]):
        yield int(bucket[lo]), form.pack(lo, lo, hi, columns)


def rows(found: list[tuple[int, int, bytes]], schema: pa.Schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(schema)], schema=schema)


def sent(blocks: DataFrame, n: int, send: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """What the blocks send, dealt by bucket."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        out = rows([(b, block, x) for b, x in send(table)])
        T.release()
        return out

    return dealt(blocks.groupBy("block").applyInArrow(run, MAIL), n, "bucket")


def answered(messages: DataFrame, n: int, solve: Callable[[list[tuple[int, pa.Buffer]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """What the buckets answer, dealt by block."""

    def run(table: pa.Table) -> pa.Table:
        got = [(b, p.as_buffer()) for b, p in zip(table.column("block").to_pylist(), table.column("payload"))]
        out = rows([(0, *x) for x in solve(got)])
        T.release()
        return out

    return dealt(messages.groupBy("bucket").applyInArrow(run, MAIL).select("block", "payload"), n, "block")


def settled(blocks: DataFrame, answers: DataFrame, apply: Callable[[pa.Table, list[tuple[int, pa.Buffer]]], pa.Table], schema: str | StructType) -> DataFrame:
    """What each block makes of its documents and the answers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = apply(left, [(0, p.as_buffer()) for p in right.column("payload")])
        T.release()
        return out

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
