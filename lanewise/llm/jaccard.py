"""N-gram Jaccard join by blocked sparse matrix products (operator 9).

The incidence matrix has a row for each document and a column for each word shingle. Two documents link when their
rows' Jaccard similarity is at least `percent` / 100. All steps are exact:

1. Column blocks. Each block of documents sends its sorted shingle hashes, shortened and delta-coded, to the column
   blocks; these answer with the (logarithmic) document frequency of each. Columns of one document drop out, and a
   document too few of whose shingles occur elsewhere for any link (a bound from its size) is done.
2. Equal rows become one class; from here on classes stand for documents.
3. Row blocks. Classes meet in groups of equal min-hashes, dealt into blocks of at most ROWS rows; in each block
   the sparse product, column tile by column tile, accumulates all overlaps, and pairs below the bound of their sizes
   are discarded. What links is merged into components, so large groups of near copies cost no pairs of theirs.
4. The rest. Of the classes that a link is still possible between, any two have one of their rarest shingles in common (as
   many as any link needs one of, less those in no other document). So the classes of each such shingle that are in
   different components form further row blocks, with the same product; shingles with the same classes, as those of a
   passage are, make one block together.
5. A shingle with more than ROWS classes has several blocks. If components still differ on it after all blocks are
   merged, its blocks meet two by two. No pair of classes is ever a row.

Shingles are 64-bit hashes of their words' 62-bit ones; sets are told apart by 128 bits. Cases: a text of one to four words has its whole sequence as its only shingle; null and
empty texts and those of white space alone have none, link with nothing and form components of their own; repeated
rows link with each other if they have words; a text of any length is one row of the matrix, held by one task; a null doc_id counts as larger than others and is never a component_id
where another is; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from . import _text as T
from ._graph import checkpointed, components

SHINGLE, PERCENT = 5, 75
ROWS, ROUNDS, TILE = 512, 3, 4096
LEVELS = 8  # of document frequency, for each power of two
#: What travels: a block's different shortened hashes, as differences byte by byte, and how many rows have each; levels back.
COLUMNS, FREQUENCIES = B.Form(0, **{f"p{k}": "u1" for k in range(8)}, n="u1"), B.Form(1, level="u1")


class _Sets:
    """The shingle sets of a block: hash is sorted within each row, first[r]:first[r + 1]."""

    def __init__(self, table: pa.Table, k: int):
        self.ids, text = B.unpack(table)
        raw, offs = T.strings(text)
        self.name = T.names(raw, offs)
        w = T.Words(raw, offs, lower=True)
        counts = w.counts
        at = np.flatnonzero(w.whole(k))
        hashes, row = [w.grams(k)[at]], [np.searchsorted(w.first, at, "right") - 1]
        for size in range(1, k):
            short = np.flatnonzero(counts == size)
            hashes.append(w.grams(size)[w.first[short]] if len(short) else np.empty(0, T.U64))
            row.append(short)
        hash_, row_ = np.concatenate(hashes), np.concatenate(row)
        order = np.lexsort((hash_, row_))
        hash_, row_ = hash_[order], row_[order]
        new = np.ones(len(order), bool)
        new[1:] = (hash_[1:] != hash_[:-1]) | (row_[1:] != row_[:-1])
        self.hash, self.row = hash_[new], row_[new]
        self.n = np.bincount(self.row, minlength=len(counts))
        self.first = np.append(0, np.cumsum(self.n))

    def columns(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different shortened hashes, each entry's place among them, and in how many rows they are."""
        return np.unique((self.hash >> T.U64(64 - bits)).astype(np.int64), return_inverse=True, return_counts=True)


def _planes(gaps: np.ndarray) -> dict[str, np.ndarray]:
    wide = np.ascontiguousarray(gaps).astype("<i8").view(np.uint8).reshape(-1, 8)
    return {f"p{k}": np.ascontiguousarray(wide[:, k]) for k in range(8)}


def _values(got: B.Letters) -> np.ndarray:
    """The columns' hashes: the first of each message as such, the others as differences."""
    gaps = np.ascontiguousarray(np.stack([got[f"p{k}"] for k in range(8)], 1)).view("<i8").ravel()
    sums = np.append(0, np.cumsum(gaps))
    return sums[1:] - np.repeat(sums[np.cumsum(got.counts) - got.counts], got.counts)


def sized(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, block, row (a hash of the text) and, for rows that may link, a 128-bit set_key and their shared
    shingles, rarest first."""
    n = B.block_count(docs)
    bits = min(62, max(40, (n * B.BLOCK_BYTES // 6).bit_length() + 10))
    cuts = np.array([(i << bits) // n for i in range(n + 1)], np.int64)

    def send(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        values, _, count = _Sets(table, k).columns(bits)
        at = np.searchsorted(values, cuts)
        gaps = np.diff(values, prepend=0)
        opens = at[:-1][at[:-1] < at[1:]]
        gaps[opens] = values[opens]
        yield from B.mail(COLUMNS, np.repeat(np.arange(n), np.diff(at)), _planes(gaps) | {"n": np.minimum(count, 255)})

    def solve(got: list[tuple[int, pa.Buffer]]) -> Iterator[tuple[int, bytes]]:
        (own,) = B.letters(got, COLUMNS)
        got.clear()
        values, count = _values(own), own["n"].astype(np.int64)
        order = np.argsort(values, kind="stable")
        head = np.flatnonzero(np.append(True, values[order][1:] != values[order][:-1]))
        total = np.add.reduceat(count[order], head)
        level = np.minimum(255, np.ceil(LEVELS * np.log2(total))).astype(np.uint8)
        back = np.empty(len(values), np.uint8)
        back[order] = np.repeat(level, np.diff(np.append(head, len(values))))
        for block, rows in own.by_sender(np.arange(len(own))):
            yield block, FREQUENCIES.pack(int(own.at[rows[0]]), 0, len(rows), {"level": back[rows]})

    def apply(table: pa.Table, answers: list[tuple[int, pa.Buffer]]) -> pa.Table:
        sets = _Sets(table, k)
        _, place, _ = sets.columns(bits)
        (found,) = B.letters(answers, FREQUENCIES)
        level = np.empty(len(found), np.uint8)
        level[found.at] = found["level"]
        level = level[place]
        shared = np.bincount(sets.row[level > 0], minlength=len(sets.n))
        may = (sets.n > 0) & (100 * shared >= percent * sets.n)
        keep = np.flatnonzero((level > 0) & may[sets.row]) if len(level) else np.empty(0, np.int64)
        order = keep[np.lexsort((sets.hash[keep], level[keep], sets.row[keep]))]
        tokens = sets.hash[order].astype("<u8")
        size = np.where(may, shared, 0)
        at = np.append(0, np.cumsum(size))
        # a sum of mixed members names a set, whatever their order
        sums = [np.append(T.U64(0), np.cumsum(T.mix(sets.hash ^ T.U64(seed)))) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        key = np.stack([x[sets.first[1:]] - x[sets.first[:-1]] for x in sums], 1).astype("<u8")
        data, raw = tokens.tobytes(), key.tobytes()
        out = {"doc_id": sets.ids, "n": pa.array(sets.n), "block": pa.array(np.full(len(sets.n), table.column("block")[0].as_py(), np.int32)), "row": pa.array(sets.name.view(np.int64))}
        out["set_key"] = pa.array([raw[16 * r : 16 * r + 16] if may[r] else None for r in range(len(may))], pa.binary())
        out["tokens"] = pa.array([data[8 * at[r] : 8 * at[r + 1]] if may[r] else None for r in range(len(may))], pa.binary())
        return pa.table(out)

    blocks = B.packed(docs, n)
    return B.settled(blocks, B.answered(B.sent(blocks, n, send), n, solve), apply, "doc_id long, n long, block int, row long, set_key binary, tokens binary")


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (a + b - overlap)


def block_links(sizes: np.ndarray, rows: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of one row block, from its blocked sparse product."""
    g = len(rows)
    row = np.repeat(np.arange(g), [len(x) for x in rows])
    _, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    dense = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], dense[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((g, g), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, TILE):
        a, b = np.searchsorted(column, [lo, lo + TILE])
        tile = np.zeros((g, min(TILE, int(column[-1]) + 1 - lo)), np.float32)
        tile[row[a:b], column[a:b] - lo] = 1
        overlap += tile @ tile.T
    near = linked(overlap.astype(np.int64), sizes[:, None], sizes[None, :], percent)
    found, left = [], np.ones(g, bool)
    for root in range(g):
        if not left[root]:
            continue
        left[root], front = False, np.array([root])
        while len(front):
            reach = near[front].any(0) & left
            front = np.flatnonzero(reach)
            left &= ~reach
            found += [(root, int(x)) for x in front]
    return found


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of rows that agree in the first column, out of batches sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = table.column(0).to_numpy()
        at = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
        lo = 0
        if held and len(keys) and held[0].column(0)[0].as_py() != keys[0]:
            yield pa.concat_tables(held)
            held = []
        for hi in at[:-1]:
            yield pa.concat_tables([*held, table.slice(lo, hi - lo)])
            held, lo = [], hi
        held.append(table.slice(lo))
    if held:
        yield pa.concat_tables(held)


def _tokens(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u8") for x in column]


def products(dealt: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) found in row blocks: of the classes (cid) that are dealt the same number, by their sparse product."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            cid, n = table.column("cid").to_numpy(), table.column("n").to_numpy()
            found = block_links(n, _tokens(table.column("tokens")), percent) if len(cid) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(cid[[a for a, _ in found]]), pa.array(cid[[b for _, b in found]])], ["u", "v"])

    rows = dealt.join(classes, "cid").select("dealt", "cid", "n", "tokens")
    return rows.repartition("dealt").sortWithinPartitions("dealt").mapInArrow(T.lean(product), "u long, v long")


def met(classes: DataFrame, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """Links (u, v) found in row blocks of classes with equal min-hashes."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column(1))
            low = [[int(T.mix(x ^ T.U64(0x9E37 + r)).min() >> T.U64(1)) for r in range(rounds)] for x in tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.list_(pa.int64()))], ["cid", "keys"])

    hashed = checkpointed(classes.select("cid", "tokens").mapInArrow(T.lean(keys), "cid long, keys array<long>").select("cid", F.posexplode("keys").alias("round", "key")))
    # written, so that the join has exchanges of its own, whose large partitions Spark splits
    many = checkpointed(hashed.groupBy("round", "key").agg(F.count("*").alias("many")).where("many > 1"))
    salt = F.pmod(F.xxhash64("cid", "round"), F.ceil(F.col("many") / ROWS))
    dealt = hashed.join(many, ["round", "key"]).select("cid", F.xxhash64("round", "key", salt).alias("dealt"))
    return products(dealt, classes, percent)


def prefixes(classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """token, cid, label, n, left: each class's rarest shingles, with how many it has from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            tokens = _tokens(batch.column(2))
            own = np.array([len(x) for x in tokens], np.int64)
            # of the n - ceil(percent n / 100) + 1 rarest, those that no other document has can be left out
            size = np.clip(n - -(-percent * n // 100) + 1 - (n - own), 0, own)
            row = np.repeat(np.arange(len(n)), size)
            at = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size)
            token = np.concatenate([x[:s] for x, s in zip(tokens, size)]) if len(n) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(3).take(pa.array(row)), pa.array(n[row]), pa.array(own[row] - at)], ["token", "cid", "label", "n", "left"])

    full = classes.join(labels, classes.cid == labels.node, "left").select("cid", "n", "tokens", F.coalesce("root", "cid").alias("label"))
    return full.mapInArrow(T.lean(run), "token long, cid long, label long, n long, left long")


def _possible(prefix: DataFrame, percent: int) -> DataFrame:
    """The rows of prefix that may be a pair's first shingle in common, by sizes and places.

    Of two linked classes a and b, a the smaller or equal one, the sizes from that shingle on bound their overlap, so
    (100 + percent) * least(left) >= percent * (n_a + n_b) >= 2 * percent * n_a. A row stays if it may be the smaller of a
    pair at all, or if one of these has a size that makes it the larger of a pair; its shingle needs two labels.
    """
    small = F.expr(f"{100 + percent} * left >= {2 * percent} * n")
    sizes = [F.min(F.when(small, F.col("n"))).alias("from"), F.max(F.when(small, F.col("n"))).alias("to")]
    tokens = checkpointed(prefix.groupBy("token").agg(F.min("label").alias("one"), F.max("label").alias("other"), *sizes).where("one < other AND from IS NOT NULL").drop("one", "other"))
    large = F.expr(f"greatest({percent * percent} * n, {100 * percent} * from) <= 100 * least({percent} * n, {100 + percent} * left - {percent} * n, {percent} * to)")
    return checkpointed(prefix.join(tokens, "token").where(small | large).select(*prefix.columns))


def rest(classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """cid, token, many (classes of the token): what must still meet so that no link between two labels is missed, with
    one token for all that have the same classes."""
    prefix = _possible(_possible(prefixes(classes, labels, percent), percent), percent)
    sizes = [F.count("*").alias("many"), F.min("label").alias("one"), F.max("label").alias("other"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y")]
    tokens = prefix.groupBy("token").agg(*sizes, F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("sum"), F.min("left").alias("left"))
    # of two classes alone, sizes and places tell whether they can link
    fits = (percent * F.col("most") <= 100 * F.col("least")) & ((100 + percent) * F.col("left") >= percent * F.col("sum"))
    kept = tokens.where((F.col("one") < F.col("other")) & ((F.col("many") > 2) | fits)).groupBy("many", "x", "y").agg(F.min("token").alias("token"))
    return checkpointed(prefix.join(checkpointed(kept.select("token", "many")), "token").select("cid", "token", "many"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, root) after further links."""
    more = components(_between(links, labels))
    own = more.select(F.col("node").alias("was"), F.col("root").alias("now"))
    changed = labels.join(own, labels.root == own.was, "left").select("node", F.coalesce("now", "root").alias("root"))
    return checkpointed(changed.union(more.select("node", "root")).groupBy("node").agg(F.min("root").alias("root")))


def labelled(classes: DataFrame, percent: int) -> DataFrame:
    """node, root: the component of each class that has a link, named by its least class."""
    labels = checkpointed(components(met(classes, percent)))
    open_ = rest(classes, labels, percent)
    blocks = F.ceil(F.col("many") / ROWS)
    own = F.pmod(F.xxhash64("cid", "token"), blocks)
    labels = _merged(labels, products(open_.select("cid", F.xxhash64("token", own).alias("dealt")), classes, percent))
    large = open_.where(F.col("many") > ROWS).join(labels, F.col("cid") == F.col("node"), "left").select("cid", "token", "many", F.coalesce("root", "cid").alias("label"))
    apart = checkpointed(large.groupBy("token").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one < other").select("token"))
    if apart.isEmpty():
        return labels
    pairs = large.join(apart, "token").select("cid", "token", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("with")).where("own <> with")
    return _merged(labels, products(pairs.select("cid", F.xxhash64("token", F.least("own", "with"), F.greatest("own", "with")).alias("dealt")), classes, percent))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    rows = checkpointed(sized(docs, shingle, percent).withColumn("d", F.coalesce("doc_id", F.lit(B.NULL_ID))))
    some, name = _named(rows, percent)
    both = some.join(name, "set_key").select("doc_id", "n", "component").unionAll(rows.where("set_key is null").select("doc_id", "n", "d"))
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component") != B.NULL_ID, F.col("component")).alias("component_id"))


def _named(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows that may link, and each set_key's component, named by its least doc_id."""
    some = rows.where("set_key is not null")
    classes = some.groupBy("set_key").agg(F.min("d").alias("least"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    labels = labelled(classes, percent)
    name = classes.select("cid", "set_key", "least").join(labels, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("root", "cid")).drop("node", "root")
    least = name.groupBy("label").agg(F.min("least").alias("component"))
    return some, name.select("set_key", "label").join(least, "label").select("set_key", "label", "component")


def representatives(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that of the least doc_id; the others' names alone travel to the blocks."""
    columns, n = docs.columns, B.block_count(docs)
    rows = checkpointed(sized(docs, shingle, percent).withColumn("d", F.coalesce("doc_id", F.lit(B.NULL_ID))))
    some, name = _named(rows, percent)
    own = some.join(name, "set_key").select("block", "d", "row", "label")
    stays = own.groupBy("label").agg(F.min(F.struct("d", "row", "block")).alias("stays")).select("stays.*", F.lit(1).alias("keep"))
    decided = own.groupBy("block", "d", "row").agg(F.lit(1)).select("block", "d", "row").join(stays, ["block", "d", "row"], "left").select("block", "d", "row", F.coalesce("keep", F.lit(0)).alias("keep"))

    def apply(table: pa.Table, decisions: pa.Table) -> pa.Table:
        ids, text = B.unpack(table)
        key = list(zip(B.ids(ids).tolist(), T.names(*T.strings(text)).view(np.int64).tolist()))
        left = {(d, r): k for d, r, k in zip(*(decisions.column(c).to_pylist() for c in ("d", "row", "keep")))}
        keep = np.ones(len(key), bool)
        for i, k in enumerate(key):
            if k in left:
                keep[i], left[k] = left[k] > 0, 0
        return B.restored(table, columns, keep=keep)

    blocks = B.packed(docs, n, whole=True)
    return blocks.groupBy("block").cogroup(B.dealt(decided, n, "block").groupBy("block")).applyInArrow(apply, B.schema_of(docs))


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links as such between labels."""
    for side in ("u", "v"):
        links = links.join(labels, F.col(side) == F.col("node"), "left").withColumn(side, F.coalesce("root", side)).drop("node", "root")
    return links
