"""Queries of vectors: similarity search, codes of few bits, norms, n-grams and text embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import embed, vectors
from lanewise.operators import merge, recall
from lanewise.sources import carriers as C

K, QUERY_ID, LABEL, AGENT, EVERY = 10, 0, 3, "agent_1", 100
#: Of the test table's vectors.
DIM = 64


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vecs(spark, sf_dir)


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = QUERY_ID) -> list[float]:
    return vecs(spark, sf_dir).where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def topk(where: Column | str | None = None):
    return lambda spark, sf_dir: recall.recall(vecs(spark, sf_dir), query_vector(spark, sf_dir), K, where)


def recall_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: vectors as puts of their agents, every tenth forgotten by another, merged, then searched by label."""
    rows = vecs(spark, sf_dir)
    log = rows.select("agent", F.col("vec_id").alias("fid"), F.col("vec_id").alias("ts"), F.col("vec_id").alias("event_id"), F.lit("put").alias("op"))
    forgotten = log.where("fid % 10 = 7").withColumn("op", F.lit("forget"))
    live = merge.live_state(log.unionAll(forgotten)).select(F.col("fid").alias("vec_id"), "author")
    found = recall.recall(rows.join(live, "vec_id"), query_vector(spark, sf_dir), K, F.col("label") == LABEL)
    return found


def recall_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K rows most like each vector whose id is divisible by EVERY, against all rows."""
    queries = vecs(spark, sf_dir).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return recall.recall_many(vecs(spark, sf_dir), queries, K)


def coded(spark: SparkSession, sf_dir: str, width: int = 4) -> DataFrame:
    return vecs(spark, sf_dir).select("vec_id", vectors.encode(width)("embedding").alias("payload"))


def recall_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K rows most like one query by a search over codes of four bits: rows that the bounds of their codes don't rule
    out are scored by their vectors."""
    return recall.recall_packed(coded(spark, sf_dir), vecs(spark, sf_dir), query_vector(spark, sf_dir), K)


def packed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row and width, how far the true inner product with one query may be from its estimate, and whether it is
    within."""
    query = query_vector(spark, sf_dir)
    exact = vectors.dot(F.col("embedding"), F.array(*map(F.lit, map(float, query))))
    found = None
    for width in vectors.WIDTHS:
        rows = vecs(spark, sf_dir).select("vec_id", exact.alias("exact"), vectors.bounds(np.array(query))(vectors.encode(width)("embedding")).alias("b"))
        part = rows.select("vec_id", F.lit(width).alias("width"), F.round("b.most", 5).alias("most"), (F.abs(F.col("exact") - F.col("b.score")) <= F.col("b.most")).alias("within"))
        found = part if found is None else found.unionAll(part)
    return found


def score_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated and exact inner products of all rows with one query, from codes of four bits."""
    query = query_vector(spark, sf_dir)
    rows = vecs(spark, sf_dir).select("vec_id", "embedding", vectors.encode(4)("embedding").alias("payload"))
    exact = vectors.dot(F.col("embedding"), F.array(*map(F.lit, map(float, query))))
    return rows.select("vec_id", F.round(vectors.score(np.array(query))("payload"), 6).alias("score"), F.round(exact, 6).alias("exact"))


def _text(payload: Column) -> Column:
    return F.array_join(F.transform(vectors.codes_of(payload), lambda c: c.cast("string")), ",")


def requantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of mixed widths narrowed to two bits: their codes, and their cosine as it is estimated then."""
    rows = vecs(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 3 == 0, vectors.encode(8)("embedding")).when(F.col("vec_id") % 3 == 1, vectors.encode(4)("embedding")).otherwise(vectors.encode(1)("embedding")).alias("payload"))
    narrow = rows.select("vec_id", vectors.requantize(2)("payload").alias("payload"))
    return narrow.select("vec_id", F.col("payload.width").alias("width"), F.round(F.col("payload.cosine").cast("double"), 4).alias("cosine"), _text(F.col("payload")).alias("codes"))


def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all widths, and how long each payload's are."""
    out = vecs(spark, sf_dir).select("vec_id", *(vectors.encode(w)("embedding").alias(f"w{w}") for w in vectors.WIDTHS))
    return out.select("vec_id", *(x for w in vectors.WIDTHS for x in (F.octet_length(f"w{w}.codes").alias(f"bytes_{w}"), _text(F.col(f"w{w}")).alias(f"codes_{w}"))))


def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine and ratio of lengths between each vector and what its codes of two bits are decoded to."""
    rows = vecs(spark, sf_dir).select("vec_id", "embedding", vectors.reconstruct(vectors.encode(2)("embedding")).alias("near"))
    cosine = vectors.dot(F.col("embedding"), F.col("near")) / (vectors.norm(F.col("embedding")) * vectors.norm(F.col("near")))
    return rows.select("vec_id", F.round(cosine, 6).alias("cosine"), F.round(vectors.norm(F.col("near")) / vectors.norm(F.col("embedding")), 4).alias("ratio"), F.size("near").alias("dim"))


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the table's coordinates fall to each level of four bits, and the level."""
    levels = F.array(*(F.lit(float(x)) for x in vectors.normal_levels(16)))
    codes = coded(spark, sf_dir).select(F.explode(vectors.codes_of(F.col("payload"))).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n")).select("code", "n", F.round(F.element_at(levels, F.col("code") + 1), 6).alias("level"))


def payload_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of payloads of which some are damaged, each in one way: the good ones' scores, with the damaged ones left out
    and named by what is wrong."""
    query, kind = query_vector(spark, sf_dir), F.col("vec_id") % 20
    p = lambda c: F.col(f"payload.{c}")
    damaged = F.struct(
        F.when(kind == 3, 5).otherwise(p("width")).alias("width"),
        F.when(kind == 6, 63).otherwise(p("dim")).alias("dim"),
        F.when(kind == 9, F.lit(float("nan"))).otherwise(p("norm")).cast("float").alias("norm"),
        *(p(c).alias(c) for c in ("cosine", "length", "spread")),
        F.when(kind == 12, F.substring(p("codes"), 1, 7)).when(kind == 15, F.lit(None)).otherwise(p("codes")).alias("codes"),
    )
    rows = coded(spark, sf_dir).select("vec_id", F.when(kind != 18, damaged).alias("payload"))
    good = vectors.valid(F.col("payload"), DIM)
    score = vectors.score(np.array(query))(F.when(good, F.col("payload")))
    return rows.select("vec_id", good.alias("good"), F.when(good, F.round(score, 6)).alias("score"))


def packed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vecs(spark, sf_dir).select(vectors.encode(4)("embedding").alias("payload"), F.size("embedding").alias("dim"))
    return rows.groupBy("payload.width").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload.codes")).alias("packed"), F.sum(F.col("dim") * 4).alias("plain"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn's embedding: its length (1, or 0 without an n-gram) and dimension."""
    rows = C.spread(C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", embed.embed()("text").alias("v"))
    return rows.select("conv_id", "turn", F.round(vectors.norm(F.col("v")), 6).alias("length"), F.size("v").alias("dim"))


def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many character n-grams of 3 to 5 each turn has, and how many different ones."""
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[ \t\n\r\f\x0B]+", " ")), F.lit(" "))
    return C.table(spark, sf_dir, "conversations").select("conv_id", "turn", embed.gram_counts(text).alias("g")).select("conv_id", "turn", "g.*")


def pack_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecs(spark, sf_dir).select("vec_id", F.array_join(F.transform(vectors.sign_codes(F.col("embedding")), lambda c: c.cast("string")), ",").alias("codes"))


def unpack_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecs(spark, sf_dir).select("vec_id", F.array_join(F.transform(vectors.bits(vectors.sign_codes(F.col("embedding"))), lambda c: c.cast("string")), "").alias("bits"))


def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecs(spark, sf_dir).select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.array(*map(F.lit, map(float, query_vector(spark, sf_dir))))
    return vecs(spark, sf_dir).select("vec_id", F.round(vectors.dot(F.col("embedding"), query), 6).alias("score"))


_V = "WITH " + C.SQL["vecs"]
_DOT = f"round(list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {QUERY_ID})), 6)"
_TOP = f"ORDER BY score DESC, vec_id LIMIT {K}"


def _top(where: str) -> str:
    return f"{_V} SELECT vec_id, {_DOT} AS score FROM vecs WHERE {where} {_TOP}"



def _list(values: np.ndarray) -> str:
    return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in values) + "]"


def _codec() -> str:
    """The codec in SQL, from the numbers that the codec's rules give: rotated unit vectors u, their codes by width, and what
    a payload stores of them."""
    turn = ", ".join(_list(row) for row in vectors.rotation(DIM))
    parts = [f"rotation AS MATERIALIZED (SELECT [{turn}] AS m)", "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings)", "u AS (SELECT vec_id, e, norm, list_transform(m, lambda r: list_dot_product(r, e) / norm) AS u FROM v, rotation)"]
    for w in vectors.WIDTHS:
        levels, edges = vectors.codebook(w, DIM)
        parts.append(f"c{w} AS (SELECT *, list_transform(codes, lambda c: ({_list(levels)})[c + 1]) AS near FROM (SELECT vec_id, e, u, norm, list_transform(u, lambda x: CAST(len(list_filter({_list(edges)}, lambda b: b < x)) AS INT)) AS codes FROM u))")
        parts.append(f"p{w} AS (SELECT *, sqrt(list_dot_product(near, near)) AS length, list_dot_product(u, near) / sqrt(list_dot_product(near, near)) AS cosine FROM c{w})")
    return "WITH " + ",\n".join(parts)


def _narrowed(old: int) -> str:
    levels, edges = vectors.codebook(2, DIM)
    return f"""SELECT vec_id, 2 AS width, CAST(cosine AS FLOAT)::DOUBLE * list_dot_product(unit, new) / sqrt(list_dot_product(new, new)) AS cosine, codes
FROM (SELECT *, list_transform(codes, lambda c: ({_list(levels)})[c + 1]) AS new FROM (SELECT vec_id, cosine, unit, list_transform(unit, lambda x: CAST(len(list_filter({_list(edges)}, lambda b: b < x)) AS INT)) AS codes
FROM (SELECT vec_id, cosine, list_transform(near, lambda x: x / length) AS unit FROM p{old} WHERE vec_id % 3 = {0 if old == 8 else 1})))"""


CODEC = _codec()
_QUERY = f"(SELECT e FROM v WHERE vec_id = {QUERY_ID})"
_STORED = "CAST(norm AS FLOAT)::DOUBLE * CAST(cosine AS FLOAT)::DOUBLE / CAST(length AS FLOAT)::DOUBLE"
_MOST = f"round(CAST(norm AS FLOAT)::DOUBLE * (SELECT norm FROM v WHERE vec_id = {QUERY_ID}) * (CAST(sqrt(1 - cosine * cosine) AS FLOAT)::DOUBLE * (1 + {vectors.SLACK}) + {vectors.SLACK}), 5)"
_ESTIMATE = f"round(list_dot_product(near, (SELECT u FROM u WHERE vec_id = {QUERY_ID})) * (SELECT norm FROM u WHERE vec_id = {QUERY_ID}) * {_STORED}, 6)"

_BIT = "CASE WHEN embedding[{i}] > 0 THEN 1 ELSE 0 END"
_GRAMS = """WITH t AS (SELECT conv_id, turn, concat(' ', trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), ' ') AS t FROM conversations),
g AS (SELECT conv_id, turn, list_concat(list_concat(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)), list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4))), list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5))) AS g FROM t)
SELECT conv_id, turn, CAST(len(g) AS INT) AS n_grams, CAST(len(list_distinct(g)) AS INT) AS n_distinct FROM g"""

QUERIES = {
    "recall_topk": (topk(), _top("true")),
    "recall_where": (topk(f"label <=> {LABEL} AND agent <=> '{AGENT}'"), _top(f"label = {LABEL} AND agent = '{AGENT}'")),
    "recall_where_expr": (topk("label > 5 AND vec_id % 2 = 1"), _top("label > 5 AND vec_id % 2 = 1")),
    "recall_by": (topk(f"agent = '{AGENT}'"), _top(f"agent = '{AGENT}'")),
    "recall_live": (recall_live, _top(f"label = {LABEL} AND vec_id % 10 <> 7")),
    "recall_batch": (
        recall_batch,
        f"""WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings r WHERE q.vec_id % {EVERY} = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM t WHERE rank <= {K}""",
    ),
    "recall_packed": (recall_packed, _top("true")),
    "packed_bounds": (packed_bounds, CODEC + " UNION ALL ".join(f" SELECT vec_id, {w} AS width, {_MOST} AS most, true AS within FROM p{w}" for w in vectors.WIDTHS)),
    "score_packed": (score_packed, f"{CODEC} SELECT vec_id, {_ESTIMATE} AS score, round(list_dot_product(e, {_QUERY}), 6) AS exact FROM p4"),
    "requantize": (
        requantize,
        f"{CODEC}, n AS ({_narrowed(8)} UNION ALL {_narrowed(4)} UNION ALL SELECT vec_id, 1, CAST(cosine AS FLOAT)::DOUBLE, codes FROM p1 WHERE vec_id % 3 = 2) SELECT vec_id, width, round(CAST(cosine AS FLOAT)::DOUBLE, 4) AS cosine, array_to_string(codes, ',') AS codes FROM n",
    ),
    "encode": (encode, f"{CODEC} SELECT vec_id, " + ", ".join(f"CAST({DIM * w // 8} AS INT) AS bytes_{w}, array_to_string(c{w}.codes, ',') AS codes_{w}" for w in vectors.WIDTHS) + " FROM c1 JOIN c2 USING (vec_id) JOIN c4 USING (vec_id) JOIN c8 USING (vec_id)"),
    "reconstruct": (reconstruct, f"{CODEC} SELECT vec_id, round(cosine, 6) AS cosine, CAST(1.0 AS DOUBLE) AS ratio, CAST({DIM} AS INT) AS dim FROM p2"),
    "codebook": (codebook, f"{CODEC} SELECT code, count(*) AS n, round(({_list(vectors.normal_levels(16))})[code + 1], 6) AS level FROM (SELECT unnest(codes) AS code FROM c4) GROUP BY code"),
    "payload_quarantine": (
        payload_quarantine,
        f"{CODEC} SELECT vec_id, vec_id % 20 NOT IN (3, 6, 9, 12, 15, 18) AS good, CASE WHEN vec_id % 20 NOT IN (3, 6, 9, 12, 15, 18) THEN {_ESTIMATE} END AS score FROM p4",
    ),
    "packed_bytes": (packed_bytes, "SELECT 4 AS width, count(*) AS n, CAST(sum(ceil(len(embedding) * 4 / 8)) AS BIGINT) AS packed, CAST(sum(len(embedding) * 4) AS BIGINT) AS plain FROM embeddings"),
    "embed": (embedded, None),
    "ngram_counts": (ngram_counts, _GRAMS),
    "vector_norm": (norms, "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings"),
    "vector_dot": (dots, f"SELECT vec_id, {_DOT} AS score FROM embeddings"),
    "pack_codes": (pack_codes, "SELECT vec_id, concat_ws(',', " + ", ".join(" + ".join(f"{1 << j} * {_BIT.format(i=8 * k + j + 1)}" for j in range(8)) for k in range(8)) + ") AS codes FROM embeddings"),
    "unpack_codes": (unpack_codes, "SELECT vec_id, concat(" + ", ".join(_BIT.format(i=i + 1) for i in range(64)) + ") AS bits FROM embeddings"),
}
