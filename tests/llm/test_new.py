"""Fill-in-the-middle, collocations and exact dedup, held against plain versions over small tables."""

from __future__ import annotations

import random
from collections import Counter

import brute
import corpus
import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, of_duckdb, of_spark
from pyspark.sql import functions as F

from lanewise.llm import _text as T
from lanewise.llm import collocations, exact, infill
from lanewise.llm import queries as Q

DOCS = corpus.texts(7)
NEW = ["op11_fill_in_middle", "op12_collocations", "op13_exact_dedup"]
INFILL = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
COPIES = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def counted(df, columns):
    return Counter(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("name", NEW)
def test_query_is_the_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert of_spark(Q.QUERIES[name](spark, folder)) == of_duckdb(connect(folder), Q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", NEW)
def test_empty_table(spark, tmp_path, name):
    assert Q.QUERIES[name](spark, corpus.write(tmp_path, [])).collect() == []


def test_infill(spark, tmp_path):
    odd = ["", "a", "é", "<P>", "x <S> y", "<M", "a<P", "<<<>>>", "S>P>M>" * 5, "ab1é語😀" * 9, "\n\r\t\0", "łAß" * 40, "<P <S <M " * 30, "word " * 3000]
    docs = DOCS + [(1000 + k, odd[k % len(odd)]) for k in range(400)] + [(None, "no id"), (None, None), (1000, "again"), (1000, "again"), (-5, "below")]
    whole = Q.table(spark, corpus.write(tmp_path, docs), "documents")
    found = counted(infill.digests(whole), INFILL)
    assert found == Counter(brute.op11(docs))
    assert {x[2] for x in found} == {"plain", "psm", "spm"}
    texts = Counter((i, t or "") for i, t in docs)
    back = infill.transformed(whole).select("doc_id", infill.rebuilt(F.col("output"), F.col("form")).alias("text"))
    assert counted(back, ["doc_id", "text"]) == texts


def test_infill_sql(tmp_path):
    con = connect(corpus.write(tmp_path, DOCS))
    assert Counter(con.execute(f"SELECT {', '.join(INFILL)} FROM ({Q.ORACLE_SQL['op11_fill_in_middle']})").fetchall()) == Counter(brute.op11(DOCS))


def test_cuts_of_runs():
    """Every cut of every text, many texts at once, against lists of units."""
    texts = ["", "abc", "a1b22", "é語😀 x", "  ", "ZßZ", "...", "语语abc语"]
    raw, offs = T.strings(pa.array(texts))
    runs = infill.Runs(raw, offs)
    units = [brute.re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert runs.counts().tolist() == [len(u) for u in units]
    for k in range(max(map(len, units)) + 1):
        want = ["".join(u[:k]) for u in units]
        size, chars = runs.cut(np.array([min(k, len(u)) for u in units]))
        assert size.tolist() == [len(w.encode()) for w in want] and chars.tolist() == [len(w) for w in want]


def phrases_of(spark, folder, docs, **how):
    langs, rng = ["en", "de", None, "und"], random.Random(2)
    langs = [rng.choice(langs) for _ in docs]
    whole = Q.table(spark, corpus.write(folder, docs, langs=langs), "documents")
    own = {k: v for k, v in how.items() if k in ("least", "top")}
    return counted(collocations.collocations(whole, **how), PHRASE), Counter(brute.op12([(g, t) for g, (_, t) in zip(langs, docs)], **own))


@pytest.mark.parametrize("how", [{"least": 5}, {"least": 3, "buckets": 8, "marks": 8}, {"least": 4, "top": 3}, {"least": 300}, {"least": 10**6}, {"least": 1, "buckets": 1 << 12}])
def test_collocations(spark, tmp_path, how):
    """Full bitmaps (of 8 bits), a least count beyond a byte, and none that is frequent."""
    docs = DOCS + [(2000 + k, "New York is, as ever: new york!\tNEW  YORK\r\nnot.new york new york new york " * (1 + k % 9)) for k in range(60)]
    found, want = phrases_of(spark, tmp_path, docs, **how)
    assert found == want and (want or how["least"] == 10**6)


def test_collocations_that_a_task_adds_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(T, "PIECE", 500)
    found, want = phrases_of(spark, tmp_path, DOCS, least=4)
    assert found == want and want


def test_scores_beyond_64_bits(spark, monkeypatch):
    """1000 * a * n of large counts, and the floor of its quotient."""
    rows = [("x", "p", 1, 3 * 10**9 + 1), ("x", "q", 1, 3 * 10**9), ("x", "p q", 2, 10**9 + 7)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, size int, n long")
    monkeypatch.setattr(collocations, "frequent", lambda *a: (phrases, spark.createDataFrame([("x", 7 * 10**15 + 3)], "lang string, words long")))
    assert [r.score for r in collocations.collocations(phrases).collect()] == [1000 * (10**9 + 7) * (7 * 10**15 + 3) // ((3 * 10**9 + 1) * 3 * 10**9)]


def test_exact(spark, tmp_path):
    docs = DOCS + [(i, t) for i, t in DOCS[:20]] + [(None, None), (None, ""), (None, "only without id"), (None, "only without id"), (7000, "tie"), (7000, "tie"), (6999, "tie"), (-1, "Tie")]
    whole = Q.table(spark, corpus.write(tmp_path, docs), "documents")
    assert counted(exact.removed_copies(whole), COPIES) == Counter(brute.op13(docs))
    kept = exact.unique_rows(whole.withColumn("key", F.lit(1)).withColumn("#row2", F.lit(2)))
    assert kept.columns == [*whole.columns, "key", "#row2"]
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter((i, t or "") for i, t in {(x[1], next(t or "" for j, t in docs if brute.sha((t or "").encode()) == x[4])) for x in brute.op13(docs)})


@pytest.mark.parametrize("weak", [lambda t: F.lit(b"\0"), lambda t: F.substring(F.unhex(F.md5(t.cast("binary"))), 1, 1)])
def test_collisions(spark, tmp_path, weak):
    """A hash that all texts have in common, and one of 256 values: bytes decide."""
    whole = Q.table(spark, corpus.write(tmp_path, DOCS), "documents")
    assert counted(exact.removed_copies(whole, weak), COPIES) == Counter(brute.op13(DOCS))
    assert exact.unique_rows(whole, weak).count() == len({t or "" for _, t in DOCS})


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(exact, "CHUNK", 1000)
    docs = spark.range(25_000).selectExpr("CASE WHEN id % 5 > 0 THEN 9L END AS doc_id", "'same' AS text")
    found = counted(exact.removed_copies(docs), COPIES)
    sha = brute.sha(b"same")
    assert found == Counter({(9, 9, 25_000, False, sha): 19_999, (None, 9, 25_000, False, sha): 5_000, (9, 9, 25_000, True, sha): 1})


def test_no_python_in_exact(spark):
    plan = Q.op13_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
