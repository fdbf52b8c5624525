"""The SQL of those operators that have some: against the plain versions, and on the test tables against the queries."""

from __future__ import annotations

import brute
import corpus
import pytest
from oracle import connect, of_duckdb, of_spark

from lanewise.llm import queries as Q

DOCS = corpus.texts(5)
ITEMS = corpus.items(DOCS)
PLAIN = {"op2_decontamination": lambda: brute.op2(DOCS, ITEMS), "op9_jaccard_join": lambda: brute.op9(DOCS), "op10_superkmer_dedup": lambda: brute.op10(DOCS)}
COLUMNS = {"op2_decontamination": "doc_id, n_words, n_hit, n_items, items_sha256, contaminated", "op9_jaccard_join": "doc_id, n_shingles, component_id", "op10_superkmer_dedup": "doc_id, n_words, n_removed, kept_sha256"}


@pytest.mark.parametrize("name", PLAIN)
def test_sql_is_the_contract(tmp_path, name):
    con = connect(corpus.write(tmp_path, DOCS, benchmark=ITEMS))
    assert sorted(con.execute(f"SELECT {COLUMNS[name]} FROM ({Q.ORACLE_SQL[name]})").fetchall()) == sorted(PLAIN[name]())


@pytest.mark.parametrize("name", PLAIN)
def test_query_is_the_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert of_spark(Q.QUERIES[name](spark, folder)) == of_duckdb(connect(folder), Q.ORACLE_SQL[name])
