"""Each stage of the pipeline on its own input, held against the plain versions."""

from __future__ import annotations

import brute
import corpus
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from lanewise.llm import queries as Q
from lanewise.llm import toxicity

DOCS = corpus.texts(3)
ITEMS = corpus.items(DOCS)
LABELS = [(i, 0, int(k % 5 == 0)) for k, (i, _) in enumerate(DOCS)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return corpus.write(tmp_path_factory.mktemp("tables"), DOCS, LABELS, ITEMS)


def docs_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_names():
    assert [name for name, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]


def test_stages(spark, folder, tmp_path):
    whole = Q.table(spark, folder, "documents")
    stages = dict(P.STAGES)

    def stage(name, df):
        out = stages[name](spark, df, folder)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    civil = stage("toxicity", whole)
    wanted = {r.doc_id for r in toxicity.scored(whole, Q.table(spark, folder, "labels")).where("predicted = 0").collect()}
    assert civil.columns == whole.columns and {r.doc_id for r in civil.collect()} == wanted

    # the later stages begin with all documents here, so that what the model rejects makes no difference
    single = stage("ngram_jaccard_join", whole)
    first = {i for i, _, root in brute.op9(DOCS) if i == root}
    assert single.columns == whole.columns and docs_of(single) == sorted(((i, t) for i, t in DOCS if i in first), key=str)

    kept = [(i, t) for i, t in DOCS if i in first]
    cut = stage("substring_dedup", single)
    assert cut.columns == whole.columns
    for (i, n, removed, sha), row in zip(sorted(brute.op10(kept)), sorted(cut.collect(), key=lambda r: r.doc_id)):
        text = dict(kept)[i]
        assert row.doc_id == i and (row.text == text if not removed else brute.sha(row.text.encode()) == sha)
        assert row.n_chars == (None if row.text is None else len(row.text))

    left = [(r.doc_id, r.text) for r in cut.collect()]
    clean = stage("benchmark_decontamination", cut)
    bad = {x[0] for x in brute.op2(left, ITEMS) if x[-1]}
    assert bad and clean.columns == whole.columns and docs_of(clean) == sorted(((i, t) for i, t in left if i not in bad), key=str)

    codes = stage("bpe_encoding", clean)
    assert tokens_of(codes) == encoded(docs_of(clean))


def tokens_of(df):
    return sorted(((r.doc_id, r.n_tokens, list(r.ids), r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def encoded(docs):
    """What the tokenizer itself gives for these documents."""
    tool = Tokenizer.from_file(Q.TOKENIZER)
    tool.no_truncation()
    tool.no_padding()
    out = []
    for i, text in docs:
        ids = tool.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), ids, brute.sha(",".join(map(str, ids)).encode()), brute.sha(tool.decode(ids, skip_special_tokens=False).encode())))
    return sorted(out, key=str)


def cut(docs):
    """The texts without words of windows that start in a document of smaller doc_id; others as they are."""
    first, out = {}, []
    split = [(i, t, brute.SPACED.findall((t or "").encode())) for i, t in docs]
    for i, _, w in split:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(i, first.get(g, i))
    for i, t, w in split:
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out.append((i, b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else t))
    return out


def test_run(spark, folder):
    """All stages against plain ones; which documents are toxic is the model's word."""
    civil = {r.doc_id for r in toxicity.scored(Q.table(spark, folder, "documents"), Q.table(spark, folder, "labels")).where("predicted = 0").collect()}
    docs = [(i, t) for i, t in DOCS if i in civil]
    first = {i for i, _, root in brute.op9(docs) if i == root}
    docs = cut([(i, t) for i, t in docs if i in first])
    bad = {x[0] for x in brute.op2(docs, ITEMS) if x[-1]}
    want = encoded([(i, t) for i, t in docs if i not in bad])
    assert tokens_of(P.run(spark, folder)) == want and len(want) > 20


def test_stages_with_repeated_rows_and_null_ids(spark, tmp_path):
    docs = [(1, "a b c d e f g " * 40), (1, "a b c d e f g " * 40), (None, "a b c d e f g " * 40), (None, None), (None, None), (2, "x"), (2, "y"), (None, "")]
    folder = corpus.write(tmp_path, docs, [(2, 1, 0)], [(1, "nothing of these")])
    whole = Q.table(spark, folder, "documents")
    left = {name: sorted(((r.doc_id, r.text) for r in stage(spark, whole, folder).collect()), key=str) for name, stage in P.STAGES[:-1]}
    everything = sorted(docs, key=str)
    assert left["toxicity"] == left["benchmark_decontamination"] == everything
    assert left["ngram_jaccard_join"] == sorted([(1, docs[0][1]), (None, None), (None, None), (2, "x"), (2, "y"), (None, "")], key=str)
    assert left["substring_dedup"] == sorted([(1, docs[0][1]), (1, docs[0][1]), (None, ""), (None, None), (None, None), (2, "x"), (2, "y"), (None, "")], key=str)
    assert len(P.STAGES[-1][1](spark, whole, folder).collect()) == len(docs)


def test_empty(spark, tmp_path):
    assert P.run(spark, corpus.write(tmp_path, [])).count() == 0
