"""From raw documents to token ids: five stages, each over all that the one before it kept.

Toxic documents go, near-duplicate groups keep their first document, passages that an earlier document has are cut,
documents contaminated by the benchmark go, and what is left is encoded. All stages but the last return the columns
of documents.

Cases: a null text is civil, has no near copy and loses nothing, is clean and has no tokens; it passes all stages.
Of repeated rows one stays if they have words, and all if not; a null doc_id counts as larger than every other. Texts of
any length are judged whole. Equal doc_ids with different texts are different documents. Stages take empty tables and keep
further columns, whatever their names, up to the last, which has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanewise.llm import bpe, decontam, jaccard, superkmers, toxicity
from lanewise.llm._graph import checkpointed
from lanewise.llm.queries import TOKENIZER, table


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect."""
    return jaccard.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word windows that start in a document of smaller doc_id."""
    return superkmers.removed_words(docs, texts=True)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their count, and digests of the ids and of the decoded text."""
    return bpe.encoded(docs, TOKENIZER, tokens=True).drop("decoded")


STAGES = [
    ("toxicity", keep_civil),
    ("ngram_jaccard_join", keep_first_of_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", keep_uncontaminated),
    ("bpe_encoding", encode),
]

#: The toxicity model and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are checkpointed for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
