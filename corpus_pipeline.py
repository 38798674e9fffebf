"""A corpus cleaning pipeline over ``documents``: toxic documents go, one of each group of near copies stays, documents that hold
benchmark items go, secrets are masked, and what is left is encoded.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcquarry.llm import bpe, decontamination, ngram_join, secrets, toxicity
from srcquarry.llm.common import stored, table
from srcquarry.llm.queries import BYTE_BPE
from srcquarry.sources.scratch import delete_paths, noted_tables


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose expected severity reaches the cut go; the model is fitted on the labelled rows of ``documents``."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return ngram_join.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold an item of the benchmark go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; all rows stay."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, lang, source, ids): the token ids of every row, as little-endian 32-bit."""
    return bpe.encoded(docs, BYTE_BPE)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("encoding", encoding_stage),
]
#: Trained models and exact similarity joins are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``.  Of the shared folder it keeps the last stage's table only: what a
    stage wrote on its way, and its input, go as soon as its result is written.

    Every stage takes null and repeated ids, null, empty and very long texts, an empty table and further columns, which all but
    the last one keep; ``n_chars`` is the text's after secrets were masked, whatever column of that name there was.
    """
    docs = table(spark, sf_dir, "documents")
    spent: list[str] = []
    for name, stage in STAGES:
        with noted_tables() as made:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        delete_paths(spark, [*spent, *(p for p in made if p != docs.scratch_path)])
        spent = [docs.scratch_path]
    return docs
