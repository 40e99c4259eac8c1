"""A training corpus from raw documents: five stages, each over all that its
predecessor kept.

Language ID, near-duplicate removal, benchmark decontamination, secret
redaction, and byte-level BPE.  ``run`` writes every stage's rows as Parquet to
the shared folder and reads them again for the next one, so a lost executor
costs one stage's tasks and not the whole chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graupel.llm import bpe, decontam, langid, neardup, secrets
from graupel.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; all labelled ones teach."""
    model = langid.train(docs)
    return langid.identify(docs, model, "text", COLUMNS).where("accepted").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs.select(*COLUMNS))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and ``n_chars`` made good."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digests."""
    return bpe.digests(docs, *bpe.public_ranks(), with_ids=True)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmarks),
    ("secret scans", without_secrets),
    ("byte-level BPE", as_tokens),
]

#: No stage but the last could be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
