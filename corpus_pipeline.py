"""A cleaning pipeline over the documents table: each stage takes what its predecessor kept.

Defined cases, of every stage: an empty table gives an empty one; a null or empty text is a document without words, clean,
alone and kept as it is (the mixture gives it no tokens); a null doc_id is passed through; repeated rows are near
duplicates of each other; very long texts are taken whole; all columns but the text that is redacted and its n_chars are
passed through, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, jaccard, mixture, pii, toxicity
from tidewatch.llm.common import kept, scope, table
from tidewatch.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network doesn't reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the lowest doc_id."""
    return jaccard.keep_one_of_each_class(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it, replaced in the texts."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of sources, languages and topics."""
    return mixture.sample_documents(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The final texts' digests: number of ids, the ids and what they decode to."""
    return bpe.bpe_digests(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
    ("bpe", encode_and_decode),
]

#: The stages hold a trained network, a search by sampled paths and a tokenizer: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope():  # a stage's own tables go with it
            docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
