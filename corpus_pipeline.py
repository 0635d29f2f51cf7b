"""A corpus pipeline of five stages over ``documents``; each works on all rows its predecessor kept.

Defined results, for every stage. Null text counts as the empty text where it is scored, compared, measured or encoded, and stays
null in the table. Null doc_id: such rows are scored, never merged with others, pseudonymised, mixed and encoded like others.
Repeated rows: rows equal in doc_id and text are copies, of which one stays when groups are merged; unlike texts under one
doc_id are documents of their own; elsewhere rows are handled each. Ties: of a group the smallest doc_id stays, of copies the
row whose JSON comes first. An empty table gives an empty one, with all columns. Extra columns stay
as they are until the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import bpe_trie, jaccard, mixing, pii, quality
from knotwork.llm.registry import pii_key
from knotwork.runtime import scratch_path
from knotwork.sources.files import Folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them.

    Empty and null texts are scored by their statistics alone. Without usable labels every score is 0.5 and all go.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest id.

    Texts without words, and rows without an id, are near to nothing and stay; so do unlike texts that share an id.
    """
    return jaccard.representatives(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; n_chars follows where a text changes length.

    Null and empty texts stay; a null n_chars stays null.
    """
    out = pii.pseudonymised(docs.withColumn("__was", F.length("text")), pii_key(spark))
    return out.withColumn("n_chars", (F.col("n_chars") + F.coalesce(F.length("text") - F.col("__was"), F.lit(0))).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources as whole documents: a row for each copy that the mix takes, none for those it leaves out.

    The shares of words that the mix takes of a document are rounded to whole copies by a draw from its id; rows that share an id
    get the mean of their shares. Texts without words go, as the mix takes none of them. A null source is a source of its own.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document; null texts have no tokens."""
    return bpe_trie.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True).drop("decoded")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("PII", hide_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Scores, pseudonyms and token ids cannot be expressed in SQL; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read back for the next stage.

    A stage's table is deleted once the next one is written; the last one stays for the reader of the result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.split()[0]}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            Folder(spark, before).delete()
        before = path
    return docs
