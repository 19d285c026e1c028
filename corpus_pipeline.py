"""A corpus pipeline of five stages, each a (spark, docs, sf_dir) -> DataFrame function.

Stages one to four return the columns of ``documents`` for the rows they keep;
the last returns token counts and digests.  Each stage's result is written and
read again before the next, so each works on all that its predecessor kept.
Nulls, empty texts, repeated rows and empty tables are as the operators' own
documentation says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonogrid.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from sonogrid.llm._store import written
from sonogrid.llm.queries import vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language: ``und`` and ambiguous ones go."""
    # under numbers, so that no column clashes with what the operator adds
    carry = [(f"own{i}", F.col(f"`{c}`")) for i, c in enumerate(docs.columns)]
    found = language_id.identify_languages(docs, carry=carry)
    kept = found.where("lang_pred <> 'und' and not ambiguous")
    return kept.select(*[F.col(f"own{i}").alias(c) for i, c in enumerate(docs.columns)])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the least id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by Jaccard similarity of 0.8 on five-word shingles, the one with the least id."""
    classes = ngram_join.jaccard_components(docs, k=5, num=80, den=100)
    gone = written(classes.where("component_id <> doc_id").select("doc_id").distinct())
    few = gone.limit(ngram_join.MAX_BROADCAST_IDS + 1).count() <= ngram_join.MAX_BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens fit the target shares of sources, languages and topics."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded texts."""
    return bpe.encode_documents(docs, vocabulary_path())


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixture), ("bpe", encode)]

#: SQL can express none of the learned stages, so the whole has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
