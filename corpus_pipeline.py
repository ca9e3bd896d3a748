"""A corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of ``documents``, and any other columns that came with them. Empty tables go through all stages; texts of any length
are taken whole. Null and empty texts go in the first stage, as they have no words; rows without a doc_id stay, as no
stage can tell them apart.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldspark.llm import lines, mixing, ngram_join, packing, quality
from fieldspark.llm.common import stored
from fieldspark.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; null and empty texts have too few words. Repeated rows share their verdict."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that another line stands for; n_chars follows the text left.

    Of a component the first line by (doc_id, line number) stays, so repeated rows keep the same lines. Rows without a
    doc_id stay as they are. A document of which no line is left goes.
    """
    kept = lines.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard similarity of 0.8 or more.

    The least doc_id stays, in one row: of repeated rows one, of an id's several texts the one with the least name. Rows
    without a doc_id or without words stay.
    """
    return ngram_join.keep_one(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, none less than once; targets lift rare languages. Rows without a language are weighed by their words alone; repeated rows have equal rates."""
    return mixing.mix(docs, docs.select("doc_id", "lang"), domain="lang", floor=1.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids. Copies that the mixing made, and rows without a doc_id, are packed each on its own."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mix_domains),
    ("packing", packed),
]

#: Shingle joins, MinHash and tokens are beyond SQL here; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
