"""A training-data pipeline over the operators of lexicarta.llm.

Each stage takes the documents its predecessor kept and returns the columns of
``documents``; the last returns the encoded corpus.  In every stage, extra columns
pass through whatever their names, repeated rows share one decision, a null
``doc_id`` cannot be named by an operator and so its row stays unless its own text
decides, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.llm import decontaminate, jaccard_join, language_id, pieces, secret_scan
from lexicarta.llm.scratch import Scratch

#: Below this score no language explains a text.
LEAST_SCORE = 0.4
#: So many ids (8 MB) go to every task; more are joined by a shuffle.
MOST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose ``doc_id`` is among ``ids``; rows with a null id stay.

    ``doc_id`` is compared as the whole number that the operators return.
    """
    gone = Scratch(docs.sparkSession, "gone").write(ids.select("doc_id").distinct(), "ids")
    if gone.count() <= MOST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone.withColumnRenamed("doc_id", "gone_id"), docs["doc_id"].cast("long") == F.col("gone_id"), "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no language learnt from the labelled documents: null, without a letter, or explained by none.

    Where no document has a label there is no language to learn and every text goes.  A
    tie goes to the first language; of rows with one id, all go if one does.
    """
    found = language_id.predict(docs, language_id.train(docs))
    return without(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group linked by five-word shingles at Jaccard 0.8.

    Null and wordless texts link with nothing and stay; rows that repeat an id and its
    text stay together.
    """
    found = jaccard_join.jaccard_join(docs, k=5, num=80, den=100)
    return without(docs, found.where("doc_id <> component_id"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, as it is or with other values in its slots.

    Null texts hold none and stay; without benchmark items all stay.
    """
    return without(docs, decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the text and correct ``n_chars``; all documents stay, null texts as nulls."""
    found = secret_scan.redact(secret_scan.scan(docs, secret_scan.train(docs), carry=True))
    text = F.when(F.col("row.text").isNotNull(), F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(text != F.col("row.text"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return found.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with digests of the ids and of their decoding; a null text is an empty one."""
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), output="ids")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("secrets", secret_stage),
    ("encoding", encoding_stage),
]

#: SQL can express neither the language model nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is staged once, for the next reads it more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
