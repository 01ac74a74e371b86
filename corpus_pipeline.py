"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, then token ids.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows it is given and returns the columns of ``documents`` (the
last adds the ids). Near-duplicates keep the document with the smallest id of each group.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import ship
from brindle.llm import bpe, common, contamination, linededup, quality, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the given rows' labels, does not reject.

    Null and empty texts score by the bias; null labels are left out; repeated rows are kept or go together; extra columns
    keep their values, whatever their names. Without labels every score is 0.5 and all rows stay; no rows give no rows."""
    ship(spark)
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model, names=("_q_score", "_q_predicted")).where("_q_predicted = 1").select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without later copies of repeated passages of 50 words or more; ``n_chars`` follows.

    Null and empty texts stay as they are; a null doc_id counts as the smallest; of equal passages the one with the smallest
    (doc_id, text hash, line) stays; rows that repeat doc_id and text are cut alike; extra columns keep their values."""
    return linededup.dedup_lines(docs, min_words=50, name="_ld_removed").select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are linked by a similarity of 0.8 or more on sets of five words.

    The smallest doc_id stays, a null one only if there is no other, and of rows that repeat doc_id and text one; texts
    without words, null ones among them, are one group; extra columns keep their values; no rows give no rows."""
    ship(spark)
    return simhash.representatives(docs, width=5, similarity=0.8).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts and items match nothing; repeated rows go together; rows of one doc_id are judged by their own
    text; extra columns keep their values; an empty benchmark drops nothing."""
    ship(spark)
    return contamination.without_leaks(docs, contamination.load(common.table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (little-endian unsigned 32-bit), their number, and whether decoding gives the text back.

    Null and empty texts have no ids and count as decoded; repeated rows encode alike; extra columns are left out."""
    ship(spark)
    encoded = bpe.encode(docs, bpe.load(public_tokenizers.path("byte_bpe_50k.json")))
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return encoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", cut_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("tokens", to_token_ids),
]

#: Learned weights, winnowed hashes and merges are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
