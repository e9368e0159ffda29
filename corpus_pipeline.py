"""From raw documents to token files: five stages, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, quality, simhash, tokens
from tidemark.llm.queries import grades
from tidemark.llm.registry import table
from tidemark.llm.storage import free_names, written
from tidemark.session import scratch_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Good documents: the classifier gives the best grade at least even odds."""
    model = quality.train_quality(docs, grades(table(spark, sf_dir, "labels")))
    return quality.score_quality(docs, model, least_grade=2).where("selected").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs, simhash.similar_groups(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), window_words=5)
    return decontaminate.drop_leaked(docs, leaks)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded to whole copies (0 to 2)."""
    taken = mixing.mix_sources(docs).taken
    of_id, how_many, copy = free_names(docs, "_id", "_copies", "_copy")
    copies = (
        taken.groupBy("doc_id")
        .agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
        .where(F.col("size") > 0)
        .select(F.col("doc_id").alias(of_id), F.round(F.col("taken") / F.col("size")).cast("int").alias(how_many))
        .where(F.col(how_many) > 0)
    )
    return (
        docs.join(copies, F.col("doc_id").eqNullSafe(F.col(of_id)))
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(how_many))))
        .select(*docs.columns)
    )


def token_planes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; per document its place and a checksum of its ids, read back."""
    path = scratch_folder(spark, "token-files")
    tokens.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    back = tokens.read_token_files(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_planes),
]

# byte-pair encoding and fitted models have no SQL form; tests/llm holds brute-force twins
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
