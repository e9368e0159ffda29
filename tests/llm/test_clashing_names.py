"""Tables whose own columns bear the names of temporary ones."""

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lines, quality, simhash, urls
from tidemark.llm.queries import URL_RULES, grades

SF = "/root/testdata/sf0.001"
NAMES = ["_id", "_cut", "_lines", "_kept", "_gone", "_grade", "_of", "_text", "_score", "_match", "_copies", "_copy", "_ID_"]


def with_names(df):
    return df.withColumns({name: F.lit(f"own {name}") for name in NAMES})


def whole(df):
    """Rows with their own columns still there."""
    rows = df.collect()
    assert rows and all(r[name] == f"own {name}" for r in rows for name in NAMES)
    return rows


def test_operators_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = with_names(docs)
    assert len(whole(lines.drop_shared_lines(own))) == docs.count()
    groups = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id")).alias("component_id"))
    assert len(whole(simhash.keep_one(own, groups))) == groups.where("doc_id = component_id").count()
    leaks = docs.where("doc_id % 5 = 0").select("doc_id")
    assert len(whole(decontaminate.drop_leaked(own, leaks))) == docs.count() - leaks.count()
    ratings = grades(spark.read.parquet(f"{SF}/labels.parquet"))
    model = quality.train_quality(own, ratings)
    assert (model.weights == quality.train_quality(docs, ratings).weights).all()
    assert len(whole(quality.score_quality(own, model, 2))) == docs.count()
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert len(whole(urls.filter_urls(with_names(pages), URL_RULES))) == pages.count()


def test_mixing_stage_keeps_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = corpus_pipeline.source_mixing(spark, docs, SF).count()
    assert len(whole(corpus_pipeline.source_mixing(spark, with_names(docs), SF))) == plain
