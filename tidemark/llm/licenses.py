"""Licence scan: a trained paragraph classifier confirmed by comparison with templates.

All of it is DataFrame and Spark ML code in the JVM.  Paragraphs (lines) become
sparse vectors of hashed words and word pairs; a multinomial logistic regression
with an ``unknown`` class names a family.  A second, one-variable regression on
held-out rows turns its margin into a calibrated probability of being a licence
text at all, and the word pairs shared with a template confirm the family.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import written

UNKNOWN = "unknown"

# fixed values: customary statements of licence families
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL", "GNU General Public License"),
    ("LGPL", "GNU Lesser General Public License"),
    ("AGPL", "GNU Affero General Public License"),
    ("BSD", "BSD 3-Clause License"),
    ("MPL", "Mozilla Public License"),
    ("CC-BY", "CC BY 4.0"),
    ("CC-BY-SA", "CC BY-SA 4.0"),
    ("CC-BY-NC", "CC BY-NC 4.0"),
    ("CC0", "CC0 1.0 Universal"),
    ("Unlicense", "released into the public domain"),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
]


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, A-Z in lower case; other letters stay in words."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.filter(F.split(plain, " ", -1), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    """Neighbouring words; a single word stands for itself."""
    n = F.size(words)
    return F.when(n < 2, words).otherwise(
        F.zip_with(
            F.slice(words, 1, F.greatest(n - 1, F.lit(0))),
            F.slice(words, 2, F.greatest(n - 1, F.lit(0))),
            lambda a, b: F.concat_ws(" ", a, b),
        )
    )


def shared_part(template: Column, own: Column) -> Column:
    """Share of the statement's word pairs in the paragraph or, from three on, of the paragraph's in the statement."""
    both = F.size(F.array_intersect(template, own))
    return F.greatest(both / F.size(template), F.when(both >= 3, both / F.size(own)).otherwise(0.0))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(family, template, template_pairs), one row for each statement."""
    rows = spark.createDataFrame([(f, t) for f, t in templates], "family string, template string")
    return rows.withColumn("template_pairs", F.array_distinct(pairs_of(words_of(F.col("template")))))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, position, paragraph) of every line that is not blank."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("position", "paragraph")
    ).where(F.btrim("paragraph") != "")


class LicenseModel:
    """A fitted classifier: ``classifier`` and ``calibrator`` are Spark ML models."""

    def __init__(self, hashing, families: list[str], classifier, calibrator):
        self.hashing, self.families = hashing, families
        self.classifier, self.calibrator = classifier, calibrator

    def _featurised(self, rows: DataFrame) -> DataFrame:
        terms = rows.withColumn("_words", words_of(F.col("paragraph"))).withColumn(
            "_terms", F.concat("_words", pairs_of(F.col("_words")))
        )
        return self.hashing.transform(terms).drop("_terms")

    def margins(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the likeliest licence family and its log odds against unknown."""
        scored = self.classifier.transform(self._featurised(rows)).withColumn("_raw", vector_to_array("_rawp"))
        known = F.slice("_raw", 2, len(self.families) - 1)
        best = F.array_max(known)
        return scored.withColumns(
            {
                "family": F.get(F.array(*[F.lit(f) for f in self.families[1:]]), (F.array_position(known, best) - 1).cast("int")),
                "margin": best - F.get("_raw", 0),
            }
        ).drop("_raw", "_rawp", "_features", "_prob", "_pred")

    def probability(self) -> Column:
        """Calibrated probability that a paragraph with ``margin`` is a licence text."""
        slope, offset = float(self.calibrator.coefficients[0]), float(self.calibrator.intercept)
        return 1 / (1 + F.exp(-(F.col("margin") * slope + offset)))


def _variants(templates: DataFrame) -> DataFrame:
    """Each statement as it is, with one word left out, with words around it, and long ones cut in two at each word."""
    whole = templates.select("family", F.col("template").alias("paragraph"))
    words = F.split("template", " ")
    short = templates.select("family", F.posexplode(words).alias("k", "w"), words.alias("ws")).select(
        "family", F.array_join(F.filter("ws", lambda w, i: i != F.col("k")), " ").alias("paragraph")
    )
    around = templates.select(
        "family",
        F.explode(
            F.array(
                F.concat(F.lit("Copyright (c) 2020 the authors. "), "template"),
                F.concat(F.lit("Note: "), "template", F.lit(" See the file for details.")),
                F.upper("template"),
            )
        ).alias("paragraph"),
    )
    cut = templates.select("family", words.alias("ws"), F.explode(F.sequence(F.lit(4), F.greatest(F.size(words) - 4, F.lit(4)))).alias("k"))
    parts = cut.where(F.size("ws") >= 8).select(
        "family",
        F.explode(
            F.array(
                F.array_join(F.slice("ws", 1, F.col("k")), " "),
                F.array_join(F.slice("ws", F.col("k") + 1, F.greatest(F.size("ws") - F.col("k"), F.lit(0))), " "),
            )
        ).alias("paragraph"),
    )
    return whole.unionByName(short).unionByName(around).unionByName(parts)


def train_licenses(
    docs: DataFrame,
    templates=TEMPLATES,
    buckets: int = 1 << 15,
    sample_paragraphs: int = 4000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> LicenseModel:
    """Fit on variants of the templates against a sample of the corpus.

    About ``sample_paragraphs`` paragraphs chosen by hash stand for ``unknown``;
    those that have a third of any template's word pairs, or three pairs of it as
    a third of their own, are left out of the sample.  A quarter of all rows is held out for the calibration.  On an empty
    corpus a few template-free words stand for ``unknown``.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    families = [UNKNOWN, *sorted({f for f, _ in templates})]
    pieces = paragraphs(docs, id_col, text_col)
    count = docs.count()
    share = min(1.0, sample_paragraphs / max(1, 4 * count))
    some = pieces.where(F.pmod(F.xxhash64("doc_id", "position", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    statements = F.array(*[F.array_distinct(pairs_of(words_of(F.lit(t)))) for _, t in templates])
    likeness = (
        some.withColumn("_own", F.array_distinct(pairs_of(words_of(F.col("paragraph")))))
        .where(~F.exists(statements, lambda t: shared_part(t, F.col("_own")) * 3 >= 1))
        .select(F.lit(UNKNOWN).alias("family"), "paragraph")
    )
    spare = spark.createDataFrame([(UNKNOWN, t) for t in ("nothing to see", "lorem ipsum dolor", "one two three")], "family string, paragraph string")
    labels = F.array(*[F.lit(f) for f in families])
    rows = written(
        _variants(table)
        .unionByName(likeness)
        .unionByName(spare)
        .withColumn("label", (F.array_position(labels, F.col("family")) - 1).cast("double"))
        .withColumn("held_out", F.pmod(F.xxhash64("paragraph", F.lit(9)), F.lit(4)) == 0)
        .drop("family"),
        "license-training",
    )
    hashing = HashingTF(inputCol="_terms", outputCol="_features", numFeatures=buckets, binary=True)
    model = LicenseModel(hashing, families, None, None)
    fit = LogisticRegression(
        featuresCol="_features", labelCol="label", predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_rawp",
        family="multinomial", regParam=1e-3, elasticNetParam=0.0, standardization=False, maxIter=40,
    )
    model.classifier = fit.fit(model._featurised(rows.where(~F.col("held_out"))).repartition(4))
    held = model.margins(rows.where("held_out")).select(
        (F.col("label") > 0).cast("double").alias("label"), array_to_vector(F.array("margin")).alias("_margin")
    )
    calibrate = LogisticRegression(featuresCol="_margin", labelCol="label", regParam=1e-2, maxIter=30)
    model.calibrator = calibrate.fit(held)
    return model


def scan_licenses(
    docs: DataFrame,
    model: LicenseModel,
    templates=TEMPLATES,
    min_probability: float = 0.5,
    min_similarity: float = 0.6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, position, family, probability, template, similarity, confirmed) of licence paragraphs.

    ``position`` counts lines from 0.  A paragraph is given when its calibrated
    probability reaches ``min_probability``; ``template`` is the most similar
    statement of the family found, and ``confirmed`` tells whether it shares
    ``min_similarity`` of the statement's word pairs or of its own, so shortened
    and wrapped statements count.  Null, empty and blank
    texts give no rows; rows with a null or repeated id are scanned like others.
    """
    # one row for each family of the fixed templates
    table = F.broadcast(
        template_table(docs.sparkSession, templates)
        .groupBy(F.col("family").alias("_family"))
        .agg(F.sort_array(F.collect_list(F.struct("template", "template_pairs"))).alias("statements"))
    )
    found = (
        model.margins(paragraphs(docs, id_col, text_col))
        .withColumn("probability", model.probability())
        .where(F.col("probability") >= min_probability)
        .join(table, F.col("family") == F.col("_family"))
        .withColumn("_own", F.array_distinct(pairs_of(F.col("_words"))))
    )
    likeness = F.transform(
        "statements",
        lambda s: F.struct(
            shared_part(s["template_pairs"], F.col("_own")).alias("similarity"),
            s["template"].alias("template"),
        ),
    )
    return (
        found.withColumn("_best", F.array_max(likeness))
        .select("doc_id", "position", "family", "probability", "_best.template", "_best.similarity")
        .withColumn("confirmed", F.col("similarity") >= min_similarity)
    )
