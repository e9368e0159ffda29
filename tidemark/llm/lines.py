"""Line dedup: lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import free_names, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, UPPER.lower())


def _digest(line: Column, min_chars: int) -> Column:
    """128 bits of the key, null for short keys; equal digests are taken as equal keys."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))


def drop_shared_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
) -> DataFrame:
    """``docs`` with columns line_count, dropped_count and kept_text.

    A line's key is found with ``line_key``.  Keys of at least ``min_chars`` code
    points in at least ``min_docs`` different documents lose all their lines,
    except in the largest id that holds them.  The other lines stay in order.

    A null or empty text is one empty line.  Rows with the same id count as one
    document and are cut alike; a row with a null id counts as no document and
    loses every shared line.  Columns of these three names are replaced.
    """
    docs = docs.drop("line_count", "dropped_count", "kept_text")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    # texts are cut and digested once; a document's repeats of a line meet inside the
    # first, map-side half of the distinct count
    held = written(
        docs.select(F.col(id_col).alias("_id"), F.explode(lines).alias("_line"))
        .select("_id", _digest(F.col("_line"), min_chars).alias("_key"))
        .where(F.col("_key").isNotNull()),
        "line-keys",
    )
    shared = (
        held.groupBy("_key")
        .agg(F.count_distinct("_id").alias("_docs"), F.max("_id").alias("_keeper"))
        .where(F.col("_docs") >= min_docs)
    )
    cuts = (
        held.join(shared, "_key")
        .where(F.col("_id").isNull() | (F.col("_id") != F.col("_keeper")))
        .groupBy("_id")
        .agg(F.collect_set("_key").alias("_cut"))
    )
    of_id, cut_name, all_lines, kept_lines = free_names(docs, "_id", "_cut", "_lines", "_kept")
    cuts = cuts.toDF(of_id, cut_name)
    cut = F.coalesce(F.col(cut_name), F.array().cast("array<binary>"))
    kept = F.when(F.size(cut) == 0, F.col(all_lines)).otherwise(
        F.filter(
            all_lines, lambda line: ~F.array_contains(cut, F.coalesce(_digest(line, min_chars), F.lit(b"")))
        )
    )
    # each step is a projection of its own, so that texts are split and filtered once
    return (
        docs.join(cuts, F.col(id_col).eqNullSafe(F.col(of_id)), "left")
        .withColumn(all_lines, lines)
        .withColumn(kept_lines, kept)
        .withColumns(
            {
                "line_count": F.size(all_lines).cast("long"),
                "dropped_count": (F.size(all_lines) - F.size(kept_lines)).cast("long"),
                "kept_text": F.array_join(kept_lines, "\n"),
            }
        )
        .drop(of_id, cut_name, all_lines, kept_lines)
    )


LINE_DEDUP_SQL = r"""
WITH doc AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, lines[i] AS line, i,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM doc)
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM line
  WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.line, l.i, s.keeper IS NOT NULL AND s.keeper <> l.doc_id AS gone
  FROM line l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
