"""Tables written to the shared folder, so that plans are cut and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import written  # noqa: F401  (part of this module's interface)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` names for temporary columns, lengthened where ``df`` has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    spark: SparkSession = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
