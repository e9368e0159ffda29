"""Entity-disjoint holdouts and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ranking import dense_index
from tidemark.session import written


def holdout_overlap(rows: DataFrame, holdout: str, slice_by: str = "observation_day") -> DataFrame:
    """Sizes and entity overlap of every leave-one-out split.

    Each split trains on all other holdouts.  Counts come from one row per
    entity and holdout, so rows are never repeated per split.
    """
    per = rows.groupBy(slice_by, holdout, "entity").agg(F.count(F.lit(1)).alias("n"))
    same = W.partitionBy(slice_by, "entity")
    spread = per.withColumn("elsewhere", F.sum("n").over(same) - F.col("n"))
    tested = spread.groupBy(slice_by, holdout).agg(
        F.sum("n").alias("test_rows"),
        F.count(F.lit(1)).alias("test_entities"),
        F.count_if(F.col("elsewhere") > 0).alias("overlapping_entities"),
        F.sum("elsewhere").alias("removed_rows"),
        F.count_if(F.col("elsewhere") == 0).alias("only_here"),
    )
    totals = per.groupBy(slice_by, "entity").agg(F.sum("n").alias("n")).groupBy(slice_by).agg(
        F.sum("n").alias("all_rows"), F.count(F.lit(1)).alias("all_entities")
    )
    return tested.join(totals, slice_by).select(
        slice_by,
        holdout,
        "test_rows",
        "test_entities",
        (F.col("all_rows") - F.col("test_rows")).alias("training_rows"),
        (F.col("all_entities") - F.col("only_here")).alias("training_entities"),
        "overlapping_entities",
        F.col("overlapping_entities").alias("removed_entities"),
        "removed_rows",
        (F.col("all_rows") - F.col("test_rows") - F.col("removed_rows")).alias("strict_training_rows"),
        (F.col("all_entities") - F.col("test_entities")).alias("strict_training_entities"),
    )


def leave_one_out(rows: DataFrame, holdout: str, value: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of one holdout; strict drops shared entities."""
    test = rows.where(F.col(holdout) == value)
    train = rows.where(F.col(holdout) != value)
    if strict:
        train = train.join(test.select("entity").distinct(), "entity", "left_anti")
    return train, test


def entity_split(
    rows: DataFrame, label: str, test_share: float = 0.2, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``role`` (train/test): whole entities, stratified by any positive, per slice of ``by``."""
    if not 0 < test_share < 1:
        raise ValueError("test_share must be between 0 and 1")
    profile = rows.groupBy(*by, "entity").agg(F.max(F.col(label).cast("int")).alias("stratum"))
    placed = dense_index(profile, ["entity"], [*by, "stratum"], seed)
    role = F.when(F.col("idx") < F.ceil(F.col("group_size") * F.lit(test_share)), "test").otherwise("train")
    return rows.join(placed.select(*by, "entity", role.alias("role")), [*by, "entity"])


def fold_assignment(rows: DataFrame, label: str, folds: int, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Fold 1..k per entity, round-robin within any-positive strata."""
    profile = rows.groupBy(*by, "entity").agg(F.max(F.col(label).cast("int")).alias("stratum"))
    placed = dense_index(profile, ["entity"], [*by, "stratum"], seed)
    return placed.select(*by, "entity", (F.col("idx") % folds + 1).cast("int").alias("fold"))


def fold_classes(rows: DataFrame, folds: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives inside and outside each fold, with a validity flag."""
    inside = (
        rows.join(folds, [*by, "entity"])
        .groupBy(*by, "fold")
        .agg(
            F.count(F.lit(1)).alias("validation_rows"),
            F.sum(F.col(label).cast("long")).alias("validation_positives"),
            F.count_distinct("entity").alias("validation_entities"),
        )
    )
    whole = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing
    )
    out = inside.withColumns(
        {
            "training_rows": F.sum("validation_rows").over(whole) - F.col("validation_rows"),
            "training_positives": F.sum("validation_positives").over(whole) - F.col("validation_positives"),
        }
    )

    def both(n: str, p: str):
        return (F.col(p) > 0) & (F.col(p) < F.col(n))

    return out.withColumn(
        "valid",
        both("validation_rows", "validation_positives") & both("training_rows", "training_positives"),
    )


def grouped_folds(rows: DataFrame, label: str, requested: int = 5, seed: int = 42) -> tuple[DataFrame, int, str | None]:
    """Largest class-valid fold count up to ``requested``.

    Returns the assignment, the count and the reason for any reduction.  Only
    one row per fold reaches the driver.
    """
    if requested < 2:
        raise ValueError("at least two folds are needed")
    for count in range(requested, 1, -1):
        folds = fold_assignment(rows, label, count, seed)
        found = fold_classes(rows, folds, label).select("valid").collect()
        if len(found) == count and all(r.valid for r in found):
            reason = None if count == requested else f"reduced from {requested} to {count}: more folds lacked both classes"
            return folds, count, reason
    raise ValueError("no class-valid entity folds")


def strict_training_folds(
    rows: DataFrame, holdout: str, values: Sequence[str], label: str, requested: int = 5, seed: int = 42
) -> tuple[DataFrame, list[int]]:
    """Folds inside the strict training rows of every left-out holdout of ``values`` at once.

    One row per entity: ``folds`` holds its fold for each value, 0 where it is not
    trained on because a row of it is in that holdout.  Each value has the folds that
    ``grouped_folds`` gives on the rows of ``leave_one_out``, and the largest
    class-valid count up to ``requested``; the counts are returned beside.
    """
    if requested < 2:
        raise ValueError("at least two folds are needed")
    y = F.col(label).cast("int")
    profile = rows.groupBy("entity").agg(
        F.max(y).alias("stratum"), F.count(F.lit(1)).alias("n"), F.sum(y.cast("long")).alias("p"), F.collect_set(holdout).alias("own")
    )
    known = F.array(*[F.lit(v) for v in values])
    trains = profile.select("entity", "stratum", "n", "p", F.posexplode(F.transform(known, lambda v: ~F.array_contains("own", v))).alias("set", "trained"))
    placed = written(
        dense_index(trains.where("trained").drop("trained"), ["entity"], ["set", "stratum"], seed).select("set", "entity", "n", "p", "idx"),
        "training-folds",
    )
    counts: list[int] = [0] * len(values)
    for count in range(requested, 1, -1):
        inside = placed.groupBy("set", (F.col("idx") % count).alias("fold")).agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        found: dict[int, list] = {}
        for r in inside.collect():
            found.setdefault(r["set"], []).append((r.n, r.p))
        for s in [s for s, done in enumerate(counts) if not done]:
            parts = found.get(s, [])
            n, p = sum(a for a, _ in parts), sum(b for _, b in parts)
            if len(parts) == count and all(0 < b < a and 0 < p - b < n - a for a, b in parts):
                counts[s] = count
        if all(counts):
            break
    else:
        raise ValueError("no class-valid entity folds")
    of = F.array(*[F.lit(c) for c in counts])
    fold = (F.col("idx") % of[F.col("set")] + 1).cast("int")
    pairs = placed.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("set", fold.alias("fold")))).alias("m"))
    dense = F.array(*[F.coalesce(F.col("m")[F.lit(s)], F.lit(0)) for s in range(len(values))])
    return pairs.select("entity", dense.alias("folds")), counts


def pattern_folds(rows: DataFrame, label: str, days: Sequence[int], folds: int, seed: int = 42) -> DataFrame:
    """Shared folds over several days: round-robin within label patterns."""
    pattern = F.concat(
        *[
            F.coalesce(F.max(F.when(F.col("observation_day") == d, F.col(label).cast("int"))).cast("string"), F.lit("-"))
            for d in days
        ]
    )
    profile = rows.where(F.col("observation_day").isin(list(days))).groupBy("entity").agg(pattern.alias("stratum"))
    placed = dense_index(profile, ["entity"], ["stratum"], seed)
    # consecutive strata start where the previous one stopped, keeping sizes even
    sizes = placed.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    ahead = W.partitionBy(F.lit(0)).orderBy("stratum").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("stratum", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"))
    return placed.join(starts, "stratum").select(
        "entity", ((F.col("start") + F.col("idx")) % folds + 1).cast("int").alias("fold")
    )


def fold_balance(rows: DataFrame, folds: DataFrame, label: str) -> DataFrame:
    """Squared deviation of positives per day and of sizes; lower is better."""
    per = rows.join(folds, "entity").groupBy("observation_day", "fold").agg(
        F.sum(F.col(label).cast("long")).alias("positives")
    )
    positives = per.groupBy("observation_day").agg(
        F.sum(F.pow("positives", F.lit(2.0))).alias("sq"), F.sum("positives").alias("s"), F.count(F.lit(1)).alias("k")
    ).agg(F.sum(F.col("sq") - F.pow(F.col("s"), F.lit(2.0)) / F.col("k")).alias("positive_deviation"))
    sizes = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("c")).agg(
        (F.sum(F.pow("c", F.lit(2.0))) - F.pow(F.sum("c"), F.lit(2.0)) / F.count(F.lit(1))).alias("size_deviation")
    )
    return positives.withColumn("k", F.lit(1)).join(sizes.withColumn("k", F.lit(1)), "k").select(
        "positive_deviation",
        "size_deviation",
        (F.col("positive_deviation") * 1000 + F.col("size_deviation")).alias("balance_score"),
    )


def prior_scores(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Constant score: the training prevalence."""
    prior = train.agg(F.avg(F.col(label).cast("double")).alias("score")).withColumn("one", F.lit(1))
    return test.withColumn("one", F.lit(1)).join(prior, "one").drop("one")


def common_cohort(rows: DataFrame, days: Sequence[int], keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Rows of entities with exactly one row on each required day."""
    wanted = rows.where(F.col("observation_day").isin([int(d) for d in days]))
    complete = (
        wanted.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("observation_day").alias("d"))
        .where((F.col("n") == len(days)) & (F.col("d") == len(days)))
    )
    return wanted.join(complete.select(*keys), list(keys), "left_semi")
