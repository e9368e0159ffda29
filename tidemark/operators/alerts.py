"""Alert de-duplication with a cooldown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cooldown_alerts(alerts: DataFrame, keys: Sequence[str], day: str, cooldown_days: int) -> DataFrame:
    """Keep an alert when the last kept one is ``cooldown_days`` or more ago.

    The rule depends on which earlier alerts were kept, so it folds over the
    ordered distinct days of one entity; those are bounded by course days.
    """
    days = F.array_sort(F.collect_set(F.col(day).cast("int")))
    return alerts.groupBy(*keys).agg(days.alias("days")).select(
        *keys, F.explode(F.aggregate(
            F.col("days"),
            F.array().cast("array<int>"),
            lambda acc, d: F.when(
                F.size(acc) == 0, F.array(d)
            ).when(d - F.try_element_at(acc, F.lit(-1)) >= cooldown_days, F.array_append(acc, d)).otherwise(acc),
        )).alias(day)
    )
