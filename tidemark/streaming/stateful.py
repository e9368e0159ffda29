"""Stateful operators: online baselines and alert cooldowns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.schema import ENTITY_KEYS

BASELINE_SCHEMA = T.StructType(
    [
        T.StructField("unit", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("entity", T.LongType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("historical_windows_available", T.LongType()),
        T.StructField("historical_average_clicks", T.DoubleType()),
        T.StructField("historical_standard_deviation_clicks", T.DoubleType()),
        T.StructField("historical_average_active_days", T.DoubleType()),
        T.StructField("longest_previous_inactivity_gap", T.LongType()),
    ]
)
# one list per number, aligned with the entities of the block
_BASELINE_STATE = T.StructType(
    [
        T.StructField("entity", T.ArrayType(T.LongType())),
        T.StructField("count", T.ArrayType(T.LongType())),
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("m2", T.ArrayType(T.DoubleType())),
        T.StructField("mean_days", T.ArrayType(T.DoubleType())),
        T.StructField("longest", T.ArrayType(T.LongType())),
    ]
)
_BLOCK_BITS = 6
_MEASURES = ("window_complete", "clicks_last_7_days", "active_days_last_7_days", "days_since_last_activity")


def _baseline(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emit each day's history, then fold the day into its entity's five running numbers."""
    rows = pd.concat(list(batches)).sort_values("day")
    histories = {entity: numbers for entity, *numbers in zip(*state.get)} if state.exists else {}
    out = []
    for entity, day, complete, clicks, days, gap in zip(*[rows[c].tolist() for c in ("entity", "day", *_MEASURES)]):
        entity = entity if entity == entity else None
        count, mean, m2, mean_days, longest = histories.get(entity, (0, 0.0, 0.0, 0.0, None))
        spread = (m2 / (count - 1)) ** 0.5 if count > 1 else None
        known = count > 0
        out.append((*key[:2], entity, day, count, mean if known else None, spread, mean_days if known else None, longest))
        if complete:
            count += 1
            delta = clicks - mean
            mean += delta / count
            m2 += delta * (clicks - mean)
            mean_days += (days - mean_days) / count
        if gap is not None and gap == gap:
            longest = int(gap) if longest is None else max(longest, int(gap))
        histories[entity] = (count, mean, m2, mean_days, longest)
    state.update((list(histories), *map(list, zip(*histories.values()))))
    frame = pd.DataFrame(out, columns=[f.name for f in BASELINE_SCHEMA])
    frame["longest_previous_inactivity_gap"] = frame["longest_previous_inactivity_gap"].astype("Int64")
    yield frame


def online_baseline(rolling: DataFrame) -> DataFrame:
    """Personal baselines of a stream of rolling rows that arrive in day order.

    A call and a state cost milliseconds however few rows they hold, so up to 64
    entities with neighbouring ids share one.  Blocks are bounded and grow in
    number, not in size.
    """
    block = F.shiftright(F.col("entity").cast("long"), _BLOCK_BITS).alias("block")
    slim = rolling.select("unit", "period", block, "entity", "day", *_MEASURES)
    return slim.groupBy("unit", "period", "block").applyInPandasWithState(
        _baseline, BASELINE_SCHEMA, _BASELINE_STATE, "append", GroupStateTimeout.NoTimeout
    )


_ALERT_SCHEMA = T.StructType(
    [
        T.StructField("unit", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("entity", T.LongType()),
        T.StructField("observation_day", T.LongType()),
    ]
)
_ALERT_STATE = T.StructType([T.StructField("kept", T.LongType())])


def cooldown_stream(alerts: DataFrame, cooldown_days: int = 14) -> DataFrame:
    """Keep an alert when the entity's last kept one is ``cooldown_days`` ago."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for day in sorted(set(pd.concat(list(batches))["observation_day"])):
            if last is None or day - last >= cooldown_days:
                out.append((*key, int(day)))
                last = int(day)
        state.update((last,))
        yield pd.DataFrame(out, columns=[f.name for f in _ALERT_SCHEMA])

    return alerts.select(*ENTITY_KEYS, "observation_day").groupBy(*ENTITY_KEYS).applyInPandasWithState(
        keep, _ALERT_SCHEMA, _ALERT_STATE, "append", GroupStateTimeout.NoTimeout
    )
