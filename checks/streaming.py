"""Drained streams against the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapter as A
from checks.features import _DAILY_KINDS
from checks.metrics import PRED
from checks.registry import ORACLES, query, tidy, tidy_sql
from checks.tables import _RES
from tidemark.operators import drift as Dr
from tidemark.operators.daily import with_activity_type
from tidemark.schema import CATEGORY_COLUMNS, ENTITY_KEYS
from tidemark.session import scratch_folder
from tidemark.streaming import core as C
from tidemark.streaming import late as L
from tidemark.streaming import stateful as St

ORIGIN = "2024-01-01"
QUIET = 7


def _event_stream(spark, sf):
    """The events table as a stream, with the log columns and its event time."""
    schema = A.table(spark, sf, "events").schema
    raw = C.replay_source(spark, sf, schema, pattern="events.parquet").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    kind = F.create_map(*[F.lit(x) for pair in A.TYPES.items() for x in pair])
    return raw.select(
        F.concat(F.lit("M"), (F.col("k") % 3).cast("string")).alias("unit"),
        F.concat(F.lit("P"), (F.floor(F.col("k") / 3) % 2).cast("string")).alias("period"),
        F.col("user_id").alias("entity"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.datediff(F.to_date("ts"), F.lit(ORIGIN).cast("date")).alias("day"),
        F.col("k").cast("long").alias("resource"),
        F.ceil("value").cast("long").alias("clicks"),
        kind[F.col("event_type")].alias("activity_type"),
    )


def _table_stream(spark, path):
    """A written table as one micro-batch, however many files it has."""
    return C.replay_source(spark, path, spark.read.parquet(path).schema, files_per_trigger=None)


_LIMIT = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(
    "i01_i02_streaming_daily",
    "WITH " + A.DAILY + tidy_sql(_DAILY_KINDS, f"daily WHERE TIMESTAMP '2024-01-01' + INTERVAL (day + 1) DAY <= {_LIMIT}"),
)
def streaming_daily(spark, sf):
    return tidy(C.drain(C.stream_daily(_event_stream(spark, sf), ORIGIN), "stream-daily"))


@query(
    "i03_streaming_trailing_totals",
    "WITH " + A.DAILY + f""", w AS (SELECT d.unit, d.period, d.entity, CAST(d.day + o AS BIGINT) AS day, CAST(sum(total_clicks) AS BIGINT) AS clicks_last_7_days, count(*) AS active_days_last_7_days,
      {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}_last_7_days' for c in CATEGORY_COLUMNS)} FROM daily d, range(7) r(o) GROUP BY ALL)
    SELECT * FROM w WHERE TIMESTAMP '2024-01-01' + INTERVAL (day + 1) DAY <= {_LIMIT}""",
)
def streaming_trailing(spark, sf):
    return tidy(C.drain(C.stream_trailing(_event_stream(spark, sf), ORIGIN), "stream-trailing"))


@query(
    "i04_streaming_sessions",
    "WITH " + A.DAILY + f""", g AS (SELECT *, CASE WHEN day - lag(day) OVER w > {QUIET} THEN 1 ELSE 0 END AS cut FROM daily WINDOW w AS (PARTITION BY unit, period, entity ORDER BY day)),
      s AS (SELECT *, sum(cut) OVER (PARTITION BY unit, period, entity ORDER BY day) AS sid FROM g)
    SELECT unit, period, entity, CAST(min(day) AS BIGINT) AS first_day, CAST(max(day) AS BIGINT) AS last_day, CAST(sum(total_clicks) AS BIGINT) AS clicks FROM s GROUP BY unit, period, entity, sid
    HAVING max(day) + {QUIET} <= (SELECT max(day) FROM daily) - 1""",
)
def streaming_sessions(spark, sf):
    return tidy(C.drain(C.stream_sessions(_event_stream(spark, sf), ORIGIN, QUIET), "stream-sessions"))


_BASE = {
    "unit": "s", "period": "s", "entity": "i", "day": "i", "historical_windows_available": "i", "historical_average_clicks": "d",
    "historical_standard_deviation_clicks": "d", "historical_average_active_days": "d", "longest_previous_inactivity_gap": "i",
}


@query("i05_online_baseline", "WITH " + A.FEATURES + tidy_sql(_BASE, "features"))
def online_baseline(spark, sf):
    path = scratch_folder(spark, "rolling")
    A.rolling(spark, sf).write.parquet(path)
    return tidy(C.drain(St.online_baseline(_table_stream(spark, path)), "stream-baseline"))


@query("i06_streaming_cooldown", ORACLES["e16_alert_cooldown"])
def streaming_cooldown(spark, sf):
    path = scratch_folder(spark, "alerts")
    alerts = A.saved_predictions(spark, sf).where("f1_focused_prediction = 1")
    alerts.select(*ENTITY_KEYS, F.col("observation_day").cast("long").alias("observation_day")).write.parquet(path)
    return tidy(C.drain(St.cooldown_stream(_table_stream(spark, path), 6), "stream-cooldown"))


@query("i07_stream_static_enrichment", ORACLES["c01_activity_type_join"])
def enrichment(spark, sf):
    log = _event_stream(spark, sf).drop("activity_type", "event_time")
    return tidy(C.drain(with_activity_type(log, A.resources(spark, sf)), "stream-enriched"))


@query("i08_micro_batch_drift", ORACLES["d44_score_drift"])
def micro_batch(spark, sf):
    p = A.saved_predictions(spark, sf).select("observation_day", "calibrated_output")
    path = scratch_folder(spark, "scores")
    p.where("observation_day = 19").write.parquet(path)
    reference = p.where("observation_day = 10")
    out = C.micro_batch_report(
        _table_stream(spark, path), lambda b: tidy(Dr.score_drift(b, reference, "calibrated_output")), "stream-drift"
    )
    return out.drop("batch_id")


# every seventeenth event arrives two batches after its own five days
_ARRIVAL = "CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5) AS BIGINT) + CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END"


@query(
    "i09_late_rows",
    f"""WITH a AS (SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, dense_rank() OVER (ORDER BY {_ARRIVAL}) - 1 AS batch_id FROM events),
      m AS (SELECT batch_id, max(max(ts)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS wm FROM a GROUP BY batch_id)
    SELECT batch_id, count(*) AS rows, count(*) FILTER (WHERE ts < wm) AS late_rows, CAST(max(CASE WHEN ts < wm THEN epoch(wm) - epoch(ts) END) AS BIGINT) AS most_seconds_behind
    FROM a JOIN m USING (batch_id) GROUP BY batch_id""",
)
def late_rows(spark, sf):
    """Batches arrive one after the other; the stream is stopped and started again for each."""
    folder, inbox = scratch_folder(spark, "late"), scratch_folder(spark, "inbox")
    days = F.floor(F.datediff(F.to_date("ts"), F.lit(ORIGIN).cast("date")) / 5)
    events = A.table(spark, sf, "events").select(
        "event_id",
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("event_time"),
        (days + F.when(F.col("event_id") % 17 == 0, 2).otherwise(0)).alias("arrival"),
    )
    out = None
    for (arrival,) in sorted(events.select("arrival").distinct().collect()):  # a handful of batches
        batch = events.where(F.col("arrival") == arrival).drop("arrival")
        batch.write.mode("append").parquet(inbox)
        out = L.collect_late(C.replay_source(spark, inbox, batch.schema, files_per_trigger=None), folder, "event_time", "1 DAY")
    return tidy(L.late_counts(out, "event_time"))


# ---------------------------------------------------------------- finite streams, closed at their end


def _closed(spark, sf, build, name):
    events, close = C.closable(_event_stream(spark, sf))
    return tidy(C.drain(build(events), name, close=close))


@query("i01_i02_streaming_daily_closed", "WITH " + A.DAILY + tidy_sql(_DAILY_KINDS, "daily"))
def streaming_daily_closed(spark, sf):
    return _closed(spark, sf, lambda events: C.stream_daily(events, ORIGIN), "stream-daily")


@query("i03_streaming_trailing_totals_closed", ORACLES["i03_streaming_trailing_totals"].replace(f"WHERE TIMESTAMP '2024-01-01' + INTERVAL (day + 1) DAY <= {_LIMIT}", ""))
def streaming_trailing_closed(spark, sf):
    return _closed(spark, sf, lambda events: C.stream_trailing(events, ORIGIN), "stream-trailing")


@query("i04_streaming_sessions_closed", ORACLES["i04_streaming_sessions"].replace(f"HAVING max(day) + {QUIET} <= (SELECT max(day) FROM daily) - 1", ""))
def streaming_sessions_closed(spark, sf):
    return _closed(spark, sf, lambda events: C.stream_sessions(events, ORIGIN, QUIET), "stream-sessions")
