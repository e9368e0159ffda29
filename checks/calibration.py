"""Calibration per slice: Newton steps and the max-min formula written out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapter as A
from checks.metrics import LABEL, PRED, SCORE, SLICE, rd
from checks.registry import query, tidy
from tidemark.operators import calibration as C

_LOGIT = f"ln(least(greatest({SCORE}, 1e-15), 1 - 1e-15) / (1 - least(greatest({SCORE}, 1e-15), 1 - 1e-15)))"


def newton_sql(by: list[str], penalty: float, source: str = "pred", rounds: int = 24) -> str:
    """``fit`` (keys, n, pos, intercept, slope): plain Newton steps, kept where the last one is tiny."""
    k = ", ".join(by)
    parts = [
        f"ct AS MATERIALIZED (SELECT {k}, {_LOGIT} AS x, count(*) AS n, sum({LABEL}) AS pos FROM {source} GROUP BY ALL)",
        f"tt AS (SELECT {k}, sum(n) AS n, sum(pos) AS pos FROM ct GROUP BY ALL)",
        f"p0 AS (SELECT {k}, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM tt WHERE pos > 0 AND pos < n)",
    ]
    for r in range(1, rounds + 1):
        parts.append(
            f"""p{r} AS MATERIALIZED (SELECT {k}, a, b, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a2, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b2
  FROM (SELECT {k}, any_value(a) AS a, any_value(b) AS b, sum(pos - n * q) AS g0, sum((pos - n * q) * x) - {penalty} * any_value(b) AS g1, sum(n * q * (1 - q)) AS h00, sum(n * q * (1 - q) * x) AS h01, sum(n * q * (1 - q) * x * x) + {penalty} AS h11
    FROM (SELECT ct.*, a, b, 1 / (1 + exp(-(a + b * x))) AS q FROM ct JOIN (SELECT {k}, {'a, b' if r == 1 else 'a2 AS a, b2 AS b'} FROM p{r - 1}) USING ({k})) GROUP BY ALL))"""
        )
    settled = "abs(a2 - a) <= 1e-7 * (1 + abs(a)) AND abs(b2 - b) <= 1e-7 * (1 + abs(b))"
    parts.append(
        f"fit AS (SELECT {k}, n, pos, CASE WHEN {settled} THEN a2 END AS intercept, CASE WHEN {settled} THEN b2 END AS slope FROM tt LEFT JOIN p{rounds} USING ({k}))"
    )
    return ", ".join(parts)


_LINES = PRED + newton_sql(SLICE, 0.0) + f""" SELECT {', '.join(SLICE)}, {rd('intercept', 'calibration_intercept')}, {rd('slope', 'calibration_slope')},
 CASE WHEN pos = 0 OR pos = n THEN '{C.ONE_CLASS}' WHEN slope IS NULL THEN '{C.NOT_CONVERGED}' END AS calibration_diagnostic_warning FROM fit"""


@query("j10_calibration_lines", _LINES)
def calibration_lines(spark, sf):
    return tidy(C.calibration_lines(A.saved_predictions(spark, sf), SLICE, SCORE, LABEL))


_SIGMOID = PRED + newton_sql(SLICE, 1.0) + f""" SELECT {', '.join(SLICE)}, count(*) AS n, {rd('any_value(intercept)', 'intercept')}, {rd('any_value(slope)', 'slope')},
 {rd('avg(o)', 'mean_output')}, {rd(f'avg((o - {LABEL}) * (o - {LABEL}))', 'brier_score')}
 FROM (SELECT p.*, intercept, slope, 1 / (1 + exp(-(intercept + slope * {_LOGIT}))) AS o FROM pred p JOIN fit USING ({', '.join(SLICE)}) WHERE slope IS NOT NULL) GROUP BY {', '.join(SLICE)}"""


@query("j08_sigmoid_mappings", _SIGMOID)
def sigmoid_mappings(spark, sf):
    p = A.saved_predictions(spark, sf).select(*SLICE, SCORE, LABEL)
    fitted = C.sigmoid_mappings(p, SLICE, SCORE, LABEL)
    out = C.apply_sigmoid(p, SLICE, SCORE, fitted, "output").groupBy(*SLICE).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("output").alias("mean_output"),
        F.avg(F.pow(F.col("output") - F.col(LABEL), F.lit(2.0))).alias("brier_score"),
    )
    return tidy(out.join(fitted.select(*SLICE, "intercept", "slope"), SLICE))


def isotonic_sql(by: list[str], source: str = "pred") -> str:
    """``iso`` (keys, s, v): the largest over starts of the smallest mean over ends, for each distinct score."""
    k = ", ".join(by)
    on = " AND ".join(f"a.{c} = b.{c}" for c in by)
    return f"""ic AS (SELECT {k}, {SCORE} AS s, count(*) AS n, sum({LABEL}) AS pos FROM {source} GROUP BY ALL),
iw AS MATERIALIZED (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM ic WINDOW w AS (PARTITION BY {k} ORDER BY s)),
im AS (SELECT {', '.join('a.' + c for c in by)}, a.i AS j, b.i AS i, b.s, min((b.cp - a.cp + a.pos) / CAST(b.cn - a.cn + a.n AS DOUBLE)) OVER (PARTITION BY {', '.join('a.' + c for c in by)}, a.i ORDER BY b.i DESC) AS m FROM iw a JOIN iw b ON {on} AND b.i >= a.i),
iso AS (SELECT {k}, s, max(m) AS v FROM im GROUP BY ALL)"""


@query("j09_isotonic_mappings", PRED + isotonic_sql(SLICE) + f" SELECT {', '.join(SLICE)}, {rd('s', 'score')}, {rd('v', 'output')} FROM iso")
def isotonic_mappings(spark, sf):
    p = A.saved_predictions(spark, sf).select(*SLICE, SCORE, LABEL)
    out = C.apply_isotonic(p.select(*SLICE, F.col(SCORE).alias("score")).distinct(), SLICE, "score", C.isotonic_blocks(p, SLICE, SCORE, LABEL), "output")
    return tidy(out)


# the mapping of day 10, read at the scores of every day: linear between its scores, clipped outside
_READ = PRED + "p10 AS (SELECT * FROM pred WHERE observation_day = 10), " + isotonic_sql(["observation_day"], "p10") + f""",
ask AS (SELECT observation_day, {SCORE} AS x, count(*) AS n FROM pred GROUP BY ALL),
lo AS (SELECT a.observation_day, x, n, l.s AS ls, l.v AS lv FROM ask a ASOF LEFT JOIN iso l ON a.x >= l.s),
hi AS (SELECT a.observation_day, x, ls, lv, n, h.s AS hs, h.v AS hv FROM lo a ASOF LEFT JOIN iso h ON a.x <= h.s)
SELECT observation_day, {rd('x', 'score')}, n, {rd('CASE WHEN ls IS NULL THEN hv WHEN hs IS NULL OR hs = ls THEN lv ELSE lv + (x - ls) / (hs - ls) * (hv - lv) END', 'output')} FROM hi"""


@query("j09_isotonic_mapping_of_one_day", _READ)
def isotonic_mapping_of_one_day(spark, sf):
    p = A.saved_predictions(spark, sf)
    blocks = C.isotonic_blocks(p.where("observation_day = 10"), [], SCORE, LABEL)
    asked = p.groupBy("observation_day", F.col(SCORE).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return tidy(C.apply_isotonic(asked, [], "score", blocks, "output"))
