"""Training, calibration and scoring with Spark ML.

Preprocessing is a SQL transformer with fitted constants, so a whole model is
an ordinary persistable ``PipelineModel``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import exact_quantiles
from tidemark.functions.scalars import clamp01, decision, inverse_logit, logit
from tidemark.operators import calibration as Ca
from tidemark.operators.drift import feature_drift, feature_profile, long_features, score_profile
from tidemark.operators.fits import fold_scores
from tidemark.operators.holdout import grouped_folds
from tidemark.operators.thresholds import select_thresholds
from tidemark.schema import CHANGE_FEATURES, check_feature_names
from tidemark.session import cut_lineage, written

MISSING = "missing_indicator__"
METHODS = ("uncalibrated", "sigmoid", "isotonic")
_LABEL, _WEIGHT, _VECTOR = "ml_label", "ml_weight", "ml_features"


@dataclass(frozen=True)
class BaseModel:
    """A fitted pipeline with the names of its transformed features."""

    pipeline: PipelineModel
    inputs: tuple[str, ...]
    names: tuple[str, ...]
    training_rows: int
    iterations: int

    @property
    def classifier(self) -> LogisticRegressionModel:
        return self.pipeline.stages[-1]

    @property
    def coefficients(self) -> list[float]:
        return [float(v) for v in self.classifier.coefficients]

    @property
    def intercept(self) -> float:
        return float(self.classifier.intercept)


def _number(value: float) -> str:
    return f"{value!r}D"


def fit_base_model(
    train: DataFrame, features: Sequence[str], label: str, max_iterations: int = 1000
) -> BaseModel:
    """Median imputation with missing flags, standardising, balanced logistic.

    Statistics come from one aggregation plus exact distributed medians.  The
    penalty equals a unit inverse-regularisation strength on summed losses.
    """
    check_feature_names(list(features))
    y = F.col(label).cast("int")
    sums = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("pos"),
        *[F.count(f).alias(f"n_{f}") for f in features],
        *[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in features],
        *[F.var_pop(F.col(f).cast("double")).alias(f"v_{f}") for f in features],
    ).first()
    n, positives = sums["n"], sums["pos"] or 0
    if positives in (0, n):
        raise ValueError("training rows hold one class only")
    medians = {
        r.feature: r.quantiles[0]
        for r in exact_quantiles(long_features(train, features), ["feature"], "value", (0.5,)).collect()
    }
    parts, names = [], []

    def add(name: str, expression: str, mean: float, variance: float) -> None:
        scale = variance**0.5 if variance > 0 else 1.0
        parts.append(f"(({expression}) - {_number(mean)}) / {_number(scale)} AS `z_{len(names)}`")
        names.append(name)

    for f in features:
        known = sums[f"n_{f}"]
        if known == 0:
            continue
        gap, median, mean = n - known, medians[f], sums[f"m_{f}"]
        filled_mean = (mean * known + median * gap) / n
        filled_variance = (sums[f"v_{f}"] * known + known * gap / n * (mean - median) ** 2) / n
        add(f, f"coalesce(CAST(`{f}` AS DOUBLE), {_number(median)})", filled_mean, filled_variance)
    for f in features:
        share = (n - sums[f"n_{f}"]) / n
        if share > 0:
            add(f"{MISSING}{f}", f"CASE WHEN `{f}` IS NULL THEN 1.0D ELSE 0.0D END", share, share * (1 - share))
    prepare = SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")
    assemble = VectorAssembler(inputCols=[f"z_{i}" for i in range(len(names))], outputCol=_VECTOR)
    weight = F.when(y == 1, F.lit(n / (2.0 * positives))).otherwise(F.lit(n / (2.0 * (n - positives))))
    prepared = assemble.transform(
        prepare.transform(train.select(*features, y.cast("double").alias(_LABEL), weight.alias(_WEIGHT)))
    ).select(_LABEL, _WEIGHT, _VECTOR)
    learner = LogisticRegression(
        featuresCol=_VECTOR,
        labelCol=_LABEL,
        weightCol=_WEIGHT,
        predictionCol="ml_class",
        probabilityCol="ml_probability",
        rawPredictionCol="ml_raw",
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iterations,
        tol=1e-7,
    )
    fitted = learner.fit(prepared)
    return BaseModel(
        PipelineModel(stages=[prepare, assemble, fitted]),
        tuple(features),
        tuple(names),
        n,
        fitted.summary.totalIterations,
    )


def apply_base_model(model: BaseModel | PipelineModel, rows: DataFrame, score: str = "base_model_score", raw: str | None = None) -> DataFrame:
    """Add the positive-class probability, and the raw logit when asked for."""
    pipeline = model.pipeline if isinstance(model, BaseModel) else model
    scored = pipeline.transform(rows)
    columns = [F.col(c) for c in rows.columns]
    if raw is not None:
        columns.append(vector_to_array("ml_raw")[1].alias(raw))
    return scored.select(*columns, vector_to_array("ml_probability")[1].alias(score))


def _one_feature(rows: DataFrame, feature, label: str, penalised: bool) -> LogisticRegressionModel:
    data = VectorAssembler(inputCols=["x"], outputCol=_VECTOR).transform(
        rows.select(feature.alias("x"), F.col(label).cast("double").alias(_LABEL))
    )
    n = data.count() if penalised else 1
    return LogisticRegression(
        featuresCol=_VECTOR,
        labelCol=_LABEL,
        regParam=1.0 / n if penalised else 0.0,
        standardization=False,
        maxIter=1000,
        tol=1e-9,
    ).fit(data)


@dataclass(frozen=True)
class Calibrator:
    """A fitted monotone mapping of scores; apply with :meth:`apply`."""

    method: str
    slope: float = 0.0
    intercept: float = 0.0
    isotonic: DataFrame | None = None  # blocks of the step function

    def apply(self, rows: DataFrame, score: str, out: str = "calibrated_output") -> DataFrame:
        if self.method == "uncalibrated":
            return rows.withColumn(out, F.col(score))
        if self.method in ("sigmoid", "sigmoid_raw"):
            x = logit(F.col(score)) if self.method == "sigmoid" else F.col(score)
            value = inverse_logit(F.lit(self.intercept) + F.lit(self.slope) * x)
            return rows.withColumn(out, clamp01(value))
        return Ca.apply_isotonic(rows, [], score, self.isotonic, out)


def fit_calibrator(method: str, rows: DataFrame, score: str, label: str) -> Calibrator:
    """Sigmoid on clipped logits (or raw scores) or clipped isotonic mapping."""
    if method == "uncalibrated":
        return Calibrator(method)
    if method in ("sigmoid", "sigmoid_raw"):
        x = logit(F.col(score)) if method == "sigmoid" else F.col(score)
        m = _one_feature(rows, x, label, penalised=True)
        return Calibrator(method, float(m.coefficients[0]), float(m.intercept))
    if method == "isotonic":
        return Calibrator(method, isotonic=cut_lineage(Ca.isotonic_blocks(rows, [], score, label)))
    raise ValueError(f"unknown calibration method {method}")


def calibration_line(rows: DataFrame, score: str, label: str) -> tuple[float, float] | None:
    """Intercept and slope of outcome on score logit; None with one class."""
    ends = rows.agg(F.min(label).alias("a"), F.max(label).alias("b")).first()
    if ends.a == ends.b:
        return None
    m = _one_feature(rows, logit(F.col(score)), label, penalised=False)
    return float(m.intercept), float(m.coefficients[0])


def each(work: Sequence, run: Callable, parallel: int = 4) -> list:
    """Run independent fits from a few driver threads, results in order."""
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(run, work))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def out_of_fold_scores(
    rows: DataFrame,
    folds: DataFrame,
    count: int,
    features: Sequence[str],
    label: str,
    score: str = "oof_score",
    raw: str | None = None,
    parallel: int = 4,
) -> tuple[DataFrame, list[BaseModel]]:
    """Score every row once with a model that never saw its entity."""
    assigned = cut_lineage(rows.join(folds, "entity"))

    def run(fold: int) -> tuple[DataFrame, BaseModel]:
        model = fit_base_model(assigned.where(F.col("fold") != fold), features, label)
        return apply_base_model(model, assigned.where(F.col("fold") == fold), score, raw), model

    done = each(range(1, count + 1), run, parallel)
    return union_all([d for d, _ in done]), [m for _, m in done]


def fit_reference(
    rows: DataFrame, label: str, features: Sequence[str] = tuple(CHANGE_FEATURES), folds: int = 5, seed: int = 42
) -> tuple[BaseModel, Calibrator, DataFrame]:
    """Model on all rows, sigmoid of out-of-fold logits, and calibrated OOF rows."""
    assignment, count, _ = grouped_folds(rows, label, folds, seed)
    scored = fold_scores(rows, assignment, count, {"reference": features}, label, rows.columns)
    oof = written(scored.drop("model").withColumnsRenamed({"logit": "oof_raw", "score": "oof_score"}), "reference-scores")
    calibrator = fit_calibrator("sigmoid_raw", oof, "oof_raw", label)
    return fit_base_model(rows, features, label), calibrator, calibrator.apply(oof, "oof_raw")


def save_reference(
    model: BaseModel,
    calibrator: Calibrator,
    path: str,
    version: str,
    rows: DataFrame | None = None,
    score: str = "calibrated_output",
    label: str = "actual_label",
) -> None:
    """Persist the pipeline, the sigmoid in a manifest row, and what monitoring needs.

    With ``rows`` (training rows with their out-of-fold score), the profile of the
    model's features, the profile of the score and the threshold policies are saved
    beside the pipeline as tables.
    """
    from tidemark.schema import RECORD_SCHEMA_VERSION

    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    session = _session()
    session.createDataFrame(
        [(version, RECORD_SCHEMA_VERSION, calibrator.slope, calibrator.intercept, model.training_rows, model.iterations, ",".join(model.inputs))],
        "model_version string, schema_version string, slope double, intercept double, training_rows long, iterations int, features string",
    ).write.mode("overwrite").parquet(f"{path}/manifest")
    if rows is not None:
        tables = {
            "profile": feature_profile(rows, model.inputs),
            "score_profile": score_profile(rows, score),
            "policies": select_thresholds(rows.withColumn("all", F.lit("all")), ["all"], score, label).drop("all"),
        }
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def reference_table(path: str, name: str) -> DataFrame:
    """``profile``, ``score_profile`` or ``policies`` of a saved reference model."""
    return _session().read.parquet(f"{path}/{name}")


def reference_drift(rows: DataFrame, path: str) -> DataFrame:
    """Drift of the saved model's features between its training rows and ``rows``."""
    features = reference_table(path, "manifest").first().features.split(",")
    return feature_drift(rows, reference_table(path, "profile"), features)


def apply_policies(rows: DataFrame, path: str, score: str) -> DataFrame:
    """``rows`` once for each saved threshold policy, with threshold_policy, selected_threshold and decision."""
    # five rows at most
    policies = reference_table(path, "policies").select("threshold_policy", F.col("threshold").alias("selected_threshold"))
    entries = F.array_sort(F.collect_list(F.struct("threshold_policy", "selected_threshold")))
    saved = policies.agg(entries.alias("_policies")).withColumn("_one", F.lit(1))
    each_policy = rows.withColumn("_one", F.lit(1)).join(F.broadcast(saved), "_one").withColumn("_p", F.explode("_policies"))
    return each_policy.select(
        *rows.columns, "_p.threshold_policy", "_p.selected_threshold", decision(F.col(score), F.col("_p.selected_threshold")).alias("decision")
    )


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def score_records(records: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Scores of valid records and the rejected records with their error."""
    from tidemark.operators.modeling import check_records
    from tidemark.schema import RECORD_REFERENCE

    manifest = records.sparkSession.read.parquet(f"{path}/manifest").first()
    checked = check_records(records)
    scored = apply_base_model(PipelineModel.load(f"{path}/pipeline"), checked.where("error IS NULL"), "p", "raw")
    calibrator = Calibrator("sigmoid_raw", manifest.slope, manifest.intercept)
    out = calibrator.apply(scored, "raw", "score")
    reference = F.col(RECORD_REFERENCE) if RECORD_REFERENCE in records.columns else F.lit(None).cast("string")
    return (
        out.select(
            reference.alias(RECORD_REFERENCE),
            "score",
            F.lit(manifest.model_version).alias("model_version"),
            F.lit(manifest.schema_version).alias("schema_version"),
        ),
        checked.where("error IS NOT NULL"),
    )


def coefficient_rows(models: Sequence[tuple[dict, BaseModel]]) -> DataFrame:
    """Coefficients with feature names; one small row per model and feature."""
    rows = [
        (*tags.values(), name, name.startswith(MISSING), value)
        for tags, m in models
        for name, value in zip(m.names, m.coefficients)
    ]
    keys = ", ".join(f"{k} int" for k in models[0][0])
    return _session().createDataFrame(
        rows, f"{keys}, feature string, is_missing_indicator boolean, standardized_coefficient double"
    )
