"""Fitting the profit and priority models with Spark ML trees."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Normalizer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.operators.boosting import as_model, fit_boosted
from salesloom.operators.features import (
    NUMERIC,
    PRIORITY_LABELS,
    Encoder,
    categories_of,
    class_weights,
    features_profit,
    features_training,
    fit_encoder,
    label_priority4,
    label_profit,
    label_urgent,
)
from salesloom.plans.filters import NO_FILTER, Filter
from salesloom.session import stored
from salesloom.sources.star import Star
from salesloom.sources.transactions import as_fractions, star_transactions

# The tuned hyper-parameters of the two priority models. Spark
# samples features per node where the tuned library samples them per tree.
URGENCY_PARAMS = {"trees": 120, "depth": 5, "rate": 0.08, "sample": 0.85, "features": "0.85", "seed": 42}
PRIORITY_PARAMS = {"trees": 150, "depth": 6, "rate": 0.07, "sample": 0.85, "features": "0.85", "seed": 42}
PROFIT_PARAMS = dict(URGENCY_PARAMS)

TASKS = ("urgency", "priority", "profit_class", "profit_amount")


@dataclass
class Model:
    """A fitted estimator with the encoder its vectors were built by."""

    task: str
    encoder: Encoder
    pipeline: PipelineModel

    def vectors(self, frame: DataFrame) -> DataFrame:
        return with_vector(frame, self.encoder)

    def transform(self, features: DataFrame) -> DataFrame:
        """Adds prediction columns to a frame of features."""
        out = self.pipeline.transform(self.vectors(features)).drop("features")
        if self.task != "priority":
            return out
        shares = vector_to_array("probability")
        likeliest = (F.array_position(shares, F.array_max(shares)) - 1).cast("double")
        return out.withColumn("prediction", likeliest).drop(*[c for k in range(len(PRIORITY_LABELS)) for c in _names(k)], "_pairs", "_shares")


def kind_of(task: str) -> str:
    return "priority" if task in ("urgency", "priority") else "profit"


def with_vector(frame: DataFrame, encoder: Encoder) -> DataFrame:
    return encoder.vectors(frame)


def training_features(star: Star, task: str, flt: Filter = NO_FILTER) -> DataFrame:
    """Feature frame of all lines with the task's label, and a split key."""
    frame = star_transactions(star, flt, extra=("order_key", "row_id", "profit"))
    label = {
        "urgency": label_urgent(),
        "priority": label_priority4(),
        "profit_class": label_profit(),
        "profit_amount": F.col("profit"),
    }[task]
    labelled = frame.withColumn("label", label.cast("double")).where("label IS NOT NULL")
    if kind_of(task) == "profit":
        return features_profit(labelled)
    # The star's records carry percent; triage is fitted on fractions, so that 1 % is not taken for 100 %.
    return features_training(as_fractions(labelled))


def holdout(frame: DataFrame, tenths: int = 2) -> tuple[DataFrame, DataFrame]:
    """Training part and held-out part; all lines of an order, which share its priority, are in one of them."""
    slot = F.pmod(F.xxhash64("order_key"), F.lit(10))
    return frame.where(slot >= tenths), frame.where(slot < tenths)


def _boosted(kind, params: dict, trees: int | None, **columns):
    return kind(
        maxIter=trees or params["trees"],
        maxDepth=params["depth"],
        stepSize=params["rate"],
        subsamplingRate=params["sample"],
        featureSubsetStrategy=params["features"],
        seed=params["seed"],
        **columns,
    )


def _names(index: int) -> tuple[str, str, str]:
    """Prediction, probability and raw columns of the model of one class."""
    return f"_hit_{index}", f"_probability_{index}", f"_raw_{index}"


def _with_trees(kind, model, trees: list, params: dict, encoder: Encoder, spark: SparkSession, **columns):
    return as_model(_boosted(kind, params, len(trees), **columns), model, trees, params["rate"], len(NUMERIC), len(encoder.names), spark)


def _one_against_rest(features: DataFrame, encoder: Encoder, trees: int | None) -> PipelineModel:
    """Boosting is binary: one weighted model per class, their probabilities scaled to add up to one.

    The models are fitted on the same rows, so each job counts for all of them.
    """
    labelled = features.where("label is not null")
    rows = class_weights(labelled, "label").select("label", "weight").collect()  # one row per class
    weights = np.zeros(len(PRIORITY_LABELS))
    for row in rows:
        weights[int(row["label"])] = row["weight"]
    booster = _boosted(GBTRegressor, PRIORITY_PARAMS, trees)
    classes = np.arange(len(PRIORITY_LABELS), dtype=np.float64)
    found = fit_boosted(booster, encoder.coded(labelled, "label"), encoder.sizes(), lambda label: np.where(label == classes[:, None], 1.0, -1.0), True, weights)

    def made(index: int):
        hit, probability, raw = _names(index)
        columns = {"labelCol": "is_class", "weightCol": "weight", "predictionCol": hit, "probabilityCol": probability, "rawPredictionCol": raw}
        return _with_trees(_classifier, GBTClassificationModel, found[index], PRIORITY_PARAMS, encoder, features.sparkSession, **columns)

    with ThreadPoolExecutor(len(found)) as pool:
        models = list(pool.map(inheritable_thread_target(features.sparkSession)(made), range(len(found))))
    pairs = VectorAssembler(inputCols=[_names(k)[1] for k in range(len(models))], outputCol="_pairs")
    shares = VectorSlicer(inputCol="_pairs", outputCol="_shares", indices=[2 * k + 1 for k in range(len(models))])
    return PipelineModel([*models, pairs, shares, Normalizer(inputCol="_shares", outputCol="probability", p=1.0)])


def _classifier(probabilityCol: str = "probability", rawPredictionCol: str = "rawPrediction", **params) -> GBTClassifier:
    return GBTClassifier(**params).setProbabilityCol(probabilityCol).setRawPredictionCol(rawPredictionCol)


def _fit(task: str, features: DataFrame, encoder: Encoder, trees: int | None) -> PipelineModel:
    if task == "priority":
        return _one_against_rest(features, encoder, trees)
    amount = task == "profit_amount"
    params = URGENCY_PARAMS if task == "urgency" else PROFIT_PARAMS
    targets = (lambda label: label[None]) if amount else (lambda label: 2.0 * label[None] - 1.0)
    (found,) = fit_boosted(_boosted(GBTRegressor, params, trees), encoder.coded(features, "label"), encoder.sizes(), targets, not amount)
    kind, model = (GBTRegressor, GBTRegressionModel) if amount else (GBTClassifier, GBTClassificationModel)
    return PipelineModel([_with_trees(kind, model, found, params, encoder, features.sparkSession)])


def _spread(features: DataFrame) -> DataFrame:
    """Fitting passes over its rows many times: they are dealt evenly, once, into files of the advisory size when written."""
    return features.hint("rebalance")


def train(task: str, features: DataFrame, trees: int | None = None) -> Model:
    """Fit one of ``TASKS`` on a labelled feature frame."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    # Vocabulary, scaler, weights and the fit each read the features: the joins
    # behind them run once, and a lost executor costs a read, not a re-join.
    # Boosting cuts its own lineage every few trees in the same folder.
    features = stored(_spread(features.select(*NUMERIC, *categories_of(kind_of(task)), "label")), f"train-{task}")
    encoder = fit_encoder(features, kind_of(task))
    return Model(task, encoder, _fit(task, features, encoder, trees))


def train_on_star(star: Star, task: str, trees: int | None = None, flt: Filter = NO_FILTER) -> Model:
    return train(task, training_features(star, task, flt), trees)


def decision_factors(model: Model, spark: SparkSession) -> DataFrame:
    """Features by importance in the fitted trees, largest first."""
    trees = [s.featureImportances.toArray() for s in model.pipeline.stages if hasattr(s, "featureImportances")]
    weights = sum(trees) / len(trees)
    rows = [(name, float(w)) for name, w in zip(model.encoder.names, weights)]
    frame = spark.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")


# --- Persistence ----------------------------------------------------------


def save_model(model: Model, path: str, spark: SparkSession) -> None:
    """Pipeline, vocabulary and scaler, each a folder under ``path``."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    vocabulary = [(c, v, i) for c, vs in model.encoder.levels.items() for i, v in enumerate(vs)]
    scaler = [(n, m, s) for n, (m, s) in model.encoder.scale.items()]
    for name, rows, schema in (
        ("vocabulary", vocabulary, "feature string, level string, position int"),
        ("scaler", scaler, "feature string, mean double, std double"),
        ("task", [(model.task,)], "task string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> Model:
    task = spark.read.parquet(f"{path}/task").first()["task"]
    levels: dict[str, list[str]] = {}
    for row in spark.read.parquet(f"{path}/vocabulary").orderBy("feature", "position").collect():
        levels.setdefault(row["feature"], []).append(row["level"])
    scale = {r["feature"]: (r["mean"], r["std"]) for r in spark.read.parquet(f"{path}/scaler").collect()}
    return Model(task, Encoder(kind_of(task), levels, scale), PipelineModel.load(f"{path}/pipeline"))
