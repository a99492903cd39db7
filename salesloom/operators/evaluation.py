"""Model quality from confusion counts: reports, crosstabs, mean probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.operators.scoring import predicted
from salesloom.operators.training import Model, holdout, training_features
from salesloom.sources.star import Star


def confusion(frame: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per (true, predicted): all that the report needs of the data."""
    return frame.groupBy(F.col(label).alias("truth"), F.col(prediction).alias("guess")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _or_zero(top, bottom):
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def classification_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then the averages.

    ``accuracy`` carries the accuracy in its f1 column, as the usual printout
    does; classes that were only predicted count with support 0.
    """
    hits = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
    truth = counts.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(hits).alias("hits"))
    guess = counts.groupBy(F.col("guess").alias("class")).agg(F.sum("n").alias("guessed"))
    joined = truth.join(guess, "class", "full").select(
        "class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "hits", "guessed")]
    )
    precision, recall = _or_zero(F.col("hits"), F.col("guessed")), _or_zero(F.col("hits"), F.col("support"))
    scored = joined.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1_score",
        _or_zero(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )
    metrics = ["precision", "recall", "f1_score"]
    per_class = scored.select(F.col("class").cast("string").alias("class"), *metrics, "support")
    whole = scored.agg(
        F.sum("support").alias("support"),
        F.sum("hits").alias("hits"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[_or_zero(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in metrics],
    )
    none = F.lit(None).cast("double")
    accuracy = F.struct(
        F.lit("accuracy").alias("class"),
        none.alias("precision"),
        none.alias("recall"),
        _or_zero(F.col("hits"), F.col("support")).alias("f1_score"),
        F.col("support"),
    )
    averages = [
        F.struct(F.lit(f"{kind} avg").alias("class"), *[F.col(f"{kind}_{m}").alias(m) for m in metrics], F.col("support"))
        for kind in ("macro", "weighted")
    ]
    summary = whole.select(F.explode(F.array(accuracy, *averages)).alias("r")).select("r.*")
    return per_class.unionByName(summary)


def prediction_counts(frame: DataFrame, prediction: str = "prediction") -> DataFrame:
    return frame.groupBy(prediction).agg(F.count(F.lit(1)).alias("line_count"))


def confusion_crosstab(frame: DataFrame, truth: str, prediction: str, classes: list[int]) -> DataFrame:
    """True value by prediction, one column per class, zero-filled."""
    wide = frame.groupBy(truth).pivot(prediction, classes).agg(F.count(F.lit(1)))
    return wide.select(truth, *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"pred_{c}") for c in classes])


def mean_prob_by_class(frame: DataFrame, truth: str, probabilities: str, classes: int) -> DataFrame:
    means = [F.avg(F.element_at(probabilities, i + 1)).alias(f"prob_{i}") for i in range(classes)]
    return frame.groupBy(truth).agg(*means)


def score_sample(star: Star, model: Model) -> DataFrame:
    """All lines with the true priority, prediction and probabilities."""
    scored = predicted(model, training_features(star, model.task))
    return scored.select("order_priority", F.col("prediction").cast("int").alias("prediction"), "probabilities")


def report_on_star(star: Star, task: str, fit, part: str = "holdout") -> DataFrame:
    """Fit on the training part and report on it or on the held-out part."""
    features = training_features(star, task)
    kept, held = holdout(features)
    model = fit(task, kept)
    judged = model.transform(held if part == "holdout" else kept)
    counts = confusion(judged.select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("guess")), "label", "guess")
    return classification_report(counts)
