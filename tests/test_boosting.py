"""The boosting of this package against Spark ML's own, and how many jobs it takes."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from salesloom.operators import boosting, features, training


@pytest.fixture(scope="module")
def lines(spark):
    """Lines with ties, nulls and an unknown level, in one partition."""
    k = F.col("id")
    number = lambda m, n: ((k * m) % n).cast("double")
    texts = {c: F.when(k % 13 != i, F.concat(F.lit(c), ((k * (i + 3)) % (i + 2)).cast("string"))) for i, c in enumerate(features.categories_of("profit"))}
    frame = spark.range(0, 3000, 1, 1).select(
        number(37, 211).alias("sales"),
        (number(7, 11) / 100).alias("discount"),
        number(11, 50).alias("quantity"),
        number(53, 97).alias("shipping_cost"),
        number(53, 61).alias("shipping_cost_ratio"),
        number(29, 71).alias("discount_impact"),
        number(31, 83).alias("total_cost_spent"),
        *[t.alias(c) for c, t in texts.items()],
        F.when(k % 17 == 0, "Critical").when(k % 5 == 0, "High").when((k * 37) % 211 > 90, "Low").otherwise("Medium").alias("named"),
    )
    return frame.withColumns(
        {
            "profit_amount": F.col("sales") * (1 - 3 * F.col("discount")) - F.col("shipping_cost"),
            "profit_class": F.when(F.col("sales") > F.col("quantity") * 2, 1.0).otherwise(0.0),
            "urgency": F.col("named").isin("Critical", "High").cast("double"),
            "priority": features.label_priority4("named").cast("double"),
        }
    ).localCheckpoint()


def of_spark(task, rows, encoder, trees):
    """What Spark ML fits on the same vectors, one model per target."""
    ready = encoder.vectors(rows).select("features", "label")
    if task == "profit_amount":
        return [training._boosted(GBTRegressor, training.PROFIT_PARAMS, trees).fit(ready)]
    if task != "priority":
        return [training._boosted(GBTClassifier, training.PROFIT_PARAMS, trees).fit(ready)]
    weights = features.class_weights(ready, "label").select("label", "weight")
    ready = ready.join(F.broadcast(weights), "label")
    return [
        training._boosted(GBTClassifier, training.PRIORITY_PARAMS, trees, weightCol="weight").fit(ready.withColumn("label", (F.col("label") == k).cast("double")))
        for k in range(4)
    ]


@pytest.mark.parametrize("task", training.TASKS)
@pytest.mark.parametrize("place", ["apart", "jobs"])
def test_margins_equal_those_of_spark(lines, monkeypatch, task, place):
    """On the driver and in jobs, where sums have another order; margins may differ where two splits gain the same but for rounding."""
    if place == "jobs":
        monkeypatch.setattr(boosting, "APART", 0)
        monkeypatch.setattr(boosting, "FEW", 0)
        monkeypatch.setattr(boosting, "CUT", 2)
    rows = lines.select(*features.NUMERIC, *features.categories_of(training.kind_of(task)), F.col(task).alias("label"))
    encoder = features.fit_encoder(rows, training.kind_of(task))
    own = [s for s in training._fit(task, rows, encoder, 4).stages if hasattr(s, "trees")]
    ready = encoder.vectors(rows).select("features")
    for mine, theirs in zip(own, of_spark(task, rows, encoder, 4), strict=True):
        assert mine.treeWeights == theirs.treeWeights and len(mine.trees) == mine.getMaxIter() == 4
        assert mine.trees[0].featureImportances.numNonzeros()
        x, y = margins(mine, ready), margins(theirs, ready)
        if place == "apart" or task.startswith("profit"):
            assert np.mean(np.isclose(x, y, rtol=1e-6, atol=1e-9)) > (0.9 if place == "apart" else 0.5)
        assert np.corrcoef(x, y)[0, 1] > 0.97 and np.std(x) == pytest.approx(np.std(y), rel=0.03)


def margins(model, ready):
    column = model.getRawPredictionCol() if hasattr(model, "getRawPredictionCol") else model.getPredictionCol()
    return np.array([r[0] if isinstance(r[0], float) else r[0][1] for r in model.transform(ready).select(column).collect()])


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup("counted fit", "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted fit"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_jobs_of_a_fit(spark, lines, monkeypatch):
    """A fit of four classes took jobs per level, tree and class; few rows take none for a tree, others one a level."""
    rows = lines.select(*features.NUMERIC, *features.categories_of("priority"), F.col("priority").alias("label"))
    assert jobs_of(spark, lambda: training.train("priority", rows, 4)) < 60
    monkeypatch.setattr(boosting, "FEW", 0)
    assert jobs_of(spark, lambda: training.train("priority", rows, 4)) < 125


def test_generator_is_sparks(spark):
    """Seeds, bags from any offset, and Java's long numbers."""
    jvm = spark._jvm
    random = getattr(getattr(jvm.org.apache.spark.util.random, "XORShiftRandom$"), "MODULE$")
    for seed in (0, 42, 171, -6753137726878686297):
        assert boosting.hashed(seed) == random.hashSeed(seed) & boosting.STATE
        java, longs = jvm.java.util.Random(seed), boosting.longs(seed)
        assert [next(longs) for _ in range(5)] == [java.nextLong() & boosting.STATE for _ in range(5)]
    generator = jvm.org.apache.spark.util.random.XORShiftRandom(43)
    want = [generator.nextDouble() < 0.85 for _ in range(200)]
    assert boosting.drawn(boosting.hashed(43), 0, 200, 0.85).tolist() == want
    assert boosting.drawn(boosting.hashed(43), 71, 100, 0.85).tolist() == want[71:171]


def test_one_row_is_a_leaf(spark, lines):
    """Without a split each tree is a leaf: the label, and then nothing that is left of it."""
    one = lines.limit(1).select(*features.NUMERIC, *features.categories_of("profit"), F.lit(3.5).alias("label"))
    model = training.train("profit_amount", one, 2)
    assert model.pipeline.stages[-1].totalNumNodes == 2
    assert model.transform(one).first()["prediction"] == pytest.approx(3.5)
