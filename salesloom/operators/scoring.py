"""Decoding model output, batch scoring, and the discount what-if sweep.

The decoders are column functions of (prediction, probabilities), kept apart
from the models, so any source of probabilities can be decoded.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.numeric import as_column, discount_money, margin_percent, net_status, rounded
from salesloom.operators.features import PRIORITY_LABELS, URGENT_LABELS, categories_of, features_for
from salesloom.operators.training import Model
from salesloom.session import stored
from salesloom.sources.transactions import NUMBERS, PROFIT_FEATURES

# Texts shown with a decision.
URGENT_MESSAGE = "Pesanan ini berisiko tinggi / butuh penanganan segera!"
NORMAL_MESSAGE = "Pesanan reguler — penanganan standar operasional."
PRIORITY_MESSAGES = {
    "Critical": "Pesanan ini KRITIS — butuh penanganan segera / VIP!",
    "High": "Prioritas TINGGI — proses lebih cepat dari standar.",
    "Medium": "Prioritas SEDANG — tangani sesuai alur operasional biasa.",
    "Low": "Prioritas RENDAH — tidak mendesak, bisa dijadwalkan.",
}

# How two-class probabilities spread over the four labels.
SPREAD = {"Critical": ("urgent", 0.4), "High": ("urgent", 0.6), "Medium": ("normal", 0.6), "Low": ("normal", 0.4)}


def _pct(p) -> Column:
    return rounded(as_column(p) * F.lit(100.0), 1)


def decode_profit(prediction, probabilities) -> Column:
    """PROFIT or LOSS with confidence and both probabilities in percent."""
    p, hit = as_column(probabilities), as_column(prediction) == 1
    profit = _pct(F.when(F.size(p) > 1, F.element_at(p, 2)).otherwise(F.array_max(p)))
    return F.struct(
        F.when(hit, "PROFIT").otherwise("LOSS").alias("prediction"),
        hit.alias("is_profit"),
        _pct(F.array_max(p)).alias("confidence"),
        profit.alias("profit_probability"),
        rounded(F.lit(100.0) - profit, 1).alias("loss_probability"),
    )


def decode_amount(estimate) -> Column:
    """Estimated profit and its status, judged before rounding."""
    value = as_column(estimate).cast("double")
    return F.struct(
        rounded(value, 2).alias("estimated_profit"),
        (value > 0).alias("is_profitable"),
        (value == 0).alias("is_break_even"),
        net_status(value).alias("net_status"),
    )


def rule_derived_class(estimate) -> Column:
    """Class stated by the sign of an amount, for when only that is known."""
    value = as_column(estimate).cast("double")
    gain = value > 0
    full, none = F.lit(100.0), F.lit(0.0)
    return F.struct(
        net_status(value).alias("prediction"),
        gain.alias("is_profit"),
        full.alias("confidence"),
        F.lit(True).alias("rule_derived"),
        F.when(gain, full).otherwise(none).alias("profit_probability"),
        F.when(gain, none).otherwise(full).alias("loss_probability"),
    )


def decode_priority2(prediction, probabilities) -> Column:
    """Urgent or Normal from a two-class model."""
    p, hit = as_column(probabilities), as_column(prediction) == 1
    urgent, normal = _pct(F.element_at(p, 2)), _pct(F.element_at(p, 1))
    side = {"urgent": urgent, "normal": normal}
    spread = [c for label, (name, part) in SPREAD.items() for c in (F.lit(label), rounded(side[name] * F.lit(part), 1))]
    return F.struct(
        as_column(prediction).cast("int").alias("prediction"),
        hit.alias("is_urgent"),
        F.when(hit, "Urgent").otherwise("Normal").alias("priority_label"),
        F.when(hit, "urgent").otherwise("normal").alias("urgency"),
        F.when(hit, URGENT_MESSAGE).otherwise(NORMAL_MESSAGE).alias("message"),
        _pct(F.array_max(p)).alias("confidence"),
        urgent.alias("urgent_probability"),
        normal.alias("normal_probability"),
        urgent.alias("priority_score"),
        F.create_map(F.lit("Urgent"), urgent, F.lit("Normal"), normal, *spread).alias("class_probs"),
    )


def _label_at(index: Column) -> Column:
    chain = F.when(index == 0, PRIORITY_LABELS[0])
    for i, label in enumerate(PRIORITY_LABELS[1:], start=1):
        chain = chain.when(index == i, label)
    return chain.otherwise(F.concat(F.lit("Class "), index.cast("string")))


def decode_priority4(prediction, probabilities) -> Column:
    """One of four priorities; urgent is the sum of the two pressing ones."""
    p, index = as_column(probabilities), as_column(prediction).cast("int")
    label = _label_at(index)
    known = index.between(0, len(PRIORITY_LABELS) - 1)
    message = F.lit("")
    for name, text in PRIORITY_MESSAGES.items():
        message = F.when(label == name, text).otherwise(message)
    urgency = F.when(known, F.lower(label)).otherwise("medium")
    pressing = [i for i, name in enumerate(PRIORITY_LABELS) if name in URGENT_LABELS]
    mass = sum((F.coalesce(F.try_element_at(p, F.lit(i + 1)), F.lit(0.0)) for i in pressing), F.lit(0.0))
    urgent = _pct(mass)
    normal = rounded(F.lit(100.0) - urgent, 1)
    shares = F.map_from_entries(F.transform(p, lambda v, i: F.struct(_label_at(i).alias("key"), _pct(v).alias("value"))))
    totals = F.create_map(F.lit("Urgent"), urgent, F.lit("Normal"), normal)
    return F.struct(
        index.alias("prediction"),
        urgency.isin("critical", "high").alias("is_urgent"),
        label.alias("priority_label"),
        urgency.alias("urgency"),
        message.alias("message"),
        _pct(F.array_max(p)).alias("confidence"),
        urgent.alias("urgent_probability"),
        normal.alias("normal_probability"),
        urgent.alias("priority_score"),
        F.map_concat(shares, totals).alias("class_probs"),
    )


def features_used(prediction=None, probabilities=None) -> Column:
    """What a triage decision was based on, rounded for reading."""
    cells = []
    if prediction is not None:
        p = as_column(probabilities)
        cells = [
            as_column(prediction).cast("int").alias("raw_pred"),
            F.transform(p, _pct).alias("raw_proba"),
            F.size(p).alias("n_classes"),
        ]
    return F.struct(
        *cells,
        F.col("sales").cast("double").alias("sales"),
        rounded(F.col("discount") * F.lit(100.0), 2).alias("discount"),
        F.col("quantity").cast("int").alias("quantity"),
        F.col("shipping_cost").cast("double").alias("shipping_cost"),
        rounded("shipping_cost_ratio", 4).alias("shipping_cost_ratio"),
        rounded("discount_impact", 2).alias("discount_impact"),
        rounded("total_cost_spent", 2).alias("total_cost_spent"),
    )


# --- Batch scoring --------------------------------------------------------


def predicted(model: Model, features: DataFrame, prefix: str = "") -> DataFrame:
    """Feature rows with ``prediction`` and, for classes, ``probabilities``."""
    out = model.transform(features)
    if "probability" in out.columns:
        out = out.withColumn(f"{prefix}probabilities", vector_to_array("probability"))
    out = out.withColumnRenamed("prediction", f"{prefix}prediction")
    return out.drop("probability", "rawPrediction")


def score_classify(records: DataFrame, model: Model) -> DataFrame:
    """Transactions with a ``classification`` struct."""
    return _keeping(records, lambda f: predicted(model, f), {"classification": decode_profit("prediction", "probabilities")})


def score_regress(records: DataFrame, model: Model) -> DataFrame:
    """Transactions with a ``regression`` struct."""
    return _keeping(records, lambda f: predicted(model, f), {"regression": decode_amount("prediction")})


def score_combined(records: DataFrame, classifier: Model, regressor: Model) -> DataFrame:
    """Both structs on the same rows."""

    def both(features: DataFrame) -> DataFrame:
        return predicted(regressor, predicted(classifier, features, "class_"), "amount_")

    return _keeping(
        records,
        both,
        {
            "classification": decode_profit("class_prediction", "class_probabilities"),
            "regression": decode_amount("amount_prediction"),
        },
    )


def score_priority(records: DataFrame, model: Model) -> DataFrame:
    """Transactions with a ``triage`` struct and the ``debug`` struct."""
    decode = decode_priority2 if model.task == "urgency" else decode_priority4
    return _keeping(
        records,
        lambda f: predicted(model, f),
        {
            "triage": decode("prediction", "probabilities"),
            "debug": features_used("prediction", "probabilities"),
        },
        kind="priority",
    )


def _keeping(records: DataFrame, score, results: dict[str, Column], kind: str = "profit") -> DataFrame:
    """Score the features of the records and return the records as they came."""
    original = F.struct(*[F.col(c) for c in records.columns]).alias("_record")
    features = features_for(kind, records.select("*", original))
    scored = score(features).select("_record", *[c.alias(n) for n, c in results.items()])
    return scored.select("_record.*", *results)


def with_margin(scored: DataFrame) -> DataFrame:
    """Margin and discount cost of an estimate, as shown next to it."""
    estimate = F.col("regression.estimated_profit")
    return scored.withColumns(
        {
            "margin_pct": margin_percent(estimate, "sales"),
            "discount_cost": discount_money("sales", "discount"),
        }
    )


# --- What-if --------------------------------------------------------------

SWEEP_HIGH = 100
_INPUTS = (*NUMBERS, *PROFIT_FEATURES)


def numbered_inputs(records: DataFrame) -> DataFrame:
    """Each different transaction once, with how often it occurs and an id, written once.

    The id is given when the rows are written, so every later read sees the same one.
    """
    inputs = records.groupBy(*_INPUTS).agg(F.count(F.lit(1)).alias("occurrences"))
    return stored(inputs.withColumn("id", F.monotonically_increasing_id()), "inputs")


def what_if_grid(records: DataFrame, step: int = 1) -> DataFrame:
    """Every transaction at every discount from 0 to 100 percent."""
    sweep = F.explode(F.sequence(F.lit(0), F.lit(SWEEP_HIGH), F.lit(step)))
    moved = records.withColumnRenamed("discount", "given_discount").withColumn("discount_pct", sweep)
    return moved.withColumn("discount", F.col("discount_pct").cast("double"))


def _swept(records: DataFrame, regressor: Model, step: int) -> DataFrame:
    return predicted(regressor, features_for("profit", what_if_grid(records, step)))


def what_if_curve(records: DataFrame, regressor: Model, step: int = 1) -> DataFrame:
    """Projected profit over all transactions at each discount.

    The sweep is summed where it is made: what is shuffled is one row per
    discount and task, not the multiplied transactions.
    """
    rows = _swept(records, regressor, step).groupBy("discount_pct")
    return rows.agg(
        F.count(F.lit(1)).alias("transactions"),
        rounded(F.avg("prediction"), 2).alias("avg_estimated_profit"),
    ).orderBy("discount_pct")


def what_if_best(records: DataFrame, regressor: Model, step: int = 1) -> DataFrame:
    """Per different transaction, the discount with the highest estimate.

    The sweep carries an id and numbers; the texts of a transaction meet its result at the end.
    """
    inputs = numbered_inputs(records)
    best = best_discounts(inputs, regressor, step)
    return inputs.join(best, "id").withColumnRenamed("discount", "given_discount").drop("id")


def best_discounts(inputs: DataFrame, regressor: Model, step: int = 1) -> DataFrame:
    """By id: the lowest discount among those of the highest estimate.

    Inputs are dealt by id before the sweep multiplies them, so that a sweep is reduced in its task. Both
    steps are hash aggregations: equal estimates are first reduced to their lowest
    discount, then the highest estimate wins.
    """
    parts = int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = _swept(inputs.repartition(parts, "id"), regressor, step).select("id", "prediction", "discount_pct")
    lowest = swept.groupBy("id", "prediction").agg(F.min("discount_pct").alias("discount_pct"))
    return lowest.groupBy("id").agg(
        F.max_by("discount_pct", "prediction").alias("best_discount_pct"), rounded(F.max("prediction"), 2).alias("estimated_profit")
    )


# --- Reasons of a decision ------------------------------------------------


def decision_reasons(records: DataFrame, model: Model) -> DataFrame:
    """What each input of a record adds to its own score, the largest effect first: a list of structs per record.

    An input's effect is the score minus the score with that input at its base: the mean
    of the training lines for a number, the base level for a text. All variants of a record
    go through one transform and come together again by the record's id.
    """
    kind = "priority" if model.task in ("urgency", "priority") else "profit"
    inputs = [*NUMBERS, *categories_of(kind)]
    kept = stored(records.withColumn("_id", F.monotonically_increasing_id()), "records")
    base = {name: F.lit(_base_number(model, name, kind)) for name in NUMBERS}
    variant = F.explode(F.array(F.lit(""), *[F.lit(name) for name in inputs])).alias("_without")
    varied = kept.select("_id", *inputs, variant)
    moved = varied.select(
        "_id",
        "_without",
        *[F.when(F.col("_without") != c, F.col(c).cast("double") if c in base else F.col(c)).otherwise(base.get(c, F.lit(None))).alias(c) for c in inputs],
    )
    scored = predicted(model, features_for(kind, moved)).select("_id", "_without", _score_of(model).alias("score"))
    whole = F.max(F.when(F.col("_without") == "", F.col("score")))
    each = [F.max(F.when(F.col("_without") == c, F.col("score"))).alias(f"_{c}") for c in inputs]
    by_record = scored.groupBy("_id").agg(whole.alias("score"), *each)
    effects = F.array(*[F.struct(F.lit(c).alias("input"), (F.col("score") - F.col(f"_{c}")).alias("effect")) for c in inputs])
    larger = lambda x, y: F.when(F.abs(x["effect"]) > F.abs(y["effect"]), -1).when(F.abs(x["effect"]) < F.abs(y["effect"]), 1).otherwise(0)
    ranked = by_record.select("_id", "score", F.array_sort(effects, larger).alias("reasons"))
    return kept.join(ranked, "_id").drop("_id")


def _base_number(model: Model, name: str, kind: str) -> float:
    """Mean of the training lines, as records give the number: profit records have discounts in percent."""
    mean = model.encoder.scale.get(name, (0.0, 1.0))[0]
    return mean * 100.0 if name == "discount" and kind == "profit" else mean


def _score_of(model: Model) -> Column:
    """What is explained: the estimate, or the chance of the last class of two, or of a pressing one of four."""
    if model.task == "profit_amount":
        return F.col("prediction")
    if model.task != "priority":
        return F.element_at("probabilities", 2)
    return sum(F.element_at("probabilities", k + 1) for k, name in enumerate(PRIORITY_LABELS) if name in URGENT_LABELS)


# --- What every score must fulfil -----------------------------------------


def score_checks(scored: DataFrame) -> DataFrame:
    """Lines whose classification is consistent in itself: check, line_count."""
    c, near = F.col("classification"), lambda x, y: F.abs(x - y) < 0.11
    return counted(
        scored,
        {
            "probabilities in range": c["profit_probability"].between(0, 100) & c["loss_probability"].between(0, 100),
            "probabilities add up": near(c["profit_probability"] + c["loss_probability"], F.lit(100.0)),
            "class is the likelier": ((c["profit_probability"] >= 50) == c["is_profit"]) | near(c["profit_probability"], F.lit(50.0)),
            "confidence is the larger": near(c["confidence"], F.greatest(c["profit_probability"], c["loss_probability"])),
            "class named": (c["prediction"] == "PROFIT") == c["is_profit"],
        },
    )


def amount_checks(scored: DataFrame) -> DataFrame:
    """The same of estimates with their margin."""
    r, sign = F.col("regression"), F.signum(F.col("regression.estimated_profit"))
    named = F.when(sign > 0, "PROFIT").when(sign < 0, "LOSS")
    return counted(
        scored,
        {
            "estimate is a number": r["estimated_profit"].isNotNull() & ~F.isnan(r["estimated_profit"]),
            "status follows the sign": (sign == 0) | (r["net_status"] == named),
            "one of the flags": ~(r["is_profitable"] & r["is_break_even"]),
            "margin is a share of sales": F.abs(F.col("margin_pct") - r["estimated_profit"] / F.col("sales") * 100) < 0.01,
        },
    )


def priority_checks(scored: DataFrame) -> DataFrame:
    """The same of triage decisions, of two or four classes."""
    t, p = F.col("triage"), F.col("debug.raw_proba")
    total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
    return counted(
        scored,
        {
            "probabilities in range": F.forall(p, lambda v: v.between(0, 100)),
            "probabilities add up": F.abs(total - 100) < 0.3,
            "class is the likeliest": F.abs(F.element_at(p, t["prediction"] + 1) - F.array_max(p)) < 0.11,
            "sides add up": F.abs(t["urgent_probability"] + t["normal_probability"] - 100) < 0.11,
            "every class has a share": F.size(t["class_probs"]) == 6,
        },
    )


def counted(frame: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows fulfil each condition, from one pass."""
    sums = frame.agg(*[F.count(F.when(holds, 1)).alias(f"_{k}") for k, holds in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"_{k}").alias("line_count")) for k, name in enumerate(checks)])
    return sums.select(F.inline(rows))
