"""Features, labels, class weights and input validation, all as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.numeric import ratio_or_zero
from salesloom.sources.transactions import NUMBERS, PRIORITY_FEATURES, PROFIT_FEATURES

NUMERIC = (
    "sales",
    "discount",
    "quantity",
    "shipping_cost",
    "shipping_cost_ratio",
    "discount_impact",
    "total_cost_spent",
)

# Labels in alphabetical order are the class indices.
PRIORITY_LABELS = ("Critical", "High", "Low", "Medium")
URGENT_LABELS = ("Critical", "High")


def categories_of(kind: str) -> tuple[str, ...]:
    return {"profit": PROFIT_FEATURES, "priority": PRIORITY_FEATURES}[kind]


# --- Derived numbers ------------------------------------------------------


def _with_costs(frame: DataFrame, discount: Column, total) -> DataFrame:
    sales, shipping = F.col("sales").cast("double"), F.col("shipping_cost").cast("double")
    based = frame.withColumns(
        {
            "sales": sales,
            "discount": discount,
            "quantity": F.col("quantity").cast("double"),
            "shipping_cost": shipping,
        }
    )
    return based.withColumns(
        {
            "shipping_cost_ratio": ratio_or_zero("shipping_cost", "sales"),
            "discount_impact": F.col("sales") * F.col("discount"),
        }
    ).withColumn("total_cost_spent", total)


def features_profit(frame: DataFrame) -> DataFrame:
    """Profit models: discount always in percent; cost is shipping plus rebate."""
    discount = F.col("discount").cast("double") / F.lit(100.0)
    return _with_costs(frame, discount, F.col("shipping_cost") + F.col("discount_impact"))


def features_priority(frame: DataFrame) -> DataFrame:
    """Triage: a discount above 1 is in percent; cost is sales plus shipping."""
    raw = F.col("discount").cast("double")
    discount = F.when(raw > 1.0, raw / F.lit(100.0)).otherwise(raw)
    return _with_costs(frame, discount, F.col("sales") + F.col("shipping_cost"))


def features_training(frame: DataFrame) -> DataFrame:
    """Training lines: discount is a fraction already; zero sales give ratio 0."""
    based = _with_costs(frame, F.col("discount").cast("double"), F.col("sales") + F.col("shipping_cost"))
    quotient = F.coalesce(F.try_divide("shipping_cost", "sales"), F.lit(0.0))
    return based.withColumn("shipping_cost_ratio", quotient)


def features_for(kind: str, frame: DataFrame) -> DataFrame:
    return {"profit": features_profit, "priority": features_priority}[kind](frame)


# --- One-hot vocabulary ---------------------------------------------------


def onehot_vocab(frame: DataFrame, categories) -> DataFrame:
    """Levels per feature in order, the first (the base level) left out.

    One pass without multiplying rows: each task keeps the set of levels it sees.
    """
    sets = frame.agg(*[F.collect_set(F.col(c).cast("string")).alias(c) for c in categories])
    rest = lambda c: F.slice(F.array_sort(c), F.lit(2), F.greatest(F.size(c), F.lit(1)))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), rest(F.col(c)).alias("levels")) for c in categories]))
    return sets.select(rows.alias("r")).select("r.feature", F.explode("r.levels").alias("level"))


@dataclass
class Encoder:
    """Ordered vocabulary and scaling of a feature vector."""

    kind: str
    levels: dict[str, list[str]]
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        coded = [f"{c}_{v}" for c in categories_of(self.kind) for v in self.levels.get(c, [])]
        return [*NUMERIC, *coded]

    def numeric(self) -> list[Column]:
        """Scaled numbers; a column the scaler does not know stays as it is."""
        out = []
        for name in NUMERIC:
            value = F.col(name)
            if name in self.scale:
                mean, std = self.scale[name]
                value = (value - F.lit(mean)) / F.lit(std if std else 1.0)
            out.append(value.alias(name))
        return out

    def sizes(self) -> list[int]:
        """Levels of each text column that has elements in the vectors, in their order."""
        return [len(self.levels[c]) for c in categories_of(self.kind) if self.levels.get(c)]

    def coded(self, frame: DataFrame, label: str) -> DataFrame:
        """Scaled numbers, the index of each text's level, the label: what `vectors` holds, not yet one-hot."""
        coded = [c for c in categories_of(self.kind) if self.levels.get(c)]
        out = frame.select(*[v.alias(f"_{n}") for n, v in zip(NUMERIC, self.numeric())], *[F.col(c).cast("string").alias(f"_{c}") for c in coded], label)
        for c in coded:
            out = StringIndexerModel.from_labels(self.levels[c], f"_{c}", f"_at_{c}", handleInvalid="keep").transform(out)
        return out.select(*[f"_{n}" for n in NUMERIC], *[f"_at_{c}" for c in coded], label)

    def vectors(self, frame: DataFrame, numbers: bool = True) -> DataFrame:
        """The frame with its sparse ``features``: scaled numbers, then 0 or 1 per vocabulary entry.

        A level is found by its index in the vocabulary, so the work of a row follows its
        features and not the size of the vocabulary. The base level, unknown values and nulls
        have the index behind the last, which the encoding leaves out.
        """
        coded = [c for c in categories_of(self.kind) if self.levels.get(c)]
        numeric = self.numeric() if numbers else []
        out = frame.select("*", *[v.alias(f"_{n}") for n, v in zip(NUMERIC, numeric)], *[F.col(c).cast("string").alias(f"_{c}") for c in coded])
        helpers = [f"_{n}" for n in (*(NUMERIC if numbers else ()), *coded)]
        if coded:
            texts, places, flags = ([f"{mark}{c}" for c in coded] for mark in ("_", "_at_", "_is_"))
            for c, text, place in zip(coded, texts, places):
                out = StringIndexerModel.from_labels(self.levels[c], text, place, handleInvalid="keep").transform(out)
            out = OneHotEncoder(inputCols=places, outputCols=flags, dropLast=True).fit(out).transform(out)
            helpers += [*places, *flags]
        parts = [f"_{n}" for n in NUMERIC if numbers] + [f"_is_{c}" for c in coded]
        return VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep").transform(out).drop(*helpers)


def read_levels(vocabulary: DataFrame) -> dict[str, list[str]]:
    """The vocabulary as lists in order; the model holds it, whatever its size."""
    levels: dict[str, list[str]] = {}
    for row in sorted(vocabulary.collect()):
        levels.setdefault(row["feature"], []).append(row["level"])
    return levels


def onehot_features(frame: DataFrame, encoder: Encoder) -> DataFrame:
    """One 0/1 column per vocabulary entry, picked from the sparse vectors; for vocabularies of a schema's size."""
    names = encoder.names[len(NUMERIC) :]
    if not names:
        return frame.select()
    flags = encoder.vectors(frame, numbers=False).select(vector_to_array("features").alias("f"))
    return flags.select(*[F.col("f")[k].alias(n) for k, n in enumerate(names)])


# --- Scaling --------------------------------------------------------------


def scaler_stats(frame: DataFrame) -> DataFrame:
    """Mean and population deviation per numeric column, from one pass."""
    cells = []
    for name in NUMERIC:
        cells += [F.avg(name).alias(f"{name}__mean"), F.stddev_pop(name).alias(f"{name}__std")]
    one = frame.agg(*cells)
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("feature"), F.col(f"{n}__mean").alias("mean"), F.col(f"{n}__std").alias("std"))
                for n in NUMERIC
            ]
        )
    )
    return one.select(rows.alias("r")).select("r.feature", "r.mean", "r.std")


def read_scale(stats: DataFrame) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (float(r["mean"]), float(r["std"])) for r in stats.collect() if r["mean"] is not None}


def features_scaled(frame: DataFrame, encoder: Encoder) -> DataFrame:
    return frame.select(*encoder.numeric())


def fit_encoder(frame: DataFrame, kind: str) -> Encoder:
    """Vocabulary and scaler of a feature frame."""
    vocabulary = onehot_vocab(frame, categories_of(kind))
    return Encoder(kind, read_levels(vocabulary), read_scale(scaler_stats(frame)))


# --- Labels and weights ---------------------------------------------------


def label_urgent(priority="order_priority") -> Column:
    return F.col(priority).isin(*URGENT_LABELS).cast("int")


def label_priority4(priority="order_priority") -> Column:
    chain = F.when(F.col(priority) == PRIORITY_LABELS[0], 0)
    for index, label in enumerate(PRIORITY_LABELS[1:], start=1):
        chain = chain.when(F.col(priority) == label, index)
    return chain


def label_profit(profit="profit") -> Column:
    return F.when(F.col(profit) > 0, 1).otherwise(0)


def class_weights(frame: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: lines / (classes * lines of the class)."""
    counts = frame.groupBy(label).agg(F.count(F.lit(1)).alias("line_count"))
    every = Window.partitionBy()  # over one row per class
    whole, classes = F.sum("line_count").over(every), F.count(F.lit(1)).over(every)
    weight = whole.cast("double") / (classes * F.col("line_count")).cast("double")
    return counts.select(label, "line_count", weight.alias("weight"))


# --- Validation -----------------------------------------------------------


def violations(kind: str = "profit") -> Column:
    """Reasons why a record cannot be scored; empty for a valid one."""
    rules = [
        ("sales_not_positive", F.col("sales") <= 0),
        ("discount_out_of_range", (F.col("discount") < 0) | (F.col("discount") > 100)),
        ("quantity_below_one", F.col("quantity") < 1),
        ("shipping_cost_negative", F.col("shipping_cost") < 0),
        # A number that is not one passes no range check.
        *[(f"{c}_not_a_number", F.isnan(F.col(c).cast("double"))) for c in ("sales", "discount", "shipping_cost")],
        *[(f"missing_{c}", F.col(c).isNull()) for c in (*NUMBERS, *categories_of(kind))],
    ]
    return F.array_compact(F.array(*[F.when(failed, F.lit(reason)) for reason, failed in rules]))


def validate(frame: DataFrame, kind: str = "profit") -> DataFrame:
    return frame.withColumn("reasons", violations(kind))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to score, and rejected rows with their reasons."""
    ok = F.size("reasons") == 0
    return checked.where(ok).drop("reasons"), checked.where(~ok)


def validation_report(checked: DataFrame) -> DataFrame:
    """Records per outcome: each reason, and the valid ones."""
    outcome = F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("valid"))).otherwise(F.col("reasons")))
    return checked.select(outcome.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("record_count"))
