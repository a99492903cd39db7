"""Every operator as a named query over one folder of trade tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.functions.numeric import rounded
from salesloom.functions.text import compact_money, count_text, date_text, day_text, percent_text, profit_level, profit_text
from salesloom.operators import evaluation, features, geography, listings, rollups, scoring, training
from salesloom.plans.bundles import dashboard_summary, region_drilldown, tidy
from salesloom.plans.fact import line_fact
from salesloom.plans.filters import Filter, preset_window
from salesloom.session import scratch_path, stored
from salesloom.sources.export import export_csv, write_star, write_star_tables
from salesloom.sources.star import Star, load_star, load_star_tables
from salesloom.sources.trade import trade_star
from salesloom.sources.transactions import as_fractions, read_transactions, star_transactions
from salesloom.streaming.scoring import score_stream

# Sample parameters of the registered queries.
FILTERED = Filter("1996-01-01", "1998-12-31", "", "APAC")
REGION, COUNTRY, TEXT = "ASIA-0", "NATION_2", "brand#1"
LOW, HIGH, DAY = "1995-01-01", "2001-08-01", "1997-05-28"
QUARTER = "q4_1997"

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


_opened: dict[tuple, Star] = {}


def opened(spark: SparkSession, path: str) -> Star:
    """The star of a folder, opened once per session."""
    key = (id(spark), spark.sparkContext.applicationId, path)
    if key not in _opened:
        _opened[key] = trade_star(spark, path)
    return _opened[key]


def query(name: str):
    def add(function: Callable[[Star], DataFrame]):
        _registry[name] = lambda spark, path: function(opened(spark, path))
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(_registry)


def _add(name: str, function: Callable[[Star], DataFrame]) -> None:
    query(name)(function)


# --- Fact, KPIs and rollups -----------------------------------------------


@query("line_fact")
def _line_fact(star):
    frame = line_fact(star)
    days = {c: day_text(c) for c in ("order_date", "ship_date")}
    money = {c: F.col(c).cast("double") for c in ("sales", "profit", "shipping_cost", "discount")}
    return frame.withColumns({**days, **money})


for _name in (
    "kpi",
    "revenue_by_year",
    "sales_by_category",
    "profit_by_market",
    "top_subcategory",
    "quantity_stats",
    "segment_stats",
    "region_stats",
):
    _add(_name, getattr(rollups, _name))
    _add(f"{_name}_filtered", partial(getattr(rollups, _name), flt=FILTERED))

for _name in (
    "orders_by_shipmode",
    "orders_by_priority",
    "weekly_trend",
    "profit_margin_trend",
    "monthly_sales_trend",
    "profit_histogram",
    "profit_vs_discount",
    "profit_badge_counts",
    "net_status_counts",
    "badge_level_counts",
    "margin_metrics",
):
    _add(_name, getattr(rollups, _name))

for _name in ("drill_subcategories", "drill_segments", "drill_trend", "drill_countries"):
    _add(_name, partial(getattr(rollups, _name), region=REGION))
_add("drill_countries_top1", partial(rollups.drill_countries, region=REGION, limit=1))

_add("segment_share", lambda star: rollups.segment_share(rollups.drill_segments(star, REGION)))
_add("kpi_formatted", lambda star: rollups.kpi_formatted(rollups.kpi(star)))
_add("avg_price_top", lambda star: rollups.avg_price_top(rollups.quantity_stats(star)))
_add("quantity_bubble", lambda star: rollups.quantity_bubble(rollups.quantity_stats(star)))
_add("subcategory_by_quantity", lambda star: rollups.by_metric(rollups.top_subcategory(star), "sub_category", "quantity"))
_add("region_by_quantity", lambda star: rollups.by_metric(rollups.region_stats(star), "region", "quantity"))
_add("segment_by_quantity", lambda star: rollups.by_metric(rollups.segment_stats(star), "segment", "quantity"))
_add("dashboard_summary", lambda star: tidy(dashboard_summary(star, FILTERED)))
_add("region_drilldown", lambda star: tidy(region_drilldown(star, REGION)))


@query("stored_star_kpi")
def _stored_star(star):
    """The star written as five tables once, then queried from them."""
    spark = star.tables["orders"].sparkSession
    path = scratch_path(spark, "star")
    write_star(star, path)
    return rollups.kpi(load_star(spark, path, dated_lines=True), FILTERED)


@query("bucketed_star_region_stats")
def _bucketed_star(star):
    """The star in buckets of the order key, where sums by order exchange no lines."""
    spark = star.tables["orders"].sparkSession
    path = scratch_path(spark, "star")
    prefix = path.rsplit("/", 1)[-1].replace("-", "_")
    write_star_tables(star, path, prefix, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rollups.region_stats(load_star_tables(spark, prefix, dated_lines=True), FILTERED)


# --- Listings -------------------------------------------------------------

_add("orders_listing", listings.orders_listing)
_add("orders_search", partial(listings.orders_listing, text=TEXT))
_add("orders_explorer", partial(listings.orders_listing, text="wid_et%", flt=FILTERED))
_add("orders_page", partial(listings.orders_page, page=1, limit=20))
_add("orders_page_search", partial(listings.orders_page, text=TEXT, page=3, limit=20))
_add("orders_page_filtered", partial(listings.orders_page, page=2, limit=50, flt=FILTERED))
for _kind in ("products", "customers", "locations"):
    _add(f"{_kind}_rollup", getattr(listings, f"{_kind}_rollup"))
    _add(f"join_left_{_kind}", getattr(listings, f"{_kind}_rollup"))
    _add(f"{_kind}_page", partial(getattr(listings, f"{_kind}_page"), page=2, limit=20))
_add("products_search", partial(listings.products_rollup, text="RED"))
_add("customers_search", partial(listings.customers_rollup, text="furni"))
_add("locations_search", partial(listings.locations_rollup, text="asia-1"))
_add("pagination_counts", listings.pagination_counts)
_add("pagination_counts_search", partial(listings.pagination_counts, text=TEXT))
_add("page_info", lambda star: listings.page_info(listings.pagination_counts(star), 2, 20))


@query("orders_far_page")
def _far_page(star):
    frame = listings.orders_listing(star)
    return listings.rows_at(frame, "order_date", 3000, 50, span=100)


@query("products_keyset_page")
def _keyset_page(star):
    """Second page of products, reached from the last row of the first."""
    frame = listings.products_rollup(star)
    first = listings.page_after(frame, "total_profit", None, 20).collect()
    return listings.page_after(frame, "total_profit", first[-1].asDict() if first else None, 20)


@query("customer_texts")
def _customer_texts(star):
    """The customer listing as display text."""
    rows = listings.customers_rollup(star)
    return rows.select(
        "customer_id",
        count_text("total_orders").alias("orders_text"),
        compact_money("total_sales").alias("sales_text"),
        profit_text("total_profit").alias("profit_text"),
        profit_level("total_profit").alias("profit_level"),
        percent_text("avg_discount").alias("discount_text"),
    )


@query("order_date_texts")
def _order_date_texts(star):
    from salesloom.plans.fact import headers

    rows = headers(star, ["order_date", "ship_date"])
    texts = rows.select(date_text("order_date").alias("order_day"), date_text("ship_date").alias("ship_day"))
    return texts.groupBy("order_day", "ship_day").agg(F.count(F.lit(1)).alias("order_count"))


@query("export_csv")
def _export(star):
    rows = listings.customers_rollup(star)
    spark = rows.sparkSession
    path = scratch_path(spark, "csv")
    export_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


# --- Geography ------------------------------------------------------------

_add("country_catalog", geography.country_catalog)
_add("market_countries", lambda star: geography.listed_out(geography.market_countries(star), "market", "countries", "country"))
_add(
    "category_hierarchy",
    lambda star: geography.listed_out(geography.category_hierarchy(star), "category", "sub_categories", "sub_category"),
)
_add("country_highlight", partial(geography.country_highlight, flt=FILTERED))
_add("country_lines", partial(geography.country_lines, country=COUNTRY))
_add("country_stats", partial(geography.country_stats, country=COUNTRY, window=preset_window("all", LOW, HIGH)))
_add("country_day_stats", partial(geography.country_stats, country=COUNTRY, day=DAY))
_add("country_q4_stats", partial(geography.country_stats, country=COUNTRY, window=preset_window(QUARTER, LOW, HIGH)))
_add("country_empty_stats", partial(geography.country_stats, country="NOWHERE"))
_add("country_shipmode", partial(geography.country_shipmode, country=COUNTRY, window=preset_window("all", LOW, HIGH)))
_add("country_shipmode_q4", partial(geography.country_shipmode, country=COUNTRY, window=preset_window(QUARTER, LOW, HIGH)))
_add("step_day", partial(geography.stepped_days, delta=7, low="1996-01-01", high="1998-12-31"))

# --- Transactions, features, labels ---------------------------------------


@query("read_transactions")
def _read_transactions(star):
    records = star_transactions(star)
    spark = records.sparkSession
    path = scratch_path(spark, "json")
    records.write.json(path)
    read = read_transactions(spark, path, "profit", "json")
    return read.groupBy("segment", "ship_mode").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum("quantity").alias("quantity"),
        rounded(F.sum("sales"), 2).alias("sales"),
        rounded(F.avg("discount"), 4).alias("avg_discount"),
    )


def _fractions(star: Star) -> DataFrame:
    return as_fractions(star_transactions(star))


def _profit_features(star: Star) -> DataFrame:
    return features.features_profit(star_transactions(star))


_add("features_profit", lambda star: _profit_features(star).select(*features.NUMERIC))
_add("features_priority", lambda star: features.features_priority(_mixed_scales(star)).select(*features.NUMERIC))
_add("features_training", lambda star: features.features_training(_fractions(star)).select(*features.NUMERIC))


def _mixed_scales(star: Star) -> DataFrame:
    """Discounts in percent for odd quantities, as fractions for even ones."""
    percent = F.when(F.col("quantity") % 2 == 1, F.col("discount")).otherwise(F.col("discount") / F.lit(100.0))
    return star_transactions(star).withColumn("discount", percent)


_add("onehot_vocab", lambda star: features.onehot_vocab(star_transactions(star), features.categories_of("profit")))


@query("triage_training_features")
def _triage_features(star):
    """What the triage models are fitted on, with the label of the four classes."""
    frame = training.training_features(star, "priority")
    return frame.select(*features.NUMERIC, F.col("label").cast("int").alias("label"))


@query("onehot_features")
def _onehot(star):
    names = features.categories_of("profit")
    records = stored(star_transactions(star).select(*names), "levels")  # vocabulary and encoding both read it
    vocabulary = features.onehot_vocab(records, names)
    return features.onehot_features(records, features.Encoder("profit", features.read_levels(vocabulary)))


@query("scaler_stats")
def _scaler(star):
    stats = features.scaler_stats(features.features_training(_fractions(star)))
    return stats.select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("features_scaled")
def _scaled(star):
    frame = stored(features.features_training(_fractions(star)).select(*features.NUMERIC), "numbers")
    encoder = features.Encoder("priority", {}, features.read_scale(features.scaler_stats(frame)))
    scaled = features.features_scaled(frame, encoder)
    return scaled.select(*[F.round(c, 4).alias(c) for c in scaled.columns])


def _label_counts(name: str, label) -> Callable[[Star], DataFrame]:
    def run(star: Star) -> DataFrame:
        frame = star_transactions(star, extra=("profit",)).select(label().cast("int").alias(name))
        return frame.groupBy(name).agg(F.count(F.lit(1)).alias("line_count"))

    return run


_add("label_urgent", _label_counts("urgent", features.label_urgent))
_add("label_priority4", _label_counts("priority_index", features.label_priority4))
_add("label_profit", _label_counts("profitable", features.label_profit))
_add("class_weights", lambda star: features.class_weights(star_transactions(star), "order_priority"))


def _flawed(star: Star) -> DataFrame:
    """Transactions moved so that some break each rule."""
    return star_transactions(star).withColumns(
        {
            "sales": F.col("sales") - F.lit(2000.0),
            "discount": F.col("discount") * F.lit(12.0) - F.lit(6.0),
            "quantity": F.col("quantity") - 3,
            "shipping_cost": F.col("shipping_cost") - F.lit(100.0),
            "segment": F.when(F.col("segment") != "MACHINERY", F.col("segment")),
        }
    )


_add("validation_report", lambda star: features.validation_report(features.validate(_flawed(star))))


@query("validation_split")
def _validation_split(star):
    valid, rejected = features.split_valid(features.validate(_flawed(star)))
    texts = rejected.select(F.concat_ws(",", "reasons").alias("reasons"))
    both = valid.select(F.lit("").alias("reasons")).unionByName(texts)
    return both.groupBy("reasons").agg(F.count(F.lit(1)).alias("record_count"))


# --- Training and scoring -------------------------------------------------

_fitted: dict[tuple, training.Model] = {}


def fitted(star: Star, task: str, trees: int | None = None) -> training.Model:
    """A model per session and source, fitted on first use."""
    session = star.tables["orders"].sparkSession
    key = (session.sparkContext.applicationId, star.origin, task, trees)
    if key not in _fitted:
        _fitted[key] = training.train_on_star(star, task, trees)
    return _fitted[key]


def _fitted_part(star: Star, task: str, part: DataFrame) -> training.Model:
    """The model of the training part, fitted once for both reports."""
    key = (part.sparkSession.sparkContext.applicationId, star.origin, task, "training part")
    if key not in _fitted:
        _fitted[key] = training.train(task, part)
    return _fitted[key]


def _training_summary(star: Star, task: str) -> DataFrame:
    """How the fitted model does on the lines it was fitted on."""
    judged = fitted(star, task).transform(training.training_features(star, task))
    if task == "profit_amount":
        return judged.agg(
            F.count(F.lit(1)).alias("line_count"),
            F.corr("label", "prediction").alias("correlation"),
            F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))).alias("rmse"),
        )
    return evaluation.confusion(judged, "label", "prediction")


for _task in training.TASKS:
    _add(f"train_{_task}", partial(_training_summary, task=_task))

_add("decision_factors", lambda star: training.decision_factors(fitted(star, "profit_amount"), star.tables["orders"].sparkSession))


@query("save_load_model")
def _save_load(star):
    model = fitted(star, "profit_class")
    spark = star.tables["orders"].sparkSession
    path = scratch_path(spark, "model")
    training.save_model(model, path, spark)
    loaded = training.load_model(spark, path)
    frame = features.features_profit(star_transactions(star))
    both = scoring.predicted(loaded, scoring.predicted(model, frame, "saved_"), "loaded_")
    same = F.col("saved_probabilities") == F.col("loaded_probabilities")
    return both.groupBy(same.alias("same_result")).agg(F.count(F.lit(1)).alias("line_count"))


_add("score_classify", lambda star: scoring.score_classify(star_transactions(star), fitted(star, "profit_class")))
_add(
    "score_regress",
    lambda star: scoring.with_margin(scoring.score_regress(star_transactions(star), fitted(star, "profit_amount"))),
)
_add(
    "score_combined",
    lambda star: scoring.score_combined(
        star_transactions(star), fitted(star, "profit_class"), fitted(star, "profit_amount")
    ),
)
_add("score_priority_binary", lambda star: scoring.score_priority(_fractions(star), fitted(star, "urgency")))
_add("score_priority_4class", lambda star: scoring.score_priority(_fractions(star), fitted(star, "priority")))
_add("what_if_curve", lambda star: scoring.what_if_curve(star_transactions(star), fitted(star, "profit_amount")))
_add("what_if_best", lambda star: scoring.what_if_best(star_transactions(star), fitted(star, "profit_amount")))

_add("score_classify_checks", lambda star: scoring.score_checks(scoring.score_classify(star_transactions(star), fitted(star, "profit_class"))))


@query("score_regress_checks")
def _amount_checks(star):
    scored = scoring.score_regress(star_transactions(star), fitted(star, "profit_amount"))
    return scoring.amount_checks(scoring.with_margin(scored))


for _kind, _task in (("binary", "urgency"), ("4class", "priority")):
    _add(
        f"score_priority_{_kind}_checks",
        lambda star, task=_task: scoring.priority_checks(scoring.score_priority(_fractions(star), fitted(star, task))),
    )


@query("what_if_best_checks")
def _best_checks(star):
    """Different transactions whose best discount stands against their whole sweep, and lines they stand for."""
    model = fitted(star, "profit_amount")
    inputs = scoring.numbered_inputs(star_transactions(star))
    best = scoring.best_discounts(inputs, model)
    sweep = scoring.predicted(model, features.features_profit(scoring.what_if_grid(inputs)))
    each = sweep.join(best, "id").groupBy("id", "occurrences").agg(
        F.max(rounded("prediction", 2)).alias("highest"),
        F.max("estimated_profit").alias("estimated_profit"),
        F.max(F.when(F.col("discount_pct") == F.col("best_discount_pct"), rounded("prediction", 2))).alias("there"),
    )
    right = (F.col("highest") == F.col("estimated_profit")) & (F.col("there") == F.col("highest"))
    return each.agg(F.count(F.when(right, 1)).alias("different"), F.sum(F.when(right, F.col("occurrences"))).alias("line_count"))


@query("decision_reasons")
def _reasons(star):
    """How often each input is the first reason of an estimate, and its mean effect."""
    rows = scoring.decision_reasons(star_transactions(star), fitted(star, "profit_amount"))
    each = rows.select(F.posexplode("reasons").alias("place", "reason")).select("place", "reason.*")
    return each.groupBy("input").agg(
        F.count(F.when(F.col("place") == 0, 1)).alias("first"), F.avg(F.abs("effect")).alias("mean_effect"), F.count(F.lit(1)).alias("line_count")
    )


def _stand_in(star: Star) -> DataFrame:
    """Predictions and probabilities computed from the lines, no model needed."""
    frame = star_transactions(star, extra=("profit",)).withColumn("pct", F.round("discount").cast("int"))
    p = ((F.col("quantity") * 37 + F.col("pct") * 113) % 1000).cast("double") / F.lit(1000.0)
    weights = [(1 + (F.col("quantity") * k + F.col("pct")) % m).cast("double") for k, m in ((3, 7), (5, 11), (7, 13), (2, 5))]
    total = weights[0] + weights[1] + weights[2] + weights[3]
    return frame.withColumns(
        {
            "p2": F.array(F.lit(1.0) - p, p),
            "guess2": (p >= 0.5).cast("int"),
            "p4": F.array(*[w / total for w in weights]),
            "guess4": (F.col("quantity") + F.col("pct")) % 5,
        }
    )


def _decoded(star: Star, decoded, labels: tuple[str, ...] = ()) -> DataFrame:
    """Lines per different decoding; the label map becomes one column each."""
    frame = _stand_in(star).select(decoded.alias("d"))
    flat = frame.select("d.*")
    if labels:
        probs = [F.try_element_at("class_probs", F.lit(n)).alias(f"prob_{n.lower()}") for n in labels]
        flat = flat.select(*[c for c in flat.columns if c != "class_probs"], *probs)
    return flat.groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("line_count"))


_SIX = ("Urgent", "Normal", "Critical", "High", "Medium", "Low")
_add("decode_profit", lambda star: _decoded(star, scoring.decode_profit("guess2", "p2")))
_add("decode_amount", lambda star: _decoded(star, scoring.decode_amount("profit")))
_add("rule_derived_class", lambda star: _decoded(star, scoring.rule_derived_class("profit")))
_add("decode_priority2", lambda star: _decoded(star, scoring.decode_priority2("guess2", "p2"), _SIX))
_add("decode_priority4", lambda star: _decoded(star, scoring.decode_priority4("guess4", "p4"), _SIX))


@query("features_used")
def _features_used(star):
    frame = features.features_priority(_fractions(star)).select(scoring.features_used().alias("f"))
    return frame.select("f.*")


@query("what_if_grid")
def _what_if_grid(star):
    """The sweep's features, averaged per discount."""
    grid = features.features_profit(scoring.what_if_grid(star_transactions(star)))
    return grid.groupBy("discount_pct").agg(
        F.count(F.lit(1)).alias("row_count"),
        rounded(F.avg("discount_impact"), 4).alias("avg_discount_impact"),
        rounded(F.avg("total_cost_spent"), 4).alias("avg_total_cost"),
    )


# --- Evaluation -----------------------------------------------------------


def _judged(star: Star) -> DataFrame:
    """True priority and a rule-based guess of its class."""
    frame = _stand_in(star)
    guess = (F.col("quantity") * 7 + F.col("pct")) % 4
    return frame.withColumns({"truth4": features.label_priority4(), "rule4": guess})


@query("classification_report")
def _report(star):
    report = evaluation.classification_report(evaluation.confusion(_judged(star), "truth4", "rule4"))
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")], "support")


_add("prediction_counts", lambda star: evaluation.prediction_counts(_judged(star), "rule4"))
_add("confusion_crosstab", lambda star: evaluation.confusion_crosstab(_judged(star), "order_priority", "guess4", [0, 1, 2, 3, 4, 5]))


@query("mean_prob_by_class")
def _mean_prob(star):
    means = evaluation.mean_prob_by_class(_stand_in(star), "order_priority", "p4", 4)
    return means.select("order_priority", *[F.round(f"prob_{i}", 6).alias(f"prob_{i}") for i in range(4)])


_add("score_sample", lambda star: evaluation.score_sample(star, fitted(star, "priority")))
for _part in ("holdout", "training"):
    _add(
        f"report_{_part}",
        lambda star, part=_part: evaluation.report_on_star(star, "priority", partial(_fitted_part, star), part),
    )


# --- Streaming ------------------------------------------------------------


@query("score_stream")
def _score_stream(star):
    """All transactions as files, scored by the streaming job."""
    spark = star.tables["orders"].sparkSession
    source, out = scratch_path(spark, "incoming"), scratch_path(spark, "outgoing")
    _flawed(star).write.json(source)
    model = fitted(star, "profit_class")
    score_stream(spark, source, {"profit_class": model}, out).awaitTermination()
    outcomes = F.when(F.col("outcome") == "scored", F.array(F.lit("scored"))).otherwise(F.col("reasons"))
    rows = spark.read.parquet(f"{out}/records").select(F.explode(outcomes).alias("outcome"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("record_count"))
