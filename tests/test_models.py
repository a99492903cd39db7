"""Features, encoders, models, what-if and the stream against brute force."""

import json

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from salesloom import oracle
from salesloom.operators import evaluation, features, scoring, training
from salesloom.sources.export import export_csv, write_star
from salesloom.sources.star import load_star, table_options
from salesloom.sources.transactions import NUMBERS, PROFIT_FEATURES, PROFIT_SCHEMA, read_transactions, star_transactions
from salesloom.operators import rollups
from salesloom.streaming.scoring import score_records, score_stream

SAMPLE = {
    "sales": 100.0, "discount": 10.0, "quantity": 2, "shipping_cost": 5.0, "category": "Furniture",
    "sub_category": "Brand#3", "segment": "BUILDING", "market": "EU", "ship_mode": "Standard Class",
    "order_priority": "Medium", "region": "EUROPE-1",
}


def record(spark, **changes):
    return spark.createDataFrame([{**SAMPLE, **changes}], PROFIT_SCHEMA)


@pytest.fixture(scope="module")
def models(star):
    return {task: training.train_on_star(star, task, trees=3) for task in training.TASKS}


def test_two_feature_definitions(spark):
    profit = features.features_profit(record(spark)).first()
    assert (profit["discount"], profit["discount_impact"], profit["total_cost_spent"]) == (0.1, 10.0, 15.0)
    triage = features.features_priority(record(spark)).first()
    assert (triage["discount"], triage["total_cost_spent"]) == (0.1, 105.0)


@pytest.mark.parametrize("given,profit,triage", [(1.0, 0.01, 1.0), (1.5, 0.015, 0.015), (0.1, 0.001, 0.1), (0.0, 0.0, 0.0)])
def test_discount_scales(spark, given, profit, triage):
    frame = record(spark, discount=given)
    assert features.features_profit(frame).first()["discount"] == pytest.approx(profit)
    assert features.features_priority(frame).first()["discount"] == pytest.approx(triage)


def test_zero_sales_ratio(spark):
    frame = record(spark, sales=0.0)
    for build in (features.features_profit, features.features_priority, features.features_training):
        assert build(frame).first()["shipping_cost_ratio"] == 0.0


def test_first_level_and_unknown_value_encode_alike(spark, star):
    encoder = features.fit_encoder(features.features_profit(star_transactions(star)), "profit")
    assert len(encoder.names) == 7 + sum(len(v) for v in encoder.levels.values())
    first = features.onehot_features(record(spark, ship_mode="First Class"), encoder).first()
    unknown = features.onehot_features(record(spark, ship_mode="Drone"), encoder).first()
    missing = features.onehot_features(record(spark, ship_mode=None), encoder).first()
    assert first == unknown == missing
    known = features.onehot_features(record(spark), encoder).first()
    assert sum(known) == sum(first) + 1


def test_constant_column_scales_to_zero(spark):
    encoder = features.Encoder("profit", {}, {"sales": (100.0, 0.0)})
    row = features.features_scaled(features.features_profit(record(spark)), encoder).first()
    assert row["sales"] == 0.0 and row["quantity"] == 2.0


def test_validation(spark):
    bad = record(spark, sales=0.0, discount=101.0, quantity=0, shipping_cost=-1.0, segment=None)
    reasons = features.validate(bad).first()["reasons"]
    assert reasons == [
        "sales_not_positive", "discount_out_of_range", "quantity_below_one", "shipping_cost_negative", "missing_segment",
    ]
    assert features.validate(record(spark)).first()["reasons"] == []
    assert features.validate(record(spark, sales=None)).first()["reasons"] == ["missing_sales"]
    assert features.validate(record(spark, sales=float("nan"))).first()["reasons"] == ["sales_not_a_number"]
    assert features.validate(record(spark, order_priority=None), "priority").first()["reasons"] == []


def test_labels(spark):
    rows = spark.createDataFrame([(p,) for p in ("Critical", "High", "Low", "Medium")], "order_priority string")
    got = rows.select(features.label_urgent().alias("u"), features.label_priority4().alias("p")).collect()
    assert [r["u"] for r in got] == [1, 1, 0, 0] and [r["p"] for r in got] == [0, 1, 2, 3]


def test_balanced_weights(spark):
    frame = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    got = {r["label"]: r["weight"] for r in features.class_weights(frame, "label").collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": pytest.approx(2.0)}


def test_models_beat_guessing(star, models):
    judged = models["profit_amount"].transform(training.training_features(star, "profit_amount"))
    assert judged.agg(F.corr("label", "prediction")).first()[0] > 0.8
    counts = evaluation.confusion(
        models["profit_class"].transform(training.training_features(star, "profit_class")), "label", "prediction"
    ).collect()
    right = sum(r["n"] for r in counts if r["truth"] == r["guess"])
    majority = max(sum(r["n"] for r in counts if r["truth"] == t) for t in (0.0, 1.0))
    assert right > majority


def test_scores_equal_the_model_on_one_vector(spark, star, models):
    """Batch scores against the estimator called on hand-built vectors."""
    records = star_transactions(star).limit(20).collect()
    frame = spark.createDataFrame(records, star_transactions(star).select(*NUMBERS, *PROFIT_FEATURES).schema)
    model = models["profit_amount"]
    tree = model.pipeline.stages[-1]
    expected = []
    for r in records:
        d = r["discount"] / 100.0
        impact = r["sales"] * d
        numbers = [r["sales"], d, r["quantity"], r["shipping_cost"], r["shipping_cost"] / r["sales"], impact, r["shipping_cost"] + impact]
        vector = [
            (x - model.encoder.scale[n][0]) / (model.encoder.scale[n][1] or 1.0) for n, x in zip(features.NUMERIC, numbers)
        ]
        vector += [float(r[c] == v) for c in PROFIT_FEATURES for v in model.encoder.levels[c]]
        expected.append(tree.predict(Vectors.dense(vector)))
    got = [r["regression"]["estimated_profit"] for r in scoring.score_regress(frame, model).collect()]
    assert sorted(got) == pytest.approx(sorted(round(e, 2) for e in expected), abs=0.011)


def test_combined_holds_both(star, models):
    rows = scoring.score_combined(star_transactions(star), models["profit_class"], models["profit_amount"])
    assert rows.count() == 6000
    one = rows.first()
    assert one["classification"]["prediction"] in ("PROFIT", "LOSS")
    assert one["classification"]["profit_probability"] + one["classification"]["loss_probability"] == pytest.approx(100)


@pytest.mark.parametrize("task", ["urgency", "priority"])
def test_priority_scores(star, models, task):
    row = scoring.score_priority(star_transactions(star), models[task]).first()
    triage, debug = row["triage"], row["debug"]
    assert triage["urgent_probability"] + triage["normal_probability"] == pytest.approx(100, abs=0.11)
    assert set(triage["class_probs"]) == {"Urgent", "Normal", "Critical", "High", "Medium", "Low"}
    assert debug["n_classes"] == (2 if task == "urgency" else 4)
    assert sum(debug["raw_proba"]) == pytest.approx(100, abs=0.3)


def test_unknown_class_index(spark):
    row = spark.range(1).select(scoring.decode_priority4(F.lit(7), F.array(*[F.lit(0.2)] * 5)).alias("d")).first()["d"]
    assert row["priority_label"] == "Class 7" and row["urgency"] == "medium" and row["message"] == ""
    assert row["class_probs"]["Class 4"] == 20.0


def test_break_even(spark):
    row = spark.range(1).select(scoring.decode_amount(F.lit(0.0)).alias("a"), scoring.rule_derived_class(F.lit(0.0)).alias("c")).first()
    assert row["a"]["is_break_even"] and row["a"]["net_status"] == "BREAK EVEN"
    assert row["c"]["prediction"] == "BREAK EVEN" and row["c"]["loss_probability"] == 100.0


def test_what_if_against_one_by_one_scoring(spark, star, models):
    records = spark.createDataFrame(
        star_transactions(star).limit(3).collect() * 2, star_transactions(star).schema
    )
    model = models["profit_amount"]
    best = scoring.what_if_best(records, model).collect()
    assert len(best) == 3 and all(r["occurrences"] == 2 for r in best)
    curve = {r["discount_pct"]: r["avg_estimated_profit"] for r in scoring.what_if_curve(records, model).collect()}
    assert sorted(curve) == list(range(101))
    for r in best:
        base = {k: v for k, v in r.asDict().items() if k in SAMPLE}
        tried = spark.createDataFrame([{**base, "discount": float(d)} for d in range(101)], PROFIT_SCHEMA)
        scored = scoring.score_regress(tried, model).select("discount", "regression.estimated_profit").collect()
        top = max(e for _, e in scored)
        assert r["estimated_profit"] == pytest.approx(top)
        assert r["best_discount_pct"] == min(int(d) for d, e in scored if e == top)


def test_reasons_against_one_by_one_scoring(spark, star, models):
    """Each input put to its base by hand and scored alone."""
    records = spark.createDataFrame(star_transactions(star).limit(4).collect(), star_transactions(star).schema)
    for task in ("profit_amount", "urgency", "priority"):
        model = models[task]
        kind = training.kind_of(task)
        inputs = [*NUMBERS, *features.categories_of(kind)]

        def score(record):
            frame = features.features_for(kind, spark.createDataFrame([record], PROFIT_SCHEMA))
            row = scoring.predicted(model, frame).first()
            if task == "profit_amount":
                return row["prediction"]
            return row["probabilities"][1] if task == "urgency" else row["probabilities"][0] + row["probabilities"][1]

        for r in scoring.decision_reasons(records, model).limit(2).collect():
            given = {f.name: r[f.name] for f in PROFIT_SCHEMA}
            for name in inputs:
                mean = model.encoder.scale.get(name, (None, 1.0))[0]
                # A quantity is whole in a record: its base is not, so it is checked through its effect alone.
                if name == "quantity":
                    continue
                base = mean * 100 if name == "discount" and kind == "profit" else mean
                expected = score(given) - score({**given, name: base})
                assert {x["input"]: x["effect"] for x in r["reasons"]}[name] == pytest.approx(expected, abs=1e-9)
            effects = [abs(x["effect"]) for x in r["reasons"]]
            assert effects == sorted(effects, reverse=True) and len(effects) == len(inputs)


def test_vocabulary_of_any_size(spark):
    """Five thousand levels: a sparse vector, found by index."""
    rows = [(100.0 + k, 0.1, 2, 5.0, *[f"x{k % 3}"] * 5, f"level{k:05d}") for k in range(5000)]
    frame = spark.createDataFrame(rows, "sales double, discount double, quantity int, shipping_cost double, " + ", ".join(f"{c} string" for c in features.categories_of("priority")))
    encoder = features.fit_encoder(features.features_training(frame), "priority")
    assert len(encoder.names) == 7 + 5 * 2 + 4999
    row = encoder.vectors(features.features_training(frame)).where("sub_category = 'level04321'").first()["features"]
    assert row.size == len(encoder.names) and row[encoder.names.index("sub_category_level04321")] == 1.0
    assert sum(row.toArray()[7:]) in (1.0, 6.0)


def test_four_classes_are_boosted_one_against_rest(star, models):
    model = models["priority"]
    boosters = [s for s in model.pipeline.stages if hasattr(s, "featureImportances")]
    assert len(boosters) == 4 and all(s.getNumTrees == 3 and s.getStepSize() == 0.07 for s in boosters)
    judged = model.transform(training.training_features(star, "priority")).limit(200).collect()
    for r in judged:
        p = r["probability"].toArray()
        assert p.sum() == pytest.approx(1.0) and p[int(r["prediction"])] == p.max() and (p > 0).all()


def test_factors(spark, models):
    rows = training.decision_factors(models["profit_amount"], spark).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_saved_model_scores_alike(spark, star, models, tmp_path):
    for task in ("profit_class", "priority"):
        training.save_model(models[task], f"{tmp_path}/{task}", spark)
        loaded = training.load_model(spark, f"{tmp_path}/{task}")
        assert loaded.task == task and loaded.encoder == models[task].encoder
        frame = training.training_features(star, task)
        old, new = (scoring.predicted(m, frame).select("probabilities") for m in (models[task], loaded))
        assert old.exceptAll(new).count() == 0


def test_report_by_hand(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(2, 1)]
    counts = evaluation.confusion(spark.createDataFrame(pairs, "t int, g int"), "t", "g")
    rows = {r["class"]: r for r in evaluation.classification_report(counts).collect()}
    assert rows["0"]["precision"] == 1.0 and rows["0"]["recall"] == 0.75
    assert rows["1"]["precision"] == 0.5 and rows["1"]["recall"] == 1.0
    assert rows["2"]["precision"] == 0.0 and rows["2"]["f1_score"] == 0.0 and rows["2"]["support"] == 1
    assert rows["accuracy"]["f1_score"] == pytest.approx(5 / 7)
    assert rows["macro avg"]["recall"] == pytest.approx((0.75 + 1 + 0) / 3)
    assert rows["weighted avg"]["recall"] == pytest.approx(5 / 7)


def test_holdout_parts_add_up(star):
    frame = training.training_features(star, "priority")
    kept, held = training.holdout(frame)
    assert kept.count() + held.count() == frame.count() == 6000


def test_stream_equals_batch(spark, star, models, tmp_path):
    broken = F.when(F.col("quantity") % 5 == 0, F.lit(-1.0)).otherwise(F.col("sales"))
    records = star_transactions(star).withColumn("sales", broken)
    records.repartition(6).write.json(f"{tmp_path}/in")
    both = {t: models[t] for t in ("profit_class", "profit_amount")}
    score_stream(spark, f"{tmp_path}/in", both, f"{tmp_path}/out", files_per_batch=2).awaitTermination()
    scored, rejected = score_records(read_transactions(spark, f"{tmp_path}/in"), both)
    for name, batch in (("scored", scored), ("rejected", rejected)):
        streamed = spark.read.parquet(f"{tmp_path}/out/records").where(F.col("outcome") == name)
        assert streamed.select("batch").distinct().count() == 3
        texts = [f.select(F.to_json(F.struct(*batch.columns)).alias("j")) for f in (streamed, batch)]
        assert texts[0].exceptAll(texts[1]).count() == 0 and texts[1].exceptAll(texts[0]).count() == 0
    # A second run finds nothing new and changes nothing.
    before = spark.read.parquet(f"{tmp_path}/out/records").count()
    score_stream(spark, f"{tmp_path}/in", both, f"{tmp_path}/out").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/records").count() == before == 6000


def test_stream_keeps_what_does_not_parse(spark, models, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text(json.dumps(SAMPLE) + '\n{"sales": "many"}\nnot a record\n')
    score_stream(spark, f"{tmp_path}/in", {"profit_class": models["profit_class"]}, f"{tmp_path}/out").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out/records").collect()
    texts = {r["_corrupt_record"] for r in rows if r["outcome"] == "rejected"}
    assert texts == {'{"sales": "many"}', "not a record"} and len(rows) == 3
    # A replay of the batch leaves one copy of each.
    score_stream(spark, f"{tmp_path}/in", {"profit_class": models["profit_class"]}, f"{tmp_path}/out", checkpoint=f"{tmp_path}/other").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/records").count() == 3


def test_reading_records(spark, tmp_path):
    rows = [SAMPLE, {**SAMPLE, "quantity": "two"}, {k: v for k, v in SAMPLE.items() if k != "region"}]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = features.validate(read_transactions(spark, f"{tmp_path}/r.json")).collect()
    assert [r["reasons"] for r in got] == [[], ["missing_quantity"], ["missing_region"]]
    records = read_transactions(spark, f"{tmp_path}/r.json").limit(1)
    for fmt in ("parquet", "csv"):
        writer = records.write.option("header", True) if fmt == "csv" else records.write
        writer.format(fmt).save(f"{tmp_path}/{fmt}")
        assert read_transactions(spark, f"{tmp_path}/{fmt}", fmt=fmt).collect() == records.collect()


def test_csv_export_quotes(spark, tmp_path):
    frame = spark.createDataFrame([('a,"b"', None, 1.5), ("plain", "", 2.0)], "x string, y string, z double")
    export_csv(frame.coalesce(1), f"{tmp_path}/csv")
    lines = next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv").read_text().splitlines()
    assert lines == ["x,y,z", '"a,""b""",,1.5', "plain,,2.0"]


def test_options_of_single_tables():
    split = {"partitionColumn": "row_id", "lowerBound": 1, "upperBound": 90, "numPartitions": 3}
    common = {"url": "jdbc:some:db"}
    assert table_options("jdbc", "orders", common, {"order_items": split}) == {**common, "dbtable": "orders"}
    assert table_options("jdbc", "order_items", common, {"order_items": split}) == {**common, "dbtable": "order_items", **split}
    assert table_options("csv", "orders", {}) == {"header": True}
    assert table_options("parquet", "orders", common) == common


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_stored_star(spark, star, tmp_path, kind):
    path = f"{tmp_path}/star"
    if kind == "parquet":
        write_star(star, path)
    else:
        from salesloom.plans.fact import stored_tables

        for name, frame in stored_tables(star).items():
            frame.write.option("header", True).csv(f"{path}/{name}")
    again = load_star(spark, path, kind)
    for name in ("kpi", "weekly_trend", "orders_by_shipmode", "region_stats", "segment_stats"):
        assert getattr(rollups, name)(again).collect() == getattr(rollups, name)(star).collect(), name


def test_classification_checks_at_even_odds(spark):
    shares = [(0.0, 0.51, 0.49), (0.0, 0.501, 0.499), (0.0, 0.5004, 0.4996), (1.0, 0.5, 0.5), (1.0, 0.499, 0.501), (1.0, 0.2, 0.8)]
    frame = spark.createDataFrame([(p, [a, b]) for p, a, b in shares], "prediction double, probabilities array<double>")
    scored = frame.select(scoring.decode_profit("prediction", "probabilities").alias("classification"))
    assert {r["check"]: r.line_count for r in scoring.score_checks(scored).collect()} == dict.fromkeys(oracle.CHECKS["score_classify_checks"], 6)
    wrong = scored.withColumn("classification", F.col("classification").withField("is_profit", ~F.col("classification.is_profit")))
    counts = {r["check"]: r.line_count for r in scoring.score_checks(wrong).collect()}
    assert counts["class is the likelier"] == 4 and counts["class named"] == 0
