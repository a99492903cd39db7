"""Toxicity: the label model against known accuracies, held-out accuracy, odd tables."""

import random
import zlib

import numpy as np
import pytest
from compare import SMALL

from salesloom.llm import queries, toxicity

ODD = "doc_id long, text string, key string, votes string, toxicity string, label string"


def made(n, seed):
    """Texts of made-up words; some mark toxic ones, in two languages, and labels of a half of them."""
    draw = random.Random(seed)
    plain = ["".join(draw.choice("abdeglmnoprstu") for _ in range(draw.randrange(3, 9))) for _ in range(400)]
    bad = ["zorblax", "quexil", "wumpit", "kragfoo", "plinkor"]
    rows, labels = [], []
    for k in range(n):
        toxic = draw.random() < 0.15
        words = [draw.choice(plain) for _ in range(draw.randrange(20, 80))]
        if toxic and k % 2:
            words += [w for w in bad if draw.random() < 0.6] or [bad[0]]
        elif toxic:
            words += [f"xyvu{draw.choice(plain)}" for _ in range(3)]
        draw.shuffle(words)
        rows.append((k, " ".join(words).title()))
        if draw.random() < 0.5:
            labels.append((k, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def table(spark):
    rows, labels = made(3000, 8)
    copies = [(10_000 + k, rows[3][1]) for k in range(300)]  # a group of copies, all labelled toxic
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(4)
    return docs, labels + [(k, 1) for k, _ in copies], {k: t for k, t in labels}


def auc(pairs):
    one, other = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    return np.mean([(a > b) + (a == b) / 2 for a in one for b in other])


def test_held_out_accuracy(spark, table):
    docs, labels, truth = table
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(v.startswith("xyv") for v in model.accuracy)
    scores = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert len(scores) == 3300 and all(0 <= s <= 1 for s in scores.values())
    held = [(scores[k], t) for k, t in truth.items() if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 200 and auc(held) > 0.98
    assert np.mean([(s >= 0.5) == bool(t) for s, t in held]) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark, table):
    docs, labels, _ = table
    turned = [(k, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, t in labels]
    one, two = (toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int")) for rows in (labels, turned))
    assert one.voters == two.voters and one.prior == two.prior and one.weights.keys() == two.weights.keys()


def test_label_model_finds_accuracies_and_correlations():
    draw = np.random.default_rng(2)
    n, p = 200_000, 0.1
    toxic = draw.random(n) < p
    names = ["a", "b", "c", "d", "a again"]
    hits = np.array([0.6, 0.5, 0.4, 0.3])
    votes = draw.random((n, 4)) < np.where(toxic[:, None], hits, [0.01, 0.02, 0.001, 0.005])
    votes = np.column_stack([votes, votes[:, 0] & (draw.random(n) < 0.95)]).astype(float)
    model = toxicity.Model(names, prior=p)
    weights = toxicity._label_model(model, n, votes.T @ votes, {})
    for k, name in enumerate(names[:4]):
        assert abs(model.accuracy[name][0] - hits[k]) < 0.05
    assert model.correlated["a", "a again"] > 0.5 and ("a", "b") not in model.correlated
    assert weights[0] < weights[2]  # the repeated voter shares its weight


def test_odd_tables(spark, docs):
    odd = spark.createDataFrame([(r.doc_id, r.text, "a", "b", "c", "d") for r in docs.collect()] + [(20, "日本語の文", "a", "b", "c", "d")], ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (7, 0), (None, 1), (9, None), (10, 7)], "doc_id long, toxic int")
    for labels in (none, some):
        rows = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
        assert len(rows) == odd.count() and all(0 <= r.toxicity <= 1 for r in rows)
        assert rows[0]["key"] == "a" and rows[0]["votes"] == "b"
        same = {r.toxicity for r in rows if r.doc_id in (6, 7) and r.text}
        assert len(same) == 1  # copies
    empty = odd.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, some)).collect() == []


def test_query(spark):
    rows = queries.queries()["op11_toxicity"](spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.5)
