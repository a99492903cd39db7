"""Operator 11: toxicity by weak supervision.

Voters mark a text as toxic or abstain: one per lexicon of common insults, one per
pattern, and one per word or word beginning that labelled rows show almost only in toxic
texts, copies counted once. A generative label model needs no labels for them: with votes that are independent
given the class, the covariance of two voters is p (1 - p) d_i d_j, d being how much
more often a voter speaks on toxic texts, so any three voters give their d (a
voter that no two others agree with takes it from the labelled sample). What a
covariance has beyond that is correlation: voters that repeat each other are not
compared and share their weight. The second moments of the votes of all documents are all it needs: one sum over
the table. Voters weigh by their log likelihood ratio; the share of toxic rows among the labels
is the prior, and what texts with votes leave of it is the chance of those without.

A logistic regression on words and word beginnings, trained on the posteriors, gives the score.

Labels come only from rows that are not held out (`held_out`); held-out documents
take no part in anything learned. Labels find the vocabulary and the prior; ids, sources
and languages are never inputs of a score. Samples: at most about MINED labelled rows of
each class for the vocabulary, about TRAINED documents for the regression, both by hash; counts and
moments cover all documents.

Defined results: a null text is empty; an empty text has the score of the intercept
alone; texts are read whole; copies get equal scores; a null id is not held out and has
no label; an id with several labels counts each of them; without labels of both classes there is no
mined voter and p is PRIOR; without any vote every score is p; an empty table gives an empty table;
columns of the table are kept, one named like `out` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.session import stored

FOLDS = 5  # a row whose hash has remainder 0 is held out
MINED = 6_000  # labelled rows of each class that the vocabulary is taken from
TRAINED = 40_000  # documents the regression is fitted on
VOCABULARY = 3_000  # words and word beginnings of the regression
VOTERS = 48  # mined voters; with the fixed ones at most 62
SURE = 0.95  # share of toxic rows, classes evened out, from which a word is a voter
CERTAIN = 40.0  # log likelihood ratio (G) of a voter's counts in the sample
TOGETHER = 10  # documents on which two voters speak before they are compared
REPEATED = 0.7  # correlation of two voters that say the same rather than agree
SKETCH = 4  # smallest hashes of the sample's texts by which copies are found
SEEN = 5  # rows of the sample a word of the vocabulary is in
PRIOR = 0.05
LEAST = 0.001  # chance of a text without a vote, at least
ALIKE = 0.1  # conditional correlation from which voters share their weight
BEGINNINGS = range(3, 9)  # characters of word beginnings
LONGEST = 40  # characters of a word kept whole

# Common insults by language.
LEXICONS = {
    "en": "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool bastard jerk imbecile",
    "fr": "idiote imbécile crétin connard salaud abruti débile minable ordure",
    "de": "idiotin dummkopf arschloch trottel abschaum mistkerl depp widerlich",
    "es": "imbécil estúpido estúpida basura cabrón gilipollas asqueroso payaso",
}
# Patterns over the lower-cased text.
PATTERNS = {
    "threat": r"\b(?:kill|hurt|beat|destroy) (?:you|yourself|him|her|them|yourselves)\b",
    "dismissal": r"\b(?:shut up|go to hell|drop dead|get lost|nobody likes you)\b",
    "masked": r"\b[a-z][*@#]{2,}[a-z]+\b",
    "shouting": r"!{3,}",
}
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    """A vocabulary with weights, the voters and what the label model holds of them."""

    voters: list[str]
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    accuracy: dict[str, tuple[float, float]] = field(default_factory=dict)  # voter: share of toxic, of other texts it marks
    correlated: dict[tuple[str, str], float] = field(default_factory=dict)
    prior: float = PRIOR


def held_out(id: Column) -> Column:
    """Whether the row is kept from learning."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def units(word: str) -> list[str]:
    """A word and its beginnings, marked by `*`; of scripts without blanks its pairs and triples."""
    if any(c >= "⺀" for c in word):
        return [word[i : i + k] for k in (2, 3) for i in range(len(word) - k + 1)]
    beginnings = [f"{word[:k]}*" for k in BEGINNINGS if k <= len(word)]
    return [*beginnings, word] if len(word) <= LONGEST else beginnings


class Reader:
    """Units of a wanted set in texts; words are looked up once per task."""

    def __init__(self, wanted: set[str] | None):
        self.wanted = wanted
        self.seen: set[str] = set()
        self.found: dict[str, tuple[str, ...]] = {}
        self.hits: set[str] = set()  # the words of `found`: sets meet without a step per word

    def __call__(self, text: str) -> set[str]:
        words = set(_WORD.findall(text))
        new = words - self.seen
        if len(self.seen) + len(new) > 300_000:
            self.seen, self.found, self.hits, new = set(), {}, set(), words
        for word in new:
            found = tuple(u for u in units(word) if self.wanted is None or u in self.wanted)
            if found:
                self.found[word] = found
                self.hits.add(word)
        self.seen |= new
        out: set[str] = set()
        for word in words & self.hits:
            out.update(self.found[word])
        return out


class Voting:
    """The votes of a text: mined units, then lexicons, then patterns; also its units."""

    def __init__(self, mined: list[str], wanted: set[str]):
        lexicons = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
        self.read = Reader({*wanted, *mined, *(w for words in lexicons.values() for w in words)})
        self.mined, self.lexicons = mined, lexicons
        self.patterns = {name: re.compile(p) for name, p in PATTERNS.items()}

    def __call__(self, text: str) -> tuple[int, set[str]]:
        text = text.lower()
        found = self.read(text)
        votes = [u in found for u in self.mined]
        votes += [not found.isdisjoint(words) for words in self.lexicons.values()]
        votes += [p.search(text) is not None for p in self.patterns.values()]
        return sum(1 << k for k, v in enumerate(votes) if v), found


def voter_names(mined: list[str]) -> list[str]:
    return [*mined, *(f"lexicon {n}" for n in LEXICONS), *(f"pattern {n}" for n in PATTERNS)]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", toxic: str = "toxic") -> Model:
    """The model of all documents that are not held out, and of their labels."""
    given = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(~held_out(F.col("id")))
    known = labels.select(F.col(id).alias("id"), F.col(toxic).cast("int").alias("toxic")).where(~held_out(F.col("id"))).where("toxic in (0, 1)")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = counts[1] / (counts[0] + counts[1]) if len(counts) == 2 else PRIOR
    vocabulary, rates = _mined(given, known, counts) if len(counts) == 2 else ([], {})
    mined = list(rates)
    names = voter_names(mined)
    model = Model(names, prior=prior)
    voted = stored(_votes(given, mined), "votes")
    total, moments = _moments(voted, len(names))
    evidence = _label_model(model, total, moments, rates)
    if not evidence:
        model.intercept = float(np.log(prior / (1 - prior)))
        return model
    posterior = _posterior(voted, evidence, prior)
    _train(model, given, voted, posterior, mined, vocabulary)
    return model


def _share(frame: DataFrame, key: Column, rows: int, wanted: int) -> DataFrame:
    """About `wanted` of the rows, by hash of the key; all of them if there are fewer."""
    return frame.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(min(1.0, wanted / max(rows, 1)) * (1 << 30)))


def _mined(given: DataFrame, known: DataFrame, counts: dict[int, int]) -> tuple[list[str], dict[str, tuple[float, float]]]:
    """Vocabulary, and voters with their shares of toxic and of other rows, from a sample of the labelled rows."""
    parts = [_share(known.where(F.col("toxic") == k), F.col("id"), counts[k], MINED) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most about 2 * MINED rows of an id and a number
    rows = _without_copies(given.join(F.broadcast(chosen), "id").select("text", "toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(None)
        found = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[toxic].update(read(text.lower()))
            if len(found[0]) + len(found[1]) > 1_000_000:
                yield _counts(found)
                found = (Counter(), Counter())
        yield _counts(found)

    seen = rows.select("text", "toxic").mapInArrow(run, "unit string, one long, other long").groupBy("unit").agg(F.sum("one").alias("one"), F.sum("other").alias("other"))
    n = {0: 1, 1: 1} | {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    seen = seen.where(F.col("one") + F.col("other") >= SEEN)
    ratio = F.log((F.col("one") + 0.5) / (n[1] + 1.0) * (n[0] + 1.0) / (F.col("other") + 0.5))
    strength = (F.abs(ratio) * F.sqrt(F.col("one") + F.col("other"))).alias("strength")
    best = seen.select("unit", "one", "other", strength).orderBy(F.desc("strength"), "unit").limit(VOCABULARY).collect()
    rates = {r["unit"]: ((r["one"] + 0.5) / (n[1] + 1), (r["other"] + 0.5) / (n[0] + 1)) for r in best}
    certain = {r["unit"] for r in best if _certainty(r["one"], r["other"], n[1], n[0]) >= CERTAIN}
    sure = {u: r for u, r in rates.items() if u in certain and r[0] / (r[0] + r[1]) >= SURE}
    mined = _apart(sure)
    return [r["unit"] for r in best], {u: rates[u] for u in mined}


def _certainty(one: int, other: int, ones: int, others: int) -> float:
    """G of a unit in `one` of `ones` toxic rows and `other` of `others`: how unlikely that is by chance."""
    expected = (one + other) / (ones + others)
    parts = [(one, ones * expected), (other, others * expected), (ones - one, ones * (1 - expected)), (others - other, others * (1 - expected))]
    return 2 * sum(seen * np.log(seen / chance) for seen, chance in parts if seen and chance)


def _without_copies(rows: DataFrame) -> DataFrame:
    """One text of those of a class that share one of their smallest hashes of five words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [_sketch(t) for t in batch.column(0).to_pylist()]
            columns = [pa.array([s[k] for s in sketches], pa.int64()) for k in range(SKETCH)]
            yield pa.record_batch([*batch.columns, *columns], ["text", "toxic", *names])

    names = [f"least{k}" for k in range(SKETCH)]
    rows = stored(rows.mapInArrow(run, "text string, toxic int, " + ", ".join(f"{n} long" for n in names)), "labelled")
    alone = rows.select(F.xxhash64("text").alias("key"), "toxic", *names)
    for n in names:
        alone = alone.groupBy("toxic", n).agg(F.min_by(F.struct(*[c for c in alone.columns if c not in ("toxic", n)]), "key").alias("s")).select("toxic", n, "s.*")
    kept = alone.select("key", F.col("toxic").alias("class")).distinct()
    return rows.join(kept, (F.xxhash64("text") == kept["key"]) & (rows["toxic"] == kept["class"])).dropDuplicates(["key", "class"])


def _sketch(text: str) -> list[int]:
    words = text.lower().split()
    grams = {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}
    hashes = np.array([int.from_bytes(blake2b(g.encode("utf-8", "replace"), digest_size=8).digest(), "little") for g in grams], np.uint64)
    return [int((hashes * np.uint64(2 * k + 1) ^ (hashes >> np.uint64(7 * k + 1))).min() >> np.uint64(1)) for k in range(SKETCH)]


def _counts(found: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = list({*found[0], *found[1]})
    columns = [pa.array(names, pa.string()), *(pa.array([found[k][u] for u in names], pa.int64()) for k in (1, 0))]
    return pa.record_batch(columns, ["unit", "one", "other"])


def _apart(rates: dict[str, tuple[float, float]]) -> list[str]:
    """The units that mark most toxic rows and least others, none beginning like another; of equal ones the longest."""
    out: list[str] = []
    worth = {u: one - 5 * other for u, (one, other) in rates.items()}
    for unit in sorted(worth, key=lambda u: (-worth[u], -len(u), u)):
        stem = unit.rstrip("*")
        if not any(stem.startswith(o) or o.startswith(stem) for o in (v.rstrip("*") for v in out)):
            out.append(unit)
        if len(out) == VOTERS:
            break
    return out


def _votes(given: DataFrame, mined: list[str]) -> DataFrame:
    """(key, votes) of each document: its hash and a bit per voter."""
    rows = given.select(F.xxhash64("id", "text").alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = Voting(mined, set())
        for batch in batches:
            votes = [vote(t)[0] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(votes, pa.int64())], ["key", "votes"])

    return rows.mapInArrow(run, "key long, votes long")


def _moments(voted: DataFrame, voters: int) -> tuple[int, np.ndarray]:
    """Number of documents, and of those on which each two voters speak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((voters, voters), np.int64), 0
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False)[:, None] >> np.arange(voters) & 1
            total += (bits.T.astype(float) @ bits.astype(float)).astype(np.int64)
            n += len(bits)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(total.ravel()[at], n))], ["at", "n"])

    rows = voted.select("votes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    found, n = np.zeros(voters * voters), 0
    for r in rows:
        if r["at"] < 0:
            n = r["n"]
        else:
            found[r["at"]] = r["n"]
    return n, found.reshape(voters, voters)


def _label_model(model: Model, n: int, moments: np.ndarray, rates: dict[str, tuple[float, float]]) -> dict[int, float]:
    """Weight of each voter that has one, by its number; the model's accuracies and correlations are filled in.

    A voter is compared with others that agree with it beyond chance without repeating it; without
    two such it takes the difference of its shares in the labelled sample.
    """
    if not n:
        return {}
    p, share = model.prior, np.diag(moments) / n
    covariance = moments / n - np.outer(share, share)
    noise = np.sqrt(np.maximum(np.outer(share, share), 1e-12) / n)
    single = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tied = (covariance > 3 * noise) & (moments >= TOGETHER) & (covariance < REPEATED * np.outer(single, single))
    np.fill_diagonal(tied, False)
    apart = np.zeros(len(share))
    for i, name in enumerate(model.voters):
        near = np.flatnonzero(tied[i])
        ratios = [covariance[i, j] * covariance[i, k] / covariance[j, k] for a, j in enumerate(near) for k in near[:a] if tied[j, k]]
        if ratios:
            apart[i] = np.sqrt(np.median(ratios) / (p * (1 - p)))
        elif name in rates:
            apart[i] = max(rates[name][0] - rates[name][1], 0.0)
    one = np.clip(share + (1 - p) * apart, 1e-9, 0.999)
    other = np.clip(share - p * apart, np.maximum(share / 1000, 1e-9), 0.999)
    speaks = np.flatnonzero((apart > 0) & (one > other))
    within = covariance - p * (1 - p) * np.outer(apart, apart)
    spread = np.sqrt(np.maximum(p * one * (1 - one) + (1 - p) * other * (1 - other), 1e-12))
    alike = within / np.outer(spread, spread)
    out = {}
    for i in speaks:
        near = [j for j in speaks if j != i and alike[i, j] > ALIKE]
        model.accuracy[model.voters[i]] = (float(one[i]), float(other[i]))
        model.correlated |= {(model.voters[i], model.voters[j]): float(alike[i, j]) for j in near}
        out[int(i)] = float(np.log(one[i] / other[i]) / (1 + sum(min(alike[i, j], 1.0) for j in near)))
    return out


def _posterior(voted: DataFrame, evidence: dict[int, float], prior: float) -> Column:
    """The chance that a text is toxic given its votes.

    What texts with votes leave of the prior's share of all texts is spread over those without one.
    """
    bit = lambda k: F.col("votes").bitwiseAND(F.lit(1 << k).cast("long")) != 0
    weight = sum((F.when(bit(k), F.lit(w)).otherwise(F.lit(0.0)) for k, w in evidence.items()), F.lit(0.0))
    spoken = 1 / (1 + F.exp(-(weight + F.lit(float(np.log(prior / (1 - prior)))))))
    row = voted.agg(F.count("*").alias("n"), F.count(F.when(weight == 0, 1)).alias("silent"), F.sum(F.when(weight != 0, spoken)).alias("toxic")).first()
    left = (prior * row["n"] - (row["toxic"] or 0.0)) / max(row["silent"], 1)
    return F.when(weight != 0, spoken).otherwise(F.lit(float(min(max(left, LEAST), prior))))


def _train(model: Model, given: DataFrame, voted: DataFrame, posterior: Column, mined: list[str], vocabulary: list[str]) -> None:
    """Logistic regression on a sample of documents, half of them likely toxic, weighted back to the share they have."""
    judged = voted.select("key", posterior.alias("posterior"))
    likely = F.col("posterior") >= 0.5
    sizes = {r["likely"]: r["count"] for r in judged.groupBy(likely.alias("likely")).count().collect()}
    parts = []
    for side, n in sizes.items():
        weight = F.lit(max(1.0, 2 * n / TRAINED)).alias("weight")
        parts.append(_share(judged.where(likely == F.lit(side)), F.col("key"), n, TRAINED // 2).select("key", "posterior", weight))
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    chosen = chosen.dropDuplicates(["key"])  # at most about TRAINED rows of three numbers
    wanted = list(dict.fromkeys([*vocabulary, *mined, *(w for words in LEXICONS.values() for w in words.split())]))
    rows = given.select(F.xxhash64("id", "text").alias("key"), "text").join(F.broadcast(chosen), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(set(wanted))
        for batch in batches:
            found = [sorted(read(t.lower())) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(found, pa.list_(pa.string())), batch.column(2), batch.column(3)]
            yield pa.record_batch(columns, ["key", "units", "posterior", "weight"])

    read = rows.select("key", "text", "posterior", "weight").mapInArrow(run, "key long, units array<string>, posterior double, weight double")
    sample = stored(read.dropDuplicates(["key"]), "sample")
    vectors = CountVectorizerModel.from_vocabulary(wanted, "units", "features").setBinary(True).transform(sample)
    toxic, other = (
        vectors.select("features", F.lit(label).alias("label"), (F.col("weight") * part).alias("weight"))
        for label, part in ((1.0, F.col("posterior")), (0.0, 1 - F.col("posterior")))
    )
    both = toxic.unionByName(other).where("weight > 1e-6")
    fitted = LogisticRegression(weightCol="weight", regParam=1e-5, maxIter=60).fit(both)
    weights = fitted.coefficients.toArray()
    model.weights = {u: float(w) for u, w in zip(wanted, weights) if w}
    model.intercept = float(fitted.intercept)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """The documents with a column `out`: 0 to 1, higher where toxic is likelier."""
    weights, intercept = model.weights, model.intercept

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read = Reader(set(weights))
        for batch in texts:
            found = [intercept + sum(sorted(weights[u] for u in read(t.lower()))) for t in batch]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(found, float), -700, 700))))

    return docs.withColumn(out, scored(F.coalesce(F.col(text), F.lit(""))))
