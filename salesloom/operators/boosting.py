"""Gradient boosting on binned rows: the trees of Spark ML's boosting with less work per row and job.

Bins, bags, feature subsets, gains, ties and stopping follow Spark ML's gradient-boosted trees
with their parameters, and what is returned is Spark ML's model. What differs is how a
level of a tree is counted:

* A row is kept as a few small codes, several columns in one, instead of one integer per
  vector element; the 0/1 elements of a text column are told from one code of it.
* A code leads to a mask of the leaves that it does not rule out, so a row meets its leaf of any tree by
  one lookup per code, and its gradient is computed once per tree.
* Models that are fitted on the same rows, one per class, share their jobs.
* Rows up to `FEW` are fitted on the driver by the same functions, without jobs.

Memory follows the rows of a chunk; chunks are persisted and may be on disk. What reaches the
driver is a sum per node and bin; with more than `MANY` partitions the sums are added on the way.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.session import remove, scratch_path, shared_folder

CHUNK = 1 << 17  # rows that are handled at a time
CELLS = 1 << 10  # different values of a code of several columns
FEW = 1 << 17
APART = 1 << 16  # rows times models up to which no columns share a code: sums are then added in Spark's order
MANY = 64
CUT = 10  # trees after which the lineage is cut, as Spark ML does

STATE = 0xFFFFFFFFFFFFFFFF  # bits of a state


# --- Bags: Spark's generator, from any place of its sequence -------------------------


def _next(state: np.ndarray) -> np.ndarray:
    state = state ^ (state << np.uint64(21))
    state = state ^ (state >> np.uint64(35))
    return state ^ (state << np.uint64(4))


def _applied(table: np.ndarray, states: np.ndarray) -> np.ndarray:
    """A linear map of states, given as its images of each value of each of their eight bytes."""
    out = np.zeros_like(states)
    for byte in range(8):
        out ^= table[byte].take((states >> np.uint64(8 * byte)).astype(np.uint8))
    return out


def _table(images: np.ndarray) -> np.ndarray:
    """The table of the map with these 64 images of single bits."""
    out = np.zeros((8, 256), np.uint64)
    for bit in range(8):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] ^ images[bit::8, None]
    return out


@lru_cache(256)
def _jump(steps: int) -> np.ndarray:
    """The table of `steps` steps of the generator."""
    images = np.uint64(1) << np.arange(64, dtype=np.uint64)
    power = _table(_next(images))
    while steps:
        if steps & 1:
            images = _applied(power, images)
        power, steps = _table(_applied(power, power[np.arange(64) // 8, 1 << np.arange(64) % 8])), steps >> 1
    return _table(images)


def drawn(start: int, offset: int, n: int, rate: float) -> np.ndarray:
    """Which of the rows offset to offset + n are in the bag whose generator starts at `start`."""
    if rate >= 1.0:
        return np.ones(n, bool)
    lanes = 1 << max(0, n.bit_length() - 6)  # some 32 rows a lane
    each = -(-n // lanes)  # rows per lane, two steps a row
    states = _applied(_jump(2 * offset), np.array([start & STATE], np.uint64))
    while len(states) < lanes:
        states = np.concatenate([states, _applied(_jump(2 * each * len(states)), states)])
    out = np.empty((each, lanes))
    for k in range(each):
        high = _next(states)
        states = _next(high)
        low = (high & np.uint64((1 << 26) - 1)) << np.uint64(27)
        out[k] = (low + (states & np.uint64((1 << 27) - 1))) * 2.0**-53
    return (out < rate).T.ravel()[:n]


def hashed(seed: int) -> int:
    """The state that Spark's generator starts from: the seed's bytes through MurmurHash3, twice."""
    low = _murmur(seed, 0x3C074A61)
    return _murmur(seed, low) << 32 | low


def _murmur(seed: int, h: int) -> int:
    data, most = (seed & STATE).to_bytes(8, "big"), 0xFFFFFFFF
    for at in (0, 4):
        k = int.from_bytes(data[at : at + 4], "little") * 0xCC9E2D51 & most
        k = (k << 15 | k >> 17) * 0x1B873593 & most
        h ^= k
        h = ((h << 13 | h >> 19) & most) * 5 + 0xE6546B64 & most
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & most
    h = (h ^ h >> 13) * 0xC2B2AE35 & most
    return h ^ h >> 16


def longs(seed: int) -> Iterator[int]:
    """What nextLong of Java's generator gives."""
    state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1
    while True:
        halves = []
        for _ in range(2):
            state = state * 0x5DEECE66D + 0xB & (1 << 48) - 1
            half = state >> 16
            halves.append(half - (1 << 32) if half >> 31 else half)
        yield (halves[0] << 32) + halves[1] & STATE


def subset(start: int, features: int, wanted: int) -> list[int]:
    """Spark's reservoir of the features that a node looks at, in its order."""
    kept, state = list(range(min(wanted, features))), hashed(start)
    for k in range(wanted, features):
        value = 0
        for bits in (26, 27):
            state = (state ^ state << 21) & STATE
            state ^= state >> 35
            state = (state ^ state << 4) & STATE
            value = value << 27 | state & (1 << bits) - 1
        if (at := int(value * 2.0**-53 * (k + 1))) < wanted:
            kept[at] = k
    return kept


# --- Columns, codes and chunks ---------------------------------------------------------


@dataclass(frozen=True)
class Column:
    """A number with its thresholds, or a text whose vector elements are its levels, or one of these levels."""

    first: int  # index of its first vector element
    source: int  # which value of a row it is made from
    thresholds: np.ndarray | None
    levels: int = 0
    only: int | None = None

    def bins(self, values: list[np.ndarray]) -> np.ndarray:
        value = values[self.source]
        if self.thresholds is not None:
            return np.searchsorted(self.thresholds, value, "left")
        return value.astype(np.int64) if self.only is None else (value != self.only).astype(np.int64)

    @property
    def cells(self) -> int:
        return self.levels + 1 if self.thresholds is None else len(self.thresholds) + 1


def _groups(columns: list[Column], cells: int = CELLS) -> list[list[int]]:
    """Columns that share a code, none with more than `cells` values unless a column has them itself."""
    out: list[list[int]] = []
    for k in sorted(range(len(columns)), key=lambda k: -columns[k].cells):
        size = lambda group: math.prod(columns[j].cells for j in group)
        fitting = [g for g in out if size(g) * columns[k].cells <= cells]
        if fitting:
            max(fitting, key=size).append(k)
        else:
            out.append([k])
    return out


@dataclass
class Chunk:
    """Rows of a partition: codes, label, and per model the margin and the gradient that the next tree is fitted on."""

    partition: int
    offset: int
    codes: list[np.ndarray]
    label: np.ndarray
    margin: np.ndarray | None = None
    gradient: np.ndarray | None = None
    bag: np.ndarray | None = None


def _packed(batches: Iterator, columns: list[Column], groups: list[list[int]], partition: int) -> Iterator[Chunk]:
    """Chunks of a partition from batches of scaled numbers, level indexes and the label, in order."""
    offset, held, count = 0, [], 0

    def chunk() -> Chunk:
        values = [np.concatenate(parts) for parts in zip(*held)]
        bins = [c.bins(values) for c in columns]
        codes = []
        for group in groups:
            code, size = np.zeros(len(values[-1]), np.int64), 1
            for k in group:
                code, size = code * columns[k].cells + bins[k], size * columns[k].cells
            codes.append(code.astype(np.uint16 if size <= 1 << 16 else np.uint32))
        return Chunk(partition, offset, codes, values[-1])

    for batch in batches:
        held.append([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in batch.columns])
        count += batch.num_rows
        if count >= CHUNK:
            yield chunk()
            offset, held, count = offset + count, [], 0
    if count:
        yield chunk()


# --- Trees -----------------------------------------------------------------------------


@dataclass
class Node:
    """Sums of its rows (count, weight, sum, squares), and its split once it has one."""

    sums: np.ndarray
    depth: int
    valid: bool = True
    gain: float = -1.0
    feature: int = -1
    threshold: float = 0.0  # of a number; a text's element goes left by the category
    category: int = -1
    left: Node | None = None
    right: Node | None = None

    @property
    def impurity(self) -> float:
        return float(_variance(*self.sums[1:])) if self.valid else -1.0

    @property
    def value(self) -> float:
        return float(self.sums[2] / self.sums[1]) if self.sums[1] else 0.0

    def leaves(self) -> list[Node]:
        return [*self.left.leaves(), *self.right.leaves()] if self.left else [self]


def _variance(weight, total, squares):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(weight != 0, (squares - total * total / weight) / weight, 0.0)


@dataclass
class Job:
    """What the chunks need to know of a fit."""

    columns: list[Column]
    groups: list[list[int]]
    seed: int
    rate: float
    step: float
    starts: dict[int, int]  # seed to the state of its generator
    weights: np.ndarray | None  # by label
    targets: Callable[[np.ndarray], np.ndarray]  # label to one row of targets per model
    logistic: bool
    apart: bool  # every vector element has its own code, and all nodes are counted
    home: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # vector element: group, column, level

    def sizes(self) -> list[int]:
        return [math.prod(self.columns[k].cells for k in g) for g in self.groups]

    def right_of(self, node: Node) -> tuple[int, np.ndarray]:
        """Group of the node's column, and which of its codes go right."""
        group, k, level = self.home[node.feature]
        column = self.columns[k]
        bins = np.arange(column.cells)
        right = bins > np.searchsorted(column.thresholds, node.threshold, "left") if column.thresholds is not None else (bins == level) != node.category
        shape = [self.columns[j].cells for j in self.groups[group]]
        at = self.groups[group].index(k)
        return group, np.broadcast_to(right.reshape([-1 if j == at else 1 for j in range(len(shape))]), shape).ravel()

    def masks(self, root: Node) -> list[np.ndarray | None]:
        """Per group and code the leaves that it leaves open, as bits; None for a group without a split."""
        place = {id(leaf): k for k, leaf in enumerate(root.leaves())}
        kind = np.uint32 if len(place) <= 32 else np.uint64
        out: list[np.ndarray | None] = [None] * len(self.groups)
        bits = lambda node: kind(sum(1 << place[id(leaf)] for leaf in node.leaves()))
        todo = [root]
        while todo:
            node = todo.pop()
            if node.left:
                group, right = self.right_of(node)
                if out[group] is None:
                    out[group] = np.full(len(right), ~kind(0), kind)
                out[group] &= np.where(right, ~bits(node.left), ~bits(node.right))
                todo += [node.left, node.right]
        return out


def _leaf(codes: list[np.ndarray], masks: list[np.ndarray | None], n: int) -> np.ndarray:
    """Index of the leaf that each row reaches."""
    open_ = None
    for code, mask in zip(codes, masks):
        if mask is not None:
            found = mask.take(code, mode="clip")
            open_ = found if open_ is None else np.bitwise_and(open_, found, out=open_)
    if open_ is None:
        return np.zeros(n, np.int64)
    return (open_ & (~open_ + open_.dtype.type(1))).astype(np.float64).view(np.int64) // (1 << 52) - 1023


def _advanced(chunk: Chunk, job: Job, tree: int, trees: list[tuple[list, np.ndarray]]) -> Chunk:
    """The chunk before tree number `tree`: margins with the trees before it, their gradients, and its bag."""
    n = len(chunk.label)
    bag = drawn(job.starts[job.seed + tree + chunk.partition + 1], chunk.offset, n, job.rate)
    target = job.targets(chunk.label)
    if not tree:
        return Chunk(chunk.partition, chunk.offset, chunk.codes, chunk.label, np.zeros_like(target), target, bag)
    margin = np.stack([f + (1.0 if tree == 1 else job.step) * values.take(_leaf(chunk.codes, masks, n)) for f, (masks, values) in zip(chunk.margin, trees)])
    with np.errstate(over="ignore"):
        gradient = 4.0 * target / (1.0 + np.exp(2.0 * target * margin)) if job.logistic else 2.0 * (target - margin)
    return Chunk(chunk.partition, chunk.offset, chunk.codes, chunk.label, margin, gradient, bag)


def _counted(chunks: Iterator[Chunk], job: Job, plans: list[tuple[list, np.ndarray, int] | None]) -> list[np.ndarray | None]:
    """Per model the sums by slot, column cell and kind: count, weight, sum, squares.

    A plan has the masks of the tree so far, the slot of each of its leaves and the number of slots; rows that are
    not in the bag or whose leaf has no slot, that is the number of slots instead, are not counted.
    """
    sizes = job.sizes()
    kinds = 3 if job.weights is None else 4
    sums: list = [None if p is None else [np.zeros((kinds, p[2] * s)) for s in sizes] for p in plans]
    for chunk in chunks:
        weights = None if job.weights is None else job.weights.take(chunk.label.astype(np.int64))
        for model, plan in enumerate(plans):
            if plan is None:
                continue
            masks, slots, count = plan
            slot = slots.take(_leaf(chunk.codes, masks, len(chunk.label)))
            rows = np.flatnonzero(chunk.bag & (slot < count))
            slot, gradient = slot.take(rows), chunk.gradient[model].take(rows)
            weight = None if weights is None else weights.take(rows)
            first = gradient if weight is None else weight * gradient
            second = first * gradient
            for group, (code, size) in enumerate(zip(chunk.codes, sizes)):
                at, cells = slot * size + code.take(rows), count * size
                held = sums[model][group]
                held[0] += np.bincount(at, minlength=cells)
                held[-2] += np.bincount(at, first, cells)
                held[-1] += np.bincount(at, second, cells)
                if weight is not None:
                    held[1] += np.bincount(at, weight, cells)
    return [None if s is None else _by_column(s, job, p[2]) for s, p in zip(sums, plans)]


def _by_column(sums: list[np.ndarray], job: Job, count: int) -> np.ndarray:
    """Sums of codes as sums of the cells of each column, one after the other."""
    parts: list = [None] * len(job.columns)
    for group, held in zip(job.groups, sums):
        shape = [job.columns[k].cells for k in group]
        cube = held.reshape(len(held), count, *shape)
        for at, k in enumerate(group):
            parts[k] = cube.sum(axis=tuple(2 + j for j in range(len(shape)) if j != at))
    out = np.concatenate(parts, axis=2)
    if len(out) == 3:  # without weights a row weighs 1
        out = np.concatenate([out[:1], out])
    return out.transpose(1, 2, 0)


def _splits(sums: np.ndarray, job: Job) -> tuple:
    """Of all open nodes, every split: its vector element, threshold, category that goes left, sums of the left and of both."""
    starts = np.cumsum([0, *(c.cells for c in job.columns)])
    elements, thresholds, categories, lefts, wholes = [], [], [], [], []
    for k, column in enumerate(job.columns):
        cells = sums[:, starts[k] : starts[k + 1]]
        running = np.cumsum(cells, axis=1)
        if column.thresholds is not None:
            count = len(column.thresholds)
            left, whole = running[:, :-1], np.broadcast_to(running[:, -1:], (len(sums), count, 4))
            category = np.full((len(sums), count), -1)
            thresholds.append(column.thresholds)
            elements.append(np.full(count, column.first))
        else:
            one, whole = cells[:, :-1], running[:, -1:]
            if column.levels == 1:
                zero = cells[:, 1:]
            else:  # what a sum leaves of no rows is not 0
                zero = np.where((whole[..., :1] - one[..., :1]) > 0, whole - one, 0.0)
            means = [np.where(s[..., 1] != 0, s[..., 2] / np.where(s[..., 1] != 0, s[..., 1], 1.0), np.inf) for s in (zero, one)]
            category = (means[1] < means[0]).astype(int)
            left, whole = np.where(category[..., None] == 1, one, zero), zero + one
            thresholds.append(np.zeros(column.levels))
            elements.append(column.first + np.arange(column.levels))
        lefts.append(left)
        wholes.append(whole)
        categories.append(category)
    return np.concatenate(elements), np.concatenate(thresholds), np.concatenate(categories, 1), np.concatenate(lefts, 1), np.concatenate(wholes, 1)


def _split(nodes: list[Node], sums: np.ndarray, job: Job, drawn_features: list[list[int]]) -> None:
    """Gives each node its best split among its features, the first of equal ones, where one gains."""
    elements, thresholds, categories, left, whole = _splits(sums, job)
    for k, node in enumerate(nodes):
        if not node.depth:  # a column's cells add up to the node
            node.sums = sums[k, : job.columns[0].cells].sum(axis=0)
        node.valid = len(elements) > 0
    if not len(elements):
        return
    right = whole - left
    begins = np.flatnonzero(np.diff(elements, prepend=-1))
    place = dict(zip(elements[begins].tolist(), range(len(begins))))
    ends = [*begins[1:], len(elements)]
    for k, node in enumerate(nodes):
        order = [place[f] for f in drawn_features[k] if f in place]
        if not node.depth and order:
            first = begins[order[0]]
            node.sums = left[k, first] + right[k, first]
    impurities = np.array([_variance(*n.sums[1:]) for n in nodes])
    weights = left[..., 1] + right[..., 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = impurities[:, None] - left[..., 1] / weights * _variance(*left.transpose(2, 0, 1)[1:]) - right[..., 1] / weights * _variance(*right.transpose(2, 0, 1)[1:])
    fits = (left[..., 0] >= 1) & (right[..., 0] >= 1) & (gains >= 0.0)
    gains = np.where(fits, gains, -np.inf)
    highest = np.maximum.reduceat(gains, begins, axis=1)
    for k, node in enumerate(nodes):
        order = [place[f] for f in drawn_features[k] if f in place]
        best = order[int(np.argmax(highest[k, order]))] if order else -1
        if best < 0 or highest[k, best] == -np.inf:
            node.valid = False
        elif highest[k, best] > 0:
            at = begins[best] + int(np.argmax(gains[k, begins[best] : ends[best]]))
            node.gain, node.feature, node.threshold, node.category = float(gains[k, at]), int(elements[at]), float(thresholds[at]), int(categories[k, at])
            node.left, node.right = Node(left[k, at], node.depth + 1), Node(right[k, at], node.depth + 1)


def _grown(total: Callable, job: Job, depth: int, models: int, seed: int, features: int, wanted: int) -> list[Node]:
    """One tree per model, level by level. Nodes draw their features in Spark's order: the last one found first.

    Of two open siblings the one of fewer rows is counted, the other is what it leaves of their parent; where sums
    are added in Spark's order both are counted.
    """
    roots = [Node(np.zeros(4), 0) for _ in range(models)]
    draws = [longs(seed) for _ in range(models)]
    open_ = [[(r, None)] for r in roots]  # a node, and the sums of its parent with its sibling if they can be used
    while any(open_):
        plans, told = [], []
        for root, nodes in zip(roots, open_):
            own = [node for node, rest in nodes if rest is None or node.sums[0] < rest[1].sums[0] or (node.sums[0] == rest[1].sums[0] and node is rest[2])]
            slot = {id(node): k for k, node in enumerate(own)}
            told.append(slot)
            slots = np.array([slot.get(id(leaf), len(own)) for leaf in root.leaves()])
            plans.append((job.masks(root), slots, len(own)) if own else None)
        sums = total(plans)
        for model, nodes in enumerate(open_):
            if not nodes:
                continue
            each = []
            for node, rest in nodes:
                if id(node) in told[model]:
                    each.append(sums[model][told[model][id(node)]])
                else:
                    left = rest[0] - sums[model][told[model][id(rest[1])]]
                    each.append(np.where(left[:, :1] > 0, left, 0.0))  # what a sum leaves of no rows is not 0
            looked = [subset(next(draws[model]), features, wanted) if wanted < features else list(range(features)) for _ in nodes]
            _split([node for node, _ in nodes], np.stack(each), job, looked)
            found = []
            for (node, _), own in zip(nodes, each):
                pair = [c for c in (node.left, node.right) if c and c.depth < depth and abs(c.impurity) >= 2.0**-52]
                for child in pair:
                    other = node.right if child is node.left else node.left
                    found.append((child, (own, other, node.left) if len(pair) == 2 and not job.apart else None))
            open_[model] = found[::-1]
    return roots


# --- Where the chunks are ---------------------------------------------------------------


class _Here:
    """Few rows, on the driver."""

    def __init__(self, chunks: list[Chunk]):
        self.chunks = chunks

    def advance(self, step: Callable[[Chunk], Chunk]) -> None:
        self.chunks = [step(c) for c in self.chunks]

    def total(self, job: Job, plans: list) -> list:
        return _counted(iter(self.chunks), job, plans)

    def close(self) -> None:
        pass


class _There:
    """Persisted chunks of an RDD; a tree's margins follow from those of the tree before."""

    def __init__(self, chunks: RDD, spark: SparkSession):
        self.spark, self.chunks, self.old, self.trees, self.files = spark, chunks, chunks, 0, []
        self.level = StorageLevel.MEMORY_AND_DISK
        shared_folder(spark)  # checkpoints need it set

    def advance(self, step: Callable[[Chunk], Chunk]) -> None:
        before, self.chunks = self.chunks, self.chunks.map(step).persist(self.level)
        self.trees += 1
        if self.trees % CUT == 0:
            self.chunks.checkpoint()
        self.old.unpersist()
        self.old = before

    def total(self, job: Job, plans: list) -> list:
        sums = self.chunks.mapPartitions(lambda chunks: [_counted(chunks, job, plans)])
        add = lambda x, y: [None if a is None else a + b for a, b in zip(x, y)]
        if self.chunks.getNumPartitions() > MANY:
            out = sums.treeReduce(add)
        else:
            out = reduce(add, sums.collect())
        if self.chunks.isCheckpointed() and (path := self.chunks.getCheckpointFile()) not in self.files:
            remove(self.spark, self.files)
            self.files = [path]
        return out

    def close(self) -> None:
        self.chunks.unpersist()
        self.old.unpersist()
        remove(self.spark, self.files)


def fit_boosted(booster: GBTRegressor, coded: DataFrame, levels: list[int], targets, logistic: bool, weights=None) -> list[list[Node]]:
    """Trees per target, fitted on the same rows, with the parameters of `booster`.

    `coded` has scaled numbers, one index per text column of so many `levels`, and the label; `weights` are by
    label. The thresholds of the numbers are those that Spark finds.
    """
    spark = coded.sparkSession
    jvm = spark._jvm
    module = lambda path, name: getattr(getattr(path, f"{name}$"), "MODULE$")
    numbers = len(coded.columns) - 1 - len(levels)
    label = coded.columns[-1]
    weight = F.lit(1.0) if weights is None else F.element_at(F.array(*map(F.lit, weights.tolist())), F.col(label).cast("int") + 1)
    plain = coded.select(*coded.columns[:numbers], F.col(label).alias("label"), weight.alias("weight"))
    ready = VectorAssembler(inputCols=coded.columns[:numbers], outputCol="features", handleInvalid="keep").transform(plain)
    booster = booster.copy({booster.weightCol: "weight"})
    booster._transfer_params_to_java()
    java, seed = booster._java_obj, booster.getSeed()
    kinds = module(jvm.org.apache.spark.ml.util, "MetadataUtils").getCategoricalFeatures(ready._jdf.schema().apply("features"))
    algorithm = module(jvm.org.apache.spark.mllib.tree.configuration, "Algo").Regression()
    strategy = java.getOldBoostingStrategy(kinds, algorithm).treeStrategy()
    instances = module(jvm.org.apache.spark.ml.util, "DatasetUtils").extractInstances(java, ready._jdf, jvm.scala.Option.apply(None))
    about = jvm.org.apache.spark.ml.tree.impl.DecisionTreeMetadata.buildMetadata(instances, strategy, 1, "all")
    splits = module(jvm.org.apache.spark.ml.tree.impl, "RandomForest").findSplits(instances, about, seed)
    rows, models = about.numExamples(), len(targets(np.zeros(1)))
    apart = rows * models <= APART

    columns = [Column(k, k, np.array([s.threshold() for s in splits[k]])) for k in range(numbers)]
    for k, count in enumerate(levels, start=numbers):
        first = columns[-1].first + (columns[-1].levels or 1)
        columns += [Column(first + j, k, None, 1, j) for j in range(count)] if apart else [Column(first, k, None, count)]
    groups = _groups(columns, 1 if apart else CELLS)
    home = {}
    for g, group in enumerate(groups):
        for k in group:
            for level in range(columns[k].levels or 1):
                home[columns[k].first + level] = (g, k, level)

    chunks = coded.mapInArrow(_pack(columns, groups), _CHUNKS).rdd.map(lambda r: _unpacked(r, groups, columns))
    parts, trees = chunks.getNumPartitions(), booster.getMaxIter()
    starts = {s: hashed(s) for s in range(seed + 1, seed + trees + parts + 1)}
    job = Job(columns, groups, seed, booster.getSubsamplingRate(), booster.getStepSize(), starts, weights, targets, logistic, apart, home)
    place = _Here(chunks.collect()) if rows <= FEW else _There(chunks.persist(StorageLevel.MEMORY_AND_DISK), spark)
    features = numbers + sum(levels)
    wanted = max(1, math.ceil(float(booster.getFeatureSubsetStrategy()) * features))
    out: list[list[Node]] = [[] for _ in range(models)]
    known: list = []
    try:
        for tree in range(trees):
            place.advance(lambda chunk, tree=tree, known=known: _advanced(chunk, job, tree, known))
            roots = _grown(lambda plans: place.total(job, plans), job, booster.getMaxDepth(), models, seed + tree, features, wanted)
            known = [(job.masks(r), np.array([leaf.value for leaf in r.leaves()])) for r in roots]
            for model, root in enumerate(roots):
                out[model].append(root)
    finally:
        place.close()
    return out


_CHUNKS = "partition int, offset bigint, codes array<binary>, label binary"


def _pack(columns: list[Column], groups: list[list[int]]):
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for c in _packed(batches, columns, groups, TaskContext.get().partitionId()):
            codes = pa.array([[code.tobytes() for code in c.codes]], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([c.partition], pa.int32()), pa.array([c.offset], pa.int64()), codes, pa.array([c.label.tobytes()])], ["partition", "offset", "codes", "label"])

    return run


def _unpacked(row, groups: list[list[int]], columns: list[Column]) -> Chunk:
    sizes = [math.prod(columns[k].cells for k in g) for g in groups]
    codes = [np.frombuffer(c, np.uint16 if s <= 1 << 16 else np.uint32) for c, s in zip(row["codes"], sizes)]
    return Chunk(row["partition"], row["offset"], codes, np.frombuffer(row["label"], np.float64))


# --- As Spark ML's model ----------------------------------------------------------------

_NODE = (
    "id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"
)


def _nodes(node: Node, thresholds: Callable[[int], bool], rows: list) -> int:
    """The rows of a tree, each node before its children; two leaves of one prediction are one."""
    at = len(rows)
    rows.append(None)
    leaf, left, right = (-1, [], -1), -1, -1
    if node.left:
        left = _nodes(node.left, thresholds, rows)
        right = _nodes(node.right, thresholds, rows)
        if rows[left][6] < 0 and rows[right][6] < 0 and rows[left][1] == rows[right][1]:
            del rows[at + 1 :]
            left = right = -1
    split = leaf if left < 0 else (node.feature, [node.threshold], -1) if thresholds(node.feature) else (node.feature, [float(node.category)], 2)
    rows[at] = (at, node.value, node.impurity, [float(x) for x in node.sums[1:]], int(node.sums[0]), node.gain if left >= 0 else -1.0, left, right, split)
    return at


def as_model(estimator, kind, trees: list[Node], step: float, numbers: int, features: int, spark: SparkSession):
    """The model that `estimator` would have fitted, of class `kind`, written in Spark ML's format and loaded."""
    path = scratch_path(spark, "trees")
    estimator._transfer_params_to_java()
    none = spark._jvm.scala.Option.apply(None)
    writer = getattr(getattr(spark._jvm.org.apache.spark.ml.util, "DefaultParamsWriter$"), "MODULE$")
    about = json.loads(writer.getMetadataToSave(estimator._java_obj, spark._jsparkSession, none, none))
    tree = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "timestamp": about["timestamp"], "sparkVersion": about["sparkVersion"]}
    of_tree = ("cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed")
    defaults = {k: about["defaultParamMap"][k] for k in of_tree if k in about["defaultParamMap"]}
    own = {k: about["paramMap"][k] for k in ("maxDepth", "seed")}
    trees_about, rows = [], []
    for k, root in enumerate(trees):
        tree_about = tree | {"uid": f"dtr_{about['uid'][-8:]}{k:04d}", "paramMap": own, "defaultParamMap": defaults}
        trees_about.append((k, json.dumps(tree_about), step if k else 1.0))
        found: list = []
        _nodes(root, lambda f: f < numbers, found)
        rows += [(k, n) for n in found]
    about |= {"class": f"{kind.__module__.replace('pyspark', 'org.apache.spark')}.{kind.__name__}", "numFeatures": features, "numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/model/metadata")
    spark.createDataFrame(trees_about, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/model/treesMetadata")
    spark.createDataFrame(rows, f"treeID int, nodeData struct<{_NODE}>").coalesce(1).write.parquet(f"{path}/model/data")
    model = kind.load(f"{path}/model")
    remove(spark, [path])
    return model
