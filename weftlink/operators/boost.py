"""Gradient-boosted trees that grow leaf by leaf, from histograms summed across tasks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import io
from .model import FEATURES

TASKS = 64  # that hold the cells: their histograms, at most 0.2 MB a node each, meet on the driver
SETTLED = 20  # trees after which scores are written into the cells


@dataclass
class Tree:
    """Nodes by number, the root first: feature, bound (its index among the edges) and children, or a value where feature is -1."""

    feature: list[int] = field(default_factory=list)
    bound: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, x in (("feature", -1), ("bound", -1), ("left", -1), ("right", -1), ("value", value), ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The leaf of each row of bins (features by columns), values up to a node's bound to the left."""
        at = np.zeros(len(bins), np.int64)
        feature, bound, left, right = (np.array(x) for x in (self.feature, self.bound, self.left, self.right))
        for _ in range(depth):
            f = feature[at]
            inner = f >= 0
            low = bins[np.arange(len(bins)), np.maximum(f, 0)] <= bound[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return at

    def values(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins, depth)]


@dataclass
class Boosted:
    features: list[str]
    edges: list[list[float]]
    depth: int
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        """Numbers of the bins; a missing value lies beyond all bounds."""
        return np.stack([np.searchsorted(e, np.asarray(c, np.float64), "left") for e, c in zip(self.edges, columns, strict=True)], 1)

    def score(self, bins: np.ndarray) -> np.ndarray:
        return self.start + sum((t.values(bins, self.depth) for t in self.trees), np.zeros(len(bins)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def edges_of(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to bins-1 distinct quantiles of each feature, in one pass."""
    found = rows.agg(*(F.percentile_approx(F.col(f).cast("double"), [i / bins for i in range(1, bins)], 100 * bins).alias(f) for f in features)).first()
    return [sorted(set(found[f] or [])) for f in features]


def cells(rows: DataFrame, model: Boosted, label: str) -> DataFrame:
    """(b0, b1, ..., label, n, score): rows by their bins and label, written once.

    Rows of one cell have the same gradient in every round, so their number stands for them; there are at most as many
    cells as combinations of bins, however many rows there are. ``n``, if rows have it, is the number each stands for.
    """
    names = [f"b{i}" for i in range(len(model.features))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame(model.bins([b[f].to_numpy() for f in model.features]), columns=names)
            yield out.assign(label=b["label"].to_numpy(), n=b["n"].to_numpy()).groupby([*names, "label"], as_index=False)["n"].sum()

    schema = ", ".join([*(f"{n} long" for n in names), "label long", "n long"])
    plain = rows.select(*(F.col(f).cast("double").alias(f) for f in model.features), F.col(label).cast("long").alias("label"), F.col("n") if "n" in rows.columns else F.lit(1).alias("n")).where("label is not null")
    binned = plain.groupBy(*model.features, "label").agg(F.sum("n").alias("n")).mapInPandas(run, schema)
    return binned.groupBy(*names, "label").agg(F.sum("n").alias("n")).withColumn("score", F.lit(model.start))


def _parts(batch: pd.DataFrame, width: int) -> tuple[np.ndarray, ...]:
    return batch[[f"b{i}" for i in range(width)]].to_numpy(), batch["label"].to_numpy(), batch["n"].to_numpy(), batch["score"].to_numpy()


def histograms(table: DataFrame, model: Boosted, recent: list[Tree], tree: Tree, nodes: list[int], weights: dict[int, float]) -> np.ndarray:
    """[node, feature, bin, (gradient, hessian, rows)] over all cells, for nodes of a tree that grows.

    recent: the trees that the cells' scores don't hold yet. Each task sums its cells; the sums of at most TASKS tasks
    meet here.
    """
    width, most = len(model.features), max(len(e) for e in model.edges) + 1
    place = np.full(len(tree.feature), -1)
    place[nodes] = np.arange(len(nodes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(nodes), width, most, 3))
        for b in batches:
            bins, label, n, score = _parts(b, width)
            score = score + sum((t.values(bins, model.depth) for t in recent), np.zeros(len(bins)))
            node = place[tree.leaves(bins, model.depth)]
            p = sigmoid(score)
            w = n * np.where(label == 1, weights[1], weights[0])
            for f in range(width):
                at = (node * width + f) * most + bins[:, f]
                for k, x in enumerate((w * (p - label), w * p * (1 - p), n)):
                    keep = node >= 0
                    total[..., k] += np.bincount(at[keep], x[keep], total[..., k].size).reshape(total.shape[:3])
        yield pd.DataFrame({"sums": [total.tobytes()]})

    found = table.mapInPandas(run, "sums binary").collect()
    return sum((np.frombuffer(r.sums).reshape(len(nodes), width, most, 3) for r in found), np.zeros((len(nodes), width, most, 3)))


def best_split(sums: np.ndarray, least_rows: int, least_hessian: float) -> tuple[float, int, int, np.ndarray, np.ndarray] | None:
    """(gain, feature, bound, left sums, right sums) of a node's [feature, bin, 3]; None if no split gains. Ties: first feature, lowest bound."""
    total = sums[0].sum(0)
    left = np.cumsum(sums, 1)[:, :-1]
    right = total - left
    ok = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows) & (left[..., 1] >= least_hessian) & (right[..., 1] >= least_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - total[0] ** 2 / total[1]
    gain = np.where(ok, gain, -np.inf)
    if not gain.size or gain.max() <= 1e-12:
        return None
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[f, b]), int(f), int(b), left[f, b], right[f, b]


def grow(histograms_of, depth: int, leaves: int, rate: float, least_rows: int, least_hessian: float) -> Tree:
    """A tree of at most ``leaves`` leaves, always split where it gains most.

    A node's best split doesn't depend on other nodes. So one pass for each level finds the splits of all its nodes, and
    the leaf-by-leaf order is then taken from their gains: splits that are never reached are cut off again.
    """
    wide = Tree()
    wide.add(0.0)
    splits, sums, level = {}, {}, [0]
    for d in range(depth):
        found = histograms_of(wide, level)
        if d == 0:
            sums[0] = found[0][0].sum(0)
        level, before = [], level
        for node, own in zip(before, found, strict=True):
            if (split := best_split(own, least_rows, least_hessian)) is not None:
                gain, f, b, left, right = split
                splits[node] = gain
                wide.feature[node], wide.bound[node], wide.gain[node] = f, b, gain
                wide.left[node], wide.right[node] = wide.add(0.0), wide.add(0.0)
                sums[wide.left[node]], sums[wide.right[node]] = left, right
                level += [wide.left[node], wide.right[node]]
        if not level:
            break
    value = lambda s: float(-rate * s[0] / s[1]) if s[1] > 0 else 0.0
    tree = Tree()
    tree.add(value(sums[0]))
    heap, n = [(-splits[0], 0, 0)] if 0 in splits else [], 1
    while heap and n < leaves:
        _, node, at = heapq.heappop(heap)
        tree.feature[at], tree.bound[at], tree.gain[at] = wide.feature[node], wide.bound[node], wide.gain[node]
        for side, child in (("left", wide.left[node]), ("right", wide.right[node])):
            new = tree.add(value(sums[child]))
            getattr(tree, side)[at] = new
            if child in splits:
                heapq.heappush(heap, (-splits[child], child, new))
        n += 1
    return tree


def balance(table: DataFrame) -> dict[int, float]:
    """n / (2 n_class) for either class; 1 where a class is missing."""
    counts = {r.label: r.n for r in table.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # two rows
    total = sum(counts.values())
    return {k: total / (2 * counts[k]) if counts.get(k) else 1.0 for k in (0, 1)}


def fit(rows: DataFrame, features: list[str] = FEATURES, label: str = "is_match", iterations: int = 100, rate: float = 0.05, depth: int = 6, leaves: int = 31, bins: int = 255, least_rows: int = 20, least_hessian: float = 1e-3) -> Boosted:
    """A classifier with balanced classes for the log loss; label is 0 or 1, rows without one are left out.

    Features are cut into ``bins`` bins by their quantiles; missing values lie beyond the last. What is trained on are the
    cells of equal bins and label. Each level of a tree takes one pass over them. Scores are written into the cells after
    every SETTLED trees, so that no pass has more to redo. An empty table gives a model without trees.
    """
    model = Boosted(list(features), edges_of(rows, features, bins), depth)
    if not any(model.edges):
        return model
    table = io.written(cells(rows, model, label).coalesce(TASKS), "cells")
    weights = balance(table)
    done = 0
    while len(model.trees) < iterations:
        recent = model.trees[done:]
        passed = lambda tree, nodes: histograms(table, model, recent, tree, nodes, weights)  # noqa: B023, E731
        model.trees.append(grow(passed, depth, leaves, rate, least_rows, least_hessian))
        if len(model.trees) - done >= SETTLED and len(model.trees) < iterations:
            table, done = io.written(_advanced(table, model, model.trees[done:]), "cells"), len(model.trees)
    return model


def _advanced(table: DataFrame, model: Boosted, trees: list[Tree]) -> DataFrame:
    width = len(model.features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins, _, _, score = _parts(b, width)
            yield b.assign(score=score + sum((t.values(bins, model.depth) for t in trees), np.zeros(len(bins))))

    return table.mapInPandas(run, table.schema)


def score(model: Boosted, rows: DataFrame) -> DataFrame:
    """rows with match_probability."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # trees of at most ``leaves`` leaves

    @F.pandas_udf(T.DoubleType())
    def probability(*columns: pd.Series) -> pd.Series:
        return pd.Series(sigmoid(sent.value.score(sent.value.bins([c.to_numpy() for c in columns]))))

    return rows.withColumn("match_probability", probability(*(F.col(f).cast("double") for f in model.features)))


def logs(model: Boosted, train: DataFrame, val: DataFrame, label: str = "is_match") -> DataFrame:
    """(iteration, train_logloss, val_logloss), one pass over the cells of either table; train is balanced, validation isn't."""
    spark = train.sparkSession

    def losses(rows: DataFrame, balanced: bool) -> list[float]:
        table = io.written(cells(rows, model, label).coalesce(TASKS), "cells")
        weights = balance(table) if balanced else {0: 1.0, 1: 1.0}
        width = len(model.features)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(model.trees) + 1)
            for b in batches:
                bins, y, n, at = _parts(b, width)
                w = n * np.where(y == 1, weights[1], weights[0])
                total[-1] += w.sum()
                for i, t in enumerate(model.trees):
                    at = at + t.values(bins, model.depth)
                    total[i] += (w * np.logaddexp(0, np.where(y == 1, -at, at))).sum()
            yield pd.DataFrame({"sums": [total.tobytes()]})

        total = sum((np.frombuffer(r.sums) for r in table.mapInPandas(run, "sums binary").collect()), np.zeros(len(model.trees) + 1))
        return (total[:-1] / total[-1]).tolist() if total[-1] else [float("nan")] * len(model.trees)

    rows = zip(range(1, len(model.trees) + 1), losses(train, True), losses(val, False), strict=True)
    return spark.createDataFrame(list(rows), "iteration int, train_logloss double, val_logloss double")


def importances(spark: SparkSession, model: Boosted) -> DataFrame:
    """(feature, splits, gain): how often each feature splits, and its share of all gain."""
    splits, gain = dict.fromkeys(range(len(model.features)), 0), dict.fromkeys(range(len(model.features)), 0.0)
    for t in model.trees:
        for f, g in zip(t.feature, t.gain, strict=True):
            if f >= 0:
                splits[f] += 1
                gain[f] += g
    total = sum(gain.values()) or 1.0
    return spark.createDataFrame([(n, splits[i], gain[i] / total) for i, n in enumerate(model.features)], "feature string, splits long, gain double")


def save(spark: SparkSession, model: Boosted, path: str) -> None:
    """A new folder of two small tables, nodes and edges."""
    nodes = [(k, i, *x) for k, t in enumerate(model.trees) for i, x in enumerate(zip(t.feature, t.bound, t.left, t.right, t.value, t.gain, strict=True))]
    spark.createDataFrame(nodes, "tree int, node int, feature int, bound int, left int, right int, value double, gain double").coalesce(1).write.parquet(f"{path}/nodes")
    edges = [(i, n, e, model.depth, model.start) for i, (n, e) in enumerate(zip(model.features, model.edges, strict=True))]
    spark.createDataFrame(edges, "place int, feature string, edges array<double>, depth int, start double").coalesce(1).write.parquet(f"{path}/features")


def fit_or_load(rows: DataFrame, path: str, mode: str = "train", **settings: float) -> Boosted:
    if mode == "load":
        return load(rows.sparkSession, path)
    model = fit(rows, **settings)
    save(rows.sparkSession, model, path)
    return model


def load(spark: SparkSession, path: str) -> Boosted:
    named = spark.read.parquet(f"{path}/features").orderBy("place").collect()
    trees: dict[int, Tree] = {}
    for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
        tree = trees.setdefault(r.tree, Tree())
        for name in ("feature", "bound", "left", "right", "value", "gain"):
            getattr(tree, name).append(r[name])
    return Boosted([r.feature for r in named], [list(r.edges) for r in named], named[0].depth, named[0].start, [trees[k] for k in sorted(trees)])
