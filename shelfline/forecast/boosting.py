"""Second-order gradient boosting as Spark aggregates.

Rows are training windows with binned features.  Each level of a tree is one grouped aggregate: the gradient sums and row
counts (the hessian of squared error is 1) by (node, feature, bin), combined map-side, so what reaches the driver is
nodes x features x bins numbers whatever the panel's size.  The driver picks, per open node, the split with the best gain

    1/2 * (GL^2 / (HL + l) + GR^2 / (HR + l) - G^2 / (H + l))

and a leaf's value is -G / (H + l) times the learning rate.  Rows and features are drawn per tree by hash, rows of a window
by its series and month.  Gradients are summed as whole numbers of 1/UNIT, so trees depend neither on the partitioning nor
on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BINS, UNIT, KEEP = 64, 1 << 24, 10


@dataclass(frozen=True)
class Settings:
    """The original's hyper-parameters; ``leaf_penalty`` and ``min_rows`` are its library's defaults."""
    rounds: int = 200
    depth: int = 4
    rate: float = 0.05
    rows: float = 0.8
    features: float = 0.8
    leaf_penalty: float = 1.0
    min_rows: int = 1
    seed: int = 42


@dataclass
class Tree:
    """Heap order: the children of node i are 2i + 1 (bin <= cut) and 2i + 2."""
    split: dict[int, tuple[int, int]] = field(default_factory=dict)  # node -> feature, cut
    value: dict[int, float] = field(default_factory=dict)            # leaf -> value


@dataclass
class Boosted:
    base: float
    trees: list[Tree]


def binned(features: Column) -> Column:
    """Bins of features scaled to 0..1; what lies outside goes to the outer bins."""
    return F.transform(features, lambda x: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(x * BINS).cast("int"))))


def _heap(depth: int) -> int:
    return 2 ** (depth + 1) - 1


def _literal(values: Iterable) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def _laid_out(trees: list[Tree], depth: int) -> tuple[Column, Column, Column]:
    """Features (-1 at a leaf), cuts and values of all nodes, tree after tree, as array literals: a plan has one shape
    and one compiled code whatever the trees."""
    size = _heap(depth)
    split = [t.split.get(n, (-1, 0)) for t in trees for n in range(size)]
    value = [t.value.get(n, 0.0) for t in trees for n in range(size)]
    return _literal(f for f, _ in split), _literal(c for _, c in split), _literal(f"{v!r}D" for v in value)


def _reached(trees: list[Tree], depth: int, start: Column | int = 0) -> Column:
    """The node (an index from ``start``, the tree's own first place) that a row's bins lead to."""
    feature, bound, _ = _laid_out(trees, depth)
    start = F.lit(start) if isinstance(start, int) else start

    def step(at: Column, _: Column) -> Column:
        f = F.get(feature, start + at)
        return F.when(f < 0, at).otherwise(2 * at + F.when(F.get(F.col("bins"), f) > F.get(bound, start + at), 2).otherwise(1))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def _summed(trees: list[Tree], depth: int) -> Column:
    """The sum of the trees' values."""
    value = _laid_out(trees, depth)[2]
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(trees) - 1)), F.lit(0.0),
                       lambda total, i: total + F.get(value, i * _heap(depth) + _reached(trees, depth, i * _heap(depth))))


def drawn_features(s: Settings, k: int, n: int) -> list[int]:
    """The features of tree k: those with the smallest hashes."""
    order = sorted(range(n), key=lambda f: hashlib.sha256(f"{s.seed}:{k}:{f}".encode()).hexdigest())
    return sorted(order[:max(1, int(s.features * n))])


def drawn_rows(s: Settings, k: int) -> Column:
    return F.pmod(F.xxhash64("series_id", "t", F.lit(s.seed), F.lit(k)), F.lit(1000)) < int(1000 * s.rows)


def _gain(g: float, h: float, penalty: float) -> float:
    return g * g / (h + penalty)


def best_split(cells: dict[tuple[int, int], tuple[int, int]], s: Settings) -> tuple[float, int, int, tuple, tuple] | None:
    """(gain, feature, cut, left sums, right sums) of one node from its (feature, bin) -> (gradient units, rows)."""
    best = None
    for feature in sorted({f for f, _ in cells}):
        column = sorted((b, v) for (f, b), v in cells.items() if f == feature)
        g, h = (sum(v[i] for _, v in column) for i in (0, 1))
        gl = hl = 0
        for b, v in column[:-1]:
            gl, hl = gl + v[0], hl + v[1]
            gr, hr = g - gl, h - hl
            if min(hl, hr) < s.min_rows:
                continue
            gain = (_gain(gl / UNIT, hl, s.leaf_penalty) + _gain(gr / UNIT, hr, s.leaf_penalty) - _gain(g / UNIT, h, s.leaf_penalty)) / 2
            if gain > 1e-12 and (best is None or gain > best[0]):
                best = (gain, feature, b, (gl, hl), (gr, hr))
    return best


def histogram(rows: DataFrame, tree: Tree, open_: list[int], features: list[int], depth: int) -> DataFrame:
    """node, feature, bin, g, n of the open nodes: one grouped aggregate."""
    cells = F.transform(_literal(features), lambda f: F.struct(f.alias("feature"), F.get(F.col("bins"), f).alias("bin")))
    units = F.bround((F.col("margin") - F.col("label")) * UNIT).cast("long")
    return (rows.select(_reached([tree], depth).alias("node"), units.alias("g"), cells.alias("cells"))
            .where(F.array_contains(_literal(open_), F.col("node")))
            .select("node", "g", F.inline("cells")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n")))


def grow(rows: DataFrame, features: list[int], s: Settings) -> Tree:
    tree, open_ = Tree(), [0]
    for level in range(s.depth):
        if not open_:
            break
        cells: dict[int, dict] = {}
        for r in histogram(rows, tree, open_, features, s.depth).collect():  # at most nodes x features x bins
            cells.setdefault(r["node"], {})[r["feature"], r["bin"]] = (r["g"], r["n"])
        after = []
        for node in open_:
            found = best_split(cells.get(node, {}), s)
            if level == 0 and found is None and node in cells:
                one = [v for (f, _), v in cells[node].items() if f == features[0]]
                tree.value[node] = _leaf(sum(g for g, _ in one), sum(n for _, n in one), s)
            if found:
                _, feature, bound, left, right = found
                tree.split[node] = (feature, bound)
                tree.value.pop(node, None)
                for child, (g, n) in ((2 * node + 1, left), (2 * node + 2, right)):
                    tree.value[child] = _leaf(g, n, s)
                    after.append(child)
        open_ = after
    return tree


def _leaf(units: int, n: int, s: Settings) -> float:
    return -(units / UNIT) / (n + s.leaf_penalty) * s.rate


def train(rows: DataFrame, n_features: int, s: Settings = Settings()) -> Boosted:
    """From series_id, t, bins array<int>, label.  The rows are written every ``KEEP`` trees, so a plan holds few trees."""
    total = rows.agg(F.sum(F.bround(F.col("label") * UNIT).cast("long")).alias("g"), F.count("label").alias("n")).first()
    model = Boosted(total["g"] / total["n"] / UNIT if total["n"] else 0.0, [])
    if not total["n"]:
        return model
    written = cut(rows.select("series_id", "t", "bins", "label", F.lit(model.base).alias("margin")))
    recent: list[Tree] = []
    for k in range(s.rounds):
        now = written.withColumn("margin", F.col("margin") + _summed(recent, s.depth)) if recent else written
        if len(recent) == KEEP:
            written, recent = cut(now), []
            now = written
        tree = grow(now.where(drawn_rows(s, k)), drawn_features(s, k, n_features), s)
        model.trees.append(tree)
        recent.append(tree)
    return model


def predicted(model: Boosted, bins: Column) -> Column:
    """The model's value for binned features, by Arrow batches."""
    size = max([0, *(n for t in model.trees for n in [*t.split, *t.value])]) + 1
    feature, bound = (np.zeros((len(model.trees), size), np.int64) for _ in range(2))
    inner, value = np.zeros((len(model.trees), size), bool), np.zeros((len(model.trees), size))
    for i, tree in enumerate(model.trees):
        for node, (f, b) in tree.split.items():
            feature[i, node], bound[i, node], inner[i, node] = f, b, True
        for node, v in tree.value.items():
            value[i, node] = v
    base, depth = model.base, max(1, size.bit_length())

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=float)
        x = np.stack(column.to_numpy())
        rows, out = np.arange(len(x)), np.full(len(x), base)
        for i in range(len(feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                go = inner[i, at]
                if not go.any():
                    break
                at = np.where(go, 2 * at + 1 + (x[rows, feature[i, at]] > bound[i, at]), at)
            out += value[i, at]
        return pd.Series(out)

    return score(bins)
