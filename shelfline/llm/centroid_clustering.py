"""Centroid clustering of integer vectors by a vantage-point tree over the centroids.

Each round the driver builds a vantage-point tree over the centroids (a bounded number, by parameter) and broadcasts
it.  Tasks assign their vectors by best-first branch and bound: of all subtrees that a vector has open, the one with the
least possible distance is entered next, and a vector is done once that bound is above its best distance.  Bounds come
from the triangle inequality in floating point, widened by a slack and compared inclusively, so a centroid at the same
distance is always reached; distances themselves are exact integers, and of equal ones the smaller centroid number
wins.  The searches of a batch advance together: the vectors that enter the same node are handled in one array step.

Tasks return one row of sums per cluster; Spark adds these rows up, so a cluster that holds most vectors costs a row a
task.  Vectors are read again each round and never shuffled.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out.  A scaled
component must lie within +-2**27, where squared distances are exact in a long; a vector beyond that is left out too.
A null vec_id is clustered and starts a centroid only after all others.  Repeated rows count as vectors of their own;
starts with equal hashes go in order of their vectors.  Fewer vectors than ``CLUSTERS`` give as many centroids; an
empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, "1"
REACH = 1 << 27
LEAF, CELLS = 4, 1 << 22
SLACK = 1e-9


@dataclass
class Node:
    points: np.ndarray  # a leaf's centroid numbers, else the vantage point's alone
    children: tuple[tuple[int, float, float], ...]  # (node, least and greatest distance from the vantage point)


class VantageTree:
    """Vantage-point tree over centroids; ``nearest`` returns numbers and exact squared distances."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.nodes: list[Node] = []
        waiting = [(np.arange(len(centroids)), -1)]
        while waiting:
            points, parent = waiting.pop()
            at = len(self.nodes)
            if parent >= 0:  # the parent knows how far its own point is from this subtree
                d = np.sqrt(self._squares(centroids[points], self.nodes[parent].points[:1])[:, 0].astype(float))
                self.nodes[parent].children += ((at, float(d.min()), float(d.max())),)
            if len(points) <= LEAF:
                self.nodes.append(Node(points, ()))
                continue
            self.nodes.append(Node(points[:1], ()))
            rest = points[1:]
            d = self._squares(centroids[rest], points[:1])[:, 0]
            near = d <= np.sort(d)[(len(d) - 1) // 2]
            waiting += [(part, at) for part in (rest[near], rest[~near]) if len(part)]

    def _squares(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows to some centroids."""
        gap = x[:, None, :] - self.centroids[points][None, :, :]
        return np.einsum("ijk,ijk->ij", gap, gap)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, square = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        step = max(1, CELLS // len(self.nodes))
        for at in range(0, len(x), step):
            part = slice(at, at + step)
            number[part], square[part] = self._search(x[part])
        return number, square

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.full(len(x), np.iinfo(np.int64).max)
        who = np.full(len(x), len(self.centroids))
        bound = np.full((len(x), len(self.nodes)), np.inf)  # of the nodes that are open
        bound[:, 0] = 0
        rows = np.arange(len(x))
        while len(rows):
            entered = np.argmin(bound[rows], axis=1)
            going = bound[rows, entered] <= np.sqrt(best[rows].astype(float)) * (1 + SLACK) + SLACK
            rows, entered = rows[going], entered[going]
            for at in np.unique(entered):
                node, own = self.nodes[at], rows[entered == at]
                bound[own, at] = np.inf
                d = self._squares(x[own], node.points)
                for k, point in enumerate(node.points):
                    better = (d[:, k] < best[own]) | ((d[:, k] == best[own]) & (point < who[own]))
                    best[own[better]], who[own[better]] = d[better, k], point
                if node.children:
                    away = np.sqrt(d[:, 0].astype(float))
                    for child, low, high in node.children:
                        bound[own, child] = np.maximum(np.maximum(away - high, low - away), 0) * (1 - SLACK)
        return who, best


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def kept_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer vector of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fits = F.forall(x, lambda v: v.isNotNull() & (v * scale >= -REACH) & (v * scale < REACH))  # NaN is above all numbers
    return (vectors.where((F.size("embedding") == dim) & fits)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("x")))


def starts(kept: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order."""
    mark = F.coalesce(F.sha2(F.concat(F.lit(SEED + ":"), F.col("vec_id").cast("string")), 256), F.lit("~"))
    rows = kept.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster(spark: SparkSession, vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per vector that takes part."""
    kept = kept_vectors(vectors, dim)
    centroids = starts(kept, clusters)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))

        def sums(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            size = tree.value.centroids.shape
            total, n = np.zeros(size, np.int64), np.zeros(size[0], np.int64)
            for batch in batches:
                x = _vectors(batch.column(0))
                who, _ = tree.value.nearest(x)
                for c in np.unique(who):
                    total[c] += x[who == c].sum(axis=0)
                n += np.bincount(who, minlength=len(n))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                                             names=["cluster", "n", "total"])

        # one row per cluster and component comes back: bounded by the parameters
        found = (kept.select("x").mapInArrow(sums, "cluster int, n long, total array<long>")
                 .select("cluster", "n", F.posexplode("total").alias("k", "part"))
                 .groupBy("cluster", "k").agg(F.sum("part").alias("total"), F.sum("n").alias("n")).collect())
        centroids = centroids.copy()
        for r in found:
            centroids[r["cluster"], r["k"]] = r["total"] // r["n"]
        tree.unpersist()
    tree = spark.sparkContext.broadcast(VantageTree(centroids))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, square = tree.value.nearest(_vectors(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(square)], names=["vec_id", "cluster", "distance"])

    rows = Scratch(spark, "clusters").keep(kept.mapInArrow(assigned, "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, n, sum(inertia.values()), names[c]) for c, n in sorted(inertia.items())],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", *facts.columns[:1], "distance", *facts.columns[1:])


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all ``embeddings``: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    return cluster(spark, table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    sql = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f, ROW_NUMBER() OVER () AS row_no FROM embeddings WHERE len(embedding) = {DIM}),
v AS MATERIALIZED (SELECT vec_id, row_no, list_transform(f, lambda q: CAST(floor({SCALE} * q) AS BIGINT)) AS x FROM e
      WHERE len(list_filter(f, lambda q: q IS NULL OR NOT isfinite(q) OR {SCALE} * q < -{REACH} OR {SCALE} * q >= {REACH})) = 0),
c0 AS MATERIALIZED (SELECT CAST(ROW_NUMBER() OVER (ORDER BY coalesce(sha256('{SEED}:' || vec_id), '~'), x) - 1 AS INT) AS cluster, x
       FROM v ORDER BY cluster LIMIT {CLUSTERS})"""
    for k in range(ROUNDS + 1):
        sql += f""",
a{k} AS MATERIALIZED (SELECT v.vec_id, v.row_no, v.x, arg_min(c.cluster, ({distance}, c.cluster)) AS cluster, CAST(min({distance}) AS BIGINT) AS distance
       FROM v CROSS JOIN c{k} c GROUP BY ALL)"""
        if k < ROUNDS:
            sql += f""",
s{k} AS (SELECT cluster, i, SUM(x[i]) AS s, COUNT(*) AS n FROM a{k}, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY 1, 2),
n{k} AS (SELECT cluster, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{k} GROUP BY 1),
c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN n{k} n ON n.cluster = c.cluster)"""
    return sql + f"""
SELECT a.vec_id, a.cluster, a.distance, CAST(SUM(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(SUM(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.cluster
"""


ORACLE = _oracle()
