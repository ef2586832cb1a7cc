import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from shelfline.llm import centroid_clustering as cc

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance long, x int"


def plainly(rows, clusters, rounds, dim):
    """Every vector against every centroid, in whole numbers."""
    kept = [(i, tuple(math.floor(64 * float(np.float32(v))) for v in e)) for i, e in rows
            if e is not None and len(e) == dim and all(v is not None and math.isfinite(v) and -2**27 <= 64 * v < 2**27 for v in e)]
    order = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centroids = [tuple(sum(v) // len(groups[k]) for v in zip(*groups[k], strict=True)) if k in groups else c for k, c in enumerate(centroids)]
    final = [(i, *nearest(x)) for i, x in kept]
    own = Counter()
    for _, d, k in final:
        own[k] += d
    return Counter((i, k, d, own[k], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in final)


@pytest.mark.parametrize("kind", ["spread", "ties"])
def test_equals_all_distances(spark, kind):
    rng = random.Random(3)
    value = (lambda: rng.gauss(0, 1)) if kind == "spread" else (lambda: rng.choice([-0.5, 0.0, 0.5]))
    dim = 64 if kind == "spread" else 3
    rows = [(i, [value() for _ in range(dim)]) for i in range(400)]
    rows += [rows[5], rows[5], (None, rows[7][1]), (None, None), (500, None), (501, []), (502, [1.0] * (dim - 1)), (503, [1.0] * (dim - 1) + [None]),
             (504, [float("nan")] * dim), (505, [float("inf")] * dim), (506, [0.0] * dim), (507, [-1e6] * dim), (508, [3e37] * dim)]
    df = spark.createDataFrame([(i, e, 0, 9, 9, 9) for i, e in rows], SCHEMA).repartition(5)
    for clusters in (1, 16, 40):
        got = Counter(map(tuple, cc.cluster(spark, df, clusters, 3, dim).collect()))
        assert got == plainly(rows, clusters, 3, dim)
    assert cc.cluster(spark, df.limit(0), 16, 3, dim).collect() == []
    few = rows[:3]
    assert Counter(map(tuple, cc.cluster(spark, df.where("vec_id < 3"), 16, 3, dim).collect())) == plainly(few, 16, 3, dim)


@pytest.mark.parametrize("n", [1, 4, 5, 17, 300])
def test_tree_search_is_exact_and_prunes(n):
    rng = np.random.default_rng(n)
    for centroids in (rng.integers(-50, 50, (n, 2)), rng.integers(-2, 2, (n, 2)), np.zeros((n, 2), np.int64), rng.integers(-2**27, 2**27, (n, 64))):
        tree = cc.VantageTree(centroids)
        x = np.concatenate([rng.integers(-50, 50, (200, centroids.shape[1])), centroids])
        square = np.stack([np.einsum("ij,ij->i", x - c, x - c) for c in centroids], axis=1)
        who, d = tree.nearest(x)
        assert (who == np.argmin(square, axis=1)).all() and (d == square.min(axis=1)).all()
        assert sorted(p for node in tree.nodes for p in node.points) == list(range(n))
    seen = []
    tree = cc.VantageTree(rng.integers(-50, 50, (300, 2)))
    real = tree._squares
    tree._squares = lambda x, points: seen.append(len(x) * len(points)) or real(x, points)
    tree.nearest(rng.integers(-50, 50, (500, 2)))
    assert sum(seen) < 500 * 300 / 4
