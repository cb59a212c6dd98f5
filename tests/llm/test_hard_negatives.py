"""Hard-negative mining against brute force: several shards, hot labels, ties, negative scores, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import hard_negatives, vector_shards

KINDS = "vec_id long, embedding array<double>, label int"


def brute_force(rows, anchors, k=5, low=80, high=100):
    whole = [(i, np.floor(np.array(v) * 256).astype(int), g) for i, v, g in rows]
    out = []
    for a in sorted(anchors):
        own, label = min((tuple(v), g) for i, v, g in whole if i == a)
        scored = sorted((-int(np.dot(own, v)), i, g) for i, v, g in whole if i != a)
        for p, i, _ in [x for x in scored if x[2] == label][:k]:
            found = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p][:k]
            out += [(a, i, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(found)]
    return out


@pytest.mark.parametrize("kind", ["mixed", "clusters"])
def test_against_brute_force(spark, monkeypatch, kind):
    for name, value in {"SHARD_ROWS": 90, "LEAF_ROWS": 8, "TASK_QUERIES": 9, "ROOTS": 3, "BUILD_TASKS": 3}.items():
        monkeypatch.setattr(vector_shards, name, value)
    monkeypatch.setattr(hard_negatives.VantageTree.__init__, "__defaults__", (8,))
    rng = np.random.default_rng(4)
    if kind == "mixed":
        rows = [(i, rng.normal(size=5).tolist(), int(rng.integers(0, 4)) if i % 3 else 0) for i in range(700)]
        rows += [(1000 + i, rows[0][1], i % 2) for i in range(120)]  # one hot vector of two labels
    else:
        rows = [(i, (rng.normal(size=3) + 6 * np.eye(3)[i % 3]).tolist(), i % 3 if i % 17 else 9) for i in range(700)]
    got = hard_negatives.mine(spark.createDataFrame(rows, KINDS), F.col("vec_id") % 25 == 0).collect()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_force(rows, [i for i, *_ in rows if i % 25 == 0])
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want) and want


def test_search_cuts_and_is_exact():
    """Searches over one tree equal a scan, and clustered vectors let most leaves go unseen."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 6)) * 400
    vectors = np.floor(centres[np.arange(4000) % 20] + rng.normal(size=(4000, 6)) * 9)
    ids, labels = rng.permutation(4000), rng.integers(0, 3, 4000)
    tree = hard_negatives.VantageTree(vectors, ids, labels, leaf=50)
    asked = {"vector": vectors[:60], "own": ids[:60], "label": labels[:60], "same": np.arange(60) % 2 == 0}
    scores = (vectors[:60] @ vectors.T).astype(np.int64)
    asked["high"] = np.sort(scores, 1)[:, -30]
    asked["low"] = np.sort(scores, 1)[:, -400]
    at, found, score = tree.search(asked, 5, None)
    for q in range(60):
        fit = (scores[q] >= asked["low"][q]) & (scores[q] <= asked["high"][q]) & (ids != ids[q])
        fit &= (labels == labels[q]) == asked["same"][q]
        order = sorted((-scores[q, i], ids[i]) for i in np.flatnonzero(fit))[:5]
        assert [(-s, i) for s, i in zip(score[at == q], found[at == q], strict=True)] == order
    seen = []
    tree.vectors = type("Counted", (), {"__getitem__": lambda _, own: (seen.append(len(own)), vectors[own])[1]})()
    one = {k: v[:1] for k, v in asked.items()}
    tree.search(one, 5, None)
    assert sum(seen) < 1200


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 1.9], 2), (4, [1.0], 2), (5, [nan, 1.0], 2),
        (6, [inf, 1.0], 2), (7, None, 2), (8, [None, 1.0], 2), (9, [1.0, 2.0], None), (None, [1.0, 2.0], 2), (10, [], 2),
        (100, [-1.0, 0.0], 3), (101, [-1.0, 0.0], 3), (102, [1.0, 0.0], 3), (103, [-1.0, 0.0], 4), (103, [-1.0, 0.0], 4),
    ]
    vectors = spark.createDataFrame(rows, KINDS)
    for c in ("query", "own", "rank", "score", "shard", "low", "raw"):
        vectors = vectors.withColumn(c, F.lit("clash"))
    got = sorted(map(tuple, hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0).collect()))
    size, near = 256 * 256 + 512 * 512, 256 * 256 + 512 * int(np.floor(1.9 * 256))
    unit = 65536
    assert got == [(0, 1, 1, 3, size, near), (0, 2, 1, 3, size, near), (100, 101, 1, 103, unit, unit), (100, 101, 2, 103, unit, unit)]
    assert hard_negatives.mine(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(vectors, F.col("vec_id") < -1).count() == 0
    assert hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=F.lit(1)).count() == 0
