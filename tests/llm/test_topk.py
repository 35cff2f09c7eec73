"""Exact search against comparing everything."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(vectors, every, k):
    usable = {}
    for i, v, *_ in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = set()
    for q, (v, *_) in usable.items():
        if q % every == 0:
            scores = [
                (-sum(a * b for a, b in zip(v, w)), i)
                for i, many in usable.items()
                for w in many
                if i != q and len(w) == len(v)
            ]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def found(spark, rows, vectors, every, k=5):
    frame = spark.createDataFrame(vectors, SCHEMA)
    return set(rows(topk.top_k(frame, F.col("vec_id") % every == 0, k, "vec_id", "embedding")))


def test_matches_brute_force_over_many_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 90)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    points = (centres[rng.integers(0, 6, 400)] + 0.05 * rng.normal(size=(400, 8))).astype(np.float32)
    points[::9] = points[0]  # a very common vector, so ties
    vectors = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    assert found(spark, rows, vectors, 3) == brute_force(vectors, 3, 5)


def test_odd_rows(spark, rows):
    vectors = [
        (0, [1.0, 0.5], 1), (1, [0.5, -1.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1),
        (5, [float("inf"), 1.0], 1), (6, [0.25, 0.25], None), (None, [1.0, 1.0], 1), (8, [1.0], 1), (10, [2.0], 1),
        (12, [], 1), (14, [], 1), (15, [-0.001, 0.001], 1),
    ]
    assert found(spark, rows, vectors, 2) == brute_force(vectors, 2, 5)
    assert found(spark, rows, [], 2) == set()


def test_repeated_rows_leave_room_for_other_ids(spark, rows):
    vectors = [(0, [1.0, 0.5], 1)] * 8 + [(1, [1.0, 0.5], 1), (3, [1.0, 0.5], 1), (5, [0.5, 0.5], 1), (7, [0.25, 0.5], 1)]
    assert found(spark, rows, vectors, 2) == brute_force(vectors, 2, 5)
    vectors += [(4, [1.0, 0.5], 1)] * 3 + [(9, [1.0, 0.5], 1)] * 9
    assert found(spark, rows, vectors, 2) == brute_force(vectors, 2, 5)


def test_large_components_are_exact(spark, rows):
    vectors = [(0, [2.0**40, 1.0], 1), (1, [1.0, 3.0], 1), (2, [1.0, 2.0], 1), (3, [-1.0, 2.0], 1)]
    assert found(spark, rows, vectors, 2, 2) == brute_force(vectors, 2, 2)
    far = [(0, [2.0**60], 1), (1, [2.0**60], 1)]
    assert found(spark, rows, far, 2) == {(0, 1, 1, 2**63 - 1)}


def test_tree_covers_its_points():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(500, 5))
    stack = [topk.cover_tree(points)]
    while stack:
        node = stack.pop()
        away = np.sqrt(((points[node.rows] - node.centre) ** 2).sum(axis=1))
        assert away.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        stack += node.children


def test_block_without_candidates():
    empty = pd.DataFrame({"id": [], "vector": []})
    one = pd.DataFrame({"id": [1], "vector": [np.array([1.0])], "floor": [0.0]})
    assert len(topk.block_top_k(one, empty, 3)) == 0


def test_cells_that_cannot_win_are_not_asked():
    rng = np.random.default_rng(8)
    middles = 4000 * np.linalg.qr(rng.normal(size=(12, 12)))[0]
    points = np.floor(np.repeat(middles, 200, axis=0) + 20 * rng.normal(size=(2400, 12)))
    centres = topk.centres_of(points, 12)
    own, away = topk._nearest(points, centres)
    radii = np.array([away[own == c].max() for c in range(len(centres))])
    parts = np.bincount(own, minlength=len(centres))
    cells = topk.Cells(centres, radii, np.cumsum(parts) - parts, parts)
    asking = points[::100]
    scores = asking @ points.T
    floor = np.sort(scores, axis=1)[:, -5]
    block = np.argsort(np.argsort(own, kind="stable"))  # here every row is a block of its own
    share = []
    for line, least, found in zip(scores, floor, cells.open_blocks(asking, floor, np.full(len(asking), -1))):
        assert set(block[line >= least]) <= set(found)
        share.append(len(found) / len(points))
    assert np.mean(share) < 0.2


def test_blocks_of_cells_over_clusters(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(8, 6))
    points = (middles[rng.integers(0, 8, 500)] * rng.uniform(0.2, 3, (500, 1)) + 0.02 * rng.normal(size=(500, 6)))
    points[:170] = points[3]  # a third of the rows are copies
    vectors = [(i, [float(x) for x in p[: 6 - i % 2]], 0) for i, p in enumerate(points.astype(np.float32))]
    assert found(spark, rows, vectors, 5) == brute_force(vectors, 5, 5)
    assert found(spark, rows, vectors[:3], 5) == brute_force(vectors[:3], 5, 5)


def test_an_id_with_two_vectors_asks_with_the_smaller(spark, rows):
    vectors = [(0, [2.0, 1.0], 1), (0, [1.0, 5.0], 1), (1, [0.0, 1.0], 1), (3, [1.0, 0.0], 1)]
    assert found(spark, rows, vectors, 2) == brute_force([vectors[1], vectors[0], *vectors[2:]], 2, 5)
