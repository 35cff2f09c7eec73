"""Clustering by bisectors against plain arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from gridloom.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, id int"


def brute_force(vectors, k, size, rounds):
    kept = [
        (i, [math.floor(64 * x) if abs(x) < 2**53 else int(x) * 64 for x in v], v)
        for i, v, *_ in vectors
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2])
    middle = [r[1] for r in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        mine = {}
        for _, v, _ in kept:
            mine.setdefault(nearest(v)[1], []).append(v)
        for n, many in mine.items():
            middle[n] = [sum(x) // len(many) for x in zip(*many)]
    found = [(i, *nearest(v)[::-1]) for i, v, _ in kept]
    fits = lambda x: x if x < 2**63 else None
    sums = {n: sum(d for _, m, d in found if m == n) for n in range(len(middle))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(
        ((i, n, fits(d), fits(sums[n]), fits(sum(sums.values())), digest[n]) for i, n, d in found), key=repr
    )


@pytest.mark.parametrize("k, size", [(16, 64), (5, 3), (1, 2)])
def test_matches_brute_force(spark, rows, k, size):
    rng = random.Random(k)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(size)], "x", i) for i in range(300)]
    # A hot vector, repeated ids, ties halfway between two points, and vectors that take no part.
    vectors += [(1000 + i, [0.25] * size, "x", 0) for i in range(150)]
    vectors += [(7, [0.5] * size, None, 0), (7, [-0.5] * size, None, 0), (None, [1.0] * size, "", None)]
    vectors += [(2000, None, "", 0), (2001, [], "", 0), (2002, [1.0] * (size + 1), "", 0)]
    vectors += [(2003, [math.nan] * size, "", 0), (2004, [math.inf] * size, "", 0), (2005, [None] * size, "", 0)]
    frame = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    got = rows(centroids.cluster(frame, k=k, size=size))
    assert got == brute_force(vectors, k, size, 3)


def test_components_beyond_64_bits(spark, rows):
    rng = random.Random(3)
    vectors = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randint(0, 300) for _ in range(4)], "", i) for i in range(60)]
    vectors += [(100 + i, [rng.random() for _ in range(4)], "", i) for i in range(20)]
    got = rows(centroids.cluster(spark.createDataFrame(vectors, SCHEMA), k=6, size=4))
    assert got == brute_force(vectors, 6, 4, 3)
    assert any(r[2] is None for r in got)


def test_fewer_vectors_than_centroids_and_none(spark, rows):
    vectors = [(1, [0.5, 1.0], "", 1), (2, [0.5, 1.0], "", 1), (3, [9.0, 1.0], "", 1)]
    got = rows(centroids.cluster(spark.createDataFrame(vectors, SCHEMA), size=2))
    assert got == brute_force(vectors, 16, 2, 3)
    empty = centroids.cluster(spark.createDataFrame([], SCHEMA), size=2)
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "cluster", "distance"]


def test_sign_tests_agree_with_distances():
    rng = np.random.default_rng(1)
    middle = rng.integers(-3, 4, (12, 3))  # small whole numbers, so very many ties
    vectors = rng.integers(-5, 6, (2000, 3))
    winner, distance = centroids.Bisectors(middle.tolist()).winners(vectors)
    every = ((vectors[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (winner == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
