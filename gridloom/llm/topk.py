"""Exact top-k by inner product with two cover trees.

The top of a cover tree over a bounded sample gives centres; every row is dealt to the cell of its
nearest centre, and each cell's radius is measured over all its rows. Cells are cut into blocks of
bounded size, so a crowded one is many. A query first meets one block of its own cell, which gives
it a k-th score to beat, and then only blocks of cells that can beat it: no inner product of a
query q with a row of a cell (centre c, radius s) exceeds q.c + |q|s.

Where queries and rows of a block meet, both are indexed as cover trees and walked together. For a
node of queries (centre a, radius r) and one of rows (centre b, radius s) no inner product exceeds
a.b + |a|s + |b|r + rs; the pair is skipped when that is below the worst k-th score in the query
node. Nothing is approximate: the sample only decides how rows are grouped. Vectors
that lie all in different directions leave nothing to skip; then every query meets every row.

Vectors are compared as integers: floor(scale * x) of each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.session import checkpointed

BLOCK_ROWS = 1 << 14  # rows of a block, on average
CELLS = 512  # centres at most
SAMPLE = 4096  # rows the centres are taken from, at most
LEAF = 256
WIDE_LEAF = 4096  # a node of at most this many rows that parts badly is not split
FAN = 16  # children of a node
SHRINK = 1.3  # a child covers at most this much less than its parent, if FAN allows
SLACK = 1e-9  # relative, for rounding in the bounds


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    norm: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)
    worst: float = -np.inf  # of a query node: the smallest k-th score below it


def cover_tree(points: np.ndarray, leaf: int = LEAF, wide: int = WIDE_LEAF) -> Node:
    """A cover tree over the rows of ``points``.

    The centres of a node's children are found farthest first: they cover the node within the
    children's radius and lie at least that far from each other. Radii are those measured. A node
    of up to ``wide`` rows whose children would hardly be smaller than itself stays a leaf.
    """

    def node(rows: np.ndarray, centre: int, distance: np.ndarray) -> Node:
        at = points[centre]
        return Node(at, float(distance.max()), float(np.sqrt(at @ at)), rows)

    def away(mine: np.ndarray, centre: int) -> np.ndarray:
        gap = mine - points[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    every = np.arange(len(points))
    root = node(every, 0, first := away(points, 0))
    stack = [(root, 0, first)]
    while stack:
        parent, centre, near = stack.pop()
        rows = parent.rows
        if len(rows) <= leaf or not parent.radius:
            continue
        mine = points[rows]
        centres, owner, near = [centre], np.zeros(len(rows), np.int64), near.copy()
        while len(centres) < FAN and near.max() > parent.radius / SHRINK:
            centres.append(int(rows[near.argmax()]))
            gap = away(mine, centres[-1])
            closer = gap < near
            owner[closer], near[closer] = len(centres) - 1, gap[closer]
        if len(rows) <= wide and near.max() > parent.radius / SHRINK:
            continue
        for i, c in enumerate(centres):
            chosen = owner == i
            child = node(rows[chosen], c, near[chosen])
            parent.children.append(child)
            stack.append((child, c, near[chosen]))
    return root


def centres_of(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` centres: nodes of a cover tree, the widest opened first."""
    nodes = [cover_tree(points, 1, 0)]
    while len(nodes) < count:
        widest = max(range(len(nodes)), key=lambda i: nodes[i].radius)
        if not nodes[widest].children:
            break
        nodes[widest : widest + 1] = nodes[widest].children
    return np.stack([n.centre for n in nodes])


def _bound(a: Node, b: Node) -> float:
    top = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    return top + SLACK * (1 + abs(top) + a.norm * b.norm)


class Search:
    """Best k candidates of each query: ``scores`` and ``ids``, best first.

    Scores below a query's ``floor`` are not looked for.
    """

    def __init__(self, queries, query_ids, points, point_ids, k: int, floor=None):
        self.q, self.qid, self.k = queries, query_ids, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.least = np.full(len(queries), -np.inf) if floor is None else np.array(floor, np.float64)
        # Copies of a vector are one point; of their ids only the k + 1 smallest can count, one of
        # which may be the query's own, and k rows of each.
        order = np.lexsort((point_ids, *points.T[::-1]))
        points, point_ids = points[order], point_ids[order]
        new = np.ones(len(points), bool)
        new[1:] = (points[1:] != points[:-1]).any(axis=1)
        start = np.flatnonzero(new)
        # The number of each row's id among those of its vector, and of the row among the id's.
        other = new.copy()
        other[1:] |= point_ids[1:] != point_ids[:-1]
        begin = np.flatnonzero(other)
        ids = np.cumsum(other) - 1
        nth = ids - np.repeat(ids[start], np.diff(np.append(start, len(points))))
        again = np.arange(len(points)) - np.repeat(begin, np.diff(np.append(begin, len(points))))
        self.p = points[start]
        self.group = np.cumsum(new) - 1
        keep = (nth <= k) & (again < k)
        self.group, self.pid = self.group[keep], point_ids[keep]
        self.first = np.searchsorted(self.group, np.arange(len(self.p) + 1))
        root = cover_tree(self.q)
        self.lift(root)
        self.walk(root, cover_tree(self.p))

    def lift(self, root: Node) -> None:
        """Set the worst scores that the floors give."""
        stack = [root]
        while stack:
            node = stack.pop()
            node.worst = float(self.least[node.rows].min())
            stack += node.children

    def walk(self, queries: Node, points: Node) -> None:
        stack = [(queries, points, _bound(queries, points))]
        while stack:
            a, b, top = stack.pop()
            if top < self.worst(a):
                continue
            if not a.children and not b.children:
                self.compare(a, b)
                continue
            wide = a.children and (not b.children or a.radius > b.radius)
            pairs = [(x, b) for x in a.children] if wide else [(a, y) for y in b.children]
            # The most promising pair last, so that it is taken first.
            stack += sorted(((x, y, _bound(x, y)) for x, y in pairs), key=lambda p: p[2])

    def worst(self, a: Node) -> float:
        """Children only ever raise their own figure, so a stale one is merely weaker."""
        if a.children:
            a.worst = max(a.worst, min(x.worst for x in a.children))
        return a.worst

    def compare(self, a: Node, b: Node) -> None:
        scores = self.q[a.rows] @ self.p[b.rows].T
        beat = np.maximum(self.scores[a.rows, -1], self.least[a.rows])
        hit = np.flatnonzero(scores.max(axis=1) >= beat)
        if len(hit):
            self.merge(a.rows[hit], b.rows, scores[hit], beat[hit])
            a.worst = float(np.maximum(self.scores[a.rows, -1], self.least[a.rows]).min())

    def merge(self, rows: np.ndarray, points: np.ndarray, scores: np.ndarray, beat: np.ndarray) -> None:
        """Take the scores of some queries with some points into their best."""
        if scores.shape[1] > self.k + 1:
            # One of a query's points may be itself, so one more than k is looked at.
            high = -np.partition(-scores, self.k, axis=1)[:, self.k]
            beat = np.maximum(beat, high)
        row, column = np.nonzero(scores >= beat[:, None])
        size = self.first[points[column] + 1] - self.first[points[column]]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids = self.pid[np.repeat(self.first[points[column]], size) + at]
        value, row = np.repeat(scores[row, column], size), np.repeat(row, size)
        other = ids != self.qid[rows[row]]
        old = np.repeat(np.arange(len(rows)), self.k)
        row = np.concatenate((row[other], old))
        value = np.concatenate((value[other], self.scores[rows].ravel()))
        ids = np.concatenate((ids[other], self.ids[rows].ravel()))
        order = np.lexsort((ids, -value, row))
        row, value, ids = row[order], value[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.scores[rows[row[best]], place[best]] = value[best]
        self.ids[rows[row[best]], place[best]] = ids[best]


def _exact(values: np.ndarray) -> bool:
    """Whether inner products of these integers are exact in double precision."""
    top = float(np.abs(values).max(initial=0))
    return top * top * max(values.shape[1], 1) < 2**53


def _matrix(vectors: pd.Series, length: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64).reshape(len(vectors), length)


def block_top_k(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k candidates in ``rows`` for each of ``queries``; vectors of equal length only.

    Vectors are whole numbers. ``floor`` of a query is a score its result must reach.
    """
    out = []
    lengths = rows["vector"].map(len) if len(rows) else pd.Series([], dtype="int64")
    for length, mine in queries.groupby(queries["vector"].map(len)):
        theirs = rows[lengths == length]
        if not len(theirs):
            continue
        q, p = _matrix(mine["vector"], length), _matrix(theirs["vector"], length)
        qid, pid = mine["id"].to_numpy(), theirs["id"].to_numpy()
        if _exact(q) and _exact(p):
            found = Search(q, qid, p, pid, k, mine["floor"].to_numpy())
            at, rank = np.nonzero(found.scores > -np.inf)
            score = found.scores[at, rank].astype(np.int64)
            out.append(pd.DataFrame({"query_id": qid[at], "id": found.ids[at, rank], "score": score}))
            continue
        # Components beyond double precision: exact integers, held to the range of a long.
        table = [[int(x) for x in v] for v in p]
        for i, v in zip(qid, q):
            v = [int(x) for x in v]
            scores = [sum(a * b for a, b in zip(v, w)) for w in table]
            clip = [min(max(s, -(2**63)), 2**63 - 1) for s in scores]
            best = sorted((-s, j) for s, j in zip(clip, pid) if j != i)[:k]
            out.append(pd.DataFrame({"query_id": i, "id": [j for _, j in best], "score": [-s for s, _ in best]}))
    columns = {"query_id": "int64", "id": "int64", "score": "int64"}
    if not out:
        return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in columns.items()})
    return pd.concat(out).astype(columns)


@dataclass
class Cells:
    """The cells of the vectors of one length."""

    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray  # number of each cell's first block
    parts: np.ndarray  # blocks of each cell, 0 for one without rows

    def open_blocks(self, queries: np.ndarray, floor: np.ndarray, done: np.ndarray) -> list[np.ndarray]:
        """The blocks that can hold a score of at least ``floor``, but for the one done."""
        norm = np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]
        top = queries @ self.centres.T + norm * self.radii
        slack = SLACK * (1 + np.abs(top) + norm * np.sqrt(np.einsum("ij,ij->i", self.centres, self.centres)))
        out = []
        for fits, own in zip(top + slack >= floor[:, None], done):
            cells = np.flatnonzero(fits & (self.parts > 0))
            blocks = [np.arange(f, f + n) for f, n in zip(self.first[cells], self.parts[cells])]
            blocks = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
            out.append(blocks[blocks != own])
        return out


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector (about: any would do) and the distance to it."""
    own = (np.einsum("ij,ij->i", centres, centres) / 2 - vectors @ centres.T).argmin(axis=1)
    gap = vectors - centres[own]
    return own, np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    if len(frame):
        yield from frame.groupby(frame["vector"].map(len))


def top_k(
    vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: int = 256
) -> DataFrame:
    """The k best other rows for each query: query_id, rank (from 1), ``id_col``, score.

    Ties go to the smaller id. Rows with a NULL id or a vector that is NULL or holds NULL or
    non-finite components take no part; neither do candidates with the query's own id, or
    of another length. Query rows that repeat an id give one result, that of the smallest
    vector, components compared from the first on. Components whose products
    leave double precision are multiplied as whole numbers and held to the range of a long.
    """
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & vector.isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), is_query.alias("asks"))
    spark = vectors.sparkSession
    count, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    sample = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").toPandas()
    centres = {}
    for length, mine in _by_length(sample):
        share = -(-count * len(mine) // (len(sample) * BLOCK_ROWS))
        points = np.floor(scale * _matrix(mine["vector"], length))
        centres[length] = centres_of(points, min(share, -(-CELLS * len(mine) // len(sample))))
    sent = spark.sparkContext.broadcast(centres)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, mine in _by_length(frame):
                found = np.floor(scale * _matrix(mine["vector"], length))
                own, away = _nearest(found, sent.value.get(length, np.zeros((1, length))))
                yield pd.DataFrame(
                    {"id": mine["id"].to_numpy(), "vector": list(found), "asks": mine["asks"].to_numpy(),
                     "length": length, "cell": own, "away": away}
                )

    dealt = checkpointed(
        rows.mapInPandas(deal, "id long, vector array<double>, asks boolean, length int, cell int, away double")
    )
    # One row per cell: at most CELLS and one for each length the sample lacks.
    sizes = dealt.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius"))
    cells, table, blocks = {}, [], 0
    for r in sizes.orderBy("length", "cell").collect():
        middle = centres.get(r.length, np.zeros((1, r.length)))
        zeros = [np.zeros(len(middle), t) for t in (np.float64, np.int64, np.int64)]
        mine = cells.setdefault(r.length, Cells(middle, *zeros))
        parts = -(-r.rows // BLOCK_ROWS)
        mine.radii[r.cell], mine.first[r.cell], mine.parts[r.cell] = r.radius, blocks, parts
        table.append((r.length, r.cell, blocks, parts))
        blocks += parts
    table = spark.createDataFrame(table, "length int, cell int, first long, parts long")
    placed = dealt.join(F.broadcast(table), ["length", "cell"]).withColumn(
        "block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
    )
    query_blocks = max(1, -(-asking // BLOCK_ROWS))
    queries = placed.where("asks").groupBy("id").agg(F.min(F.struct("vector", "block")).alias("_least"))
    queries = checkpointed(
        queries.select("id", "_least.*").withColumn("query_block", F.pmod(F.xxhash64("id"), F.lit(query_blocks)))
    )
    # New names, as Spark tells two columns of one origin apart by them.
    placed = placed.select(*[F.col(c).alias(f"_{c}") for c in ("id", "vector", "block")])

    def meet(asked: DataFrame) -> DataFrame:
        """The best of each query in the blocks it asks, by pairs of blocks that meet."""
        wanted = asked.select(F.col("query_block").alias("_query_block"), F.col("block").alias("_block"))
        met = placed.join(wanted.distinct(), "_block").groupBy("_query_block", "_block")
        return (
            asked.groupBy("query_block", "block")
            .cogroup(met)
            .applyInPandas(
                lambda q, r: block_top_k(q, r.rename(columns=lambda c: c.lstrip("_")), k),
                "query_id long, id long, score long",
            )
        )

    own = checkpointed(meet(queries.withColumn("floor", F.lit(float("-inf")))))
    reached = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    # The k-th score so far; one at the lower end of a long may have been cut off there.
    full = (F.col("n") >= k) & (F.col("least") > -(2**63))
    floor = F.coalesce(F.when(full, F.col("least").cast("double")), F.lit(float("-inf")))
    known = queries.join(reached, queries["id"] == reached["query_id"], "left")
    index = spark.sparkContext.broadcast(cells)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, mine in _by_length(frame):
                found = index.value[length].open_blocks(
                    _matrix(mine["vector"], length), mine["floor"].to_numpy(), mine["block"].to_numpy()
                )
                yield mine.assign(blocks=found)[["id", "vector", "query_block", "floor", "blocks"]]

    asked = known.select("id", "vector", "block", "query_block", floor.alias("floor")).mapInPandas(
        ask, "id long, vector array<double>, query_block long, floor double, blocks array<long>"
    )
    rest = meet(asked.withColumn("block", F.explode("blocks")).drop("blocks"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return (
        own.unionByName(rest)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
