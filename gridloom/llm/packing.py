"""Packing documents into training windows with a controlled mixture of sources.

Documents are dealt into parts of a few megabytes by a hash, so that each part holds about
the whole mixture. Inside a part every source is a queue of documents, and windows are filled
by deficit round-robin: a source gains its target share of each window as credit and is
served while its credit lasts, cutting documents where a turn or a window ends. Credit that
could not be used waits for the next window. A part starts with the credit its sources are
owed from the parts before it, so that the target holds over any run of windows.

Windows are full; what a part has left over at its end goes to windows of powers of two, which
need no padding either.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.llm.text import slices
from gridloom.llm.tokens import encoder
from gridloom.session import checkpointed

PART_BYTES = 4 << 20
TURN = 256  # a source waits until it may place this many tokens at once, to cut less
_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("source", pa.string()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
_SEQUENCE_BITS = 32  # of a sequence id, below the part


class Queues:
    """The documents of a part by source, and the round-robin over them."""

    def __init__(self, weights: dict[str, float], owed: dict[str, float], window: int):
        self.window = window
        self.queue: dict[str, deque] = {}
        self.left: dict[str, int] = {}
        self.weights = weights
        self.owed = owed

    def add(self, source: str, row: int, size: int) -> None:
        self.queue.setdefault(source, deque()).append((row, 0, size))
        self.left[source] = self.left.get(source, 0) + size

    def take(self, source: str, count: int) -> list[tuple[int, int, int]]:
        """The next ``count`` tokens of a source as (row, start, length) pieces."""
        out, queue = [], self.queue[source]
        self.left[source] -= count
        while count:
            row, start, end = queue.popleft()
            size = min(count, end - start)
            out.append((row, start, size))
            count -= size
            if start + size < end:
                queue.appendleft((row, start + size, end))
        return out

    def windows(self):
        """Lists of pieces: full windows, then powers of two."""
        credit = {s: self.owed.get(s, 0.0) for s in self.queue}
        order = sorted(self.queue)
        turn, total = 0, sum(self.left.values())
        while total:
            space = self.window if total >= self.window else 1 << (total.bit_length() - 1)
            total -= space
            for s in order:
                credit[s] += space * self.weights[s]
            pieces: list[tuple[int, int, int]] = []
            for k in range(len(order)):
                s = order[(turn + k) % len(order)]
                if credit[s] < min(TURN, self.left[s], space):
                    continue
                size = min(int(credit[s]), self.left[s], space)
                if size > 0:
                    pieces += self.take(s, size)
                    credit[s] -= size
                    space -= size
                if not space:
                    break
            turn += 1
            while space:  # nobody has credit enough: the one owed most goes first
                s = max((s for s in order if self.left[s]), key=lambda s: (credit[s], s))
                size = min(max(TURN, int(credit[s])), self.left[s], space)
                pieces += self.take(s, size)
                credit[s] -= size
                space -= size
            order = [s for s in order if self.left[s]]
            yield pieces


def pack_part(docs: pa.Table, shares: pa.Table, path: str, end_id: int, window: int) -> pa.Table:
    """Pack the documents of one part; ``shares`` holds source, weight and bytes owed."""
    order = docs.combine_chunks().sort_by([("order", "ascending"), ("doc_id", "ascending")])
    encode = encoder(path).encode
    sources = order.column("source").to_pylist()
    ids, cut, nbytes = [], [0], 0
    for batch in order.select(["text"]).to_batches():
        for piece in slices(batch):
            found, at = encode(piece.column("text"))
            nbytes += piece.column("text").nbytes
            # Each document's ids, then the end mark.
            whole = np.empty(len(found) + len(at) - 1, np.uint32)
            stops = at[1:] + np.arange(len(at) - 1)
            whole[stops] = end_id
            mask = np.ones(len(whole), bool)
            mask[stops] = False
            whole[mask] = found
            ids.append(whole)
            cut += (stops + 1 + cut[-1]).tolist() if len(stops) else []
    ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    weights = dict(zip(shares.column("source").to_pylist(), shares.column("weight").to_pylist()))
    rate = len(ids) / max(nbytes, 1)
    owed = {
        s: x * rate for s, x in zip(shares.column("source").to_pylist(), shares.column("owed").to_pylist())
    }
    queues = Queues(weights, owed, window)
    for i, source in enumerate(sources):
        queues.add(source, i, cut[i + 1] - cut[i])
    part = docs.column("part")[0].as_py()
    out = []
    for n, pieces in enumerate(queues.windows()):
        offset = 0
        for i, start, size in pieces:
            a = cut[i] + start
            crc = zlib.crc32(ids[a : a + size].astype("<u4").tobytes())
            sequence = (part << _SEQUENCE_BITS) | n
            out.append((i, start, size, crc, cut[i + 1] - cut[i], sequence, offset))
            offset += size
    row, *columns = np.array(out, np.int64).T
    names = order.select(["doc_id", "named"]).take(pa.array(row))
    columns = [*names.columns, *[pa.array(c) for c in columns]]
    return pa.Table.from_arrays(columns, schema=_PIECES)


def pack(
    documents: DataFrame,
    tokenizer: str,
    targets: dict[str | None, float] | None = None,
    window: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """Pack every document: one row per piece.

    Columns: doc_id, source, start (ids of the document before the piece), length, ids_crc32,
    doc_tokens (with the end mark), sequence_id, offset in the sequence. Each id of each
    document lies in exactly one piece; a NULL or empty text is just the end mark. ``targets``
    gives sources relative weights (others get none and come when nobody else has tokens);
    without it each source gets its share of all bytes. A NULL source is a source of its own,
    and rows that repeat an id are packed like any others. ``tokenizer`` is the path of a
    tokenizer file that every executor can read. An empty table gives an empty result.
    """
    rows = documents.select(
        "doc_id",
        "text",
        F.col("source").cast("string").alias("named"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("order"),
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    rows = rows.withColumn("part", F.pmod("order", F.lit(parts)))

    # A row for each part and source; bytes stand for tokens until the texts are encoded.
    held = checkpointed(rows.groupBy("part", "source").agg(F.sum("size").alias("bytes")))
    if targets is None:
        sources = held.groupBy("source").agg((F.sum("bytes") / F.lit(max(total, 1))).alias("weight"))
    else:
        whole = sum(targets.values())
        named = [(f"={s}" if s is not None else "-", w / whole) for s, w in targets.items()]
        named = documents.sparkSession.createDataFrame(named, "source string, weight double")
        sources = held.select("source").distinct().join(named, "source", "left").fillna(0.0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parted = held.groupBy("part").agg(F.sum("bytes").alias("bytes"))
    parted = parted.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("all"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        held.withColumn("own", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
        .join(parted, "part")
        .join(sources, "source")
        .select("part", "source", "weight", (F.col("weight") * F.col("all") - F.col("own")).alias("owed"))
    )

    def packed(docs: pa.Table, shares: pa.Table) -> pa.Table:
        return pack_part(docs, shares, tokenizer, end_id, window)

    schema = (
        "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long"
    )
    return rows.groupBy("part").cogroup(shares.groupBy("part")).applyInArrow(packed, schema)
