"""Packing documents whole into as few training windows as possible.

Texts are encoded once; after that only lengths travel. Pieces are dealt into parts of some
thousand, and each part is packed on its own: best fit with the longest pieces first, then
local search by swaps. Between two windows that are not full, the search moves a piece, exchanges one
for one, two for one or one for two, whenever that raises the sum of squared fills: what is
full gets fuller, what is nearly empty gets emptier, until windows empty. It ends when no
exchange raises the sum or when the number of windows has reached a lower bound.

A part may end with a few windows that have much room. Those of all parts are dealt anew, as
they are, and searched again, until one part holds them all or nothing is gained.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.bpe import byte_encoder
from gridloom.llm.text import slices
from gridloom.session import checkpointed

PART_ITEMS = 4096  # pieces packed together, on average
ROUNDS = 4  # times windows with room are dealt anew, at most
ROOM = 64  # a window with more than a 64th of its room left is dealt anew
PATIENCE = 32  # exchanges for each window of a part without emptying one, before the search ends

_BIN_BITS, _PART_BITS = 20, 36  # of a sequence id; the round stands above them


# --- one part ----------------------------------------------------------------------


def best_fit(sizes: np.ndarray, window: int) -> np.ndarray:
    """The window each piece goes to: the fullest that has room, the longest pieces first."""
    place = np.zeros(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(window + 1)]
    there, count = 0, 0  # bit r of ``there``: some window has just room for r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = there >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            target = with_room[room].pop()
            if not with_room[room]:
                there &= ~(1 << room)
        else:
            room, target, count = window, count, count + 1
        place[i] = target
        with_room[room - size].append(target)
        there |= 1 << (room - size)
    return place


def least_windows(sizes: np.ndarray, window: int) -> int:
    """A lower bound: for each limit, pieces of more than half a window need one each, and what
    those that leave no room for the limit cannot take of the pieces from the limit on needs more."""
    counts = np.bincount(sizes, minlength=window + 1)
    upto = np.append(0, np.cumsum(counts))  # pieces shorter than n
    weight = np.append(0, np.cumsum(counts * np.arange(window + 1)))
    half, best = window // 2, 0
    for limit in range(half + 1):
        alone = upto[window + 1] - upto[window - limit + 1]
        large = upto[window - limit + 1] - upto[half + 1]
        room = large * window - (weight[window - limit + 1] - weight[half + 1])
        small = weight[half + 1] - weight[limit]
        best = max(best, int(alone + large + max(0, -(-(small - room) // window))))
    return best


class Search:
    """Local search over the windows of a part; ``place`` gives each piece's window."""

    def __init__(self, sizes: np.ndarray, place: np.ndarray, window: int):
        self.sizes, self.window = sizes, window
        self.items: list[list[int]] = [[] for _ in range(int(place.max()) + 1 if len(place) else 0)]
        for i, b in enumerate(place.tolist()):
            self.items[b].append(i)
        self.fill = np.array([int(sizes[x].sum()) if x else 0 for x in self.items], np.int64)
        self.parts = {b: self.takes(b) for b in range(len(self.items)) if 0 < self.fill[b] < window}
        self.gather()

    def one_each(self, b: int) -> list[int]:
        """A piece of each length in a window; at most about the square root of twice its size."""
        return list({int(self.sizes[i]): i for i in self.items[b]}.values())

    def pairs(self, b: int) -> list[tuple[int, int, int]]:
        """(length together, piece, piece) for each two lengths in a window."""
        found: dict[int, list[int]] = {}
        for i in self.items[b]:
            found.setdefault(int(self.sizes[i]), []).append(i)
        lengths = sorted(found)
        out = {}
        for n, x in enumerate(lengths):
            if len(found[x]) > 1:
                out.setdefault(2 * x, (2 * x, *found[x][:2]))
            for y in lengths[n + 1 :]:
                out.setdefault(x + y, (x + y, found[x][0], found[y][0]))
        return list(out.values())

    def takes(self, b: int) -> np.ndarray:
        """What may be taken out of a window: (length, window, piece or -1, piece or -1)."""
        single = [(int(self.sizes[i]), b, i, -1) for i in self.one_each(b)]
        return np.array([(0, b, -1, -1), *single, *((n, b, i, j) for n, i, j in self.pairs(b))], np.int64)

    def gather(self) -> None:
        """All that may be taken, and which lengths could be put in its place."""
        rows = [r for r in self.parts.values()]
        self.rows = np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)
        self.reach = self.reached(self.rows)
        self.singles = self.rows[(self.rows[:, 2] >= 0) & (self.rows[:, 3] < 0)]
        self.reach_singles = self.reached(self.singles)

    def reached(self, rows: np.ndarray) -> np.ndarray:
        """Whether some row can be exchanged for a given length: more than it, as far as there is room."""
        change = np.zeros(2 * self.window + 3, np.int64)
        np.add.at(change, rows[:, 0] + 1, 1)
        np.add.at(change, rows[:, 0] + self.window - self.fill[rows[:, 1]] + 1, -1)
        return np.cumsum(change) > 0

    def exchange(self, donor: int) -> bool:
        """Make one exchange by which ``donor`` loses length and the sum of squares rises."""
        single = sorted(((int(self.sizes[i]), i, -1) for i in self.one_each(donor)), reverse=True)
        for gives, rows, reach in (
            (single, self.rows, self.reach),
            (sorted(self.pairs(donor), reverse=True), self.singles, self.reach_singles),
        ):
            for size, i, j in gives:
                if not reach[size]:
                    continue
                target = rows[:, 1]
                more = size - rows[:, 0]
                fits = (more > 0) & (more <= self.window - self.fill[target]) & (target != donor)
                gain = np.where(fits, more * (self.fill[target] - self.fill[donor] + more), 0)
                best = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[best] > 0:
                    _, other, a, b = rows[best].tolist()
                    self.swap(donor, [x for x in (i, j) if x >= 0], other, [x for x in (a, b) if x >= 0])
                    return True
        return False

    def swap(self, donor: int, given: list[int], other: int, taken: list[int]) -> None:
        self.items[donor] = [i for i in self.items[donor] if i not in given] + taken
        self.items[other] = [i for i in self.items[other] if i not in taken] + given
        for b in (donor, other):
            self.fill[b] = int(self.sizes[self.items[b]].sum()) if self.items[b] else 0
            self.parts.pop(b, None)
            if 0 < self.fill[b] < self.window:
                self.parts[b] = self.takes(b)
        self.gather()

    def run(self) -> np.ndarray:
        """Exchange until nothing is gained; returns each piece's window."""
        least, idle, moved = least_windows(self.sizes, self.window), 0, True
        while moved:
            moved = False
            for donor in np.argsort(self.fill, kind="stable").tolist():
                used = int((self.fill > 0).sum())
                if used <= least or idle > PATIENCE * used:
                    return self.places()
                while 0 < self.fill[donor] < self.window and self.exchange(donor):
                    moved = True
                    idle = 0 if not self.fill[donor] else idle + 1
                    if idle > PATIENCE * used:
                        break
        return self.places()

    def places(self) -> np.ndarray:
        place = np.zeros(len(self.sizes), np.int64)
        for b, items in enumerate(self.items):
            place[items] = b
        return place


def pack_sizes(sizes: np.ndarray, window: int, place: np.ndarray | None = None) -> np.ndarray:
    """Each piece's window, numbered from 0; starts from ``place`` where best fit needs more windows."""
    fresh = best_fit(sizes, window)
    if place is not None and len(np.unique(place)) <= len(np.unique(fresh)):
        fresh = np.unique(place, return_inverse=True)[1]
    return np.unique(Search(sizes, fresh, window).run(), return_inverse=True)[1]


def pack_part(rows: pa.Table, window: int, deal: int) -> pa.Table:
    """Rows of one part with their sequence_id, offset and fill set."""
    rows = rows.combine_chunks().sort_by([("length", "descending"), ("key", "ascending")])
    sizes = rows.column("length").to_numpy()
    known = rows.column("sequence_id")
    place = None if known.null_count else np.unique(known.to_numpy(), return_inverse=True)[1]
    place = pack_sizes(sizes, window, place)
    order = np.argsort(place, kind="stable")
    upto = np.cumsum(sizes[order]) - sizes[order]
    first = upto[np.searchsorted(place[order], place[order])]
    offset, fill = np.empty(len(sizes), np.int64), np.bincount(place, sizes).astype(np.int64)[place]
    offset[order] = upto - first
    sequence = (((deal << _PART_BITS) | rows.column("part")[0].as_py()) << _BIN_BITS) | place
    for name, values in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
        rows = rows.set_column(rows.column_names.index(name), name, pa.array(values, pa.int64()))
    return rows


# --- all documents -----------------------------------------------------------------


def encode_pieces(documents: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    rows = documents.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        encoder = byte_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids, at = encoder.encode(part.column("text"))
                out = []
                for row in range(part.num_rows):
                    whole = np.append(ids[at[row] : at[row + 1]], np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(whole) % window or window, len(whole), window), len(whole)]
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        out.append((row, n, a, b - a, zlib.crc32(whole[a:b].tobytes())))
                row, n, *rest = zip(*out)
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(n, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in rest]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(
        encode, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    )


def pack_whole(
    documents: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 0, part_items: int | None = None
) -> DataFrame:
    """Pack every document into sequences of at most ``window`` tokens: one row per piece.

    Columns: doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32,
    sequence_id, offset in the sequence. A document is one piece; one longer than the window is
    cut into pieces of a window, the first of which may be shorter. A NULL or empty text is just
    the end mark. Rows that repeat an id, or have none, are packed like any others; other
    columns are not looked at, and an empty table gives an empty result. ``tokenizer`` is the
    path of a byte-level tokenizer file that every executor can read.

    Texts are not shuffled. Parts take about ``part_items`` pieces whatever their source, so no
    task grows with the data.
    """
    part_items = PART_ITEMS if part_items is None else part_items
    items = checkpointed(encode_pieces(documents, tokenizer, window, end_id))
    # Numbers of rows in the checkpoint stay the same when a task is run again.
    items = items.withColumn("key", F.monotonically_increasing_id())
    none = F.lit(None).cast("long")
    full = items.where(F.col("length") == window).withColumns(
        {"sequence_id": -1 - F.col("key"), "offset": F.lit(0).cast("long")}
    )
    open_items = items.where(F.col("length") < window).withColumns(
        {"sequence_id": none, "offset": none, "fill": none, "together": F.col("key")}
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = full.select(columns)
    count, parts = open_items.count(), None
    for deal in range(ROUNDS):
        fewer = max(1, -(-count // part_items))
        if not count or (parts is not None and (parts == 1 or fewer > parts // 2)):
            break
        parts = fewer
        packed = checkpointed(_packed(open_items, parts, window, deal))
        room = F.col("fill") < window - window // ROOM
        done = done.unionByName(packed.where(~room).select(columns))
        open_items = packed.where(room).withColumn("together", F.col("sequence_id"))
        count = open_items.count()
    return done.unionByName(open_items.select(columns))


def _packed(items: DataFrame, parts: int, window: int, deal: int) -> DataFrame:
    """``items`` dealt into parts, those of a sequence together, and packed."""

    def pack(rows: pa.Table) -> pa.Table:
        return pack_part(rows, window, deal)

    rows = items.withColumn("part", F.pmod(F.xxhash64("together"), F.lit(parts)))
    return rows.groupBy("part").applyInArrow(pack, rows.schema).drop("part", "together")
