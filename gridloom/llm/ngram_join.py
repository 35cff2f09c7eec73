"""Documents that share most of their word n-grams, by a token-group matrix.

A document is its set of distinct word n-grams. Equal sets are one. Similar sets are gathered
into groups, and so are sets that are merely alike where there are many; the matrix holds the tokens of each group's union once, whatever the number of
its members. Two sets can only be linked if one has PREFIX of its tokens in the other's group,
so the matrix joined with itself on those tokens bounds the overlap of every query with every
group. Each set also has a bitmap with two to four bits a token; those of a group travel as one
row, and a token whose bit the other set lacks is not shared, which bounds the overlap again.
Only pairs that still qualify are opened, of two families the most promising pair of sets first.
There a set is held against the whole union of the other side, and against its members only if
the overlap can suffice.

Tokens are taken rarest first, by a list of the frequent ones that is found while the sets are
made: any common order makes the bound right, and this one keeps frequent passages out of it.

Everything is exact for sets of 64-bit hashes: no partner, group or token is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.components import components
from gridloom.llm.filters import rows_with_ids
from gridloom.llm.text import mix, shingle_sets, slices
from gridloom.session import checkpointed

GROUP_SETS = 256  # members of a group; a larger family is several groups
KEYS = 3  # smallest hashes by which similar sets find a common leader
SHARED_KEYS = 2  # of them, to be held against a leader; what this misses is found in the matrix
LOOSE_SETS = 32  # sets outside families that share a smallest hash are gathered if so many
FREQUENT_TOKENS = 1 << 18  # listed as frequent; the list only decides the order of tokens
COUNTED_TOKENS = 1_500_000  # tokens counted together inside a task
FREQUENT = 2  # occurrences among those; of the tokens with as many, the most frequent
LISTED_TOKENS = 20_000  # are candidates for the list


def linked(common, a, b, percent: int):
    """Whether |A and B| is at least ``percent`` of |A or B|."""
    return 100 * common >= percent * (a + b - common)


def _probe(n: int, percent: int) -> int:
    """Tokens of a set of which one must be shared with any set it is linked to."""
    return n - -(-percent * n // 100) + 1


def _index(n: int, percent: int) -> int:
    """The same if the other set is at least as large."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def digest(tokens: np.ndarray) -> int:
    """One number for a set; sets with the same number are taken for equal."""
    total = np.array([tokens.sum(dtype=np.uint64), np.uint64(len(tokens))], np.uint64)
    return int(mix(mix(total[:1]) ^ mix(total[1:] * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)[0])


def bitmap(tokens: np.ndarray) -> bytes:
    """A power of two of bits, two to four a token, with those of the tokens set."""
    size = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps as bitmaps of ``size`` bytes."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def shared_at_most(n_a: int, a: bytes, n_b: np.ndarray, b: list[bytes]) -> np.ndarray:
    """Upper bounds of the tokens that a set shares with others, by their sizes and bitmaps."""
    out = np.zeros(len(b), np.int64)
    lengths = np.array([len(x) for x in b])
    a = np.frombuffer(a, np.uint8)[None]
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        size = min(a.shape[1], int(length))
        rows = np.frombuffer(b"".join([b[j] for j in at]), np.uint8).reshape(len(at), length)
        rows, query = _folded(rows, size), _folded(a, size)
        both = np.bitwise_count(rows & query).sum(axis=1, dtype=np.int64)
        # A bit that only one set has stands for a token, or more, that only it has.
        only_a = np.bitwise_count(query).sum(dtype=np.int64) - both
        only_b = np.bitwise_count(rows).sum(axis=1, dtype=np.int64) - both
        out[at] = np.minimum(n_a - only_a, n_b[at] - only_b)
    return out


_SEEDS = mix(np.arange(1, 64, dtype=np.uint64))


def _signatures(documents: DataFrame, size: int) -> DataFrame:
    """Rows of kind 0: a document's id, set size, digest and keys; of kind 1: a frequent token."""
    names = ["kind", "id", "text_hash", "n", "digest", *(f"key{k}" for k in range(KEYS))]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_tokens, seen = [], 0, set()

        def frequent() -> pa.RecordBatch:
            tokens, many = np.unique(np.concatenate(held), return_counts=True)
            at = np.flatnonzero(many >= FREQUENT)
            at = at[np.argsort(-many[at], kind="stable")[:LISTED_TOKENS]]
            none = pa.nulls(len(at), pa.int64())
            kind, id_, n = map(pa.array, (np.ones(len(at), np.int64), tokens[at].view(np.int64), many[at]))
            return pa.RecordBatch.from_arrays([kind, id_, none, n, *[none] * (1 + KEYS)], names=names)

        for batch in batches:
            for piece in slices(batch):
                rows = []
                for tokens in shingle_sets(piece.column("text"), size):
                    if not len(tokens):
                        rows.append((0, None, *[None] * KEYS))
                        continue
                    keys = [int(mix(tokens ^ _SEEDS[k]).min().view(np.int64)) for k in range(KEYS)]
                    rows.append((len(tokens), digest(tokens), *keys))
                    if rows[-1][1] not in seen:  # copies must not make a document's tokens frequent
                        seen.add(rows[-1][1])
                        held.append(tokens)
                        held_tokens += len(tokens)
                n, *others = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(len(n), np.int64)),
                        piece.column("doc_id").cast(pa.int64()),
                        piece.column("text_hash"),
                        pa.array(n, pa.int64()),
                        *[pa.array(c, pa.int64()) for c in others],
                    ],
                    names=names,
                )
                if held_tokens > COUNTED_TOKENS:
                    yield frequent()
                    held, held_tokens, seen = [], 0, set()
        if held:
            yield frequent()

    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(sign, ", ".join(f"{name} long" for name in names))


def _pass_sets(
    documents: DataFrame, size: int, schema: str, make: Callable[[int, np.ndarray], tuple | None]
) -> DataFrame:
    """Run ``make(digest, tokens)`` on the set of each text, once for equal sets of a slice."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                rows = {}
                for tokens in shingle_sets(piece.column("text"), size):
                    if len(tokens) and (number := digest(tokens)) not in rows:
                        rows[number] = make(number, tokens)
                columns = list(zip(*rows.values())) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=names
                )

    return documents.select("text").mapInArrow(run, schema)


def _texts_of(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (key, side, digest, rep) with the text of document rep in place of it."""
    rows = rows.withColumnRenamed("rep", "doc_id")
    texts = rows_with_ids(documents.select("doc_id", "text"), rows.select("doc_id").distinct(), "doc_id")
    return texts.join(rows, "doc_id").select("key", "side", "digest", "text")


def _compared(rows: DataFrame, size: int, percent: int, every: bool) -> DataFrame:
    """Links (a, b) between the sets of side 0 and of side 1 of each ``key``.

    ``rows`` has key, side, digest and text; a key has a bounded number of sets. With
    ``every`` so many links are returned as hold together what the links of the key do, else
    one for each key that has any. Texts travel, which take less room than their tokens.
    """
    rows = rows.repartition("key").sortWithinPartitions("key", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ({}, {})
        for batch in batches:
            for piece in slices(batch):
                out = []
                keys, places, digests = (piece.column(c).to_pylist() for c in ("key", "side", "digest"))
                for k, side, d, tokens in zip(keys, places, digests, shingle_sets(piece.column("text"), size)):
                    if k != key:
                        out += _links(*sides, percent, every)
                        key, sides = k, ({}, {})
                    # An id that occurs with two texts brings a set that was not asked for.
                    if len(tokens) and digest(tokens) == d:
                        sides[side][d] = tokens
                yield _pairs(out)
        yield _pairs(list(_links(*sides, percent, every)))

    return rows.mapInArrow(compare, "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _links(queries: dict, members: dict, percent: int, every: bool):
    """Links between two groups, each query against the union first; none between sets that
    those before it join."""
    union = np.unique(np.concatenate(list(members.values()))) if len(members) > 1 else None
    above: dict[int, int] = {}

    def root(d: int) -> int:
        while (up := above.get(d, d)) != d:
            d = above[d] = above.get(up, up)
        return d

    for d, query in queries.items():
        if union is not None and 100 * _common(query, union) < percent * len(query):
            continue
        for e, member in members.items():
            small, large = sorted((len(query), len(member)))
            if 100 * small < percent * large or root(d) == root(e):
                continue
            if linked(_common(query, member), len(query), len(member), percent):
                above[root(d)] = root(e)
                yield d, e
                if not every:
                    return


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _leaders(sets: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Links from sets to leaders: one of all sets that share a smallest hash leads them."""
    found = None
    for k in range(KEYS):
        key = f"key{k}"
        # The same choice for all keys, so that most sets meet one leader only.
        leader = F.min_by(F.struct("digest", "n", "rep"), "digest")
        heads = sets.groupBy(key).agg(leader.alias("head"), F.count(F.lit(1)).alias("many"))
        heads = heads.where("many > 1").select(key, "head.*", "many").toDF(key, "head", "head_n", "head_rep", "many")
        fits = F.expr(f"100 * least(n, head_n) >= {percent} * greatest(n, head_n) and digest <> head")
        pairs = sets.join(heads, key).where(fits)
        pairs = pairs.select("head", "head_rep", "digest", "rep", "many")
        found = pairs if found is None else found.union(pairs)
    # Sharing one of the hashes says little; sets that are linked mostly share several.
    found = found.groupBy("head", "head_rep", "digest", "rep").agg(
        F.max("many").alias("many"), F.count(F.lit(1)).alias("shared")
    )
    part = F.pmod(F.xxhash64("digest"), F.ceil(F.col("many") / GROUP_SETS))
    pairs = found.where(F.col("shared") >= SHARED_KEYS).withColumn("key", F.xxhash64("head", part))
    pairs = checkpointed(pairs.drop("many", "shared"))
    heads = pairs.select("key", F.lit(0).alias("side"), F.col("head").alias("digest"), F.col("head_rep").alias("rep"))
    rows = heads.distinct().union(pairs.select("key", F.lit(1), "digest", "rep").distinct())
    return _compared(_texts_of(documents, rows), size, percent, True)


class Order:
    """The order of tokens: by hash, and the frequent ones last, the most frequent at the end."""

    def __init__(self, frequent: np.ndarray):
        """``frequent`` in ascending order of frequency."""
        self.rank = np.argsort(frequent, kind="stable")
        self.listed = frequent[self.rank]

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """Numbers that sort like the tokens."""
        out = tokens >> np.uint64(1)
        if len(self.listed):
            at = np.searchsorted(self.listed, tokens)
            at[at == len(self.listed)] = 0
            common = self.listed[at] == tokens
            out[common] = self.rank[at[common]].astype(np.uint64) | np.uint64(1 << 63)
        return out


def _first_tokens(
    documents: DataFrame, groups: DataFrame, order: Order, size: int, percent: int
) -> DataFrame:
    """digest, rep, family, group, members, n, bitmap and first tokens of every set, and where those end."""

    def first_tokens(number: int, tokens: np.ndarray) -> tuple:
        keys = order.keys(tokens)
        place = np.argsort(keys, kind="stable")[: _probe(len(tokens), percent)]
        last = int((keys[place[-1:]] ^ np.uint64(1 << 63)).view(np.int64)[0])
        return number, len(tokens), last, tokens[place].tobytes(), bitmap(tokens)

    schema = "digest long, n long, last long, tokens binary, bits binary"
    made = _pass_sets(documents, size, schema, first_tokens)
    made = made.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n", "last", "tokens", "bits")])
    return checkpointed(made.join(groups, "digest"))


def _matrix(made: DataFrame, percent: int) -> DataFrame:
    """The token-group matrix: (token, group, family, sizes), only for tokens that two families share.

    ``sizes`` packs the smallest set size behind the token, how much larger the largest is, and
    whether the token is one of the first of a set, by which smaller sets are looked up. The
    family is 0 where the group is all of it. Both keep the shuffled rows short.
    """

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One set is one group here."""
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = part.column("n").to_numpy()
                tokens = [np.frombuffer(t, np.int64) for t in part.column("tokens").to_pylist()]
                many = [len(t) for t in tokens]
                first = np.concatenate([np.arange(m) < _index(k, percent) for m, k in zip(many, n.tolist())])
                group, family, n = (np.repeat(part.column(c).to_numpy(), many) for c in ("group", "family", "n"))
                yield _cells(np.concatenate(tokens), group, family, n, n, first)

    def unions_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of one group after the other."""
        group, held = None, []
        for batch in batches:
            groups_ = zip(batch.column("group").to_pylist(), batch.column("family").to_pylist())
            n = batch.column("n").to_pylist()
            for g, k, t in zip(groups_, n, batch.column("tokens").to_pylist()):
                if g != group:
                    yield from _union(group, held, percent)
                    group, held = g, []
                held.append((k, np.frombuffer(t, np.int64)))
        yield from _union(group, held, percent)

    schema = "token long, group long, family long, sizes long"
    columns = ["group", "family", "n", "tokens"]
    singles = made.where("members = 1").select(*columns).mapInArrow(rows_of, schema)
    grouped = made.where("members > 1").select(*columns).repartition("group").sortWithinPartitions("group")
    cells = singles.union(grouped.mapInArrow(unions_of, schema))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a token with groups of more than one family; a run may span batches."""
        open_ = np.zeros((0, 4), np.int64)  # the last run so far, if it has one family only
        last_shared = None  # the token of the last run, if it has more
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy() for c in _CELL])
            rows = np.concatenate((open_, rows))
            if not len(rows):
                continue
            start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            many = np.diff(np.append(start, len(rows)))
            family = np.where(rows[:, 2] == 0, rows[:, 1], rows[:, 2])
            mixed = np.minimum.reduceat(family, start) != np.maximum.reduceat(family, start)
            if last_shared is not None and rows[0, 0] == last_shared:
                mixed[0] = True
            last_shared = rows[-1, 0] if mixed[-1] else None
            out = rows[np.repeat(mixed, many)]
            # A family's groups keep their run's cells until another family turns up.
            open_ = rows[start[-1] :] if not mixed[-1] else rows[:0]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.T], names=_CELL)

    return cells.repartition("token").sortWithinPartitions("token").mapInArrow(shared, schema)


_CELL = ["token", "group", "family", "sizes"]


def _cells(token, group, family, low, high, first) -> pa.RecordBatch:
    sizes = (low.astype(np.int64) * 2 + first) << 31 | (high - low).astype(np.int64)
    family = np.where(family == group, 0, family)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (token, group, family, sizes)], names=_CELL)


def _union(group, held: list, percent: int):
    if not held:
        return
    n = np.repeat([k for k, _ in held], [len(t) for _, t in held])
    tokens = np.concatenate([t for _, t in held])
    first = np.concatenate([np.arange(len(t)) < _index(k, percent) for k, t in held])
    for part in (first, ~first):
        # Looked up by first tokens: cells of their own, as their set sizes count.
        if part.any():
            values, at = np.unique(tokens[part], return_inverse=True)
            low, high = np.full(len(values), 2**31 - 1, np.int64), np.zeros(len(values), np.int64)
            np.minimum.at(low, at, n[part])
            np.maximum.at(high, at, n[part])
            numbers = (np.full(len(values), number) for number in group)
            yield _cells(values, *numbers, low, high, np.full(len(values), part is first))


def similar_documents(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and text_hash of every document.

    Documents are linked when the distinct ``size``-word sequences they share are at least
    ``percent`` of those either has; a shorter text's whole sequence is its one element, and a
    NULL text or one without words is linked with nothing. component_id is the smallest doc_id
    reachable by links, the document's own included. Rows with a NULL id are measured like
    others, but link nothing, and their component is NULL. Rows that repeat an id are separate
    documents of that id. All other columns are left out; an empty table gives an empty result.
    """
    documents = documents.select("doc_id", "text")
    signed = checkpointed(_signatures(documents, size))
    listed = signed.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n"))
    listed = listed.orderBy(F.desc("n"), "id").limit(FREQUENT_TOKENS).orderBy("n", "id")
    frequent = listed.select("id").toPandas()["id"].to_numpy(np.int64).view(np.uint64)
    found = signed.where("kind = 0").withColumnRenamed("id", "doc_id")

    # One row for equal sets, led by the smallest id.
    firsts = [F.first(c).alias(c) for c in ("n", *(f"key{k}" for k in range(KEYS)))]
    sets = found.where("digest is not null and doc_id is not null").groupBy("digest")
    sets = checkpointed(sets.agg(F.min("doc_id").alias("rep"), *firsts))
    # Numbers of rows in the checkpoint stay the same when a task is run again.
    sets = sets.withColumn("number", F.monotonically_increasing_id())

    known = documents.where("doc_id is not null")
    stars = checkpointed(_leaders(sets, known, size, percent).distinct())
    families = checkpointed(components(stars)) if not stars.isEmpty() else None
    groups = _groups(sets, families)
    order = Order(frequent)
    made = _first_tokens(known, groups, order, size, percent)
    cells = checkpointed(_matrix(made, percent))
    pairs = _candidates(cells, made, percent).union(_inside(groups))
    rows = checkpointed(_bounded(pairs, made, percent))
    links = stars.union(_opened_in_turn(rows, stars, known, size, percent))
    families = components(links)
    labelled = sets.select("digest", "rep").join(families.withColumnRenamed("node", "digest"), "digest")
    smallest = labelled.groupBy("label").agg(F.min("rep").alias("least"))
    labelled = labelled.join(smallest, "label").select("digest", F.col("least").alias("component"))
    all_sets = sets.select("digest", "rep").join(labelled, "digest", "left")
    all_sets = all_sets.select("digest", F.coalesce("component", "rep").alias("component"))
    joined = found.select("doc_id", "n", "digest", "text_hash").join(all_sets, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash"
    )


def one_of_each_group(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id.

    All columns stay. Of rows with that id the one with the smallest text hash stays, and of
    equal rows one. Documents with a NULL id stay, as they are linked with nothing. Only texts
    that may have to go are shuffled.
    """
    found = checkpointed(similar_documents(documents, size, percent).where("doc_id is not null"))
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    # A row is in question if it is not its component's first, or if there are more like it.
    judged = found.groupBy("doc_id", "text_hash", "component_id").agg(F.count(F.lit(1)).alias("many"))
    judged = judged.join(first, "component_id")
    stays = F.struct("doc_id", "text_hash") == F.col("first")
    asked = checkpointed(
        judged.where(~stays | (F.col("many") > 1)).select("doc_id", "text_hash", stays.alias("stays"))
    )
    # The documents' columns travel in a struct, where no name of theirs meets one made up here.
    row = F.struct(*documents.columns).alias("row")
    hashed = documents.select(row, F.col("doc_id"), F.xxhash64("text").alias("_hash"))
    maybe = rows_with_ids(hashed, asked, "doc_id")
    rest = rows_with_ids(hashed, asked, "doc_id", keep=False)
    asked = asked.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), "stays")
    same = (maybe["doc_id"] == asked["_id"]) & (maybe["_hash"] == asked["_text"])
    maybe = maybe.join(asked, same, "left").where("coalesce(stays, true)")
    once = maybe.where("stays").dropDuplicates(["_id", "_text"])
    others = maybe.where("stays is null")
    kept = [part.select("row.*") for part in (rest, once, others)]
    return kept[0].union(kept[1]).union(kept[2])


def _groups(sets: DataFrame, families: DataFrame | None) -> DataFrame:
    """digest, rep, family, group, members and loose: families cut into groups, other sets by
    themselves or, where many are alike, gathered.

    A group that is a whole family has the number of one of its sets, a set by itself its own
    short one. Sets outside families that share a smallest hash with many others, and have about
    their size, make loose groups. Nothing is known of links inside those, and they are a family
    each. So sets that are alike, but not enough for a link, meet as groups and not two by two.
    """
    base = sets.select("digest", "rep", "number", "n", *(f"key{k}" for k in range(KEYS)))
    if families is None:
        base = base.withColumns({"label": F.lit(None).cast("long"), "many": F.lit(1).cast("long")})
    else:
        sized = families.groupBy("label").agg(F.count(F.lit(1)).alias("many"))
        inside = families.join(sized, "label").select(F.col("node").alias("digest"), "label", "many")
        base = base.join(inside, "digest", "left").withColumn("many", F.coalesce("many", F.lit(1)))
    # Sizes that differ by more are in no way linked.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))
    alone = base.where("label is null")
    found = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"key{k}").alias("key"), step.alias("step")) for k in range(KEYS)])
    found = alone.select("digest", F.explode(found).alias("at"))
    crowds = found.groupBy("at").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") >= LOOSE_SETS)
    largest = F.max(F.struct("crowd", "at")).alias("in")
    gathered = found.join(crowds, "at").groupBy("digest").agg(largest).select("digest", "in.*")
    base = base.join(gathered, "digest", "left")

    def number(many: str) -> F.Column:
        return F.pmod(F.xxhash64("digest"), F.ceil(F.col(many) / GROUP_SETS)).cast("long")

    loose = F.col("crowd").isNotNull()
    group = F.when(loose, F.xxhash64("at", number("crowd"))).when(F.col("label").isNull(), F.col("number"))
    whole = F.col("many") <= GROUP_SETS
    group = group.when(whole, F.col("label")).otherwise(F.xxhash64("label", number("many")))
    members = F.coalesce("crowd", "many").alias("members")
    base = base.select("digest", "rep", "label", group.alias("group"), members, loose.alias("loose"))
    family = F.coalesce("label", "group").alias("family")
    return checkpointed(base.select("digest", "rep", family, "group", "members", "loose"))


def _inside(groups: DataFrame) -> DataFrame:
    """Each loose group as a pair of groups with itself, in the form of ``_candidates``."""
    own = groups.where("loose").select("group").distinct()
    number = F.col("group")
    return own.select(
        F.xxhash64("group", "group").alias("key"),
        *[number.alias(c) for c in ("g", "h", "family_g", "family_h")],
        F.lit(True).alias("loose"),
    )


def _candidates(cells: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (key, g, h, family_g, family_h, loose) that may be linked, by their first tokens.

    Of two single sets take the one whose first tokens end earlier in the order of tokens:
    which of them the other set has is known, so the sets share no more than those and all
    its other tokens. Of larger groups one common token is enough to be a candidate.
    """
    low = F.shiftright("sizes", 32)
    high = low + F.col("sizes").bitwiseAND(F.lit((1 << 31) - 1))
    first = F.shiftright("sizes", 31).bitwiseAND(F.lit(1))
    family = F.when(F.col("family") == 0, F.col("group")).otherwise(F.col("family")).alias("family")
    sized = cells.select("token", "group", family, low.alias("low"), high.alias("high"), first.alias("first"))
    other = sized.toDF("token", "group2", "family2", "low2", "high2", "first2")
    meets = F.expr(
        f"group < group2 and family <> family2 "
        f"and 100 * high2 >= {percent} * low and 100 * high >= {percent} * low2"
    )
    # The smaller set is looked up by its very first tokens.
    looked_up = F.expr("(first = 1 and low <= high2) or (first2 = 1 and low2 <= high)")
    pairs = sized.join(other, "token").where(meets).groupBy("group", "group2")
    pairs = pairs.agg(
        F.count(F.lit(1)).alias("shared"),
        F.bool_or(looked_up).alias("found"),
        F.first("family").alias("family_g"),
        F.first("family2").alias("family_h"),
    ).where("found")
    single = made.where("members = 1").select("group", "n", "last", "digest")
    pairs = pairs.join(single, "group", "left")
    pairs = pairs.join(single.toDF("group2", "n2", "last2", "digest2"), "group2", "left")
    loose = made.where("loose").select("group").distinct().withColumn("loose", F.lit(True))
    pairs = pairs.join(loose, "group", "left")
    pairs = pairs.join(loose.toDF("group2", "loose2"), "group2", "left")
    rest = F.expr(f"ceil({percent} * if(last <= last2, n, n2) / 100) - 1")
    needed = F.expr(f"ceil({percent} * (n + n2) / {100 + percent})")
    pairs = pairs.where(F.coalesce(F.col("shared") + rest >= needed, F.lit(True)))
    key = F.xxhash64("group", "group2").alias("key")
    pairs = pairs.select(
        key,
        F.struct(F.col("group").alias("at"), F.coalesce("digest", "family_g").alias("family")).alias("a"),
        F.struct(F.col("group2").alias("at"), F.coalesce("digest2", "family_h").alias("family")).alias("b"),
        (F.col("n").isNull() & F.col("n2").isNotNull()).alias("turned"),
        (F.col("loose").isNotNull() | F.col("loose2").isNotNull()).alias("loose"),
    )
    # A set by itself comes first: what stands there travels once more.
    g, h = F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b"))
    ends = [g["at"].alias("g"), h["at"].alias("h"), g["family"].alias("family_g"), h["family"].alias("family_h")]
    return checkpointed(pairs.select("key", *ends, "loose"))


def _bounded(pairs: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """The sets of each pair of groups that may be linked, by their bitmaps.

    Rows (key, family_g, family_h, loose, side, digest, rep, score, many, best): ``many`` pairs of sets
    of the two groups may be linked, ``best`` marks the two sets with the highest bound of their
    similarity, ``score``. A group travels as one row, whose members are bounded in number.
    """
    wanted = pairs.select(F.col("g").alias("group")).union(pairs.select("h")).distinct()
    packed = made.select("group", "digest", "rep", "n", "bits").join(wanted, "group", "left_semi")
    packed = checkpointed(packed.groupBy("group").agg(F.collect_list(F.struct("digest", "rep", "n", "bits")).alias("sets")))
    both = pairs.join(packed.toDF("g", "sets_g"), "g").join(packed.toDF("h", "sets_h"), "h")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for row in batch.slice(at, 64).to_pylist():
                    ends = row["key"], row["family_g"], row["family_h"], row["loose"]
                    out += [(*ends, *found) for found in _may_link(row["sets_g"], row["sets_h"], percent)]
                columns = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "key long, family_g long, family_h long, loose boolean, side int, digest long, rep long, score double, many long, best boolean"
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    names, types = zip(*[(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    return both.select("key", "family_g", "family_h", "loose", "sets_g", "sets_h").mapInArrow(bound, schema)


def _may_link(group: list[dict], other: list[dict], percent: int) -> list[tuple]:
    """(side, digest, rep, score, many, best) of the sets of two groups that may have a link."""
    sizes, bits = np.array([m["n"] for m in other]), [m["bits"] for m in other]
    digests = np.array([m["digest"] for m in other])
    many, score, best, near, near_other = 0, -1.0, None, set(), set()
    for i, member in enumerate(group):
        n = member["n"]
        fits = 100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)
        fits = np.flatnonzero(fits & (digests != member["digest"]))
        if not len(fits):
            continue
        shared = shared_at_most(n, member["bits"], sizes[fits], [bits[j] for j in fits])
        may = linked(shared, n, sizes[fits], percent)
        if not may.any():
            continue
        fits, shared = fits[may], shared[may]
        likeness = shared / (n + sizes[fits] - shared)
        first = int(likeness.argmax())
        if likeness[first] > score:
            score, best = float(likeness[first]), (i, int(fits[first]))
        many += len(fits)
        near.add(i)
        near_other.update(fits.tolist())
    sides = ((0, group, near), (1, other, near_other))
    return [
        (side, sets[i]["digest"], sets[i]["rep"], score, many, best[side] == i)
        for side, sets, chosen in sides
        for i in sorted(chosen)
    ]


def _opened(rows: DataFrame, documents: DataFrame, size: int, percent: int, every: bool = False) -> DataFrame:
    """Links for each key of (key, side, digest, rep): one, or with ``every`` as ``_compared`` says."""
    rows = checkpointed(rows.select("key", "side", "digest", "rep"))
    return checkpointed(_compared(_texts_of(documents, rows), size, percent, every))


def _opened_in_turn(rows: DataFrame, stars: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between families: of each two families the most promising pair of sets is opened
    first, and all others only of families that no link has joined by then. Loose groups are
    opened before, for all their links."""
    opened = _opened(rows.where("loose"), documents, size, percent, every=True)
    stars, rows = stars.union(opened), rows.where("not loose")
    first = rows.where("best and side = 0").groupBy("family_g", "family_h")
    first = first.agg(F.max(F.struct("score", "key")).alias("top")).select("top.key")
    links = _opened(rows.where("best").join(first, "key"), documents, size, percent)
    # A pair of groups with one pair of sets is done when that was opened.
    rest = rows.join(first.withColumn("opened", F.lit(True)), "key", "left")
    rest = checkpointed(rest.where("many > 1 or opened is null").drop("opened"))
    if rest.isEmpty():
        return opened.union(links)
    joined = components(stars.union(links))
    for c in ("g", "h"):
        label = joined.select(F.col("node").alias(f"family_{c}"), F.col("label").alias(f"label_{c}"))
        rest = rest.join(label, f"family_{c}", "left")
    apart = F.expr("coalesce(label_g, family_g) <> coalesce(label_h, family_h)")
    return opened.union(links).union(_opened(rest.where(apart), documents, size, percent))
