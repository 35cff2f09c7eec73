"""Phrases that occur together more often than their parts suggest, by sorting suffixes.

Every word of a text starts a suffix: itself and up to three words that follow in the same piece.
Suffix pointers are sorted by multikey three-way quicksort, word by word. Pointers equal in
their first words end up in one partition, so the size of an equal-partition is the count of the
phrase; a partition smaller than a candidate's least count is abandoned.

That needs all suffixes that begin alike in one place. They are dealt to parts by their leading
words: by the first word, unless it is so frequent that its suffixes would crowd a part; then
by two, three or four words. Equal suffixes of a slice of texts travel once, with their count. A
partition that was dealt by more words than it has sorted so far holds only some of
its phrase's occurrences; it is never abandoned, and Spark adds up what the parts found.

Suffixes of two words go first. Partitions found too small are thereby abandoned for the whole
corpus: longer suffixes end before a word, or a pair of words, rarer than a candidate's least
count. Frequent and crowded words and frequent pairs are looked up in bit tables of fixed size;
one that is taken for such by chance costs work and changes no count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.llm.text import _BASE, _BLANK, _LOWER, Words, buffers, mix, split_words
from gridloom.session import checkpointed

WORDS = 4  # of the longest phrase
SLICE = 14 << 20  # bytes of text sorted and dealt out at once
PART_SUFFIXES = 2_000_000  # suffixes of a part, on average; twice as many of two words
CROWD = 250_000  # a word with more occurrences does not decide alone where its suffixes go
SALTS = 64  # groups of a language that are ranked on their own first
_SLOTS = 1 << 20  # 64-bit words of a bit table: 8 MB

_SPLITS = np.zeros(256, bool)
_SPLITS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _SPLITS.copy()
_GAP[[9, 32]] = True
assert not (_BLANK & ~_GAP).any()


@dataclass
class Slice:
    """The words of some texts; a token is a word in a language."""

    token: np.ndarray  # of each word
    opens: np.ndarray  # whether a word is the first of its piece
    langs: pa.Array  # of each token
    words: pa.Array  # of each token


def read_slice(texts: pa.Array, langs: pa.Array) -> Slice:
    data, at = buffers(texts)
    found = split_words(_LOWER[data], at, _GAP)
    count = len(found.start)
    split = np.cumsum(_SPLITS[data], dtype=np.int32)[found.start] if count else np.zeros(0, np.int64)
    opens = np.ones(count, bool)
    opens[1:] = (split[1:] != split[:-1]) | (found.doc[1:] != found.doc[:-1])
    offsets = np.zeros(count + 1, np.int32)
    np.cumsum(found.end - found.start, out=offsets[1:])
    letters = found.data[~found.gap]
    words = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    words, langs = words.dictionary_encode(), langs.dictionary_encode()
    # Words in order, so that neighbours in a block's list are alike.
    spelled = words.dictionary.take(order := pc.sort_indices(words.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    word = rank[words.indices.to_numpy(zero_copy_only=False)]
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[found.doc]
    size = max(len(spelled), 1)
    both, token = np.unique(lang * size + word, return_inverse=True)
    return Slice(token, opens, langs.dictionary.take(pa.array(both // size)), spelled.take(pa.array(both % size)))


def read_slices(batches) -> Iterator[Slice]:
    """Slices of batches with the columns text and lang, cut between texts."""
    for batch in batches:
        _, at = buffers(batch.column("text"))
        row = 0
        while row < batch.num_rows:
            upto = int(np.searchsorted(at, at[row] + SLICE, "right")) - 1
            upto = min(max(upto, row + 1), batch.num_rows)
            part = batch.slice(row, upto - row)
            yield read_slice(part.column("text"), part.column("lang"))
            row = upto


def token_hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each token."""
    if not len(words):
        return np.zeros(0, np.uint64)
    data, at = buffers(words)
    none = np.zeros(0, np.int64)
    own = Words(data, at[:-1], at[1:], none, none, none, np.zeros(len(data), bool)).hashes()
    langs = langs.dictionary_encode()
    named = [hashlib.blake2b(x.encode(), digest_size=8).digest() for x in langs.dictionary.to_pylist()]
    named = np.frombuffer(b"".join(named), np.uint64)
    return mix(own * _BASE + named[langs.indices.to_numpy(zero_copy_only=False)])


def _in_table(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot, bit = _places(hashes)
    return (bits[slot] >> bit) & np.uint64(1) == 1


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(_SLOTS - 1)).astype(np.int64), hashes >> np.uint64(58)


# --- counting and dealing ----------------------------------------------------------


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """(lang, word, count) of words with ``least`` occurrences, and for each language a row
    whose word is NULL with the number of all its words."""

    def count(batches):
        for s in read_slices(batches):
            counts = np.bincount(s.token, minlength=len(s.words))
            langs = s.langs.dictionary_encode()
            sums = np.bincount(langs.indices.to_numpy(zero_copy_only=False), counts, len(langs.dictionary))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([s.langs, langs.dictionary]),
                    pa.concat_arrays([s.words.cast(pa.string()), pa.nulls(len(langs.dictionary), pa.string())]),
                    pa.array(np.concatenate([counts, sums.astype(np.int64)]), pa.int64()),
                ],
                names=["lang", "word", "count"],
            )

    rows = texts.mapInArrow(count, "lang string, word string, count long")
    sums = rows.groupBy("lang", "word").agg(F.sum("count").alias("count"))
    return checkpointed(sums.where(F.col("word").isNull() | (F.col("count") >= least)))


def bit_tables(phrases: DataFrame, crowd: int | None = None) -> np.ndarray:
    """Bit table of all phrases of one or two words; with ``crowd`` a second one, of those with
    more occurrences than that."""

    def places(batches):
        for b in batches:
            slot, bit = _places(phrase_hashes(b.column("lang"), b.column("phrase")))
            bits = (np.uint64(1) << bit).view(np.int64)
            many = b.column("count").to_numpy() > (crowd or 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(bits), pa.array(np.where(many, bits, 0))], names=["slot", "known", "many"]
            )

    rows = phrases.select("lang", "phrase", "count").mapInArrow(places, "slot long, known long, many long")
    found = rows.groupBy("slot").agg(F.bit_or("known").alias("known"), F.bit_or("many").alias("many")).toArrow()
    tables = np.zeros((1 if crowd is None else 2, _SLOTS), np.int64)
    for table, name in zip(tables, ("known", "many")):
        table[found.column("slot").to_numpy()] = found.column(name).to_numpy()
    return tables.view(np.uint64)


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """A 64-bit hash of each phrase of one or two words."""
    words = pc.split_pattern(phrases, " ", max_splits=1)
    out = token_hashes(langs, pc.list_element(words, 0))
    two = pc.equal(pc.list_value_length(words), 2)
    second = token_hashes(langs.filter(two), pc.list_element(words.filter(two), 1))
    two = two.to_numpy(zero_copy_only=False)
    out[two] = mix(out[two] * _BASE + second)
    return out


def suffixes(s: Slice, hashes: np.ndarray, known: np.ndarray, pairs: np.ndarray | None) -> np.ndarray:
    """Tokens of the suffixes, a row each, -1 after their end.

    Without ``pairs`` those of two known words. With it those of three and four words, of
    which each two neighbours are a known pair.
    """
    count, width = len(s.token), 2 if pairs is None else WORDS
    rows = np.full((count + width, width), -1, np.int64)
    going = _in_table(known, hashes)[s.token] if count else np.zeros(0, bool)
    goes_on = np.zeros(count + width, bool)  # whether a word follows the one before it
    goes_on[:count] = going & ~s.opens
    if pairs is not None and count > 1:
        own = hashes[s.token]
        goes_on[1:count] &= _in_table(pairs, mix(own[:-1] * _BASE + own[1:]))
    alive = np.append(going, np.zeros(width, bool))
    token = np.append(s.token, np.full(width, -1))
    for k in range(width):
        upto = count + width - k
        if k:
            alive[:upto] &= goes_on[k:]
            alive[upto:] = False
        rows[:upto, k] = np.where(alive[:upto], token[k:], -1)
    return rows[rows[:, 1 if pairs is None else 2] >= 0]


def distinct(rows: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and how often each occurs."""
    base = tokens + 1
    halves = [(rows[:, k] + 1) * base + rows[:, k + 1] + 1 for k in range(0, rows.shape[1], 2)]
    if len(halves) == 1:
        both, count = np.unique(halves[0], return_counts=True)
        halves = [both]
    else:
        (first, a), (second, b) = (np.unique(h, return_inverse=True) for h in halves)
        both, count = np.unique(a * max(len(second), 1) + b, return_counts=True)
        halves = [first[both // max(len(second), 1)], second[both % max(len(second), 1)]]
    return np.stack([x for h in halves for x in (h // base, h % base)], axis=1) - 1, count


def dealt(rows: np.ndarray, hashes: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the words that decide where each suffix goes, and how many they are."""
    place = np.zeros(len(rows), np.uint64)
    words = np.zeros(len(rows), np.int64)
    width = rows.shape[1]
    for k in range(width):
        there = rows[:, k] >= 0
        going = words == 0
        own = np.where(there, hashes[rows[:, k]], np.uint64(k))
        place = np.where(going, mix(place * _BASE + own), place)
        last = there & ~crowded[rows[:, k]] if k < width - 1 else np.ones(len(rows), bool)
        words[going & last] = k + 1
    return place, words


BLOCKS = "part long, lang string, words array<string>, planes int, size long, data binary"


def _planes(at: np.ndarray, columns: int, planes: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(column, byte of its numbers, place of that byte for every row) in the data of blocks
    whose rows begin at ``at``.

    A block holds the lowest bytes of its first column, then the next bytes, and so on: bytes that are
    alike stand together, which is what compression needs.
    """
    size = np.diff(at)
    kind = np.int32 if at[-1] * columns * planes < 1 << 31 else np.int64
    own = np.arange(at[-1], dtype=kind) + np.repeat((at[:-1] * (columns * planes - 1)).astype(kind), size)
    step = np.repeat(size.astype(kind), size)
    for column in range(columns):
        for byte in range(planes):
            yield column, byte, own
            own += step


def _steps(codes: np.ndarray, new: np.ndarray) -> None:
    """Replace numbers, in place, by the step from the row above where all columns to the left agree."""
    words = codes[:, :-2].copy()
    for k in range(words.shape[1]):
        codes[1:, k] -= np.where(new[1:], 0, words[:-1, k]).astype(np.uint32)
        new = new.copy()
        new[1:] |= words[1:, k] != words[:-1, k]


def _sums(codes: np.ndarray, new: np.ndarray) -> None:
    """The reverse of ``_steps``."""
    for k in range(codes.shape[1] - 2):
        total = np.cumsum(codes[:, k], dtype=np.int64)
        opens = np.flatnonzero(new)
        before = total[opens] - codes[opens, k]
        codes[:, k] = total - np.repeat(before, np.diff(np.append(opens, len(codes))))
        new = new.copy()
        new[1:] |= codes[1:, k] != codes[:-1, k]


def blocks(s: Slice, tables: np.ndarray, pairs: np.ndarray | None, parts: int) -> pa.RecordBatch:
    """The suffixes of a slice, a row for each part and language.

    A row holds its distinct words, and for every suffix, in order, the numbers of its
    words (0 after its end; as steps from the suffix before, see ``_steps``), its count, and how
    many words decided on the part, all as bytes laid out by ``_planes`` and
    compressed; ``size`` is their number before that.
    """
    hashes = token_hashes(s.langs, s.words)
    rows, count = distinct(suffixes(s, hashes, tables[0], pairs), len(s.words))
    place, words = dealt(rows, hashes, _in_table(tables[1], hashes))
    langs = s.langs.dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False)[rows[:, 0]].astype(np.int64)
    part = (place % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((lang, part))
    rows, count, words, part, lang = (x[order] for x in (rows, count, words, part, lang))
    new = np.ones(len(rows), bool)
    new[1:] = (part[1:] != part[:-1]) | (lang[1:] != lang[:-1])
    block, at = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(rows))
    # The distinct words of each block stand in a row; a word's number counts from its block's first.
    there = rows >= 0
    size = max(len(s.words), 1)
    keys, number = np.unique((block[:, None] * size + rows)[there], return_inverse=True)
    first = np.searchsorted(keys, np.arange(len(at)) * size)
    codes = np.zeros((len(rows), rows.shape[1] + 2), np.uint32)
    codes[:, :-2][there] = number - first[np.broadcast_to(block[:, None], rows.shape)[there]] + 1
    codes[:, -2], codes[:, -1] = count, words
    planes = max(1, (int(codes.max()).bit_length() + 7) // 8) if len(codes) else 1
    _steps(codes, new)
    data = np.empty(len(codes) * codes.shape[1] * planes, np.uint8)
    for column, byte, to in _planes(at, codes.shape[1], planes):
        data[to] = codes[:, column] >> (8 * byte)
    opens, ends = at[:-1], at * codes.shape[1] * planes
    packed = [pa.compress(pa.py_buffer(data[a:b]), "zstd", asbytes=True) for a, b in zip(ends[:-1], ends[1:])]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[opens]),
            langs.dictionary.take(pa.array(lang[opens])),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), s.words.cast(pa.string()).take(pa.array(keys % size))),
            pa.array(np.full(len(opens), planes, np.int32)),
            pa.array(np.diff(ends), pa.int64()),
            pa.array(packed, pa.binary()),
        ],
        names=["part", "lang", "words", "planes", "size", "data"],
    )


def read_blocks(rows: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers ``blocks`` has written, a row for each suffix, and the block of each."""
    numbers, of = [], []
    every = rows.column("planes").to_numpy()
    for planes in np.unique(every).tolist():
        mine = np.flatnonzero(every == planes)
        sizes = rows.column("size").to_numpy()[mine]
        packed = rows.column("data").take(pa.array(mine)).to_pylist()
        ends = np.append(0, np.cumsum(sizes))
        data = np.empty(ends[-1], np.uint8)
        for a, b, block in zip(ends[:-1], ends[1:], packed):
            data[a:b] = np.frombuffer(pa.decompress(block, int(b - a), "zstd"), np.uint8)
        at = ends // (columns * planes)
        found = np.zeros((at[-1], columns), np.uint32)
        for column, byte, place in _planes(at, columns, planes):
            found[:, column] |= data[place].astype(np.uint32) << np.uint32(8 * byte)
        new = np.zeros(len(found), bool)
        new[at[:-1]] = True
        _sums(found, new)
        numbers.append(found)
        of.append(np.repeat(mine.astype(np.int32), np.diff(at)))
    return np.concatenate(numbers), np.concatenate(of)


# --- sorting -----------------------------------------------------------------------


def equal_partitions(keys: np.ndarray, weights: np.ndarray, whole: np.ndarray, least: int):
    """Multikey three-way quicksort of the pointers 0, 1, 2, ... into the columns of ``keys``.

    Yields (depth, pointers, sizes): for the equal-partitions found at ``depth`` one pointer
    each and their size by weight. Every open partition takes one step at a time, together
    with all others: around the key of a middle pointer into less, equal and greater; the equal
    ones go on with the next key, the maximum depth ends them, and so does the key -1. Partitions
    of less than ``least`` are abandoned, unless ``whole`` says that some pointer's keys decide on
    completeness only at a greater depth.
    """
    pointers = np.arange(keys.shape[1], dtype=np.int32)
    start, size = np.zeros(1, np.int64), np.array([len(pointers)])
    depth = np.zeros(1, np.int64)
    while len(pointers):
        of = np.repeat(np.arange(len(size), dtype=np.int32), size)
        key = keys[depth[of], pointers]
        three = np.sort(np.stack([key[start], key[start + size // 2], key[start + size - 1]]), axis=0)
        pivot = three[1]
        side = (key >= pivot[of]).astype(np.int32)
        side += key > pivot[of]
        kind = 3 * of + side
        sizes = np.bincount(kind, minlength=3 * len(size))
        weight = np.bincount(kind, weights[pointers], 3 * len(size)).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        moved = np.empty_like(pointers)
        for c in range(3):
            mine = np.flatnonzero(side == c)
            earlier = np.cumsum(sizes[c::3]) - sizes[c::3]
            moved[starts[kind[mine]] + np.arange(len(mine)) - earlier[of[mine]]] = pointers[mine]
        pointers = moved
        filled = np.flatnonzero(sizes)
        start, size, weight = starts[filled], sizes[filled], weight[filled]
        equal = filled % 3 == 1
        at, ended = depth[filled // 3], equal & (pivot[filled // 3] < 0)
        late = np.maximum.reduceat(whole[pointers], start) > at
        kept = (late | (weight >= least)) & ~ended
        for d in np.unique(at[equal & kept]).tolist():
            found = equal & kept & (at == d)
            yield d, pointers[start[found]], weight[found]
        depth = at + equal
        kept &= depth < len(keys)
        pointers = pointers[np.repeat(kept, size)]
        size, depth = size[kept], depth[kept]
        start = np.cumsum(size) - size


_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("count", pa.int64())])


def sort_part(part: pa.Table, width: int, least: int) -> pa.Table:
    """Phrases that begin the suffixes of a part, with their counts: of two words for suffixes of
    two words, else of three and four."""
    part = part.combine_chunks()
    words = pa.concat_arrays([c.flatten() for c in part.column("words").chunks]).dictionary_encode()
    langs = pa.concat_arrays(part.column("lang").chunks).dictionary_encode()
    numbers = words.indices.to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(part.column("words")).to_numpy())])
    codes, block = read_blocks(part, width + 2)
    keys = np.empty((1 + width, len(codes)), np.int32)
    keys[0] = langs.indices.to_numpy(zero_copy_only=False)[block]
    for k in range(width):
        there = codes[:, k] > 0
        keys[k + 1] = np.where(there, numbers[np.where(there, first[block] + codes[:, k] - 1, 0)], -1)
    weights, whole = codes[:, -2].copy(), codes[:, -1].astype(np.int8)
    del codes, block, numbers
    out = []
    for depth, pointers, count in equal_partitions(keys, weights, whole, least):
        if depth == 2 if width == 2 else depth > 2:
            spelled = [words.dictionary.take(pa.array(keys[k, pointers])) for k in range(1, depth + 1)]
            phrase = pc.binary_join_element_wise(*spelled, " ")
            lang = langs.dictionary.take(pa.array(keys[0, pointers]))
            columns = [lang, phrase, pa.array(np.full(len(count), depth, np.int32)), pa.array(count)]
            out.append(pa.RecordBatch.from_arrays(columns, schema=_PHRASES))
    return pa.Table.from_batches(out, _PHRASES)


def sorted_suffixes(texts: DataFrame, tables, pairs, width: int, parts: int, least: int) -> DataFrame:
    """(lang, phrase, words, count) of frequent phrases among suffixes of ``width`` words."""

    def deal(batches):
        for s in read_slices(batches):
            yield blocks(s, tables.value, None if pairs is None else pairs.value[0], parts)

    def sort(part: pa.Table) -> pa.Table:
        return sort_part(part, width, least)

    found = texts.mapInArrow(deal, BLOCKS).groupBy("part")
    found = found.applyInArrow(sort, "lang string, phrase string, words int, count long")
    sums = found.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("count").alias("count"))
    return checkpointed(sums.where(F.col("count") >= least))


def count_phrases(texts: DataFrame, counts: DataFrame, least: int, crowd: int | None = None) -> DataFrame:
    """(lang, phrase, words, count) of phrases of two to four words with ``least`` occurrences.

    Suffixes of two words are sorted first. Those of three and four words follow only where all
    their pairs have turned out frequent.
    """
    sc = texts.sparkSession.sparkContext
    words = counts.where("word is not null").withColumnRenamed("word", "phrase")

    def parts(rows: DataFrame, suffixes: int) -> int:
        return max(1, -(-(rows.agg(F.sum("count")).first()[0] or 0) // suffixes))

    tables = sc.broadcast(bit_tables(words, CROWD if crowd is None else crowd))
    two = sorted_suffixes(texts, tables, None, 2, parts(words, 2 * PART_SUFFIXES), least)
    pairs = sc.broadcast(bit_tables(two))
    more = sorted_suffixes(texts, tables, pairs, WORDS, parts(two, PART_SUFFIXES), least)
    tables.destroy()
    pairs.destroy()
    return two.unionByName(more)


# --- scores ------------------------------------------------------------------------


def _span(first, size) -> F.Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def score_phrases(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest-scoring cut."""
    parts = phrases.select("lang", "phrase", "count").unionByName(
        counts.where("word is not null").select("lang", F.col("word").alias("phrase"), "count")
    )
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": _span(F.lit(1), F.col("k")), "right": _span(F.col("k") + 1, F.col("words"))})
    for side, name in (("left", "l"), ("right", "r")):
        own = parts.select("lang", F.col("phrase").alias(side), F.col("count").alias(name))
        cuts = cuts.join(own, ["lang", side])
    score = F.expr("(cast(2000000 as decimal(38,0)) * cast(count as decimal(20,0))) div (cast(l as decimal(20,0)) + r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    cuts = cuts.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("count").alias("count"), best)
    return cuts.select("lang", "phrase", "words", F.col("count").alias("a"), "best.l", "best.r", "best.score")


def contained(phrases: DataFrame, percent: int) -> DataFrame:
    """Phrases (lang, phrase) that a longer one holds and nearly always comes along with."""
    longer = phrases.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    held = longer.groupBy("lang", _span(F.col("at"), F.col("size")).alias("phrase"))
    held = held.agg(F.max("count").alias("most"))
    wide = [F.col(c).cast("decimal(20,0)") for c in ("most", "count")]
    both = phrases.join(held, ["lang", "phrase"])
    return both.where(wide[0] * 100 >= wide[1] * percent).select("lang", "phrase")


def collocations(
    documents: DataFrame, least: int = 30, top: int = 2000, percent: int = 80, crowd: int | None = None
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z count as a-z. Texts are split into pieces at ``. , ; : ! ?`` and line ends, and
    pieces into words at blanks and tabs; phrases lie inside pieces. A NULL text is empty, a
    NULL language is ``und``, repeated rows count as often as they are there, other columns are
    not looked at, and an empty table gives an empty result. a is a phrase's count, l and r those
    of the two parts it is cut into, n that of all words of the language; score is
    floor(2000000 a / (l + r)) of the lowest-scoring cut, the first of equals. Phrases with a < ``least`` are no
    candidates, and those are dropped that a longer candidate with ``percent`` of their
    occurrences contains. Order: score and a descending, then the phrase's bytes. Nothing is
    approximate.
    """
    texts = documents.select(
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
    )
    counts = word_counts(texts, least)
    phrases = count_phrases(texts, counts, least, crowd)
    scored = score_phrases(phrases, counts).join(contained(phrases, percent), ["lang", "phrase"], "left_anti")
    # One language may have most phrases: its groups are ranked first, then the best of them.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", "salt").orderBy(*order)
    scored = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = scored.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    total = counts.where("word is null").select("lang", F.col("count").alias("n"))
    return (
        ranked.where(F.col("rank") <= top)
        .join(total, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
