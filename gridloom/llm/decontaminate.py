"""Benchmark passages in documents, found by latent semantic retrieval.

Benchmark items are cut into passages and become TF-IDF vectors, with document frequencies
from the whole corpus. A randomised SVD of those vectors, computed as joins and sums over
Spark rows, gives every word of the benchmark a place in a latent space. Windows of the
documents near a passage's rarest words are folded into that space, and their cosines with
the passages name candidates. A candidate counts when the longest common subsequence of words
covers enough of the passage and enough of the passage's rarest words, its answer, are there;
so a paraphrase is found as well, and text that merely shares common words is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.table import Table
from gridloom.llm.text import Words, mix, plain_words, slices
from gridloom.session import checkpointed

PASSAGE = 64  # words of a passage of a benchmark item
STRIDE = 16  # between two passages of a longer item, so that no excerpt falls between them
WINDOW, STEP = 32, 16  # words of a window of a document, and between two
DIMENSIONS = 128
COSINE = 0.4
COVERED = 0.6  # of a passage's words, in order
ANSWER_WORDS, ANSWERED = 8, 0.4
SHORT = 12  # passages with fewer words must be there whole
SPREAD = 1.5  # words of a document a match may reach over, for each word of the passage
BLOCK_WORDS = 100_000  # benchmark words sent out at once
_BUCKETS = 1 << 16


def document_frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents words of each hash bucket occur, over all texts; and documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(_BUCKETS, np.int64), 0
        for batch in batches:
            for piece in slices(batch):
                found = plain_words(piece.column("text"))
                pairs = found.doc * np.int64(_BUCKETS) + _bucket(found.hashes())
                total += np.bincount(np.unique(pairs) & (_BUCKETS - 1), minlength=_BUCKETS)
                rows += len(found.count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["at", "count"]
        )

    rows = documents.select("text").mapInArrow(count, "at long, count long")
    rows = rows.groupBy("at").agg(F.sum("count").alias("count")).toPandas()  # at most 65,537 rows
    seen = np.zeros(_BUCKETS, np.int64)
    at, many = rows["at"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)
    seen[at[at >= 0]] = many[at >= 0]
    return seen, int(many[at < 0].sum())


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(_BUCKETS - 1)).astype(np.int64)


def _random(features: np.ndarray) -> np.ndarray:
    """The rows of a random matrix that belong to these features: signs from their hash."""
    lanes = np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64)
    bits = mix(features[:, None] ^ (lanes * np.uint64(0x9E3779B97F4A7C15))[None, :])
    bits = (bits[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return bits.reshape(len(features), DIMENSIONS).astype(float) * 2 - 1


def _vectors(words: Words, idf: np.ndarray):
    """TF-IDF of each passage as (features, values), with length 1."""
    hashes = words.hashes()
    for a, b in zip(words.first[:-1], words.first[1:]):
        features, many = np.unique(hashes[a:b], return_counts=True)
        values = many * idf[_bucket(features)]
        yield features, values / max(float(np.sqrt(values @ values)), 1e-12)


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id, passage (0, 1, ...) and text of pieces of PASSAGE words, STRIDE apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = plain_words(piece.column("text"))
                row, number, texts = [], [], []
                for i, n in enumerate(found.count.tolist()):
                    for k in range(1 + max(0, -(-(n - PASSAGE) // STRIDE)) if n else 0):
                        a = int(found.first[i]) + max(0, min(k * STRIDE, n - PASSAGE))
                        b = min(a + PASSAGE, int(found.first[i + 1])) - 1
                        row.append(i)
                        number.append(k)
                        texts.append(found.data[found.start[a] : found.end[b]].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("item_id").take(pa.array(row, pa.int64())),
                        pa.array(number, pa.int32()),
                        pa.array(texts, pa.string()),
                    ],
                    names=["item_id", "passage", "text"],
                )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    cut_up = benchmark.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, passage int, text string")
    # Equal passages are one, under the smallest item.
    return cut_up.groupBy("text").agg(F.min(F.struct("item_id", "passage")).alias("first")).select("first.*", "text")


def latent_space(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(feature, vector): the right singular vectors of the passages' TF-IDF matrix A.

    Z = A'(A R) for a random R comes from one pass over the passages and a sum per feature;
    with W = R'Z, A'A is close to Z W^-1 Z' (the Nystrom form), whose eigenvectors are a fixed
    small matrix applied to the rows of Z. Only matrices of DIMENSIONS squared reach the driver.
    """

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                features, rows = [], []
                for f, x in _vectors(plain_words(piece.column("text")), idf):
                    features.append(f)
                    rows.append(np.outer(x, x @ _random(f)))
                yield _feature_rows(np.concatenate(features), np.concatenate(rows))

    def add_up(group: pa.Table) -> pa.Table:
        features, at = np.unique(group.column("feature").to_numpy(), return_inverse=True)
        total = np.zeros((len(features), DIMENSIONS))
        np.add.at(total, at, _matrix(group.column("vector")))
        return pa.Table.from_batches([_feature_rows(features, total)])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, g = np.zeros((2, DIMENSIONS, DIMENSIONS))
        for batch in batches:
            z = _matrix(batch.column("vector"))
            w += _random(batch.column("feature").to_numpy().view(np.uint64)).T @ z
            g += z.T @ z
        at = pa.array(np.arange(DIMENSIONS**2))
        yield pa.RecordBatch.from_arrays([at, pa.array(w.ravel()), pa.array(g.ravel())], names=["at", "w", "g"])

    schema = "feature long, vector array<double>"
    partial = texts.select("text").mapInArrow(project, schema)
    parts = F.lit(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    z = checkpointed(partial.groupBy(F.pmod("feature", parts)).applyInArrow(add_up, schema))
    sums = z.mapInArrow(grams, "at long, w double, g double").groupBy("at").agg(F.sum("w").alias("w"), F.sum("g").alias("g"))
    sums = sums.orderBy("at").toPandas()
    if not len(sums):
        return z
    w, g = (sums[c].to_numpy().reshape(DIMENSIONS, DIMENSIONS) for c in ("w", "g"))
    values, vectors = np.linalg.eigh((w + w.T) / 2)
    good = values > max(values.max(), 0) * 1e-9
    half = vectors[:, good] / np.sqrt(values[good])
    size, turn = np.linalg.eigh(half.T @ g @ half)
    good = size > max(size.max(initial=0), 0) * 1e-9
    change = np.zeros((DIMENSIONS, DIMENSIONS))
    change[:, : good.sum()] = (half @ turn[:, good]) / np.sqrt(size[good])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _feature_rows(batch.column("feature").to_numpy(), _matrix(batch.column("vector")) @ change)

    return z.mapInArrow(turned, schema)


def _feature_rows(features: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * DIMENSIONS)
    vectors = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(features.view(np.int64)), vectors], names=["feature", "vector"])


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)


@dataclass
class Block:
    """A part of the benchmark, ready to be looked for."""

    items: list  # (item_id, passage)
    words: list[np.ndarray]
    answers: list[np.ndarray]
    latent: np.ndarray  # passages by dimensions, each of length 1
    known: Table  # words of these passages
    place: np.ndarray  # their vectors, times their weight

    def __post_init__(self):
        """For each known word the passages it answers, one list after the other."""
        self.least = np.array([np.ceil(ANSWERED * len(a)) for a in self.answers], np.int64)
        passage = np.repeat(np.arange(len(self.answers)), [len(a) for a in self.answers])
        word = self.known.find(np.concatenate(self.answers))
        self.answered = passage[np.argsort(word, kind="stable")]
        self.many = np.append(np.bincount(word, minlength=self.known.count), 0)  # last: not known
        self.start = np.cumsum(self.many) - self.many

    def telling(self, found: Words, entry: np.ndarray) -> np.ndarray:
        """Whether a word answers a passage of which its document has answers enough."""
        out = np.zeros(len(entry), bool)
        at = np.flatnonzero(self.many[entry])
        many = self.many[entry[at]]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        passage = self.answered[np.repeat(self.start[entry[at]], many) + within]
        at = np.repeat(at, many)
        pair = found.doc[at] * np.int64(len(self.answers)) + passage
        once = np.unique(pair * np.int64(self.known.count + 1) + entry[at])
        pairs, answers = np.unique(once // (self.known.count + 1), return_counts=True)
        pairs = pairs[answers >= self.least[pairs % len(self.answers)]]
        out[at[np.isin(pair, pairs)]] = True
        return out

    def matches(self, found: Words):
        """(text, index of passage, cosine, common words, first and end word) of each match."""
        hashes = found.hashes()
        entry = self.known.find(hashes)
        telling = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(self.telling(found, entry), out=telling[1:])
        seen: dict[tuple[int, int], tuple] = {}
        for doc, a, b in self._windows(found, telling):
            mine = entry[a:b]
            vector = self.place[mine[mine >= 0]].sum(axis=0)
            cosines = self.latent @ (vector / max(float(np.sqrt(vector @ vector)), 1e-12))
            for i in np.flatnonzero(cosines >= COSINE).tolist():
                reach = len(self.words[i])
                low, high = max(a - reach, found.first[doc]), min(b + reach, found.first[doc + 1])
                if seen.get((doc, i), (0,))[0] < reach:
                    n, first, end = self._match(i, hashes[low:high])
                    if n:
                        place = int(low - found.first[doc])
                        row = (n, first - end, float(cosines[i]), place + first, place + end)
                        seen[doc, i] = max(seen.get((doc, i), row), row)
        for (doc, i), (n, _, cosine, first, end) in sorted(seen.items()):
            yield doc, i, cosine, n, first, end

    def _windows(self, found: Words, telling: np.ndarray):
        """Windows with a telling word in them or a step away, and enough of them around."""
        least = self.least.min()
        docs = np.flatnonzero(telling[found.first[1:]] > telling[found.first[:-1]])
        for doc in docs.tolist():
            first, end = int(found.first[doc]), int(found.first[doc + 1])
            starts = np.arange(first, max(end - WINDOW + STEP, first + 1), STEP)
            ends = np.minimum(starts + WINDOW, end)
            near = telling[np.minimum(ends + STEP, end)] > telling[np.maximum(starts - STEP, first)]
            around = telling[np.minimum(ends + PASSAGE, end)] - telling[np.maximum(starts - PASSAGE, first)]
            for k in np.flatnonzero(near & (around >= least)).tolist():
                yield doc, int(starts[k]), int(ends[k])

    def _match(self, i: int, region: np.ndarray) -> tuple[int, int, int]:
        """Common words with a passage and where, if enough lie close enough together; else 0."""
        none, size = (0, 0, 0), len(self.words[i])
        if not self._is_there(i, region):
            return none
        best = common_words(self.words[i], region)
        if best[0] < needed(size):
            return none
        if best[2] - best[1] <= SPREAD * size:
            return best
        # Windows that any match of at most this spread lies in.
        step = max(1, size // 4)
        wide = int(np.ceil(SPREAD * size)) + step
        best = none
        for at in range(0, max(len(region) - wide + step, 1), step):
            part = region[at : at + wide]
            if self._is_there(i, part):
                n, first, end = common_words(self.words[i], part)
                if n >= needed(size):
                    best = max(best, (n, at + first, at + end), key=lambda x: (x[0], x[1] - x[2]))
        return best

    def _is_there(self, i: int, region: np.ndarray) -> bool:
        """The answer check, and a bound on the common subsequence by counting words."""
        answers = self.answers[i]
        if np.isin(answers, region).sum() < ANSWERED * len(answers):
            return False
        return np.isin(self.words[i], region).sum() >= needed(len(self.words[i]))


def needed(words: int) -> int:
    """How many words of a passage must be there in order."""
    return words if words < SHORT else int(np.ceil(COVERED * words))


def common_words(passage: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and a span of the region that holds one."""
    rows = np.zeros((len(passage) + 1, len(region) + 1), np.int32)
    for i, word in enumerate(passage):
        step = np.where(region == word, rows[i, :-1] + 1, rows[i, 1:])
        np.maximum.accumulate(step, out=rows[i + 1, 1:])
    n = int(rows[-1, -1])
    end = int(np.searchsorted(rows[-1], n))
    i, j, first = len(passage), end, end
    while i and j and rows[i, j]:
        if passage[i - 1] == region[j - 1] and rows[i, j] == rows[i - 1, j - 1] + 1:
            i, j, first = i - 1, j - 1, j - 1
        elif rows[i - 1, j] == rows[i, j]:
            i -= 1
        else:
            j -= 1
    return n, first, end


def _blocks(documents: DataFrame, benchmark: DataFrame) -> Iterator[Block]:
    seen, total = document_frequencies(documents)
    idf = np.log((1 + total) / (1 + seen)) + 0.1
    pieces = checkpointed(passages(benchmark))
    space = checkpointed(latent_space(pieces, idf))
    count = pieces.count()
    blocks = max(1, -(-count * PASSAGE // BLOCK_WORDS))
    by_block = F.pmod(F.xxhash64("text"), F.lit(blocks))
    for block in range(blocks if count else 0):
        mine = pieces.where(by_block == block).orderBy("item_id", "passage").toPandas()
        found = plain_words(pa.array(mine["text"], pa.string()))
        hashes = found.hashes()
        features = np.unique(hashes)
        wanted = documents.sparkSession.createDataFrame(
            [(int(f),) for f in features.view(np.int64)], "feature long"
        )
        # At most as many rows as the block has words.
        rows = space.join(wanted, "feature", "left_semi").toPandas().sort_values("feature")
        features = rows["feature"].to_numpy(np.int64).view(np.uint64)
        place = np.array(rows["vector"].tolist()).reshape(len(rows), DIMENSIONS)
        weight = idf[_bucket(features)]
        known = Table(features)
        place = place * weight[:, None]
        words = [hashes[a:b] for a, b in zip(found.first[:-1], found.first[1:])]
        latent = np.array([place[known.find(w)].sum(axis=0) for w in words]).reshape(len(words), DIMENSIONS)
        latent /= np.maximum(np.sqrt((latent**2).sum(axis=1, keepdims=True)), 1e-12)
        answers = []
        for w in words:
            rare = np.unique(w)
            answers.append(rare[np.argsort(-idf[_bucket(rare)], kind="stable")[:ANSWER_WORDS]])
        items = list(zip(mine["item_id"].tolist(), mine["passage"].tolist()))
        yield Block(items, words, answers, latent, known, place)


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it.

    Columns: doc_id, item_id, passage, cosine, common (words in order), words (of the passage),
    start and end (words of the document). Of an item's passages the best is given. NULL and
    empty texts on either side match nothing; equal items count as the smallest item_id, and
    rows that repeat an id are searched each. Documents are not shuffled; the benchmark goes
    out in blocks of bounded size, one scan for each.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType
    schema = (
        f"doc_id {kind}, item_id {item_kind.simpleString()}, passage int, cosine double, common long, "
        "words long, start long, end long"
    )
    found = documents.sparkSession.createDataFrame([], schema)
    for block in _blocks(documents, benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                for piece in slices(batch):
                    rows = [
                        (doc, *block.items[i], cosine, n, len(block.words[i]), first, end)
                        for doc, i, cosine, n, first, end in block.matches(plain_words(piece.column("text")))
                    ]
                    best: dict[tuple, tuple] = {}
                    for r in rows:
                        old = best.get(r[:2], r)
                        best[r[:2]] = max(old, r, key=lambda x: (x[4] / x[5], -x[2]))
                    row, *columns = [list(c) for c in zip(*best.values())] if best else [[]] * 8
                    types = [pa.int64(), pa.int32(), pa.float64(), *[pa.int64()] * 4]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id").take(pa.array(row, pa.int64()))]
                        + [pa.array(c, t) for c, t in zip(columns, types)],
                        names=["doc_id", "item_id", "passage", "cosine", "common", "words", "start", "end"],
                    )

        found = found.union(documents.select("doc_id", "text").mapInArrow(search, schema))
    return found


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns."""
    for block in _blocks(documents, benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                for piece in slices(batch):
                    clean = np.ones(piece.num_rows, bool)
                    for doc, *_ in block.matches(plain_words(piece.column("text"))):
                        clean[doc] = False
                    yield piece.filter(pa.array(clean))

        documents = documents.mapInArrow(keep, documents.schema)
    return documents
