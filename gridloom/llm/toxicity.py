"""Toxic passages as maximum-scoring segments of token log-odds.

Training compares the words of toxic and other documents: the log-odds of a word under a
Dirichlet prior, and the likelihood ratio of the difference (words without a clear one get a
small negative drift instead). The beginnings of a word count like
words, so that a stem speaks for its forms; the clearest of them gives the word's score. A
document is one pass over its words
that finds all maximal segments of positive score. Segment scores of harmless text follow an
extreme-value law, whose parameters come from the word frequencies and harmless documents; it
turns a segment's score into a significance that allows for the document's length. The score
of a document is a logistic curve over its best segment and the number of significant ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.session import checkpointed
from gridloom.llm.text import Words, letter_words, mix, sequences, slices

TRAIN_ROWS = 20_000  # labelled documents of each class used for training, about
MODEL_WORDS = 100_000  # words kept, those with the clearest odds
MIN_CLEAR = 4.0  # root of the likelihood ratio statistic
MIN_DOCUMENTS = 3
PRIOR = 1000.0  # pseudo-words of the Dirichlet prior
STEMS = [3, 4, 5, 6, 7, 8]  # bytes of the beginnings that count
DRIFT = -0.4  # score of a word without clear odds
SIGNIFICANT = 0.01  # expected number of chance segments per document


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    odds: np.ndarray
    clear: np.ndarray  # strength of the evidence for the odds
    decay: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # K of it
    weights: np.ndarray | None = None
    present: np.ndarray | None = None  # bit table that rules most words out at once

    def __post_init__(self):
        self.present = np.zeros(1 << 20, bool)
        self.present[(self.words & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def scores(self, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words with clear odds, and the odds."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0)
        odds, best = np.zeros(len(tokens[0])), np.zeros(len(tokens[0]))
        for hashes in tokens:
            maybe = np.flatnonzero(self.present[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.searchsorted(self.words, hashes[maybe])
            at[at == len(self.words)] = 0
            good = (self.words[at] == hashes[maybe]) & (self.clear[at] > best[maybe])
            maybe, at = maybe[good], at[good]
            odds[maybe], best[maybe] = self.odds[at], self.clear[at]
        known = np.flatnonzero(best)
        return known, odds[known]

    def background(self, clean: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words in harmless text with their shares; the rest drift."""
        share = clean / total
        share *= min(1.0, 0.5 / max(share.sum(), 1e-300))  # a word and its stems count once at most
        return np.append(self.odds, DRIFT), np.append(share, 1 - share.sum())

    def normal(self, best: float, length: int) -> float:
        """Segment score less what the best chance segment of such a text would have."""
        return self.decay * best - float(np.log(self.scale * max(length, 1)))

    def probability(self, best: np.ndarray, found: np.ndarray) -> np.ndarray:
        x = features(best, found) @ self.weights
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def tokens(found: Words) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings, which are told apart from words."""
    whole, *stems = found.prefix_hashes(STEMS)
    return [mix(whole ^ np.uint64(1)), *stems]


def features(best: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(best)), np.clip(best, -20, 40) / 10, np.log1p(found)))


def segments(at: np.ndarray, odds: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text, in linear time.

    Words between the positions ``at`` score DRIFT each. A segment is kept as its ends and the
    running totals before and after it; a new one swallows those to its left back to the
    nearest that starts from a lower total, as long as it ends higher than that one.
    """
    kept: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for i, s in zip(at.tolist(), odds.tolist()):
        total += DRIFT * (i - last - 1)
        last = i
        if s <= 0:
            total += s
            continue
        start, end, low, high = i, i + 1, total, total + s
        total = high
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((start, end, low, high, j))
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def _sampled(documents: DataFrame, labels: DataFrame, trainable: Column) -> DataFrame:
    """About TRAIN_ROWS documents of each class, chosen by a hash of the id; all if fewer.

    Of documents that share their smallest word triple, by either of two hashes, one stays:
    copies of one document would otherwise make all its words look like signs of its class.
    """
    usable = labels.where(trainable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.rows for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows")).collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    keep = F.lit(False)
    for label, rows in counts.items():
        keep |= (F.col("toxic") == label) & (part < int((1 << 30) * min(1.0, TRAIN_ROWS / rows)))
    sample = usable.where(keep)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = letter_words(piece.column("text"))
                grams = sequences(found.hashes(), 3)
                keys = np.zeros((2, len(found.count)), np.uint64)
                for row in np.flatnonzero(found.count > 2):
                    mine = grams[found.first[row] : found.first[row + 1] - 2]
                    keys[:, row] = mine.min(), mix(mine).min()
                columns = [pa.array(k.view(np.int64)) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("toxic"), *columns],
                    names=["doc_id", "toxic", "key", "other"],
                )

    signed = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    kind = signed.schema["doc_id"].dataType.simpleString()
    signed = signed.mapInArrow(sign, f"doc_id {kind}, toxic int, key long, other long")
    for key in ("key", "other"):
        rest = [F.min_by(c, "doc_id").alias(c) for c in ("key", "other") if c != key]
        signed = signed.groupBy("toxic", key).agg(F.min("doc_id").alias("doc_id"), *rest)
    return checkpointed(signed.select("doc_id", "toxic"))


def fit(documents: DataFrame, labels: DataFrame, trainable: Column | None = None) -> Model:
    """Train on documents with a ``toxic`` label of 0 or 1 for which ``trainable`` holds.

    Only the text is used. At most about TRAIN_ROWS labelled documents of each class are
    read, and at most MODEL_WORDS words kept; the sample of ids is small enough to broadcast.
    Without both labels every document gets the same score of about 0.
    """
    sample = _sampled(documents, labels, F.lit(True) if trainable is None else trainable)
    train = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = letter_words(piece.column("text"))
                rows = len(found.count)
                label = np.asarray(piece.column("toxic"), np.int64)
                for stem, part in enumerate(tokens(found)):
                    hashes, at = np.unique(part, return_inverse=True)
                    pairs = np.unique(at * np.int64(rows) + found.doc)  # once a document
                    at, toxic = pairs // rows, label[pairs % rows]
                    counts = [np.bincount(at[toxic == c], minlength=len(hashes)) for c in (0, 1)]
                    columns = [pa.array(c.astype(np.int64)) for c in (hashes.view(np.int64), *counts)]
                    whole = pa.array(np.full(len(hashes), stem == 0))
                    yield pa.RecordBatch.from_arrays(
                        [*columns, whole], names=["word", "clean", "toxic", "whole"]
                    )

    counts = (
        train.select("text", "toxic")
        .mapInArrow(count, "word long, clean long, toxic long, whole boolean")
        .groupBy("word")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.first("whole").alias("whole"))
    )
    counts = checkpointed(counts)  # used twice
    n0, n1 = counts.where("whole").agg(F.sum("clean"), F.sum("toxic")).first()
    if not n0 or not n1:
        none = np.zeros(0)
        return Model(none.astype(np.uint64), none, none, weights=np.array([-50.0, 0, 0]))
    a, b = F.col("toxic"), F.col("clean")
    prior = F.lit(0.5) + (a + b) * (PRIOR / (n0 + n1))
    odds = F.log((a + prior) / (F.lit(n1 + PRIOR) - a)) - F.log((b + prior) / (F.lit(n0 + PRIOR) - b))

    def surprise(seen: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / ((a + b) * share))).otherwise(0.0)

    clear = F.sqrt(F.greatest(2 * (surprise(a, n1 / (n0 + n1)) + surprise(b, n0 / (n0 + n1))), F.lit(0.0)))
    kept = (
        counts.where(a + b >= MIN_DOCUMENTS)
        .select("word", odds.alias("odds"), clear.alias("clear"), "clean")
        .where(F.col("clear") >= MIN_CLEAR)
        .orderBy(F.desc("clear"), "word")
        .limit(MODEL_WORDS)
        .toPandas()
        .sort_values("word")
    )
    words = kept["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    model = Model(words[order], *(kept[c].to_numpy(float)[order] for c in ("odds", "clear")))
    seen = checkpointed(_found(train.select("toxic", "text"), model, "toxic")).toPandas()
    clean = seen["toxic"].to_numpy() == 0
    length, best = seen["length"].to_numpy(float), seen["best"].to_numpy(float)
    model.decay = _decay(*model.background(kept["clean"].to_numpy(float)[order], n0))
    expected = (np.maximum(length, 1) * np.exp(-model.decay * best))[clean].sum()
    model.scale = float(clean.sum() / max(expected, 1e-300))
    normal = model.decay * best - np.log(model.scale * np.maximum(length, 1))
    model.weights = _logistic(features(normal, seen["many"].to_numpy(float)), ~clean)
    return model


def _decay(odds: np.ndarray, share: np.ndarray) -> float:
    """The positive root x of sum(share * exp(x * odds)) = 1, by bisection."""
    value = lambda x: float((share * np.exp(np.minimum(x * odds, 700))).sum()) - 1
    low, high = 0.0, 1.0
    while value(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (p - y) + 1e-2 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _found(rows: DataFrame, model: Model, keep: str) -> DataFrame:
    """For each text: ``keep``, words, best segment score, count of positive segments."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                per_doc = list(_scan(piece.column("text"), model))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(keep),
                        pa.array([n for n, _ in per_doc], pa.int64()),
                        pa.array([max((s for *_, s in f), default=0.0) for _, f in per_doc], pa.float64()),
                        pa.array([len(f) for _, f in per_doc], pa.int64()),
                    ],
                    names=[keep, "length", "best", "many"],
                )

    kind = rows.schema[keep].dataType.simpleString()
    return rows.mapInArrow(scan, f"{keep} {kind}, length long, best double, many long")


def _scan(texts: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    found = letter_words(texts)
    at, odds = model.scores(tokens(found))
    cut = np.searchsorted(at, found.first)
    for row, n in enumerate(found.count.tolist()):
        a, b = cut[row], cut[row + 1]
        yield n, segments(at[a:b] - found.first[row], odds[a:b]) if a < b else []


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1), ``toxic_words`` (significant passages) to every document.

    Passages are ranges of letter words of the whole text with their score and the number of
    such passages expected by chance. A NULL or empty text has no passage and the lowest
    score. Input columns with these names are replaced; nothing is shuffled.
    """
    documents = documents.drop("score", "toxic_words")
    schema = T.StructType(
        [*documents.schema.fields, T.StructField("score", T.DoubleType())]
        + [T.StructField("toxic_words", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])))]
    )
    passage = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                best, many, passages = [], [], []
                for n, found in _scan(piece.column("text"), model):
                    best.append(model.normal(max((s for *_, s in found), default=0.0), n))
                    many.append(len(found))
                    chance = [(a, b, s, float(np.exp(-model.normal(s, n)))) for a, b, s in found]
                    passages.append([x for x in chance if x[3] <= SIGNIFICANT])
                score = model.probability(np.array(best), np.array(many, float))
                columns = [*piece.columns, pa.array(score), pa.array(
                    [[dict(zip(("start", "end", "score", "expected"), x)) for x in p] for p in passages], passage)]
                yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, "score", "toxic_words"])

    return documents.mapInArrow(judge, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo 5, is 0."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0
