"""Text quality as perplexity under a modified Kneser-Ney model of trusted text.

The model is over the last ORDER bytes; white space counts as one blank. Counts of trusted
text, continuation counts of the lower orders, their discounts and the interpolated
probability of every n-gram seen are joins and aggregates over tables of n-grams, so they
grow and spread with the text. The tables are cut into shards by the byte before the
predicted one, which all n-grams of a prediction share; each shard goes out to one scan of the
documents and scores the bytes it is responsible for, and a document's parts are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.llm.filters import rows_with_ids
from gridloom.llm.table import Table
from gridloom.llm.text import _BLANK, buffers, slices
from gridloom.session import checkpointed

ORDER = 5
SHARD_ROWS = 2_000_000  # n-grams and contexts sent out at once, about 150 MB in a task
QUANTILE = 0.99
MARGIN = 1.05  # how far above the quantile of trusted text a perplexity may lie
HELD_BACK = 5
BINS = 1000  # of the logarithm of perplexity, to find quantiles by counting

_PAD = 0x0A  # stands before the first byte of a text


def byte_grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER bytes up to each byte of each text as one number, and the texts' offsets."""
    blank = _BLANK[data]
    keep = np.ones(len(data), bool)
    if len(data):
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[at[(at > 0) & (at < len(data))]] = True
    data = np.where(blank, np.uint8(32), data)[keep]
    at = np.concatenate(([0], np.cumsum(keep)))[at]
    grams = data.astype(np.uint64)
    position = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, ORDER):
        earlier = np.full(len(data), _PAD, np.uint64)
        earlier[k:] = data[: max(len(data) - k, 0)]
        earlier[position < k] = _PAD
        grams |= earlier << np.uint64(8 * k)
    return grams, at


def _order_column(order: int) -> Column:
    return F.lit(order).cast("int").alias("order")


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, count) of all texts, added up inside each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                grams, _ = byte_grams(*buffers(piece.column("text")))
                values, counts = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(counts)], names=["gram", "count"]
                )

    rows = texts.select("text").mapInArrow(count, "gram long, count long")
    return rows.groupBy("gram").agg(F.sum("count").alias("count"))


@dataclass
class Model:
    """Tables ``grams`` (order, gram, logp) and ``contexts`` (order, gram, logw)."""

    grams: DataFrame | None
    contexts: DataFrame | None


def _low(column: str, size: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << (8 * size)) - 1))


def fit(trusted: DataFrame) -> Model:
    """A model of the ``text`` column of all the rows given; without any text an empty one."""
    counts = {ORDER: checkpointed(count_grams(trusted))}
    if counts[ORDER].isEmpty():
        return Model(None, None)
    for n in range(ORDER - 1, 0, -1):
        # In how many different continuations of the order above a shorter n-gram occurs.
        lower = counts[n + 1].select(_low("gram", n).alias("gram"))
        counts[n] = checkpointed(lower.groupBy("gram").agg(F.count(F.lit(1)).alias("count")))
    below, grams, contexts = None, [], []
    for n in range(1, ORDER + 1):
        seen = counts[n].withColumn("context", F.shiftright("gram", 8))
        of = [F.count_if(F.col("count") == k) for k in (1, 2, 3, 4)]
        discounts = _discounts(seen.agg(*of).first())
        cut = F.lit(discounts[2])
        for k in (2, 1):
            cut = F.when(F.col("count") == k, discounts[k - 1]).otherwise(cut)
        totals = seen.withColumn("cut", cut).groupBy("context")
        totals = totals.agg(F.sum("count").alias("total"), F.sum("cut").alias("spare"))
        totals = totals.withColumn("weight", F.col("spare") / F.col("total"))
        seen = seen.withColumn("cut", cut).join(totals, "context")
        direct = (F.col("count") - F.col("cut")) / F.col("total")
        if below is None:
            seen = seen.withColumn("p", direct + F.col("weight") / 256)
        else:
            shorter = below.select(F.col("gram").alias("shorter"), F.col("p").alias("q"))
            seen = seen.withColumn("shorter", _low("gram", n - 1)).join(shorter, "shorter")
            seen = seen.withColumn("p", direct + F.col("weight") * F.col("q"))
        below = checkpointed(seen.select("gram", "p"))
        grams.append(below.select(_order_column(n), "gram", F.log("p").alias("logp")))
        contexts.append(totals.select(_order_column(n), F.col("context").alias("gram"), F.log("weight").alias("logw")))
    all_grams, all_contexts = grams[0], contexts[0]
    for g, c in zip(grams[1:], contexts[1:]):
        all_grams, all_contexts = all_grams.union(g), all_contexts.union(c)
    return Model(all_grams, checkpointed(all_contexts))


def _discounts(of: tuple) -> list[float]:
    """Discounts for counts of 1, 2 and more, from how many n-grams have counts 1 to 4."""
    n = [0, *of]
    if not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    out = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
    return [min(max(d, 0.1), k - 0.1) for d, k in zip(out, (1, 2, 3))]


class Shard:
    """The part of a model for some values of the byte before the predicted one.

    It travels as plain arrays; the tables are made where it is first used.
    """

    def __init__(self, mine: np.ndarray, grams: list[np.ndarray], contexts: list[np.ndarray]):
        self.mine, self.rows, self.made = mine, (grams, contexts), None

    def tables(self) -> tuple[list, list]:
        if self.made is None:
            self.made = tuple(
                [_column(*rows, n) for n in range(1, ORDER + 1)] for rows in self.rows
            )
            self.rows = None
        return self.made

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of the last byte of each n-gram."""
        seen, contexts = self.tables()
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for n in range(ORDER, 0, -1):
            size = np.uint64((1 << (8 * n)) - 1)
            table, value = seen[n - 1]
            at = table.find(grams[left] & size)
            hit = at >= 0
            out[left[hit]] += value[at[hit]]
            left = left[~hit]
            # Not seen: the context's spare weight times the probability of the order below.
            table, value = contexts[n - 1]
            at = table.find((grams[left] & size) >> np.uint64(8))
            if len(value):
                out[left] += np.where(at >= 0, value[at], 0.0)
        out[left] -= np.log(256)
        return out


def _column(order: np.ndarray, gram: np.ndarray, value: np.ndarray, n: int):
    mine = order == n
    return Table(gram[mine].view(np.uint64)), value[mine]


def _shards(model: Model) -> Iterator[Shard]:
    """Shards of bounded size; a byte value alone is the smallest there can be."""
    if model.grams is None:
        every = np.ones(256, bool)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        yield Shard(every, none, none)
        return
    before = F.shiftright("gram", 8).bitwiseAND(F.lit(255)).cast("int")
    last = F.col("gram").bitwiseAND(F.lit(255)).cast("int")
    grams = model.grams.withColumn("key", F.when(F.col("order") > 1, before))
    contexts = model.contexts.withColumn("key", F.when(F.col("order") > 1, last))
    sizes = grams.select("key").union(contexts.select("key")).groupBy("key").count()
    size = {r.key: r["count"] for r in sizes.collect() if r.key is not None}  # at most 256 rows
    group: list[int] = []
    groups = [group]
    for key in range(256):
        if group and sum(size.get(k, 0) for k in (*group, key)) > SHARD_ROWS:
            groups.append(group := [])
        group.append(key)
    for group in groups:
        mine = np.zeros(256, bool)
        mine[group] = True
        parts = []
        for frame, value in ((grams, "logp"), (contexts, "logw")):
            rows = frame.where(F.col("key").isNull() | F.col("key").isin(group)).drop("key").toArrow()
            parts.append([rows.column(c).to_numpy() for c in ("order", "gram", value)])
        yield Shard(mine, *parts)


def perplexity(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, bytes and perplexity of every document (NULL for a text without any).

    One row for each row of ``documents``. White space is counted once in a row.
    """
    rows = documents.select("doc_id", "lang", "text", F.xxhash64("text").alias("digest"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    parts = None
    for shard in _shards(model):
        sent = documents.sparkSession.sparkContext.broadcast(shard)

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shard = sent.value
            for batch in batches:
                for piece in slices(batch):
                    grams, at = byte_grams(*buffers(piece.column("text")))
                    here = shard.mine[((grams >> np.uint64(8)) & np.uint64(255)).astype(np.int64)]
                    place = np.flatnonzero(here)
                    total = np.concatenate(([0.0], np.cumsum(shard.score(grams[place]))))
                    cut = np.searchsorted(place, at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(piece.column(c) for c in ("doc_id", "lang", "digest")),
                            pa.array(np.diff(total[cut])),
                            pa.array(np.diff(cut)),
                            pa.array(np.diff(at)),
                        ],
                        names=["doc_id", "lang", "digest", "logp", "scored", "bytes"],
                    )

        part = rows.mapInArrow(
            score, f"doc_id {kind}, lang string, digest long, logp double, scored long, bytes long"
        ).withColumn("shard", F.lit(0 if parts is None else 1))
        parts = part if parts is None else parts.union(part)
    # Rows that agree in id and text are added up together and taken apart again.
    copies = F.count_if(F.col("shard") == 0)
    return (
        parts.groupBy("doc_id", "lang", "digest")
        .agg(F.sum("logp").alias("logp"), F.sum("scored").alias("scored"), F.first("bytes").alias("bytes"), copies.alias("copies"))
        .withColumn("perplexity", F.when(F.col("scored") > 0, F.exp(-F.col("logp") / F.col("scored"))))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "lang", "bytes", "perplexity")
    )


def classify(
    documents: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN
) -> DataFrame:
    """doc_id, lang, bytes, perplexity, limit, keep of every document.

    ``trusted_ids`` has the ids of trusted documents in ``doc_id``. One in HELD_BACK of them,
    by a hash of the id, is kept from the model, so that its perplexity is that of unseen text.
    A language's limit is the given quantile of those perplexities times ``margin``; as a few
    documents say little about a quantile, it is at least the language's median times the
    quantile of the distances from the medians in all languages. A language without trusted
    text takes the quantile over all, and without any trusted text everything is kept. A text
    without any byte has no perplexity and is not kept. Quantiles are found from counts of
    1/BINS steps of the logarithm, over all the documents held back.
    """
    held_back = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_BACK)) == 0
    trusted_ids = checkpointed(trusted_ids.select("doc_id").where("doc_id is not null").distinct())
    model_ids = trusted_ids.where(~held_back)
    trusted = rows_with_ids(documents.select("doc_id", "text"), model_ids, "doc_id")
    # Not a semi join, which the optimizer would move below the filter; and the same join at
    # every size, as the ids grow with the documents.
    model = fit(trusted.join(model_ids.hint("merge"), "doc_id"))
    scored = checkpointed(perplexity(documents, model))
    counts = (
        scored.where(F.col("perplexity").isNotNull() & held_back)
        .join(trusted_ids, "doc_id", "left_semi")
        .groupBy("lang", F.floor(F.log("perplexity") * BINS).alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    counts = checkpointed(counts)
    middle = _quantile(counts, 0.5, ["lang"]).withColumnsRenamed({"lang": "of", "bin": "middle"})
    apart = counts.join(middle, counts["lang"].eqNullSafe(middle["of"]))
    apart = apart.groupBy((F.col("bin") - F.col("middle")).alias("bin")).agg(F.sum("rows").alias("rows"))
    apart, overall = (
        F.lit(row["bin"] if row else None).cast("long")
        for row in (
            _quantile(apart, quantile, []).first(),
            _quantile(counts.groupBy("bin").agg(F.sum("rows").alias("rows")), quantile, []).first(),
        )
    )
    high = _quantile(counts, quantile, ["lang"])
    limits = high.join(middle, high["lang"].eqNullSafe(middle["of"]))
    limits = limits.select("of", F.greatest("bin", F.col("middle") + apart).alias("bin"))
    # One row per language; sent out only while that is certainly little.
    if limits.count() <= 10_000:
        limits = F.broadcast(limits)
    joined = scored.join(limits, scored["lang"].eqNullSafe(limits["of"]), "left")
    limit = F.exp((F.coalesce("bin", overall) + 1) / BINS) * margin
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return joined.withColumn("limit", limit).withColumn("keep", keep).drop("of", "bin")


def _quantile(counts: DataFrame, quantile: float, by: list[str]) -> DataFrame:
    """The smallest ``bin`` up to which ``rows`` reach a share of all."""
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    reached = F.sum("rows").over(upto) >= quantile * F.sum("rows").over(whole)
    found = counts.withColumn("reached", reached).where("reached")
    return found.groupBy(*by).agg(F.min("bin").alias("bin")).where("bin is not null")
