"""Sharding against the same rule carried out on one list."""

import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gridloom.llm import sharding

SCHEMA = "doc_id long, text string, source string, shard int, hash long"


def brute_force(docs, shards, seed=0):
    """(doc_id, crc, size, source) in order of position; equal rows are alike."""
    keyed = []
    for i, text, source, *_ in docs:
        raw = (text or "").encode()
        crc = None if text is None else zlib.crc32(raw)
        values = [str(seed), *("-" if v is None else f"={v}" for v in (i, crc, len(raw) + 16, source))]
        tie = hashlib.md5("|".join(values).encode()).hexdigest()
        key = "-" if source is None else f"={source}"
        keyed.append((key, int(tie[:10], 16), tie, (i, crc, len(raw) + 16, source)))
    by = defaultdict(list)
    for key, h, tie, row in sorted(keyed, key=lambda x: x[:3]):
        by[key].append((h, tie, row))
    ranked = []
    for key, rows in by.items():
        for r, (h, tie, row) in enumerate(rows, 1):
            ranked.append(((2 * r - 1) * 2**39 // len(rows), h, key, tie, row))
    ranked.sort(key=lambda x: x[:4])
    n, out = len(ranked), []
    for position, (*_, row) in enumerate(ranked):
        shard = position * shards // n
        out.append((*row, position, shard, position - -(-shard * n // shards)))
    return out


def corpus():
    docs = [(i, f"text {i % 37} é" * (i % 5), f"s{min(i % 9, 4)}", 1, 1) for i in range(700)]
    docs += [(3, None, None, 1, 1), (None, "", "s0", 1, 1), (5, "same", "s1", 1, 1), (5, "same", "s1", 1, 1)]
    return docs


def test_matches_the_rule(spark, rows, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_BUCKET_ROWS", 50)
    frame = spark.createDataFrame(corpus(), SCHEMA).repartition(4)
    found = sharding.shard_documents(frame, 40, seed=7)
    names = ["doc_id", "text_crc32", "size", "source", "position", "shard", "slot"]
    assert rows(found, *names) == sorted(brute_force(corpus(), 40, seed=7), key=repr)


def test_law_and_mixture(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    found = sharding.shard_documents(frame, 10).collect()
    counts = Counter(r.shard for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(10))
    for shard in counts:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(counts[shard]))
    whole = Counter(r.source for r in found)
    for source, many in whole.items():
        for shard in counts:
            got = sum(r.shard == shard and r.source == source for r in found)
            assert abs(got - many / 10) <= 2


def test_small_tables(spark, rows):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA), 40).count() == 0
    one = spark.createDataFrame([(1, None, None, 1, 1)], SCHEMA)
    assert rows(sharding.shard_documents(one, 40), "doc_id", "size", "shard", "slot") == [(1, 16, 0, 0)]


def test_no_python_on_the_way(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA).select("*", F.lit(1).alias("rank"))
    plan = sharding.shard_documents(frame, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
