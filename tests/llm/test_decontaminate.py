"""Benchmark passages against aligning every item with every document."""

import random
import re

import numpy as np

from gridloom.llm import decontaminate as d

SCHEMA = "doc_id long, text string, item_id long"
BENCHMARK = "item_id long, text string"


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def corpus():
    rng = random.Random(11)
    common = "the of and to in is that it for on with as".split()
    rare = ["".join(rng.choices("abdeginorstuvé", k=rng.randint(5, 10))) for _ in range(3000)]

    def text(n):
        return [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]

    items = [(i, text(rng.randint(14, 55))) for i in range(25)] + [(30, text(150)), (31, text(6))]
    docs, planted = [], set()
    for i in range(220):
        body = text(rng.randint(10, 300))
        if i % 4 == 0:
            item, passage = rng.choice(items)
            passage = list(passage)
            if i % 8 == 0 and len(passage) >= 25:  # a paraphrase: words lost and words changed
                for _ in range(len(passage) // 6):
                    del passage[rng.randrange(len(passage))]
                for _ in range(len(passage) // 10):
                    passage[rng.randrange(len(passage))] = rng.choice(common)
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() + "," if i % 12 == 0 else w for w in passage]
            planted.add((i, item))
        docs.append((i, " ".join(body), 0))
    return docs, [(i, " ".join(w)) for i, w in items], planted


def test_finds_what_was_planted(spark):
    docs, items, planted = corpus()
    items += [(99, items[3][1]), (50, None), (51, ""), (None, "a b c")]
    docs += [(1000, None, 0), (1001, "", 0), (1002, items[0][1], 0), (1002, items[0][1], 0), (None, items[1][1], 0)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    benchmark = spark.createDataFrame(items, BENCHMARK)
    found = d.find_leaks(frame, benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert planted | {(1002, 0), (None, 1)} == got
    assert sum(r.doc_id == 1002 for r in found) == 2
    texts = {i: t for i, t, _ in docs}
    for r in found:
        assert r.common <= lcs(words(dict(items)[r.item_id]), words(texts[r.doc_id])) and r.common >= d.needed(r.words)
    kept = d.without_leaks(frame, benchmark)
    assert kept.columns == frame.columns
    dirty = {i for i, _ in planted} | {1002, None}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in docs if i not in dirty)


def test_excerpts_across_the_cuts_of_a_long_item(spark):
    rng = random.Random(3)
    docs, items, _ = corpus()
    long = [(40 + n, ["".join(rng.choices("abdeginorstuv", k=rng.randint(5, 10))) for _ in range(n)]) for n in (100, 128, 200)]
    body = docs[1][1].split()
    planted = [(i, n, " ".join([*body[:50], *w[a : a + d.PASSAGE], *body[50:]])) for i, w in long for n, a in enumerate(range(0, len(w) - d.PASSAGE + 1, 8))]
    benchmark = spark.createDataFrame([*items, *((i, " ".join(w)) for i, w in long)], BENCHMARK)
    frame = spark.createDataFrame([(1000 * i + n, t, 0) for i, n, t in planted] + docs, SCHEMA)
    found = {(r.doc_id, r.item_id) for r in d.find_leaks(frame, benchmark).collect()}
    assert {(1000 * i + n, i) for i, n, _ in planted} == {x for x in found if x[0] >= 1000}
    kept = {r.doc_id for r in d.without_leaks(frame, benchmark).collect()}
    assert not any(1000 * i + n in kept for i, n, _ in planted)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_WORDS", 1000)
    docs, items, planted = corpus()
    found = d.find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, BENCHMARK))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == planted


def test_empty_tables(spark):
    docs, items, _ = corpus()
    none = spark.createDataFrame([], SCHEMA)
    frame = spark.createDataFrame(docs[:20], SCHEMA)
    assert d.find_leaks(none, spark.createDataFrame(items, BENCHMARK)).count() == 0
    assert d.find_leaks(frame, spark.createDataFrame([], BENCHMARK)).count() == 0
    assert d.without_leaks(frame, spark.createDataFrame([], BENCHMARK)).count() == 20


def test_latent_space_keeps_inner_products(spark):
    """With fewer passages than dimensions the space holds all of them."""
    _, items, _ = corpus()
    texts = spark.createDataFrame(items, BENCHMARK)
    idf = np.linspace(1, 3, d._BUCKETS)
    space = d.latent_space(texts, idf).collect()
    place = {r.feature: np.array(r.vector) for r in space}
    found = d.plain_words(texts.toArrow().column("text").combine_chunks())
    vectors = [dict(zip(f.view(np.int64).tolist(), x)) for f, x in d._vectors(found, idf)]
    latent = [sum(x * place[f] for f, x in v.items()) for v in vectors]
    for a, p in zip(vectors, latent):
        for b, q in zip(vectors, latent):
            assert abs(sum(x * b.get(f, 0) for f, x in a.items()) - p @ q) < 1e-6
