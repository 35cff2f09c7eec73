"""Segments against trying every range, and the classifier on text it has not seen."""

import random

import numpy as np

from gridloom.llm import toxicity

SCHEMA = "doc_id long, text string, score string"


def plain_segments(scores):
    """Maximal segments by their definition: the best range, then left and right of it."""
    best = max(
        ((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)),
        default=(0, 0, 0),
    )
    if best[0] <= 1e-9:
        return []
    a = -best[2]
    b = a - best[1]
    left = [(x, y, s) for x, y, s in plain_segments(scores[:a])]
    return left + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in plain_segments(scores[b:])]


def test_segments_are_maximal():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 14)
        at = sorted(rng.sample(range(n), rng.randint(0, n)))
        odds = [rng.choice([0.7, 1.3, 2.1, -1.7, -0.3]) + rng.random() for _ in at]
        scores = [toxicity.DRIFT] * n
        for i, s in zip(at, odds):
            scores[i] = s
        got = toxicity.segments(np.array(at, np.int64), np.array(odds))
        want = plain_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want], (scores, got, want)
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def corpus():
    rng = random.Random(9)
    clean = ["".join(rng.choices("abdeginorst", k=rng.randint(2, 9))) for _ in range(300)]
    bad = ["zorkest", "blargy", "blargum", "plonko"]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = rng.choices(clean, k=rng.randint(20, 200))
        for _ in range(rng.randint(2, 5) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice([".", "", "!"]))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "...", "x"), (None, "blargy zorkest", "x"), (0, docs[0][1], "x")]
    labels += [(0, 1), (2, None), (None, 1), (3, 7), (77777, 1)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, marks, ~toxicity.held_out())
    scored = toxicity.score(frame, model).withColumn("held_out", toxicity.held_out())
    rows = scored.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    truth = {i: i % 4 == 0 for i in range(600)}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held) > 0.97
    odd = {r.doc_id: r for r in rows if r.doc_id not in truth}
    assert all(odd[i].score < 0.5 and not odd[i].toxic_words for i in (1000, 1001, 1002))
    assert odd[None].score >= 0.5
    for r in rows:
        assert all(0 <= p.start < p.end and p.expected <= toxicity.SIGNIFICANT for p in r.toxic_words)


def test_without_labels_or_rows(spark):
    docs, _ = corpus()
    frame = spark.createDataFrame(docs[:20], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in toxicity.score(frame, toxicity.fit(frame, none)).collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


def test_ids_of_any_type(spark):
    docs, labels = corpus()
    frame, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = []
    for kind in ("long", "int", "string"):
        mine, theirs = (f.withColumn("doc_id", f.doc_id.cast(kind)) for f in (frame, marks))
        found = toxicity.score(mine, toxicity.fit(mine, theirs, ~toxicity.held_out()))
        assert dict(found.dtypes)["doc_id"] == mine.schema["doc_id"].dataType.simpleString()
        scores.append({str(r.doc_id): r.score for r in found.collect()})
    # The samples are the same up to the order of rows; an id's type changes no verdict.
    verdicts = [{i: s >= 0.5 for i, s in found.items()} for found in scores]
    assert verdicts[0] == verdicts[1] and scores[2].keys() == scores[0].keys()
