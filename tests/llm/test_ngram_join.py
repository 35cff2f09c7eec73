"""The n-gram join against comparing every pair, and its defined edge cases."""

import random
import re

import numpy as np

from gridloom.llm import ngram_join
from gridloom.llm.components import components
from gridloom.llm.ngram_join import bitmap, one_of_each_group, shared_at_most, similar_documents
from gridloom.llm.text import mix

SCHEMA = "doc_id long, text string"


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall("[^\x20\x09-\x0D]+", text)
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def brute_force(docs):
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i, _ in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if i < j and both and 100 * both >= 80 * either:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {(i, len(sets[i]), root(i)) for i in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"common{i}" for i in range(30)]
    docs = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))]
        if family % 3 == 0:
            base = passage + base[:12]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += [docs[0]] * 3 + [docs[3].upper(), "one two", "ONE\ttwo", "one  two three", "É a b c d e", "é a b c d e"]
    docs += ["", "   ", None, "x" * 100_000, " ".join(f"long{i}" for i in range(20_000))]
    return list(enumerate(docs, start=7))


def test_matches_brute_force(spark, rows):
    a = [f"a{i}" for i in range(22)]
    docs = corpus()
    # At the limit: 18 of 20 shingles, then 14 of 18, then 16 of 22.
    more = [a, [*a, "x", "y"], a[:18], a[:20] + ["z"] * 6]
    docs += list(enumerate([" ".join(m) for m in more], start=1000))
    # A NULL id takes no part; rows that repeat an id are documents of their own.
    text = docs[0][1]
    odd = [(None, text), (2000, text + " "), (2000, text + " "), (2001, "first of two with this id here"), (2001, text)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs + odd], f"{SCHEMA}, digest long").repartition(5)
    found = similar_documents(frame)
    got = rows(found, "doc_id", "n_shingles", "component_id")
    least = docs[0][0]
    n = len(shingles(text))
    extra = [(None, n, None), (2000, n, least), (2000, n, least), (2001, 3, 2001), (2001, n, least)]
    assert sorted(got, key=str) == sorted([*brute_force(docs), *extra], key=str)

    kept = one_of_each_group(frame)
    assert kept.columns == frame.columns
    expected = {c for _, _, c in brute_force(docs)} | {None, 2001}
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == expected and len(ids) == len(expected)
    assert [r.text for r in kept.collect() if r.doc_id == 2001] == [odd[3][1]]


def test_families_of_many_groups(spark, rows, monkeypatch):
    """Large families, with links between their groups only through some of the sets."""
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 3)
    monkeypatch.setattr(ngram_join, "SHARED_KEYS", 3)  # so that leaders miss links
    rng = random.Random(5)
    docs = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(60)] + [f"shared{i}" for i in range(25)]
        for _ in range(25):
            base[rng.randrange(len(base))] = f"new{rng.randrange(10**6)}"
            docs.append(" ".join(base))
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    got = rows(similar_documents(spark.createDataFrame(docs, SCHEMA)), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == sorted(brute_force(docs))


def test_sets_that_are_alike_meet_as_groups(spark, rows, monkeypatch):
    """Copies with too many changes for most links must not be joined two by two."""
    candidates, most = ngram_join._candidates, []

    def counted(cells, *others):
        most.append(cells.groupBy("token").count().agg({"count": "max"}).first()[0])
        return candidates(cells, *others)

    monkeypatch.setattr(ngram_join, "_candidates", counted)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(220):
        copy = list(base)
        for _ in range(rng.randint(3, 7)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    got = rows(similar_documents(spark.createDataFrame(docs, SCHEMA)), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == sorted(brute_force(docs))
    assert most[0] < 60


def test_bitmaps_never_bound_too_low():
    rng = np.random.default_rng(3)
    pool = mix(np.arange(1, 4000, dtype=np.uint64))
    sets = [rng.choice(pool[: 30 * n], n, replace=False) for n in (1, 2, 5, 31, 32, 33, 60, 100, 130)] * 3
    for a in sets:
        sizes = np.array([len(b) for b in sets])
        bound = shared_at_most(len(a), bitmap(a), sizes, [bitmap(b) for b in sets])
        common = np.array([len(np.intersect1d(a, b)) for b in sets])
        assert (bound >= common).all() and (bound <= np.minimum(sizes, len(a))).all()
    a, b = pool[:1000], np.concatenate((pool[:500], pool[1000:1500]))
    assert shared_at_most(1000, bitmap(a), np.array([1000]), [bitmap(b)])[0] < 750


def test_columns_of_any_name_stay(spark):
    text = "one two three four five six seven eight"
    names = ["_hash", "stays", "_id", "_text", "_word", "_bit", "_bits", "row", "many", "first"]
    schema = ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]])
    docs = [(i, t, *[f"{n}{i}" for n in names]) for i, t in ((1, text), (2, text), (3, "other words here"), (None, text))]
    docs.append(docs[0])
    kept = one_of_each_group(spark.createDataFrame(docs, schema))
    assert kept.columns == ["doc_id", "text", *names]
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([docs[0], docs[2], docs[3]], key=str)


def test_empty_table(spark):
    assert similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark, rows):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, j) for j in range(101, 140)] + [(5, 5), (139, 90)]
    found = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(found[i] == 10 for i in range(10, 41)) and all(found[i] == 90 for i in range(100, 140))
    assert 5 not in found
