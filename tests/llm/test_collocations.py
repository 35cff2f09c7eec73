"""Collocations against counting everything."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, phrase string, count int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(docs, least, top):
    f, n = {}, {}
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] = n.get(lang, 0) + len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    f[key] = f.get(key, 0) + 1
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    dropped = set()
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inner = lang, words[i : i + size]
                if 100 * a >= 80 * f[inner]:
                    dropped.add(inner)
    out = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in dropped:
            cuts = [(f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
            score, _, l, r = min((2000000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    rows = []
    for lang, many in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(many)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(rows, key=repr)


def corpus(seed, size=400):
    rng = random.Random(seed)
    common = ["The", "of", "stone", "É", "É́x", "日本", "#a", "x9"]
    rare = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(size):
        words = rng.choices(common + rare, [20] * len(common) + [1] * len(rare), k=rng.randint(0, 250))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice([["new", "york", "stock", "exchange"], ["new", "york"], ["stock", "exchange"]])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]) for w in words)
        docs.append((i, text, rng.choice(["en", "en", "en", "", None, "de"]), "x", i))
    # A third of all rows repeat one text; some have none.
    docs += [(1000 + i, "Again the same old line\r\nof the same old page", "en", None, None) for i in range(size // 2)]
    return docs + [(None, None, None, None, None), (5000, "", "fr", "", 0), (5001, " . ,", "fr", "", 0), (5002, "a b", "en", "", 0)]


@pytest.mark.parametrize("crowd, suffixes, top", [(None, 1_000_000, 2000), (40, 2000, 25), (0, 300, 2000)])
def test_matches_brute_force(spark, rows, monkeypatch, crowd, suffixes, top):
    monkeypatch.setattr(c, "PART_SUFFIXES", suffixes)
    monkeypatch.setattr(c, "SLICE", 5000)
    docs = corpus(top)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    expected = brute_force(docs, 30, top)
    assert len(expected) > 50
    assert rows(c.collocations(frame, top=top, crowd=crowd)) == expected


def test_empty_and_long(spark, rows):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = [(1, "tick tock " * 30_000, "en", "", 0), (2, "a" * 200_000, "en", "", 0)]
    assert rows(c.collocations(spark.createDataFrame(docs, SCHEMA))) == brute_force(docs, 30, 2000)


def test_quicksort_finds_every_equal_partition():
    rng = np.random.default_rng(2)
    for least in (1, 5):
        keys = rng.integers(0, 6, (4, 800)).astype(np.int32)
        keys[2:, keys[2] == 0] = -1
        keys[3, keys[3] == 1] = -1
        weights, whole = rng.integers(1, 4, 800), np.ones(800, np.int8)
        got = {}
        for depth, pointers, sizes in c.equal_partitions(keys, weights, whole, least):
            for p, size in zip(pointers, sizes):
                assert got.setdefault((depth, *keys[: depth + 1, p].tolist()), size) is size
        want = {}
        for d in range(4):
            for p in range(800):
                key = (d, *keys[: d + 1, p].tolist())
                if key[-1] >= 0:
                    want[key] = want.get(key, 0) + weights[p]
        # A partition below the least is abandoned where it is whole, from depth 1 on.
        assert {k: v for k, v in got.items() if v >= least} == {k: v for k, v in want.items() if v >= least}
        assert all(v >= least for k, v in got.items() if k[0] >= 1)


def test_blocks_travel_compressed():
    text = " ".join(f"w{i % 50} x{i % 7}" for i in range(5000))
    s = c.read_slice(pa.array([text]), pa.array(["en"]))
    every = np.full((2, c._SLOTS), -1, np.int64).view(np.uint64)
    every[1] = 0
    block = c.blocks(s, every, None, 1)
    assert len(block.column("data")[0].as_py()) < block.column("size")[0].as_py() / 2
    numbers, _ = c.read_blocks(pa.Table.from_batches([block]), 4)
    assert numbers[:, 2].sum() == 9999 and len(numbers) == len(np.unique(numbers[:, :2], axis=0))
