"""The language model against one written with dictionaries, and the classifier as a whole."""

import math
import random
from collections import Counter, defaultdict

from gridloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, bytes int"


def byte_text(text):
    out = bytearray()
    for i, b in enumerate((text or "").encode()):
        blank = b in b" \t\n\r\x0b\x0c"
        if not (blank and i and last):
            out.append(32 if blank else b)
        last = blank
    return bytes(out)


def grams(text):
    padded = b"\n" * (quality.ORDER - 1) + byte_text(text)
    return [padded[i : i + quality.ORDER] for i in range(len(padded) - quality.ORDER + 1)]


def brute_force(trusted):
    """p(gram) by interpolated modified Kneser-Ney."""
    counts = {quality.ORDER: Counter(g for t in trusted for g in grams(t))}
    for n in range(quality.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts, totals, spare = {}, {}, {}
    for n, seen in counts.items():
        of = Counter(seen.values())
        cuts[n] = quality._discounts(tuple(of.get(k, 0) for k in (1, 2, 3, 4)))
        totals[n], spare[n] = defaultdict(int), defaultdict(float)
        for g, c in seen.items():
            totals[n][g[:-1]] += c
            spare[n][g[:-1]] += cuts[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        total = totals[n].get(g[:-1])
        if not total:
            return p(g[1:])
        c = counts[n].get(g, 0)
        direct = (c - cuts[n][min(c, 3) - 1]) / total if c else 0.0
        return direct + spare[n][g[:-1]] / total * p(g[1:])

    return p


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abdeginorst", k=rng.randint(2, 8))) for _ in range(60)]
    good = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(20, 60))), "en" if i % 3 else "fr", 1) for i in range(120)]
    junk = [(500 + i, "".join(rng.choices("XQ#%&*19 \t", k=150)), "en", 1) for i in range(15)]
    odd = [(900, None, "en", 1), (901, "", "en", 1), (902, good[4][1], None, 1), (None, good[5][1], "xx", 1)]
    return good, junk, [*odd, good[7], (903, " é\n\n\tü ", "en", 1)]


def test_perplexity_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "SHARD_ROWS", 300)  # several shards
    good, junk, odd = corpus()
    trusted = [t for _, t, *_ in good[:40]]
    model = quality.fit(spark.createDataFrame(good[:40], SCHEMA).repartition(3))
    docs = good[30:60] + junk + odd
    found = quality.perplexity(spark.createDataFrame(docs, SCHEMA).repartition(2), model).collect()
    assert len(found) == len(docs)
    p = brute_force(trusted)
    assert abs(sum(p(b"ab" + bytes([c])) for c in range(256)) - 1) < 1e-9
    for i, text, lang, _ in docs:
        mine = [r for r in found if r.doc_id == i]
        logs = [math.log(p(g)) for g in grams(text)]
        for r in mine:
            assert r.bytes == len(logs) and r.lang == lang
            want = math.exp(-sum(logs) / len(logs)) if logs else None
            assert r.perplexity == want if want is None else abs(r.perplexity / want - 1) < 1e-9


def test_classifier_keeps_clean_text(spark):
    good, junk, odd = corpus()
    frame = spark.createDataFrame(good + junk + odd, SCHEMA)
    trusted = spark.createDataFrame([(i,) for i, *_ in good[:80]] + [(None,), (4,)], "doc_id long")
    found = {r.doc_id: r for r in quality.classify(frame, trusted).collect()}
    assert not any(found[i].keep for i, *_ in junk)
    assert sum(found[i].keep for i, *_ in good) >= 118
    assert found[902].keep and found[None].keep and found[None].limit
    assert not found[900].keep and found[900].perplexity is None and not found[901].keep


def test_without_trusted_text_or_rows(spark):
    good, *_ = corpus()
    none = spark.createDataFrame([], "doc_id long")
    found = quality.classify(spark.createDataFrame(good[:5], SCHEMA), none).collect()
    assert len(found) == 5 and all(r.keep and abs(r.perplexity - 256) < 1e-6 for r in found)
    assert quality.classify(spark.createDataFrame([], SCHEMA), none).count() == 0
