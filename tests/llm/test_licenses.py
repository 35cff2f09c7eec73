"""License notices against aligning every template everywhere."""

import random
import re

import pyarrow as pa

from gridloom.llm import licenses
from gridloom.llm.text import plain_words

SCHEMA = "doc_id long, text string, license string"
TEMPLATE_NAMES = [name for name, texts in licenses.TEMPLATES.items() for _ in texts]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def notices(text):
    """Names of the templates of which MIN_COVERAGE lies within some stretch of their length."""
    found, mine = set(), words(text)
    for name, texts in licenses.TEMPLATES.items():
        for template in map(words, texts):
            if len(set(template) & set(mine)) < licenses.MIN_COVERAGE * len(set(template)) / 2:
                continue  # cannot reach it; saves most of the time
            size = len(template) + licenses.BAND
            best = max((lcs(template, mine[i : i + size]) for i in range(max(1, len(mine)))), default=0)
            if best >= licenses.MIN_COVERAGE * len(template):
                found.add(name)
    return found


def corpus():
    rng = random.Random(6)
    vocabulary = "the license of under and stone version wind work any sea term".split()
    docs = []
    for i, text in enumerate(t for texts in licenses.TEMPLATES.values() for t in texts):
        before = rng.choices(vocabulary, k=rng.randint(0, 30))
        docs.append((i, " ".join([*before, text, *before]), "x"))
        changed = text.split()
        if len(changed) > 9:
            changed[4] = "changed"
            del changed[7]
        docs.append((100 + i, " ".join([*before, "\n".join(changed).upper()]), "x"))
    docs += [(200 + i, " ".join(rng.choices(vocabulary, k=60)), "x") for i in range(20)]
    return [*docs, (300, None, "x"), (301, "", "x"), (None, "Released under the MIT License.", "x"), (302, "MIT", "x")]


def test_matches_brute_force(spark):
    docs = corpus()
    found = licenses.find_licenses(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    for i, text, _ in docs:
        got = {r.license for r in found if r.doc_id == i}
        # Where two templates fit the same place, only the better one is reported, and one that
        # lacks its telling words is not.
        assert got <= notices(text), (i, text, got)
        if i is not None and i < 100:
            assert TEMPLATE_NAMES[i] in got, (i, text, got)
    unrelated = {r.doc_id for r in found if r.doc_id is not None and r.doc_id >= 200}
    assert not unrelated
    # Most notices with a word changed and one left out are still found.
    changed = {r.doc_id - 100 for r in found if r.doc_id and 100 <= r.doc_id < 200}
    assert len(changed) >= 0.8 * len(TEMPLATE_NAMES)
    for r in found:
        text = next(t for i, t, _ in docs if i == r.doc_id)
        assert words(r.excerpt) == words(text)[r.start : r.end] and r.coverage >= licenses.MIN_COVERAGE


def test_best_template_wins(spark, rows):
    text = "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."
    found = licenses.find_licenses(spark.createDataFrame([(1, text, ""), (1, text, "")], SCHEMA))
    assert rows(found, "license", "coverage") == [("CC-BY-NC-4.0", 1.0)] * 2 + [("GPL-3.0-only", 1.0)] * 2


def test_similar_licenses_are_told_apart(spark):
    """Every text, alone and with words around and a few changed, is its own license."""
    filler = "words that come before it and go on after".split()
    docs, want = [], {}
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            if text == licenses._MIT or text == licenses._BSD:
                continue  # openings that several licenses share
            want[len(docs)] = name
            docs.append((len(docs), " ".join([*filler, text, *filler]), ""))
    found = licenses.find_licenses(spark.createDataFrame(docs, SCHEMA)).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).add(r.license)
    assert {i: {name} for i, name in want.items()} == got
    header = (
        "This program is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version."
    )
    assert names(spark, header) == ["GPL-2.0-or-later"]
    assert names(spark, header.replace("version 2", "version 3")) == ["GPL-3.0-or-later"]
    assert names(spark, header.replace("GNU General", "GNU Lesser General").replace("version 2", "version 3")) == ["LGPL-3.0-or-later"]
    assert names(spark, header.replace("GNU General", "GNU Affero General").replace("version 2", "version 3")) == ["AGPL-3.0-or-later"]
    # A version nobody has listed is none of them.
    assert names(spark, header.replace("version 2", "version 7")) == []
    three = licenses.TEMPLATES["BSD-3-Clause"][2]
    assert names(spark, three.replace("the copyright holder", "Acme Corporation")) == ["BSD-3-Clause"]
    assert names(spark, three.split("3. Neither")[0]) == ["BSD-2-Clause"]


def names(spark, text):
    return [r.license for r in licenses.find_licenses(spark.createDataFrame([(1, text, "")], SCHEMA)).collect()]


def test_empty_table(spark):
    assert licenses.find_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_runs_share_a_fingerprint():
    rng = random.Random(1)
    run = [f"r{i}" for i in range(licenses.TRIPLE + licenses.WINDOW - 1)]
    for _ in range(50):
        texts = [" ".join(rng.choices("abcdef", k=rng.randint(0, 9)) + run + rng.choices("abcdef", k=5)) for _ in range(2)]
        found = plain_words(pa.array(texts))
        at, grams = licenses.fingerprints(found.hashes(), found)
        doc = found.doc[at]
        assert set(grams[doc == 0]) & set(grams[doc == 1])
