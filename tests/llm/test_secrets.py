"""Secrets: planted ones are found and blacked out, harmless text stays."""

import random
import re

import numpy as np
import pyarrow as pa

from gridloom.llm import secrets
from gridloom.llm.forest import Forest

SCHEMA = "doc_id long, text string, n_chars long, score int"


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abdeginorst", k=rng.randint(2, 9))) for _ in range(300)]
    upper, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
    docs, planted = [], {}
    for i in range(300):
        text = rng.choices(words, k=rng.randint(5, 120))
        value, put = "", None
        kind = i % 6
        if kind == 0:
            put = value = "AKIA" + "".join(rng.choices(upper, k=15)) + "7"
        elif kind == 1:
            value = "a1" + "".join(rng.choices(hexa, k=16))
            put = f"password={value}"
        elif kind == 2:
            value = "b2" + "".join(rng.choices(hexa, k=38))
            put = f'é token = "{value}"'
        elif kind == 3:
            put = rng.choice(["a.b42@mail8.example.com", "42.144.35.254", "https://example.com/a/1234567", "+1 (988) 555-2485"])
        if put:
            text.insert(rng.randrange(len(text)), put)
        docs.append((i, " ".join(text), 0, 1))
        if value:
            planted[i] = value
    return docs, planted


def test_planted_secrets(spark):
    docs, planted = corpus()
    odd = [(1000, None, 0, 1), (1001, "", 0, 1), (None, docs[0][1], 0, 1), (0, docs[0][1], 0, 1), (1002, "x" * 200_000, 0, 1)]
    frame = spark.createDataFrame(docs + odd, SCHEMA).repartition(3)
    usual = secrets.usage(frame)
    forest = secrets.train(secrets.labelled_findings(frame, usual))
    found = [r for r in secrets.find_secrets(frame, usual, forest).collect() if r.is_secret]
    got = {}
    texts = {i: t for i, t, *_ in docs}
    for r in found:
        if r.doc_id in texts:
            got.setdefault(r.doc_id, set()).add(texts[r.doc_id].encode()[r.start : r.end].decode())
    assert got == {i: {v} for i, v in planted.items()}
    assert sum(r.doc_id == 0 for r in found) == 2 and sum(r.doc_id is None for r in found) == 1

    clean = secrets.redact(frame, usual, forest)
    assert clean.columns == frame.columns
    after = {r.doc_id: r for r in clean.collect()}
    assert len(after) == len(docs) + 4
    for i, text in texts.items():
        want = text.replace(planted[i], "[REDACTED]") if i in planted else text
        assert after[i].text == want
        assert after[i].n_chars == (len(want) if i in planted else 0)
    assert after[1000].text is None and after[1001].text == "" and after[1002].text == "x" * 200_000


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    usual = secrets.usage(frame)
    forest = secrets.train(secrets.labelled_findings(frame, usual))
    assert secrets.find_secrets(frame, usual, forest).count() == 0
    assert secrets.redact(frame, usual, forest).count() == 0


def test_forest_learns_a_rule_it_is_not_told():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 0] > 0.2) & (x[:, 3] < 0.5)) | (x[:, 5] > 1.5)
    forest = Forest(x[:1000], y[:1000])
    assert ((forest.predict(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.93
    assert (Forest(x[:3], np.zeros(3)).predict(x) == 0).all() and len(Forest(x[:0], y[:0]).predict(x[:2])) == 2


def test_every_run_of_a_word_is_a_candidate():
    def parts(word, begins=False):
        return [word[a:b] for a, b, _ in secrets.spans(word, begins)]

    one, two = "a1b2c3d4e5f6a7b8", "Zk83hQpLm20xVn5T"
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    assert {one, two} <= set(parts(f"https://h.example/x?a={one}&token={two}"))
    assert {one, two} <= set(parts(f'{{"id":"{one}","n":[1,"{two}"]}}'))
    assert parts(f"{one},{two}") == [one, two] and parts(f'"{jwt}",{one}') == [jwt, one]
    assert parts("password=correcthorse") == ["correcthorse"] and parts('"correct!h0rse"', True) == ["correct!h0rse"]
    assert parts("QUJDREVGR0g=") == ["QUJDREVGR0g="]


def findings(texts):
    """Texts of the candidates of each text."""
    usual = secrets.Usage(np.zeros((40, 40)), np.zeros(secrets._WORD_BUCKETS, bool))
    piece = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    raw, _ = secrets._raw(piece)
    out = [set() for _ in texts]
    for row, a, b, *_ in secrets._findings(piece, usual):
        out[row].add(raw[a:b].decode())
    return out


def test_candidates_beside_other_scripts_and_names():
    key = "Zk83hQpLm20xVn5T"
    texts = [f"x \u201c{key}\u201d", f"password\uff1a{key} y", f"caf\u00e9{key}", f"\u5bc6\u94a5\u662f{key}\u3002\u7136\u540e{key[::-1]}\uff0c\u597d"]
    texts += ["password=correcthorse", "the password : horses", "token: horses", "password\uff1d\u201chorses\u201d", "\u5bc6ABCDEFGHIJKLMNOPQRST\u94a5"]
    texts += ["Authorization: Bearer horses", "no candidate here", "token:", "horses"]
    got = findings(texts)
    assert got[:4] == [{key}, {key}, {key}, {key, key[::-1]}]
    assert all({"horses"} <= got[i] for i in (5, 6, 7, 9)) and got[4] == {"correcthorse"}
    assert got[8] == {"ABCDEFGHIJKLMNOPQRST"} and got[10:] == [set(), set(), set()]


def test_two_secrets_of_a_word_are_redacted(spark):
    docs, _ = corpus()
    frame = spark.createDataFrame(docs, SCHEMA)
    usual = secrets.usage(frame)
    forest = secrets.train(secrets.labelled_findings(frame, usual))
    one, two = "AKIA" + "QWERTZUIOPASDFG7", "b2" + "0123456789abcdef" * 2 + "012345"
    odd = [(1, f'{{"key":"{one}","token":"{two}"}}', 0, 1), (2, f"\u5bc6\u94a5\u201c{one}\u201d\u548ctoken\uff1a{two}\u3002", 0, 1)]
    after = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(odd, SCHEMA), usual, forest).collect()}
    assert after[1] == '{"key":"[REDACTED]","token":"[REDACTED]"}'
    assert after[2] == "\u5bc6\u94a5\u201c[REDACTED]\u201d\u548ctoken\uff1a[REDACTED]\u3002"


def test_a_name_is_no_secret(spark):
    """One name beside very many values stays as it is."""
    rng = random.Random(12)
    words = "the water was cold and many stones lay along the road to town".split()
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(words, k=60))
        docs.append((i, f"{text} password={rng.randbytes(9).hex()} {text}" if i % 3 == 0 else text))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    usual = secrets.usage(frame)
    forest = secrets.train(secrets.labelled_findings(frame, usual))
    for r in secrets.redact(frame, usual, forest).collect():
        assert r.text == re.sub("(?<=password=)[0-9a-f]{18}", "[REDACTED]", docs[r.doc_id][1])
