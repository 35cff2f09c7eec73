"""Packing: ids against the tokenizer itself, a round trip, and the mixture."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridloom.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, part int"
ODD = [
    "It's John's ''s !'s dog.cat 3a.b4 x'S", "<|endoftext|>Hi <|startoftext|>x", "<|ENDOFTEXT|> a.", None, "", "  \n\t",
    "éa, É. É!x “q”a.b…c", "a b c.\x0bd\x1ce", "'re're.'re", "Σας ΑΣ. don't'nt 12.5%",
    "x̸ ≠ .́a á.b", "日本語のテキスト。🙂", "İstanbul ǅ ß STRASSE", "a" * 5000, "\x00nul\x00",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_agrees_with_the_tokenizer(tokenizer, monkeypatch):
    rng = random.Random(4)
    alphabet = "abcXYZ éÉß'’.,!-_ 019\n\t<|>&"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 300)  # so that it forgets now and then
    encoder = tokens.Encoder(PATH)
    for part in (texts, texts[::-1], texts[:3]):
        found, at = encoder.encode(pa.array(part, pa.string()))
        for text, a, b in zip(part, at[:-1], at[1:]):
            assert found[a:b].tolist() == ids(tokenizer, text), repr(text)


def corpus():
    rng = random.Random(8)
    words = ["the", "of", "thing", "stone", "Énorme", "x9", "wind.", "(sea)"]
    docs = [(i, t, f"s{i % 2}", 1) for i, t in enumerate(ODD)]
    for i in range(100, 260):
        source = rng.choice(["big", "big", "small", None])
        docs.append((i, " ".join(rng.choices(words, k=rng.randint(1, 400))), source, 1))
    return [*docs, (None, "no id", "s0", 1), (500, "twice", "s1", 1), (500, "twice", "s1", 1)]


@pytest.mark.parametrize("part_bytes", [4 << 20, 20_000])
def test_round_trip(spark, tokenizer, monkeypatch, part_bytes):
    monkeypatch.setattr(packing, "PART_BYTES", part_bytes)
    docs = corpus()
    got = packing.pack(spark.createDataFrame(docs, SCHEMA).repartition(3), PATH).toPandas()
    whole = {(None if i is None else i, s): np.array([*ids(tokenizer, t), 1], "<u4") for i, t, s, _ in docs}
    copies = {}
    for i, _, s, _ in docs:
        copies[i, s] = copies.get((i, s), 0) + 1
    for (i, s), expected in whole.items():
        mine = got[(got.doc_id.isna() if i is None else got.doc_id == i) & (got.source.isna() if s is None else got.source == s)]
        assert mine.length.sum() == len(expected) * copies[i, s]
        assert (mine.doc_tokens == len(expected)).all()
        for p in mine.itertuples():
            assert zlib.crc32(expected[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        if copies[i, s] == 1:
            mine = mine.sort_values("start")
            assert mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]]
    for _, sequence in got.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum().tolist()[:-1]]
        total = int(sequence.length.sum())
        assert total == 2048 or (total < 2048 and total & (total - 1) == 0)  # no padding at all


def test_mixture_follows_the_targets():
    queues = packing.Queues({"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 0.0, "b": 0.0, "c": 0.0}, 2048)
    for row in range(3000):
        queues.add("abc"[row % 3], row, 100 + row % 50)
    windows = list(queues.windows())
    source = {row: "abc"[row % 3] for row in range(3000)}
    share = {s: sum(n for w in windows[:40] for r, _, n in w if source[r] == s) / (40 * 2048) for s in "abc"}
    assert all(abs(share[s] - w) < 0.01 for s, w in (("a", 0.7), ("b", 0.2), ("c", 0.1)))
    assert sum(n for w in windows for *_, n in w) == sum(100 + r % 50 for r in range(3000))


def test_owed_credit_comes_first():
    queues = packing.Queues({"a": 0.5, "b": 0.5}, {"a": 3000.0, "b": -3000.0}, 2048)
    for row in range(200):
        queues.add("ab"[row % 2], row, 100)
    assert all(row % 2 == 0 for row, *_ in next(queues.windows()))


def test_targets_and_empty(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    got = packing.pack(frame, PATH, targets={"big": 3, None: 1}, window=256).toPandas()
    first = got[(got.sequence_id < 20)]
    assert set(first.source.fillna("-")) <= {"big", "-"} and len(got.doc_id.dropna().unique()) == 176
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
