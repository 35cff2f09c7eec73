"""Best-fit packing: ids against the tokenizer, a round trip, and the search."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bestfit, bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, part int, length string, fill int"
ODD = [
    "It's John's ''s !'s dog.cat 3a.b4 x'S", "<|endoftext|>Hi <|endoftext|> x <|endoftext|>", " lead and trail \n", None, "",
    "  \n\t", "a\x0b b\x0c c\x1c d", "café au lait à la carte", "  nbsp 　 wide   x \u0085 y", "x̀ ≠ .́a",
    "日本語の テキスト。\U0001f642 ok", "tabs\t\ttabs  two   three    four\n\n\nlines\r\n", "\x00nul\x00 \x00", "a" * 5000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_accented_words_share_strings(tokenizer):
    encoder = bpe.ByteEncoder(PATH)
    strings = []
    real = encoder._ids
    encoder._ids = lambda texts: strings.extend(texts) or real(texts)
    text = " café àé ÿ über×÷ señor."
    found, _ = encoder.encode(pa.array([text]))
    assert found.tolist() == ids(tokenizer, text) and len(strings) == 1


def test_encoder_agrees_with_the_tokenizer(tokenizer, monkeypatch):
    rng = random.Random(4)
    alphabet = "abcXYZ éÉß’'.,!-_ 019\n\t<|>&   　"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    monkeypatch.setattr(bpe, "KNOWN_CHUNKS", 300)  # so that it forgets now and then
    encoder = bpe.ByteEncoder(PATH)
    for part in (texts, texts[::-1], texts[3:5], texts[:3], []):
        found, at = encoder.encode(pa.array(part, pa.string()))
        assert len(at) == len(part) + 1
        for text, a, b in zip(part, at[:-1], at[1:]):
            assert found[a:b].tolist() == ids(tokenizer, text), repr(text)


def corpus(count=300):
    rng = random.Random(8)
    words = ["the", "of", "thing", "stone", "Énorme", "x9", "wind.", "(sea)"]
    docs = [(i, t, "s", 1, "", 0) for i, t in enumerate(ODD)]
    docs += [(100 + i, " ".join(rng.choices(words, k=rng.choice([3, 40, 90, 700]))), "s", 1, None, None) for i in range(count)]
    docs += [(9000, "same again " * 9, None, 1, None, None)] * 60  # repeated rows
    return [*docs, (None, "no id", "s", 1, "", 0), (9001, "word " * 1023, "s", 1, "", 0), (9002, "word " * 4095, "s", 1, "", 0)]


@pytest.mark.parametrize("part_items, window", [(4096, 2048), (50, 256)])
def test_round_trip(spark, tokenizer, part_items, window):
    docs = corpus()
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = bestfit.pack_whole(frame, PATH, window=window, part_items=part_items).toPandas()
    whole, copies = {}, {}
    for i, text, *_ in docs:
        whole[i], copies[i] = np.array([*ids(tokenizer, text), 0], "<u4"), copies.get(i, 0) + 1
    lengths = []
    for i, expected in whole.items():
        mine = got[got.doc_id.isna() if i is None else got.doc_id == i]
        first = len(expected) % window or window
        cuts = [0, *range(first, len(expected), window)]
        want = [(n, a, min(window, first if not n else window, len(expected) - a)) for n, a in enumerate(cuts)]
        want = [(n, a, size, zlib.crc32(expected[a : a + size].tobytes())) for n, a, size in want] * copies[i]
        assert sorted(mine[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
        lengths += [size for _, _, size, _ in want]
    for _, sequence in got.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum().tolist()[:-1]]
        assert sequence.length.sum() <= window
    assert got.sequence_id.nunique() <= bestfit.least_windows(np.array(lengths), window) + 1


def test_empty(spark):
    got = bestfit.pack_whole(spark.createDataFrame([], SCHEMA), PATH)
    assert got.count() == 0
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def fewest(sizes, window):
    """The fewest windows, by trying every assignment."""
    best = len(sizes)

    def go(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(sizes):
            best = len(fills)
            return
        for b in range(len(fills)):
            if fills[b] + sizes[i] <= window:
                fills[b] += sizes[i]
                go(i + 1, fills)
                fills[b] -= sizes[i]
        go(i + 1, [*fills, sizes[i]])

    go(0, [])
    return best


def test_search_against_every_packing():
    rng = random.Random(1)
    over = 0
    for _ in range(150):
        window = rng.choice([10, 24, 60])
        sizes = np.array(sorted((rng.randint(1, window) for _ in range(rng.randint(1, 9))), reverse=True))
        place = bestfit.pack_sizes(sizes, window)
        assert np.bincount(place, sizes).max() <= window
        best = fewest(sizes.tolist(), window)
        assert bestfit.least_windows(sizes, window) <= best <= place.max() + 1
        over += place.max() + 1 - best
    assert over <= 2


def test_search_empties_windows():
    # One window for each piece to start from; pairs of 30, 35 and 40 tokens fill windows of 70 and 75.
    rng = np.random.default_rng(3)
    for window, lengths in ((100, [60, 50, 40, 30, 20]), (2048, [1500, 900, 700, 500, 333, 215, 90, 17, 1])):
        sizes = rng.choice(lengths, 300).astype(np.int64)
        search = bestfit.Search(sizes, np.arange(300), window)
        squares, swaps, swap = [], [], search.swap

        def watched(donor, given, other, taken):
            swap(donor, given, other, taken)
            squares.append(int((search.fill**2).sum()))
            swaps.append((len(given), len(taken)))

        search.swap = watched
        place = search.run()
        fill = np.bincount(place, sizes)
        assert fill.max() <= window and squares == sorted(set(squares))
        assert (fill > 0).sum() <= bestfit.least_windows(sizes, window) * 1.03
        assert {(1, 0), (1, 1)} <= set(swaps)


def test_two_for_one():
    sizes = np.array([70, 30, 26, 55, 40, 4])
    search = bestfit.Search(sizes, np.array([0, 1, 1, 2, 2, 2]), 100)
    search.sizes = sizes
    assert search.exchange(1)
    kept = [sorted(sizes[x].tolist()) for x in search.items]
    assert sorted(itertools.chain(*kept)) == sorted(sizes.tolist())


def test_given_windows_stay_when_best_fit_needs_more():
    sizes = np.array([4, 4, 3, 3, 3, 3, 2, 2])  # best fit packs these into windows of 8 as well as can be
    place = np.array([0, 1, 0, 1, 2, 2, 2, 3])
    assert bestfit.pack_sizes(sizes, 8, place).max() + 1 == 3
