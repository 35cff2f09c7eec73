"""Words and word sequences of many texts as numpy arrays of 64-bit hashes.

Everything here works on the buffers of one Arrow batch inside a task. A word is a maximal
run of bytes other than blank and the control characters 9 to 13; A-Z count as a-z. Words
are compared by 64-bit hashes: two different words agree with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # texts are worked on in slices of about this size, to bound memory

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD6E8FEB86659FD93)

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly over 64 bits, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


# Letters only: ASCII punctuation and digits separate words as well; other bytes are letters.
_NOT_LETTER = _BLANK.copy()
_NOT_LETTER[:128] = True
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = False
# Letters and digits: ASCII punctuation separates words as well.
_NOT_WORD = _NOT_LETTER.copy()
_NOT_WORD[48:58] = False

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)[_LOWER]


def _powers(count: int) -> np.ndarray:
    powers = np.full(max(count, 1), _STEP, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


@dataclass
class Words:
    """The words of a slice of texts; ``doc`` is the row of the slice a word is in."""

    data: np.ndarray  # bytes of all texts
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    count: np.ndarray  # words of each text
    first: np.ndarray  # index of each text's first word; one more entry at the end
    gap: np.ndarray  # whether a byte belongs to no word

    def hashes(self) -> np.ndarray:
        """A hash of each word, from a polynomial over its bytes."""
        return self.prefix_hashes([])[0]

    def prefix_hashes(self, sizes: list[int]) -> list[np.ndarray]:
        """The words' hashes, then those of their first bytes for each of the given sizes."""
        if not len(self.start):
            return [np.zeros(0, np.uint64)] * (1 + len(sizes))
        within = np.arange(len(self.data), dtype=np.int64)
        size = np.diff(np.append(self.start, len(self.data)))
        within[self.start[0] :] -= np.repeat(self.start, size)
        within[: self.start[0]] = 0
        within[self.gap] = 0
        term = _BYTE[self.data]
        term[self.gap] = 0
        term *= _powers(int(within.max()) + 1)[within]
        out = [mix(np.add.reduceat(term, self.start))]
        for size in sorted(sizes, reverse=True):
            term[within >= size] = 0
            out.insert(1, mix(np.add.reduceat(term, self.start)))
        return out

    def text(self, at: int) -> str:
        return self.data[self.start[at] : self.end[at]].tobytes().decode("utf-8", "replace")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts; NULL counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that a slice's texts hold about SLICE_BYTES (or one text)."""
    if not batch.num_rows:
        return
    _, at = buffers(batch.column(column))
    row = 0
    while row < batch.num_rows:
        upto = int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1
        upto = min(max(upto, row + 1), batch.num_rows)
        yield batch.slice(row, upto - row)
        row = upto


def split_words(data: np.ndarray, at: np.ndarray, separators: np.ndarray = _BLANK) -> Words:
    rows = len(at) - 1
    blank = separators[data]
    opens = ~blank
    closes = opens.copy()
    edge = at[(at > 0) & (at < len(data))]
    if len(data):
        before = np.empty_like(blank)
        before[0] = True
        before[1:] = blank[:-1]
        before[edge] = True
        opens &= before
        after = np.empty_like(blank)
        after[-1] = True
        after[:-1] = blank[1:]
        after[edge - 1] = True
        closes &= after
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    doc = np.searchsorted(at, start, "right") - 1
    count = np.bincount(doc, minlength=rows) if len(doc) else np.zeros(rows, np.int64)
    return Words(data, start, end, doc, count, np.concatenate(([0], np.cumsum(count))), blank)


def words(texts: pa.Array) -> Words:
    return split_words(*buffers(texts))


def _lower_latin(data: np.ndarray) -> np.ndarray:
    """Accented Latin capitals as small letters; A-Z count as a-z anyway."""
    high = np.flatnonzero(data[:-1] == 0xC3) + 1
    high = high[(data[high] >= 0x80) & (data[high] <= 0x9E) & (data[high] != 0x97)]
    if len(high):
        data = data.copy()
        data[high] += 32
    return data


def letter_words(texts: pa.Array) -> Words:
    """Words of letters."""
    data, at = buffers(texts)
    return split_words(_lower_latin(data), at, _NOT_LETTER)


def sequences(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive values; the caller drops those across two texts."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:count].copy()
    for k in range(1, size):
        total *= _BASE
        total += hashes[k : k + count]
    return mix(total)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct ``size``-word sequences, as sorted hashes.

    A shorter text has its whole word sequence as the one element; a text without words has
    the empty set.
    """
    found = words(texts)
    hashes = found.hashes()
    grams = sequences(hashes, size)
    out = []
    for row in range(len(found.count)):
        a, n = int(found.first[row]), int(found.count[row])
        if n >= size:
            out.append(np.unique(grams[a : a + n - size + 1]))
        elif n:
            whole = _U(n)
            with np.errstate(over="ignore"):
                for h in hashes[a : a + n]:
                    whole = whole * _BASE + h
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def plain_words(texts: pa.Array) -> Words:
    """Words of letters and digits."""
    data, at = buffers(texts)
    return split_words(_lower_latin(data), at, _NOT_WORD)
