"""Token ids of many texts with a byte-level BPE tokenizer file.

The tokenizer never joins what stands before white space to what follows, nor letters to ASCII
punctuation after them, and how it treats a run of white space depends only on what comes next. So
a text can be cut before each ASCII blank that follows a visible character and between a letter
and punctuation, and its ids are those of the chunks in a row. Equal chunks of a batch are encoded
once, and a Python worker remembers a bounded number of them. Tests hold the result against
encoding whole texts.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from gridloom.llm.text import _BLANK, buffers

KNOWN_CHUNKS = 400_000  # chunks a worker remembers; past that it starts afresh

_AT_ONCE = 256  # chunks encoded in one string, a line each

_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
# Not the apostrophe, which may begin 's or 'll, and not the sign inside the end mark.
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in '!"#$%&()*+,-./:;<=>?@[\\]^_`{}~']] = True
# Of what is not ASCII, accented Latin letters (lead byte C3).
_PLAIN = re.compile(rb" ?(?:[^\s\x1c-\x1f\x80-\xff]|\xc3[\x80-\xbf])+").fullmatch


class ByteEncoder:
    """Encodes with the tokenizer in the file ``path``; make one with ``byte_encoder``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.line_end = self._ids(["\n"])[0].tolist()
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        for mark in self.specials:
            if len(self.chunks(np.frombuffer(mark, np.uint8), np.array([0, len(mark)]))) > 1:
                raise ValueError(f"texts cannot be cut around the mark {mark!r}")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def chunks(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where chunks start; a text without bytes has none."""
        opens = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            # Accented Latin letters (lead byte C3) are visible as well.
            visible = _VISIBLE[data[:-1]]
            visible[1:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80)
            opens[1:-1] = visible & _BLANK[data[1:]] | _LETTER[data[:-1]] & _SIGN[data[1:]]
        opens[at] = True
        return np.flatnonzero(opens[:-1])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def learn(self, chunks: list[bytes]) -> None:
        """Encode chunks; those of visible ASCII and accented letters after at most one blank share
        strings, as lines."""
        joined = b"\n".join(chunks)
        marks = [m for m in self.specials if m in joined]
        plain, others = [], []
        for c in chunks:
            (plain if _PLAIN(c) and not (marks and any(m in c for m in marks)) else others).append(c)
        shared = self._ids([b"\n".join(plain[i : i + _AT_ONCE] + [b""]).decode() for i in range(0, len(plain), _AT_ONCE)])
        ids = np.concatenate(shared) if shared else np.zeros(0, np.uint32)
        ends = np.flatnonzero(ids == self.line_end[0])
        if len(self.line_end) != 1 or len(ends) != len(plain):
            raise ValueError("the tokenizer does not keep lines apart")
        starts = np.append(0, ends[:-1] + 1)[: len(ends)]
        own = self._ids([c.decode("utf-8", "replace") for c in others])
        size = np.array([len(x) for x in own], np.int64)
        self.known.update(zip([*plain, *others], range(len(self.size), len(self.size) + len(chunks))))
        first = len(self.pool) + len(ids) + np.cumsum(size) - size
        self.start = np.concatenate([self.start, starts + len(self.pool), first])
        self.size = np.concatenate([self.size, ends - starts, size])
        self.pool = np.concatenate([self.pool, ids, *own])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of the texts; NULL counts as empty."""
        data, at = buffers(texts)
        start = self.chunks(data, at)
        offsets = np.append(start, len(data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        chunks = chunks.dictionary_encode()
        spelled = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [c for c in spelled if c not in self.known]
        if len(self.known) + len(new) > KNOWN_CHUNKS:
            self.forget()
            new = spelled
        if new:
            self.learn(new)
        entry = np.fromiter(map(self.known.__getitem__, spelled), np.int64, len(spelled))
        entry = entry[chunks.indices.to_numpy(zero_copy_only=False)]
        size = self.size[entry]
        upto = np.append(0, np.cumsum(size))
        place = np.repeat(self.start[entry] - upto[:-1], size) + np.arange(upto[-1])
        return self.pool[place], upto[np.searchsorted(start, at)]


_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]
