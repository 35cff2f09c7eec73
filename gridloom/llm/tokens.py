"""Token ids of many texts with a given word-level tokenizer file.

The tokenizer lower-cases, drops white space and never joins letters with what stands beside
them, so a text can be cut at ASCII white space and between an ASCII letter and ASCII
punctuation, and its ids are those of the pieces in a row. Each piece is encoded once in a
Python worker and then looked up. Tests hold the result against encoding whole texts.
"""

from __future__ import annotations

import os
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from gridloom.llm.table import Table
from gridloom.llm.text import _BLANK, Words, buffers

KNOWN_PIECES = 400_000  # pieces a worker remembers; past that it starts afresh
_AT_ONCE = 256  # pieces encoded in one call, with the end mark between them

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:127] = True
_PUNCTUATION[48:58] = False
_PUNCTUATION &= ~_LETTER
_OPENS_LETTER = _PUNCTUATION.copy()
_OPENS_LETTER[ord("'")] = False  # 's, 't and so on are tokens of their own


class Encoder:
    """Encodes with the tokenizer in the file ``path``; make one with ``encoder``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        self.specials = [t.content.encode() for t in special.values()]
        self.mark, mark = max(special.items())
        self.mark_text = mark.content
        # Lower-case words of letters alone need neither clean-up nor the splitting pattern.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self, room: int = 0) -> None:
        self.known = Table(room=max(KNOWN_PIECES, room))
        self.start = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def pieces(self, data: np.ndarray, at: np.ndarray) -> Words:
        gap = _BLANK[data]
        opens = ~gap
        if len(data):
            before = np.empty_like(gap)
            before[0] = True
            letter, punctuation = _LETTER[data], _PUNCTUATION[data]
            before[1:] = (
                gap[:-1] | (letter[:-1] & punctuation[1:]) | (_OPENS_LETTER[data[:-1]] & letter[1:])
            )
            before[at[(at > 0) & (at < len(data))]] = True
            opens &= before
        start = np.flatnonzero(opens)
        stop = np.flatnonzero(~opens & gap | opens)  # where the piece before has ended
        after = np.searchsorted(stop, start, "right")
        end = np.append(stop, len(data))[after]
        doc = np.searchsorted(at, start, "right") - 1
        count = np.bincount(doc, minlength=len(at) - 1) if len(doc) else np.zeros(len(at) - 1, np.int64)
        return Words(data, start, end, doc, count, np.concatenate(([0], np.cumsum(count))), gap)

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        plain = np.array([t.isalpha() and t.islower() and is_normalized("NFC", t) for t in texts], bool)
        words = [texts[i] for i in np.flatnonzero(plain)]
        ids = self._ids(self.plain, " ", words)
        self._remember(hashes[plain], ids, np.flatnonzero(self.ends_word[ids]) + 1, 0)
        others = [texts[i] for i in np.flatnonzero(~plain)]
        ids = self._ids(self.tokenizer, self.mark_text, others)
        self._remember(hashes[~plain], ids, np.flatnonzero(ids == self.mark) + 1, 1)

    def _ids(self, tokenizer, between: str, texts: list[str]) -> np.ndarray:
        lines = [between.join(texts[i : i + _AT_ONCE]) for i in range(0, len(texts), _AT_ONCE)]
        end = [self.mark] if between == self.mark_text else []
        found = tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        return np.concatenate([np.zeros(0, np.uint32), *[np.array([*e.ids, *end], np.uint32) for e in found]])

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, ends: np.ndarray, mark: int) -> None:
        """Keep the ids of pieces; each takes those up to its end, less its ``mark`` last ones."""
        if len(ends) != len(hashes):
            raise ValueError("the tokenizer does not keep words apart")
        starts = np.append(0, ends[:-1])[: len(ends)]
        first = self.known.count
        while len(self.start) < first + len(hashes):
            self.start, self.size = (np.append(x, np.zeros_like(x)) for x in (self.start, self.size))
        while len(self.pool) < self.used + len(ids):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[first : first + len(hashes)] = starts + self.used
        self.size[first : first + len(hashes)] = ends - starts - mark
        self.used += len(ids)
        self.known.add(hashes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of the texts; NULL counts as empty."""
        data, at = buffers(texts)
        found = self.pieces(data, at)
        hashes = found.hashes()
        raw = data.tobytes()
        place = self.known.find(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            unseen, first = np.unique(hashes[new], return_index=True)
            if self.known.count + len(unseen) > KNOWN_PIECES:
                unseen, first = np.unique(hashes, return_index=True)
                self.forget(len(unseen))
                new = np.arange(len(hashes))
            spans = zip(found.start[new[first]].tolist(), found.end[new[first]].tolist())
            self.learn(unseen, [_lower(raw[a:b]) for a, b in spans])
            place = self.known.find(hashes)
        size = self.size[place]
        upto = np.cumsum(size, dtype=np.int64)
        ids = np.repeat(self.start[place] - (upto - size), size)
        ids += np.arange(len(ids))
        ids = self.pool[ids]
        offsets = np.append(0, upto)[found.first]
        if any(s in raw for s in self.specials):
            return self._with_specials(raw, at, ids, offsets)
        return ids, offsets

    def _with_specials(self, raw, at, ids, offsets):
        """Texts that hold a special token's string are encoded whole."""
        parts = []
        for row in range(len(at) - 1):
            text = raw[at[row] : at[row + 1]]
            if any(s in text for s in self.specials):
                own = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False)
                parts.append(np.array(own.ids, np.uint32))
            else:
                parts.append(ids[offsets[row] : offsets[row + 1]])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def _lower(piece: bytes) -> str:
    """Pieces that differ in the case of A-Z share an entry, as they share their ids."""
    return piece.lower().decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
