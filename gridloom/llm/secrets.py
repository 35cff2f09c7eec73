"""Secrets in text: candidates by shape, told from false positives by a random forest.

Candidates stand in words of at least LEAST bytes with a digit, or in long runs that mix upper
and lower case or are mostly capitals: each run of _CORE in such a word is one, and the parts of
a JWT are one together. Any value next to a name such as ``password`` is one whatever its
shape: after an assignment in the same word or the words before, or after ``Bearer``. Bytes
beyond ASCII end a run (accented Latin letters do not end a value). A quoted value with blanks
in it counts up to its first blank.

The forest looks at the candidate's length and make-up, how usual its character transitions
and its words are in the whole corpus, whether it stands in a path or an address, and what
stands beside it. It is trained from labelled findings; ``weak_labels`` makes such labels for
shapes that are certain.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.forest import Forest
from gridloom.llm.memory import release
from gridloom.llm.text import Words, buffers, letter_words, slices, split_words, words

LEAST = 8
TRAIN_ROWS = 20_000  # labelled findings of each class used for training, about
_WORD_BUCKETS = 1 << 16
_COMMON = 1e-5  # share of all words from which a word counts as in the dictionary

CONTEXT = 64  # bytes looked at on either side of a candidate within its word

# A JWT, or a run with its padding (a sign before a value is no padding).
_JWT = r"e(?:y[AJ]|w[o0])[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]*)?"
_CORE = re.compile(_JWT + r"|[A-Za-z0-9+/_\-]{6,}(?:={1,2}(?![\x00\"'=]*[A-Za-z0-9+/_\-]))?")
# Names that announce a secret, and shapes that are certain either way.
_KEYS = re.compile(r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer|private)")
_CERTAIN = re.compile(
    r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|"
    r"AIza[0-9A-Za-z_\-]{35}|sk_live_[0-9A-Za-z]{16,}|" + _JWT
)
# Words are read byte by byte (Latin-1), with these characters as ASCII of the same length.
_WIDE = {c: "\0" * (len(c.encode()) - len(to)) + to for cs, to in (
    ("\uff1a", ":"), ("\uff1d", "="), ("\u201c\u201d\u201e\u300c\u300d\u300e\u300f\u00ab\u00bb\uff02", '"'),
    ("\u2018\u2019\u201a\u2039\u203a\uff07", "'"), ("\uff0c\u3001\u3002\uff1b", ","), ("\u00a0\u3000", ""),
) for c in cs}
_WIDE = {c.encode().decode("latin-1"): to for c, to in _WIDE.items()}
_WIDE_CHARACTER = re.compile("|".join(_WIDE))
_SIGN = r"\x00*[\"'\]]?\x00*(?:=>|:=|={1,2}|:)\x00*"
_PLAIN = r"(?:[!#-%*+./0-:=?@A-Z\\^_`a-z~\-]|[\xc3-\xc9][\x80-\xbf])+"
_VALUE = rf"(?:\"[^\"]{{1,200}}(?=\")|'[^']{{1,200}}(?=')|[\"']?\x00*{_PLAIN})"
_NAMED = re.compile(rf"(?:{_KEYS.pattern[4:]})[\w\-]{{0,20}}{_SIGN}(?P<value>{_VALUE})", re.I | re.A)
_LEADING = re.compile(rf"\x00*(?:(?:=>|:=|={{1,2}}|:)\x00*)?(?P<value>{_VALUE})", re.A)
_SIGN_ALONE = re.compile(r"\x00*(?:=>|:=|={1,2}|:)\x00*", re.A)
_SIGN_LAST = re.compile(rf"{_SIGN}[\"']?\x00*$", re.A)
_NAME = re.compile(rf"{_SIGN}[^\x00=:/\s]", re.A)  # after a name
_CUT = re.compile(r"[&,;{}()<>?|]")
_HARMLESS = re.compile(
    r"[^@\s]+@[^@\s]+|(?:https?|ftp)://\S+|\(?\+?[\d().\-/ ]+\)?[.,;:]?|(?:\d{1,3}\.){3}\d{1,3}[.,;:]?|"
    r"v?\d+(?:\.\d+)+[.,;:]?|\d{4}-\d\d-\d\d\S*|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}[.,;:]?"
)
_LETTERS = re.compile(r"[A-Za-z_\-]+")
FEATURES = (
    "length digits upper lower symbols changes entropy transitions dictionary longest_letters hexadecimal "
    "path address assigned quoted key_before key_inside repeats"
).split()


@dataclass
class Usage:
    """What is usual in the corpus: transitions between kinds of characters, and words."""

    transitions: np.ndarray  # log-probability of the next kind, 40 by 40
    common: np.ndarray  # whether words of a hash bucket are frequent


_KIND = np.full(256, 39, np.int64)
for _i in range(26):
    _KIND[97 + _i] = _i
    _KIND[65 + _i] = 26
for _i in range(10):
    _KIND[48 + _i] = 27 + _i
_KIND[[9, 10, 11, 12, 13, 32]] = 37
_KIND[128:] = 38
_DIGIT = (_KIND >= 27) & (_KIND < 37)


def usage(documents: DataFrame) -> Usage:
    """Counted over all texts; the counts have a fixed number of buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_WORD_BUCKETS + 1600, np.int64)
        for batch in batches:
            for piece in slices(batch):
                found = letter_words(piece.column("text"))
                bucket = (found.hashes() & np.uint64(_WORD_BUCKETS - 1)).astype(np.int64)
                total[:_WORD_BUCKETS] += np.bincount(bucket, minlength=_WORD_BUCKETS)
                kind = _KIND[found.data]
                pairs = kind[:-1] * 40 + kind[1:]
                total[_WORD_BUCKETS:] += np.bincount(pairs, minlength=1600)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "count"])
        release()

    rows = documents.select("text").mapInArrow(count, "at long, count long")
    rows = rows.groupBy("at").agg(F.sum("count").alias("count")).toPandas()  # at most 67,136 rows
    total = np.zeros(_WORD_BUCKETS + 1600)
    total[rows["at"].to_numpy(np.int64)] = rows["count"].to_numpy(float)
    word, pair = total[:_WORD_BUCKETS], total[_WORD_BUCKETS:].reshape(40, 40) + 0.5
    return Usage(np.log(pair / pair.sum(axis=1, keepdims=True)), word > _COMMON * word.sum() + word.mean())


_NOT_CORE = np.ones(256, bool)
_NOT_CORE[[c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_-"]] = False


def _latin(found: Words, i: int) -> str:
    """A word with a character for each byte; some wide punctuation as ASCII."""
    text = found.data[found.start[i] : found.end[i]].tobytes().decode("latin-1")
    return text if text.isascii() else _WIDE_CHARACTER.sub(lambda m: _WIDE[m[0]], text)


def _odd(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Whether words have a digit, and whether they are long and oddly capital."""
    digit = np.add.reduceat(_DIGIT[found.data].astype(np.int32), found.start) > 0
    upper = np.add.reduceat((_KIND[found.data] == 26).astype(np.int32), found.start)
    lower = np.add.reduceat((_KIND[found.data] < 26).astype(np.int32), found.start)
    size = found.end - found.start
    return digit, (size >= 16) & (((upper >= 4) & (lower >= 4)) | ((upper >= 16) & (upper >= size - 2)))


def named_words(found: Words) -> set[int]:
    """Indexes of the words that begin with a value whose name stands in the words before."""
    data, out = found.data, set()
    sign = (data == 0x3D) | (data == 0x3A)
    sign[2:] |= (data[:-2] == 0xEF) & (data[1:-1] == 0xBC) & ((data[2:] == 0x9A) | (data[2:] == 0x9D))
    at = np.unique(np.searchsorted(found.start, np.flatnonzero(sign), "right") - 1)
    for i in at.tolist():
        if i < 0:
            continue
        word, row = _latin(found, i), found.doc[i]
        alone = _SIGN_ALONE.match(word)
        if alone and i > found.first[row] and _KEYS.search(_latin(found, i - 1)[-CONTEXT:]):
            out.add(i if alone.end() < len(word) else i + 1)
        if _SIGN_LAST.search(word[-CONTEXT:]) and _KEYS.search(word[-CONTEXT:]):
            out.add(i + 1)
    raw = data.tobytes().lower()
    place = raw.find(b"bearer")
    while place >= 0:
        i = int(np.searchsorted(found.start, place, "right")) - 1
        if found.end[i] == place + 6:
            out.add(i + 1)
        place = raw.find(b"bearer", place + 6)
    # Not over the end of a text.
    return {i for i in out if i < len(found.start) and (i > found.first[found.doc[i]] or _SIGN_ALONE.match(_latin(found, i)))}


def candidate_words(found: Words, at: np.ndarray) -> tuple[np.ndarray, set[int]]:
    """Indexes of the words that may hold a secret, and which begin with a named value."""
    if not len(found.start):
        return np.zeros(0, np.int64), set()
    digit, odd = _odd(found)
    chosen = (found.end - found.start >= LEAST) & (digit | odd)
    runs = split_words(found.data, at, _NOT_CORE)
    if len(runs.start):
        chosen[np.searchsorted(found.start, runs.start[_odd(runs)[1]], "right") - 1] = True
    named = named_words(found)
    chosen[list(named)] = True
    # Names and signs within one word.
    sign = np.isin(found.data, [0x3D, 0x3A, 0x9A, 0x9D])
    for i in np.unique(np.searchsorted(found.start, np.flatnonzero(sign), "right") - 1).tolist():
        if i >= 0 and not chosen[i] and found.end[i] - found.start[i] > 4 and _NAMED.search(_latin(found, i)):
            chosen[i] = True
    return np.flatnonzero(chosen), named


def spans(word: str, begins: bool = False) -> list[tuple[int, int, bool]]:
    """(start, end, whether a name stands beside it) of each candidate in a word.

    ``begins``: the word begins with a value whose name stands before the word.
    """
    values = [m.span("value") for m in _NAMED.finditer(word)]
    first = _LEADING.match(word) if begins else None
    if first and (not values or first.end() <= values[0][0]):
        values.insert(0, first.span("value"))
    out = []
    for a, b in values:
        while a < b and word[a] in "\0\"'":
            a += 1
        while a < b and word[b - 1] in "\0.:?":
            b -= 1
        if a < b and not word.startswith("//", a):
            out.append((a, b, True))
    taken, runs = list(out), list(_CORE.finditer(word))
    for m in runs:
        while taken and taken[0][1] <= m.start():
            taken.pop(0)
        # Letters before a sign and a value are the value's name.
        name = _LETTERS.fullmatch(m[0]) and _NAME.match(word, m.end())
        if not name and (not taken or m.end() <= taken[0][0]):
            out.append((*m.span(), False))
    if not out and not runs and word.isascii():
        out.append((0, len(word), False))
    return sorted(out)


@lru_cache(1 << 16)
def _word_bucket(letters: str) -> int:
    return int(words(pa.array([letters])).hashes()[0] & np.uint64(_WORD_BUCKETS - 1))


def _entropy(text: bytes) -> float:
    counts = np.bincount(np.frombuffer(text, np.uint8))
    share = counts[counts > 0] / max(len(text), 1)
    return float(-(share * np.log2(share)).sum())


def describe(word: str, span: tuple[int, int], before: str, two_before: str, usual: Usage) -> list[float]:
    """The features of a finding: where it lies in its word, and the words before."""
    text = word[span[0] : span[1]]
    # What stands beside it, up to the next field of a record or of an address.
    lead = word[max(span[0] - CONTEXT, 0) : span[0]]
    if re.search(r"[A-Za-z0-9]", lead):
        before = two_before = ""
    lead = _CUT.split(lead)[-1].replace("\0", "")
    trail = _CUT.split(word[span[1] : span[1] + CONTEXT], maxsplit=1)[0]
    raw = text.encode("latin-1")
    kinds = _KIND[np.frombuffer(raw, np.uint8)]
    n = max(len(raw), 1)
    group = np.select([kinds < 26, kinds == 26, (kinds >= 27) & (kinds < 37)], [0, 1, 2], 3)
    moves = usual.transitions[kinds[:-1], kinds[1:]].mean() if len(kinds) > 1 else 0.0
    letters = re.findall(r"[A-Za-z]+", text)
    covered = 0
    covered = sum(len(w) for w in letters if len(w) > 2 and usual.common[_word_bucket(w)])
    assigned = bool(re.search(r"[=:]\s*[\"']?$", lead)) or before in ("=", ":", "=>") or before.endswith(("=", ":"))
    key = before if before not in ("=", ":", "=>") else two_before
    return [
        float(len(text)),
        float((group == 2).sum()) / n,
        float((group == 1).sum()) / n,
        float((group == 0).sum()) / n,
        float((group == 3).sum()) / n,
        float((group[1:] != group[:-1]).sum()) / n,
        _entropy(raw),
        float(moves),
        covered / n,
        float(max(map(len, letters), default=0)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", text))),
        float("/" in lead or "/" in trail or "\\" in lead + text + trail or text.count("/") > 1),
        float("@" in lead + text + trail or bool(re.search(r"\.[a-z]{2,}", trail))),
        float(assigned),
        float(lead[-1:] in "\"'" and lead != ""),
        float(bool(_KEYS.search(key))),
        float(bool(_KEYS.search(lead))),
        1.0 - len(set(text)) / n,
    ]


def _findings(piece: pa.RecordBatch, usual: Usage):
    """(row, first byte, end byte, word, span in it, named, features) for each candidate of a slice."""
    found = words(piece.column("text"))
    chosen, named = candidate_words(found, _raw(piece)[1])
    for i in chosen.tolist():
        row, place, word = int(found.doc[i]), int(found.start[i]), _latin(found, i)
        back = [_latin(found, j)[-CONTEXT:] if j >= found.first[row] else "" for j in (i - 1, i - 2)]
        for a, b, beside in spans(word, i in named):
            yield row, place + a, place + b, word, (a, b), beside, describe(word, (a, b), *back, usual)


def weak_labels(word: str, span: tuple[int, int], named: bool, features: list[float]) -> int | None:
    """1 for a certain secret, 0 for a certainly harmless finding, else None."""
    text, sign = word[span[0] : span[1]], word[: span[0]][-1:]
    value = dict(zip(FEATURES, features))
    if _CERTAIN.search(text):
        return 1
    if named and re.fullmatch(r"[A-Za-z0-9+/_\-]{8,}={0,2}", text) and any(c.isdigit() for c in text):
        return 1
    if named and text.isascii() and text.isalpha():
        # A word of the corpus after a name is prose; another one is a password.
        return 0 if value["dictionary"] == 1 else 1 if len(text) >= LEAST else None
    if not named and sign not in ("=", ":") and _HARMLESS.fullmatch(word):
        return 0
    return None


def labelled_findings(documents: DataFrame, usual: Usage) -> DataFrame:
    """(features, label, digest) of the candidates whose label is certain, over all texts."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                rows = [
                    (f, weak_labels(w, (a, b), named, f), w[max(a - CONTEXT, 0) : b])
                    for *_, w, (a, b), named, f in _findings(piece, usual)
                ]
                rows = [r for r in rows if r[1] is not None]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.list_(pa.float64())),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[2] for r in rows], pa.string()),
                    ],
                    names=["features", "label", "word"],
                )
        release()

    return documents.select("text").mapInArrow(label, "features array<double>, label int, word string")


def train(labelled: DataFrame) -> Forest:
    """A forest from ``features`` (of FEATURES) and ``label`` of findings, each word once.

    About TRAIN_ROWS findings of each label are used, chosen by a hash of the word.
    """
    once = labelled.groupBy("word").agg(F.min_by("features", "features").alias("features"), F.max("label").alias("label"))
    counts = {r.label: r.rows for r in once.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).collect()}
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    keep = F.lit(False)
    for value, rows in counts.items():
        keep |= (F.col("label") == value) & (part < int((1 << 30) * min(1.0, TRAIN_ROWS / rows)))
    rows = once.where(keep).orderBy("word").select("features", "label").toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), len(FEATURES))
    return Forest(x, rows["label"].to_numpy(float))


def find_secrets(documents: DataFrame, usual: Usage, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, start, end (bytes of the UTF-8 text), length, score, is_secret.

    The secret itself is not returned, only its SHA-256. NULL, empty and ordinary texts give
    no row; rows that repeat an id are scanned each. Nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found, at = _scored(piece, usual, forest)
                raw, _ = _raw(piece)
                rows = [(r, a - at[r], b - at[r], b - a, s, hashlib.sha256(raw[a:b]).hexdigest()) for r, a, b, s in found]
                row, *columns = [list(c) for c in zip(*rows)] if rows else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(row, pa.int64()))]
                    + [pa.array(c, t) for c, t in zip(columns, types)],
                    names=["doc_id", "start", "end", "length", "score", "sha256"],
                )
        release()

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = documents.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, start long, end long, length long, score double, sha256 string"
    )
    return found.withColumn("is_secret", F.col("score") >= threshold)


def _raw(piece: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    data, at = buffers(piece.column("text"))
    return data.tobytes(), at


def _scored(piece: pa.RecordBatch, usual: Usage, forest: Forest):
    found = list(_findings(piece, usual))
    x = np.array([f for *_, f in found], float).reshape(len(found), len(FEATURES))
    scores = forest.predict(x)
    _, at = _raw(piece)
    return [(r, a, b, float(s)) for (r, a, b, *_), s in zip(found, scores)], at.tolist()


def redact(
    documents: DataFrame, usual: Usage, forest: Forest, threshold: float = 0.5, mark: str = "[REDACTED]"
) -> DataFrame:
    """The documents with every secret in ``text`` replaced by ``mark``; ``n_chars`` follows.

    All rows and columns stay, and texts without a secret stay as they are (NULL too).
    """
    names = documents.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found, at = _scored(piece, usual, forest)
                hits: dict[int, list[tuple[int, int]]] = {}
                for row, a, b, s in found:
                    if s >= threshold:
                        hits.setdefault(row, []).append((a, b))
                if hits:
                    piece = _replaced(piece, hits, at, mark.encode())
                yield piece
        release()

    out = documents.mapInArrow(clean, documents.schema)
    if "n_chars" in names:
        length = F.length("text").cast(documents.schema["n_chars"].dataType)
        changed = F.col("text").contains(mark)
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return out


def _replaced(piece: pa.RecordBatch, hits, at, mark: bytes) -> pa.RecordBatch:
    raw, _ = _raw(piece)
    texts = piece.column("text")
    new = texts.to_pylist()
    for row, spans in hits.items():
        out, last = [], at[row]
        for a, b in sorted(spans):
            out += [raw[last:a], mark]
            last = b
        out.append(raw[last : at[row + 1]])
        new[row] = b"".join(out).decode("utf-8", "replace")
    i = piece.schema.get_field_index("text")
    return piece.set_column(i, piece.schema.field(i), pa.array(new, texts.type))
