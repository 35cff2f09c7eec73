"""URL rules as a bit-parallel automaton.

Every rule becomes a glob over the canonical URL ``.<host><path>`` and every glob a run of
bits in one row of 64-bit words. One Shift-And step per character moves the state of all
rules at once, for all URLs of a batch in one numpy operation. A rule ``net/`` is the glob
``*.net/*``: the leading star stands for labels of the host, so it cannot pass a slash, and
a finished rule keeps its last bit, which is the trailing star. A ``*`` inside a rule's
host or path stands for any characters up to the next slash or any characters at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.llm.text import buffers

_SLASH = ord("/")
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
MAX_MASK_BYTES = 64 << 20  # the masks travel with the tasks; more rules than this are refused


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


class Automaton:
    """Masks of all rules; ``match`` runs many URLs at once."""

    def __init__(self, rules: list[Rule]):
        # The longest rule wins; among equally long ones the first in the list.
        self.rules = sorted(rules, key=lambda r: -len(r.text))
        states: list[tuple[int, bool, bool]] = []  # byte, star before it, star may pass a slash
        first, last = [], []
        for rule in self.rules:
            if any(ord(c) < 32 for c in rule.text) or not rule.path.startswith("/"):
                raise ValueError(f"not a rule: {rule.text!r}")
            first.append(len(states))
            star, wide = True, False
            for part, passes in (("." + rule.host.lower(), False), (rule.path, True)):
                for c in part.encode():
                    if c == ord("*"):
                        star, wide = True, passes
                        continue
                    states.append((c, star, wide))
                    star = wide = False
            last.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        if 258 * 8 * self.words > MAX_MASK_BYTES:
            raise ValueError("too many rules for one automaton")
        self.byte = np.zeros((256, self.words), np.uint64)
        self.stay_host = np.zeros(self.words, np.uint64)  # waits before a state, not past a slash
        self.stay_any = np.zeros(self.words, np.uint64)
        self.final = np.zeros(self.words, np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        self.last = np.array(last, np.int64)
        for i, (c, star, wide) in enumerate(states):
            w, bit = i >> 6, np.uint64(1) << np.uint64(i & 63)
            self.byte[c, w] |= bit
            if star:
                (self.stay_any if wide else self.stay_host)[w] |= bit
        for i in first:
            self.begin[i >> 6] |= np.uint64(1) << np.uint64(i & 63)
        for i in last:
            self.final[i >> 6] |= np.uint64(1) << np.uint64(i & 63)

    def match(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The index of the winning rule for each URL, or -1.

        ``ready`` has a bit for each state that may take the next character. A URL leaves the
        loop when nothing is ready any more, so the cost is bounded by host and rules rather
        than by the length of a path.
        """
        rows = len(at) - 1
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        done = np.zeros((rows, self.words), np.uint64)
        ready = np.tile(self.begin, (rows, 1))
        live = order
        step = 0
        while True:
            live = live[size[live] > step]
            if not len(live):
                break
            c = data[at[live] + step]
            now = ready[live]
            hit = now & self.byte[c]
            moved = hit & ~self.final
            carry = np.zeros_like(moved)
            carry[:, 1:] = moved[:, :-1] >> np.uint64(63)
            stays = self.stay_any | np.where((c == _SLASH)[:, None], np.uint64(0), self.stay_host)
            ready[live] = (moved << np.uint64(1)) | carry | (now & stays)
            done[live] |= hit & self.final
            live = live[ready[live].any(axis=1)]
            step += 1
        won = np.full(rows, -1, np.int64)
        for i in range(len(self.last) - 1, -1, -1):  # the longest last
            bit = self.last[i]
            fits = (done[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)
            won[fits == 1] = i
        return won


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    host = F.coalesce(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(
    pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (NULL if none fits) and ``verdict`` to every row.

    A rule fits its host and all subdomains when the path starts with the rule's path; the
    longest rule wins, and without one the verdict is ``default``. A NULL or malformed URL
    has empty host and path. Columns of the input with these four names are replaced.
    Nothing is shuffled; the only thing sent out is the masks, whose size is checked.
    """
    automaton = Automaton(rules)
    names = pa.array([r.text for r in automaton.rules] + [None], pa.string())
    actions = pa.array([r.action for r in automaton.rules] + [default], pa.string())

    frame = pages.drop("host", "path", "rule", "verdict").withColumns(
        {"host": url_host(F.col(url)), "path": url_path(F.col(url))}
    )
    added = [T.StructField(name, T.StringType()) for name in ("rule", "verdict")]
    schema = T.StructType([*frame.schema.fields, *added])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = (batch.column(c).to_pylist() for c in ("host", "path"))
            canonical = pa.array([f".{h}{p}" for h, p in zip(hosts, paths)], pa.large_string())
            won = pa.array(automaton.match(*buffers(canonical)) % len(names))
            columns = [*batch.columns, names.take(won), actions.take(won)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "rule", "verdict"])

    return frame.mapInArrow(judge, schema)
