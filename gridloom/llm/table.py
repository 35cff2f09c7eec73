"""A hash table over 64-bit keys whose lookups and inserts are numpy operations."""

from __future__ import annotations

import numpy as np

from gridloom.llm.text import mix


class Table:
    """Maps distinct keys to 0, 1, 2, ... in the order they were added; at most a quarter full."""

    def __init__(self, keys: np.ndarray | None = None, room: int = 1 << 10):
        self.clear(max(room, 0 if keys is None else len(keys)))
        if keys is not None:
            self.add(keys)

    def clear(self, room: int) -> None:
        self.slots = 1 << (4 * max(room, 1) - 1).bit_length()
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.full(self.slots, -1, np.int32)
        self.count = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1: slots from its hash on are tried until it is met."""
        slot = (mix(keys) & np.uint64(self.slots - 1)).astype(np.int64)
        out = self.entry[slot]
        going = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while len(going):
            slot[going] = (slot[going] + 1) & (self.slots - 1)
            at = slot[going]
            out[going] = self.entry[at]
            going = going[(self.keys[at] != keys[going]) & (out[going] >= 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Add keys that are not in the table yet, each once."""
        if 2 * (self.count + len(keys)) > self.slots:
            raise ValueError("the table is too small for these keys")
        entries = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.count += len(keys)
        slot = (mix(keys) & np.uint64(self.slots - 1)).astype(np.int64)
        while len(keys):
            free = self.entry[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            now = np.flatnonzero(free)[first]
            self.keys[slot[now]], self.entry[slot[now]] = keys[now], entries[now]
            rest = np.ones(len(keys), bool)
            rest[now] = False
            keys, entries, slot = keys[rest], entries[rest], (slot[rest] + 1) & (self.slots - 1)
