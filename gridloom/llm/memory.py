"""Giving memory back between the stages that share a Python worker."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Return freed memory of Arrow and numpy to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
