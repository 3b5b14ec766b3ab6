"""What Python workers keep between tasks.

Spark uses its Python workers again, for tasks of any operator. A worker therefore keeps the state of one
operator at a time: `begin` is the first thing each operator's function does in a task, and lets go of
what another one has left, of free Arrow memory and of the C library's free pages.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_owner: str | None = None
_kept: dict[str, Any] = {}


def release() -> None:
    """Give free memory back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def begin(owner: str) -> None:
    """A task of `owner` starts here."""
    global _owner
    if _owner != owner:
        _kept.clear()
        _owner = owner
    release()


def kept(key: str, make: Callable[[], Any]) -> Any:
    """The state `key` of the operator that has begun; made once, until another operator begins."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]
