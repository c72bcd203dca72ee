"""Byte views of text columns, shared by the text operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa

#: The characters that part words: blank and the five controls 9 to 13. ``bytes.split()`` without
#: arguments splits at exactly these.
BLANKS = b" \t\n\x0b\x0c\r"


def raw(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.binary()).to_pylist()


def code_points(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def without(data: bytes, characters: bytes) -> int:
    """Bytes left when the given ASCII characters are taken out."""
    return len(data.translate(None, characters))


def give_back() -> None:
    """Return freed memory to the system; a worker lives on after a task with large arrays."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim:
        trim(0)
