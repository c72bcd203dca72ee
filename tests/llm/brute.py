"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokenizer(name: str) -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t


def ids_with_end(t: Tokenizer, text: str | None) -> np.ndarray:
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(t: Tokenizer, rows) -> list[tuple]:
    """(id, piece, start, length, crc) of (id, text) rows."""
    out = []
    for owner, text in rows:
        ids = ids_with_end(t, text)
        for k, a in enumerate(range(0, len(ids), 2048)):
            p = ids[a : a + 2048]
            out.append((owner, k, a, len(p), crc(p)))
    return out


def shingle_set(text: str | None, size: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def groups(rows, size: int, num: int, den: int) -> list[list[int]]:
    """Connected components, as lists of places in ``rows`` ((id, text) pairs)."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * (num + den) >= num * (len(a) + len(b)):
                parent[find(i)] = find(j)
    found: dict[int, list[int]] = {}
    for i in range(len(rows)):
        found.setdefault(find(i), []).append(i)
    return list(found.values())


def without_boilerplate(rows, ratio: float, least: int) -> list[str | None]:
    """Texts of (host, text) rows without lines that too many of the host's rows hold."""
    trim = lambda line: line.strip(" \t\r")
    pages, with_line = {}, {}
    for host, text in {r for r in rows if r[1] is not None}:  # equal texts are one page
        pages[host] = pages.get(host, 0) + 1
        for line in {trim(x) for x in text.split("\n")} - {""}:
            with_line[host, line] = with_line.get((host, line), 0) + 1
    bad = {k for k, n in with_line.items() if n >= least and n > pages[k[0]] * ratio}
    return [
        t if t is None else "\n".join(x for x in t.split("\n") if (h, trim(x)) not in bad) for h, t in rows
    ]


def check_packing(rows, length: int = 2048) -> int:
    """Sequences of (sequence, offset, length) rows; each is gapless and not too long."""
    sequences: dict[int, list] = {}
    for sequence, offset, size in rows:
        sequences.setdefault(sequence, []).append((offset, size))
    for placed in sequences.values():
        at = 0
        for offset, size in sorted(placed):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences)
