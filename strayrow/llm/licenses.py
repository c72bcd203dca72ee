"""License scans: exact seeds find places, bounded-error matching confirms short notices.

A notice that stands in a text with at most ``errors`` edits holds at least one of its
``errors + 1`` parts unchanged (pigeonhole). So the parts are searched as exact strings; the windows
around the finds are merged, and one table of edit distances over all of them (a row for each
character of the notice, by array operations) keeps the places where the notice can end. There the
``regex`` library matches the whole notice with bounded errors and gives span and edits. A seed that
a text repeats a million times costs no search of its own. Beside it, plain phrases are counted as
consecutive words.

Edge cases: a null or empty text has no words, no places and no labels; overlapping finds of one
notice are reported once, by the fewest edits, then the smaller end; bytes that are no UTF-8 count as
one replacement character each run; repeated rows are scanned one by one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.llm.texts import raw


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    errors: int


#: Phrases of consecutive words and their labels (fixed values).
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Short notices in lower case, each with the edits it may carry: about one in nine characters, fewer
#: where another license's notice is as near.
NOTICES = (
    Notice("mit", "released under the mit license", 3),
    Notice("apache", "licensed under the apache license, version 2.0", 5),
    Notice("gpl", "licensed under the gnu general public license", 5),
    Notice("cc-by-nc", "licensed under cc by-nc 4.0", 1),
    Notice("cc-by", "licensed under cc by 4.0", 1),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("mpl", "subject to the terms of the mozilla public license", 5),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("epl", "eclipse public license", 2),
    Notice("cc-by-sa", "licensed under the creative commons attribution-sharealike", 6),
    Notice("cc-by-sa", "licensed under cc by-sa 4.0", 1),
    Notice("mit", "permission is hereby granted, free of charge, to any person obtaining a copy", 8),
    Notice("isc", "permission to use, copy, modify, and/or distribute this software for any purpose", 8),
    Notice("apache", "you may not use this file except in compliance with the license", 7),
    Notice("bsd", "neither the name of the copyright holder nor the names of its contributors", 8),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 7),
)
#: Characters of windows that one table of edit distances covers.
CHUNK = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


class Scanner:
    """Finds notices and phrases in one text after another."""

    def __init__(self, notices: Sequence[Notice] = NOTICES, phrases=PHRASES):
        self.notices = [
            (n, self._seeds(n), regex.compile(f"(?:{regex.escape(n.text)}){{e<={n.errors}}}", regex.BESTMATCH))
            for n in notices
        ]
        self.phrases = [(p.encode().split(), label) for p, label in phrases]

    @staticmethod
    def _seeds(notice: Notice) -> list[tuple[str, int]]:
        """The notice in ``errors + 1`` parts, with their offsets."""
        text, parts = notice.text, notice.errors + 1
        cuts = [len(text) * k // parts for k in range(parts + 1)]
        return [(text[a:b], a) for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _windows(text: str, notice: Notice, seeds: list[tuple[str, int]]) -> list[tuple[int, int]]:
        """Where the notice can stand, by its seeds; windows that meet are one."""
        around = []
        for seed, offset in seeds:
            at = text.find(seed)
            while at >= 0:
                around.append(at - offset)
                at = text.find(seed, at + 1)
        windows: list[tuple[int, int]] = []
        for start in sorted(around):
            low, high = max(0, start - notice.errors), start + len(notice.text) + notice.errors
            if windows and low <= windows[-1][1]:
                windows[-1] = (windows[-1][0], high)
            else:
                windows.append((low, high))
        return [(a, min(b, len(text))) for a, b in windows]

    @staticmethod
    def _ends(text: str, notice: Notice, windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(edits, end) of every place in the windows where the notice can end, fewest edits first."""
        before = len(notice.text) + notice.errors
        parts: list[tuple[int, int, int]] = []
        found: list[tuple[int, int]] = []
        held = 0
        for a, b in windows:
            # A long window is cut; each part begins with as much of the one before as a match can take.
            for cut in range(a, b, CHUNK):
                parts.append((max(a, cut - before), cut, min(b, cut + CHUNK)))
                held += parts[-1][2] - parts[-1][0]
                if held >= CHUNK:
                    found += Scanner._ends_in(text, notice, parts)
                    parts, held = [], 0
        return sorted(found + Scanner._ends_in(text, notice, parts))

    @staticmethod
    def _ends_in(text: str, notice: Notice, parts: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """(edits, end) of places behind the second number of each part (start, place, end)."""
        # No character is -1, so more of them than errors keep matches inside their part.
        gap = notice.errors + 1
        codes = np.full(sum(b - a + gap for a, _, b in parts), -1, np.int32)
        places = np.zeros(len(codes), np.int64)
        at = 0
        for a, cut, b in parts:
            codes[at : at + b - a] = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), "<i4")
            places[at + cut - a : at + b - a] = np.arange(cut + 1, b + 1)
            at += b - a + gap
        steps = np.arange(len(codes) + 1, dtype=np.int32)
        row = np.zeros(len(codes) + 1, np.int32)
        for k, letter in enumerate(map(ord, notice.text), 1):
            best = row + 1
            best[0] = k
            np.minimum(best[1:], row[:-1] + (codes != letter), out=best[1:])
            best -= steps
            row = np.minimum.accumulate(best, out=best)
            row += steps
        ends = np.flatnonzero((row[1:] <= notice.errors) & (places > 0))
        return list(zip(row[ends + 1].tolist(), places[ends].tolist()))

    def spans(self, lowered: bytes) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) in code points, by start."""
        return [f[:4] for f in self.finds(lowered)]

    def finds(self, lowered: bytes) -> list[tuple[str, int, int, int, float]]:
        """Spans, each with the notice's share of unedited characters."""
        text = lowered.decode("utf-8", "replace")
        found = []
        for notice, seeds, pattern in self.notices:
            windows = self._windows(text, notice, seeds)
            if not windows:
                continue
            shortest = max(1, len(notice.text) - notice.errors)
            taken: list[tuple[int, int]] = []
            for _, end in self._ends(text, notice, windows):
                k = bisect_right(taken, (end, 0))
                if k and end < taken[k - 1][1] + shortest or k < len(taken) and taken[k][0] < end:
                    continue  # it would overlap a span with as few edits
                low = max(0, end - len(notice.text) - notice.errors, taken[k - 1][1] if k else 0)
                hit = pattern.search(text, low, end)
                if hit:
                    insort(taken, hit.span())
                    edits = sum(hit.fuzzy_counts)
                    found.append((notice.label, *hit.span(), edits, 1 - edits / len(notice.text)))
        return sorted(found, key=lambda x: (x[1], x[2], x[0], x[3]))

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every phrase."""
        found = []
        for phrase, label in self.phrases:
            last, size = phrase[-1], len(phrase)
            at = -1
            try:
                while True:
                    at = words.index(last, at + 1)
                    if at + 1 >= size and words[at + 1 - size : at + 1] == phrase:
                        found.append((at + 1 - size, label))
            except ValueError:
                pass
        return sorted(found)

    def scan(self, text: bytes | None) -> dict:
        lowered = (text or b"").translate(_LOWER)
        words = lowered.translate(_WORDS).split()
        places, spans = self.places(words), self.finds(lowered)
        base = sorted({label for _, label in places})
        best = max([s[4] for s in spans], default=0.0)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": places[0][0] if places else None,
            "last_word": places[-1][0] if places else None,
            "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *[s[0] for s in spans]})),
            "score": 1.0 if places else best,
            "spans": [dict(zip(("label", "start", "end", "edits"), s)) for s in spans],
        }


_SCAN_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        (
            "spans",
            pa.list_(
                pa.struct(
                    [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]
                )
            ),
        ),
    ]
)
_SCAN_DDL = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, start: long, end: long, edits: long>>"
)


def scan_licenses(
    docs: DataFrame,
    notices: Sequence[Notice] = NOTICES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: word counts, phrase places, labels, score and the spans of notices.

    ``score`` is 1 where a phrase stands, else the best notice's share of unedited characters,
    0 without any. ``start`` and ``end`` of a span count code points of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        for batch in batches:
            results = pa.array([scanner.scan(t) for t in raw(batch.column(1))], _SCAN_TYPE)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *results.flatten()], names=[id_col, *[f.name for f in _SCAN_TYPE]]
            )

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.dtypes[0][1]}, {_SCAN_DDL}")
