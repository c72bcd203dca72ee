"""Quality rules: a cascade that tries the rules with the most rejections per cost first.

A rule is a test on lazily counted features of one text. ``order_rules`` runs every rule alone on
a bounded sample (500 rows) and measures its cost and how often it rejects; ``judge`` then tries the rules in
the order of rejections per cost and stops at the first that rejects, so that later rules cost
nothing for such rows. A rule's verdict never depends on the order: ``kept`` is the same for
every order, only ``rejected_by`` names the first rule of the order that rejects.

Edge cases: a null text counts as empty and is rejected by ``few_words``; repeated rows are judged
one by one; an empty table gives an empty table; other columns are neither read nor returned by
``judge`` and are returned unchanged by ``keep_good``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.llm.texts import BLANKS, code_points, raw, without

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
SAMPLE_ROWS = 500


class Features:
    """What the rules ask of a text; each count is made when first asked for."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return code_points(self.text) - (len(self.text) - without(self.text, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - without(self.text, SYMBOLS)

    @cached_property
    def n_capitals(self) -> int:
        return len(self.text) - without(self.text, CAPITALS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that stand in a window of three words which the text holds more than once."""
        n = self.n_words
        if n < 4:
            return 0
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), np.int64, n)
        size = len(numbers)
        if size > 1_000_000:  # the cube would not fit into 64 bits
            pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
            windows = pairs[:-1] * size + ids[2:]
        else:
            windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        order = np.argsort(windows)
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            return 0
        found = np.zeros(n - 2, bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : shift + n - 2] |= found
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


BASE_RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
#: Limits far from ordinary prose: a symbol for every fifth word, a third of capitals, words of
#: two or fifteen letters on average, more than every second line a repetition.
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda f: 100 * f.n_symbols > 20 * f.n_words),
    Rule("capitals", lambda f: 100 * f.n_capitals > 30 * f.word_chars),
    Rule("short_words", lambda f: f.word_chars < 2 * f.n_words),
    Rule("long_words", lambda f: f.word_chars > 15 * f.n_words),
    Rule("repeated_lines", lambda f: 100 * f.n_dup_lines > 50 * len(f.lines)),
)


def rejecting(features: Features, rules: Iterable[Rule]) -> str | None:
    """Name of the first rule that rejects; later ones are not tried."""
    for rule in rules:
        if rule.rejects(features):
            return rule.name
    return None


def order_rules(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """The rules by rejections per second, measured on the first ``sample_rows`` rows.

    The sample settles the order only. Ties, and an empty sample, keep the given order.
    """
    seconds, rejected = [0.0] * len(rules), [0] * len(rules)
    for (text,) in docs.select(F.col(text_col).cast("string")).take(sample_rows):
        for k, rule in enumerate(rules):
            alone = Features(text and text.encode())
            began = time.perf_counter()
            rejected[k] += rule.rejects(alone)
            seconds[k] += time.perf_counter() - began
    gain = [n / max(s, 1e-9) for n, s in zip(rejected, seconds)]
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -gain[k])]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(
    docs: DataFrame,
    rules: Sequence[Rule] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: Sequence[str] = COUNTS,
) -> DataFrame:
    """Id, the asked counts, ``kept`` and ``rejected_by`` of every row.

    Without ``rules`` the usual ones run in the order measured on a sample.
    """
    rules = order_rules(docs, text_col=text_col) if rules is None else list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in counts}
            reasons = []
            for text in raw(batch.column(1)):
                features = Features(text)
                reasons.append(rejecting(features, rules))
                for c in counts:
                    columns[c].append(getattr(features, c))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(columns[c], pa.int64()) for c in counts],
                    pa.array([r is None for r in reasons], pa.bool_()),
                    pa.array(reasons, pa.string()),
                ],
                names=[id_col, *counts, "kept", "rejected_by"],
            )

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    fields = ", ".join(f"{c} long" for c in counts)
    schema = f"`{id_col}` {slim.dtypes[0][1]}, {fields + ', ' if fields else ''}kept boolean, rejected_by string"
    return slim.mapInArrow(run, schema)


def keep_good(
    docs: DataFrame, rules: Sequence[Rule] | None = None, text_col: str = "text"
) -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    rules = order_rules(docs, text_col=text_col) if rules is None else list(rules)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [rejecting(Features(t), rules) is None for t in raw(batch.column(place))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
