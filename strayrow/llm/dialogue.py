"""Repair of conversations whose turns lack alternation, by Hirschberg's divide and conquer.

A conversation is in order if the initials of its roles read ``(s?(ua)+)?``. Four states follow that:
nothing yet, after the system message, after the user, after the assistant; in each, only one of
user and assistant may come next. Every message is kept (0), given the role that may come next (2)
or deleted (3; blank and repeated messages must be), empty messages of the role that may come next
are inserted (2 each), and each truncated message that stays costs 1 more. The audit is the string
of the edits' initials in order; of the cheapest ones the ASCII-least counts, and as each edit leads
to one state only, it settles the repair.

The cheapest way is found as Hirschberg did for sequences (A linear space algorithm for computing
maximal common subsequences, CACM 1975): a forward vector with the cost of each state after the
first half and a backward vector with the cost of getting from each state to the end meet in the
middle of the conversation, the best crossing is chosen, and both halves are done in the same
manner, so that nothing but vectors of four is kept. Every way crosses the middle in one state if
the state right after the middle message is taken, and the audits of two ways up to there differ
before either ends. The forward vector therefore carries, beside the costs, the rank of each
state's least audit; among crossings of equal cost the one of the least rank is audit-least.

Rows are sorted by ranges of (conversation, turn, role, text), so a large conversation lies in
several partitions, and cut into blocks of at most ``BLOCK`` messages and some ``BLOCK_BYTES`` of
text. A block is summed up by the 4 x 4 costs of its ways from state to state and the ranks of their
audits. These compose as single messages do, so the same search first finds the states between the
blocks of a conversation, of which a task holds a few numbers each, and then, block by block and
spread over all tasks, the edits inside.

Edge cases: null roles and texts are single spaces; turns come in order, nulls first; messages of
equal turn in the order of role and text; rows without a conversation id are one conversation;
repeated rows are messages of their own (and so duplicates); a role's initial is its first
character, an empty role or any other initial than s, u, a must be given a role or deleted;
an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import col
from strayrow.functions.materialize import Scratch

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1  # fixed costs
BLOCK = 2_048
BLOCK_BYTES = 4 << 20

_NEVER = 1 << 40
_STATES = range(4)  # nothing yet, after s, after u, after a
_NEXT_ROLE = "uuau"  # the role of an insertion or a rerole in each state
_NEXT = (2, 2, 3, 2)
_ENDS = (0, 3)

# A vector holds (cost, rank of the least audit) of each state; a way is (cost, order of its audit).
Way = tuple[int, int]
Vector = tuple[Way, ...]


def _edits(code: str) -> list[tuple[str, str, int]]:
    """All steps of one message as (audit, states it starts from and ends in, cost)."""
    initial, fault = code
    found = []
    for start in _STATES:
        state, before, paid = start, "", 0
        for _ in _STATES:  # more insertions than states would go round in a circle
            found.append((before + "D", start, state, paid + DELETE))
            if fault not in "bd":
                more = CUT_OFF if fault == "t" else 0
                found.append((before + "R", start, _NEXT[state], paid + REROLE + more))
                if initial == _NEXT_ROLE[state] or (initial, state) == ("s", 0):
                    to = 1 if initial == "s" else _NEXT[state]
                    found.append((before + "K", start, to, paid + KEEP + more))
            before, paid, state = before + "I", paid + INSERT, _NEXT[state]
    return found


@lru_cache(None)  # four kinds of initials by four kinds of faults
def steps(code: str) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest, then audit-least step from state to state over one message."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for audit, start, end, cost in _edits(code):
        best[start, end] = min(best.get((start, end), (_NEVER, "")), (cost, audit))
    return best


@lru_cache(None)
def table(code: str) -> tuple[tuple[Way, ...], ...]:
    """``steps`` as costs and the order of the audits that leave one state."""
    rows = []
    for start in _STATES:
        ways = [steps(code).get((start, end), (_NEVER, "~")) for end in _STATES]
        ordered = sorted({audit for _, audit in ways})
        rows.append(tuple((cost, ordered.index(audit)) for cost, audit in ways))
    return tuple(rows)


def _ranked(found: list[tuple[int, tuple[int, int]]]) -> Vector:
    ordered = sorted({audit for _, audit in found})
    return tuple((cost, ordered.index(audit)) for cost, audit in found)


def advance(vector: Vector, item) -> Vector:
    """The forward vector after one more message, or block, given as its table."""
    found = []
    for end in _STATES:
        found.append(
            min(
                (min(_NEVER, vector[s][0] + item[s][end][0]), (vector[s][1], item[s][end][1]))
                for s in _STATES
            )
        )
    return _ranked(found)


def retreat(costs: tuple[int, ...], item) -> tuple[int, ...]:
    """The backward vector before one more message or block."""
    return tuple(min(min(_NEVER, item[s][e][0] + costs[e]) for e in _STATES) for s in _STATES)


@lru_cache(1 << 16)
def _advanced(vector: Vector, code: str) -> Vector:
    return advance(vector, table(code))


@lru_cache(1 << 16)
def _retreated(costs: tuple[int, ...], code: str) -> tuple[int, ...]:
    return retreat(costs, table(code))


def _start(state: int) -> Vector:
    return tuple((0 if s == state else _NEVER, 0 if s == state else 1) for s in _STATES)


def forward(items, state: int) -> Vector:
    """Costs and ranks after all items; costs are kept small, so that few vectors occur."""
    vector, paid = _start(state), 0
    for item in items:
        vector = _advanced(vector, item) if isinstance(item, str) else advance(vector, item)
        least = min(c for c, _ in vector)
        if least:
            paid += least
            vector = tuple((c - least if c < _NEVER else c, r) for c, r in vector)
    return tuple((c + paid if c < _NEVER else c, r) for c, r in vector)


def backward(items, state: int) -> tuple[int, ...]:
    costs, paid = tuple(0 if s == state else _NEVER for s in _STATES), 0
    for item in reversed(items):
        costs = _retreated(costs, item) if isinstance(item, str) else retreat(costs, item)
        least = min(costs)
        if least:
            paid += least
            costs = tuple(c - least if c < _NEVER else c for c in costs)
    return tuple(c + paid if c < _NEVER else c for c in costs)


def crossings(items, start: int, end: int) -> list[int]:
    """The state after each item on the cheapest, then audit-least way from start to end."""
    out, waiting = [end] * len(items), [(0, len(items), start, end)]
    while waiting:
        a, b, first, last = waiting.pop()
        if b - a < 2:
            continue
        middle = (a + b) // 2
        ahead, behind = forward(items[a:middle], first), backward(items[middle:b], last)
        _, _, state = min((c + behind[s], r, s) for s, (c, r) in enumerate(ahead))
        out[middle - 1] = state
        waiting += [(a, middle, first, state), (middle, b, state, last)]
    return out


def tail(state: int) -> tuple[int, str]:
    """Insertions that end a conversation in order: their cost and audit."""
    paid, audit = 0, ""
    while state not in _ENDS:
        paid, audit, state = paid + INSERT, audit + "I", _NEXT[state]
    return paid, audit


def last_state(items) -> int:
    """The state after the last item on the best way to an end."""
    vector = forward(items, 0)
    return min((c + tail(s)[0], r, s) for s, (c, r) in enumerate(vector))[2]


def audits(codes, start: int, end: int) -> list[str]:
    """The edits of each message of a block."""
    out, state = [], start
    for code, to in zip(codes, crossings(codes, start, end)):
        out.append(steps(code)[state, to][1])
        state = to
    return out


def summary(codes) -> list[int]:
    """A block's table as 32 numbers: costs of its 16 ways, then the order of their audits."""
    vectors = [forward(codes, s) for s in _STATES]
    return [c for v in vectors for c, _ in v] + [r for v in vectors for _, r in v]


def _table_of(numbers) -> tuple:
    return tuple(tuple((int(numbers[4 * s + e]), int(numbers[16 + 4 * s + e])) for e in _STATES) for s in _STATES)


# The relational part -----------------------------------------------------------------------


def fault_of(text: Column, repeated: Column) -> Column:
    """``b``, ``d``, ``t`` or ``-``: the first of a message's faults."""
    solid = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    last = F.substring(solid, -1, 1)
    return (
        F.when(F.length(solid) == 0, "b").when(repeated, "d").when(last.isin(".", "!", "?"), "-").otherwise("t")
    )


def _messages(conversations: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    conv, turn, role, text = map(col, names)
    return conversations.select(
        conv.alias("conv"), turn.alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
    )


_BLOCK_FIELDS = (
    "part int, block long, turns array<{turn}>, roles array<string>, texts array<string>, codes array<string>, "
    "paths array<long>"
)


def _blocks(rows: DataFrame, kind: dict[str, str]) -> DataFrame:
    """Sorted messages cut into blocks, each with the table of its ways."""
    said = ["conv", "role", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")]
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (
        rows.select(*said, place.alias("place"))
        .groupBy("conv", "role", "h", "g")
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
        .where("n > 1")
    )
    keyed = rows.select("*", *said[2:], place.alias("place"))
    same = [keyed[c].eqNullSafe(again[c]) for c in ("conv", "role", "h", "g")]
    marked = keyed.join(again, same[0] & same[1] & same[2] & same[3], "left")
    sorted_rows = marked.select(
        keyed["conv"], keyed["turn"], keyed["role"], keyed["text"],
        # 0: said once; 1: said again, here for the first time; 2: said before, at an earlier turn
        F.when(again["n"].isNull(), 0).when(again["first"].eqNullSafe(keyed["place"]), 1).otherwise(2).alias("again"),
        fault_of(keyed["text"], F.lit(False)).alias("fault"),
    )
    order = ["conv", "turn", "role", "text"]
    sorted_rows = sorted_rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        part = TaskContext.get().partitionId()
        owner, held, previous = None, [], None
        number = size = pending = 0

        def closed():
            turns, roles, texts, codes = map(list, zip(*held))
            return owner[0], part, number, turns, roles, texts, codes, summary(codes)

        out = []
        for batch in batches:
            for conv, turn, role, text, times, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (owner[0] != conv or len(held) >= BLOCK or size >= BLOCK_BYTES):
                    out.append(closed())
                    number, held, size, pending = number + 1, [], 0, pending + size
                    if len(out) >= 1_024 or pending >= BLOCK_BYTES:
                        yield _batch(out, batch.schema)
                        out, pending = [], 0
                repeated = times == 2 or (times == 1 and (conv, turn, role, text) == previous)
                previous = (conv, turn, role, text) if times == 1 else None
                initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
                fault = "d" if repeated and fault != "b" else fault
                owner = (conv,)
                held.append((turn, role, text, initial + fault))
                size += len(text)
        if held:
            out.append(closed())
        if out:
            yield _batch(out, batch.schema)

    def _batch(out, schema):
        conv, part, number, turns, roles, texts, codes, paths = zip(*out)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(conv, schema.field(0).type), pa.array(part, pa.int32()), pa.array(number, pa.int64()),
                pa.array(turns, pa.list_(schema.field(1).type)), pa.array(roles, pa.list_(pa.string())),
                pa.array(texts, pa.list_(pa.string())), pa.array(codes, pa.list_(pa.string())),
                pa.array(paths, pa.list_(pa.int64())),
            ],
            names=["conv", "part", "block", "turns", "roles", "texts", "codes", "paths"],
        )

    return sorted_rows.mapInArrow(cut, f"conv {kind['conv']}, " + _BLOCK_FIELDS.format(turn=kind["turn"]))


def _in_order(df: DataFrame) -> DataFrame:
    """All rows of a conversation in one task, in order, to be streamed."""
    return df.repartition("conv").sortWithinPartitions("conv", "part", "block")


def _between(blocks: DataFrame, kind: dict[str, str]) -> DataFrame:
    """First and last state of each block, and whether it is its conversation's last."""

    def run(batches):
        held: list = []

        def solved():
            tables = [_table_of(paths) for *_, paths in held]
            end = last_state(tables)
            states = [0, *crossings(tables, 0, end)]
            for i, (conv, part, block, _) in enumerate(held):
                yield conv, part, block, states[i], states[i + 1], i + 1 == len(held)

        out, schema = [], None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    out += solved()
                    held = []
                held.append(row)
            if len(out) >= 8_192:
                yield _batch(out, schema)
                out = []
        if held:
            out += solved()
        if out:
            yield _batch(out, schema)

    def _batch(out, schema):
        columns = list(zip(*out))
        kinds = [*(schema.field(i).type for i in range(3)), pa.int32(), pa.int32(), pa.bool_()]
        names = ["conv", "part", "block", "first", "last", "ends"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    slim = _in_order(blocks.select("conv", "part", "block", "paths"))
    return slim.mapInArrow(run, f"conv {kind['conv']}, part int, block long, first int, last int, ends boolean")


def repaired_block(roles, texts, codes, first: int, last: int, ends: bool):
    """Audit, cost, roles and texts of one block's repair."""
    state, audit, paid, new_roles, new_texts = first, [], 0, [], []
    names = {"u": "user", "a": "assistant"}
    edits = audits(codes, first, last)
    for role, text, code, way in zip(roles, texts, codes, edits):
        for edit in way:
            if edit == "D":
                paid += DELETE
                continue
            if edit == "I":
                new_roles.append(names[_NEXT_ROLE[state]])
                new_texts.append("")
                paid += INSERT
            else:
                new_roles.append(role if edit == "K" else names[_NEXT_ROLE[state]])
                new_texts.append(text)
                paid += (REROLE if edit == "R" else KEEP) + (CUT_OFF if code[1] == "t" else 0)
            state = 1 if edit == "K" and code[0] == "s" else _NEXT[state]
        audit.append(way)
    if ends:
        more, way = tail(state)
        for _ in way:
            new_roles.append(names[_NEXT_ROLE[state]])
            new_texts.append("")
            state = _NEXT[state]
        audit.append(way)
        paid += more
    return "".join(audit), paid, new_roles, new_texts


def repair_conversations(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The repaired conversations in blocks that lie in the order of ``part`` and ``block``.

    A row has the conversation ``conv``, the original messages (``turns``, ``roles``, ``texts``;
    ``codes``: initial and first fault of each, b, d, t or -), the repaired ones (``new_roles``,
    ``new_texts``), and the block's share of ``audit`` and ``cost``. Conversations without messages
    have no row.
    """
    names = (conv_col, turn_col, role_col, text_col)
    scratch = Scratch(conversations.sparkSession, "dialogue")
    rows = _messages(conversations, names)
    kind = dict(rows.dtypes)
    blocks = scratch.keep(_blocks(rows, kind), "blocks")
    between = _between(blocks, kind)
    joined = blocks.alias("b").join(
        between.alias("s"),
        F.expr("b.conv <=> s.conv AND b.part = s.part AND b.block = s.block"),
    ).select("b.conv", "b.part", "b.block", "turns", "roles", "texts", "codes", "first", "last", "ends")

    def repair(batches):
        for batch in batches:
            done = [
                repaired_block(*row)
                for row in zip(*(batch[c].to_pylist() for c in ("roles", "texts", "codes", "first", "last", "ends")))
            ]
            audit, cost, new_roles, new_texts = zip(*done) if done else ([], [], [], [])
            strings = pa.list_(pa.string())
            kept = ["conv", "part", "block", "turns", "roles", "texts", "codes"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch[c] for c in kept], pa.array(audit, pa.string()), pa.array(cost, pa.int64()),
                    pa.array(new_roles, strings), pa.array(new_texts, strings),
                ],
                names=[*kept, "audit", "cost", "new_roles", "new_texts"],
            )

    return joined.mapInArrow(
        repair,
        f"conv {kind['conv']}, part int, block long, turns array<{kind['turn']}>, roles array<string>, "
        "texts array<string>, codes array<string>, audit string, cost long, new_roles array<string>, "
        "new_texts array<string>",
    )


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair_conversations``: counts of faults, whole ``cost``
    and ``audit``, and the sha256 of the repaired messages, streamed block by block."""
    kind = dict(repaired.dtypes)

    def run(batches):
        found, one = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if one is not None and one.conv != row[0]:
                    found.append(one.row())
                    one = None
                one = one or _Digest(row[0])
                one.add(*row[3:])
            if len(found) >= 4_096:
                yield _digest_batch(found, batch.schema)
                found = []
        if one is not None:
            yield _digest_batch([*found, one.row()], batch.schema)

    parts = repaired.select(
        "conv", "part", "block", "turns", "roles", "codes", "audit", "cost", "new_roles", "new_texts"
    )
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return _in_order(parts).mapInArrow(run, f"conv {kind['conv']}, {counts}, audit string, repaired_sha256 string")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = ("su", "ua", "au")


class _Digest:
    """Sums over the blocks of one conversation, which come in order."""

    def __init__(self, conv):
        self.conv = conv
        self.low = self.high = self.initial = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys("bdt", 0)
        self.audit: list[str] = []
        self.said, self.any = hashlib.sha256(), False

    def add(self, turns, roles, codes, audit, cost, new_roles, new_texts) -> None:
        for turn, role, code in zip(turns, roles, codes):
            if turn is not None and turn != self.high:  # turns never fall
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.turns += 1
            self.illegal += self.initial is not None and self.initial + role[:1] not in _LEGAL
            self.initial = role[:1]
            if code[1] in self.faults:
                self.faults[code[1]] += 1
        for role, text in zip(new_roles, new_texts):
            self.said.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True
        self.audit.append(audit)
        self.cost += cost

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (
            self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.said.hexdigest()
        )


def _digest_batch(rows, schema) -> pa.RecordBatch:
    kinds = [schema.field(0).type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["conv", *_COUNTS, "audit", "repaired_sha256"])
