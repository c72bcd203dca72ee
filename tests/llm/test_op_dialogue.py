"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as repo
from strayrow.llm import dialogue
from strayrow.llm.queries import damaged

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        if not solid:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("-" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cheapest, then ASCII-least edits, found by Dijkstra over (place, initials so far as a state)."""
    faults = plain_faults(rows)
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    waiting, done = [(0, "", 0, "", ())], set()
    while waiting:
        cost, audit, at, last, kept = heapq.heappop(waiting)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, kept
        if (at, last) in done:
            continue
        done.add((at, last))
        for role in ("user", "assistant"):
            if role[0] in legal[last]:
                heapq.heappush(waiting, (cost + 2, audit + "I", at, role[0], (*kept, (role, ""))))
        if at == len(rows):
            continue
        _, role, text = rows[at]
        heapq.heappush(waiting, (cost + 3, audit + "D", at + 1, last, kept))
        if faults[at] in "bd":
            continue
        more = faults[at] == "t"
        if role and role[0] in legal[last]:
            heapq.heappush(waiting, (cost + more, audit + "K", at + 1, role[0], (*kept, (role, text))))
        for new in ("user", "assistant"):
            if new[0] in legal[last]:
                heapq.heappush(waiting, (cost + 2 + more, audit + "R", at + 1, new[0], (*kept, (new, text))))
    raise AssertionError


def plain_digest(rows):
    """Of one conversation's (turn, role, text) rows in order."""
    faults = plain_faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, kept = plain_repair(rows)
    said = "\n".join(f"{r}:{t}" for r, t in kept)
    return (
        gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()
    )


def plain_damage(rows):
    """All (conv, turn, role, text) rows to conversations in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        case = zlib.crc32(key.encode()) % 20
        held = out.setdefault(conv, [])
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        held += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {conv: sorted(held, key=order) for conv, held in out.items()}


def digested(df):
    found = dialogue.digests(dialogue.repair_conversations(df)).collect()
    return {r["conv"]: tuple(r)[1:] for r in found}


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No", " ", "", "Why?", "a. \n", "b\t", "é!", None, "Yes."]
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(1, most)):
            turn = rng.choice([turn, turn, turn * 2, None]) if rng.random() < 0.3 else turn
            role = roles[turn % 2] if turn is not None and rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
    expected = {c: plain_digest(r) for c, r in plain_damage(rows).items()}
    got = repo.queries()["op13_conversation_repair"](spark, sf).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == expected
    assert len(got) == len(expected)


@pytest.mark.parametrize("block", [1, 2, 5, 2_048])
def test_random_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(dialogue, "BLOCK", block)
    rows = random_rows(block, 60, 14)
    expected = {c: plain_digest(r) for c, r in plain_damage(rows).items() if r}
    assert digested(damaged(spark.createDataFrame(rows, SCHEMA).repartition(5))) == expected


def test_long_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "BLOCK", 50)
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"text {t % 900}" + "." * rng.randint(0, 1)) for t in range(1500)]
    expected = plain_digest([r[1:] for r in rows])
    assert digested(spark.createDataFrame(rows, SCHEMA).repartition(9)) == {7: expected}


def test_halves_meet_in_the_cheapest_least_audit():
    rng = random.Random(5)
    for _ in range(300):
        codes = [rng.choice("suax") + rng.choice("--tbd") for _ in range(rng.randint(1, 9))]
        end = dialogue.last_state(codes)
        got = "".join(dialogue.audits(codes, 0, end)) + dialogue.tail(end)[1]
        rows = []
        for i, code in enumerate(codes):
            role = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}[code[0]]
            rows.append((i, role, {"-": f"{i}.", "t": f"{i}", "b": " ", "d": " "}[code[1]]))
        assert got == plain_repair(rows)[1]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert digested(empty) == {}
    long = "word " * 200_000
    rows = [(1, 0, "user", long + "."), (1, 1, "assistant", long), (2, None, None, None), (2, None, "user", "")]
    clashing = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x")).withColumn("conv", F.lit(1)).withColumn("a.b", F.lit(2))
    expected = {c: plain_digest(sorted(((t, " " if r is None else r, " " if x is None else x) for i, t, r, x in rows if i == c), key=lambda r: (r[0] or 0, r[1], r[2]))) for c in (1, 2)}
    assert digested(clashing) == expected
