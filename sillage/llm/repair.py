r"""Conversation structure repair: the cheapest edits that make a conversation `(s?(ua)+)?` by its role initials.

Rows and states of that pattern span a DAG of edits: keep, rerole, delete a row, or insert one. An arc is on a cheapest
path if the least cost to its start, its own and the least cost from its end on add up to the least of all. From the
start, the frontier, a set of nodes, takes the least letter of its tight arcs at each step. Least costs depend on the row
and its neighbour's only, relative to their minimum, so few distinct ones exist; they are kept by number.

A conversation is sorted and streamed twice through one task: first narrow rows, of which three bytes each are kept,
give the edits; then the rows with their texts go by, so a conversation need not fit in memory. Which rows repeat an
earlier one is found beforehand by an aggregation, whatever the number of rows that share a text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of the edits; what an undeleted truncated row adds; the white space of the contract; pairs of initials that
#: may follow each other; characters of a text that order rows of one turn and role.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
TIE = 64
#: States: nothing yet, after system, after user, after assistant; the state after a row of an initial.
_START, _SYSTEM, _USER, _ASSISTANT = STATES = range(4)
_NEXT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: The state that the one of user and assistant that may follow leads to; the role that leads there.
_TURN = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_FAR = 1 << 40
#: A row as one byte: its initial (0: none of the pattern), and what its fault asks for.
_INITIALS = "-sua"
_MUST_DELETE, _IS_TRUNCATED = 4, 8

Costs = tuple[int, ...]


@lru_cache(maxsize=None)  # 16 codes, 4 states
def _arcs(code: int, q: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, state) of the arcs from state q that use up a row."""
    out = [("D", DELETE, q)]
    if not code & _MUST_DELETE:
        more = TRUNCATED if code & _IS_TRUNCATED else 0
        if (to := _NEXT.get((q, _INITIALS[code & 3]))) is not None:
            out.append(("K", KEEP + more, to))
        out.append(("R", REROLE + more, _TURN[q]))
    return tuple(out)


def _relative(costs: list[int]) -> tuple[int, Costs]:
    least = min(costs)
    return least, tuple(min(c - least, _FAR) for c in costs)


def _insert_before(cost: Iterable[int]) -> list[int]:
    """Least costs to the end where rows may be inserted first; more than two at one place never pay."""
    cost = list(cost)
    return [min(cost[q], INSERT + cost[_TURN[q]], 2 * INSERT + cost[_TURN[_TURN[q]]]) for q in STATES]


def _insert_after(cost: Iterable[int]) -> list[int]:
    """Least costs from the start where rows may be inserted last."""
    cost = list(cost)
    for _ in range(2):
        cost = [min([cost[q], *(INSERT + cost[p] for p in STATES if _TURN[p] == q)]) for q in STATES]
    return cost


@lru_cache(maxsize=65_536)
def _back(code: int, after: Costs) -> tuple[int, Costs]:
    """Least costs to the end from before a row, given those from after it: the least, and the rest above it."""
    return _relative(_insert_before(min(c + after[to] for _, c, to in _arcs(code, q)) for q in STATES))


@lru_cache(maxsize=65_536)
def _fore(code: int, before: Costs) -> tuple[int, Costs]:
    """Least costs from the start to after a row, given those to before it."""
    out = [4 * _FAR] * 4
    for q in STATES:
        for _, c, to in _arcs(code, q):
            out[to] = min(out[to], before[q] + c)
    return _relative(_insert_after(out))


def edits(codes: bytes) -> tuple[int, str]:
    """The least cost of making the rows legal, and the letters of the cheapest edits, the least in ASCII of all."""
    n = len(codes)
    last, rel = _relative(_insert_before([0, _FAR, _FAR, 0]))
    numbers: dict[Costs, int] = {rel: 0}
    at = array("H", bytes(2 * (n + 1)))  # the number of the costs from each row on
    total = last
    for i in range(n - 1, -1, -1):
        more, rel = _back(codes[i], rel)
        total += more
        at[i] = numbers.setdefault(rel, len(numbers))
    to_end = list(numbers)
    back = total  # least cost to the end from any state before row i
    total += rel[_START]
    first, fore_rel = _relative(_insert_after([0, _FAR, _FAR, _FAR]))
    fore, letters, frontier, i = first, bytearray(), {_START}, 0
    while True:
        here = to_end[at[i]]
        if i == n and frontier & {_START, _ASSISTANT} and any(fore + fore_rel[q] == total for q in frontier & {_START, _ASSISTANT}):
            return total, letters.decode()
        tight = [("I", _TURN[q]) for q in frontier if fore + fore_rel[q] + INSERT + back + here[_TURN[q]] == total]
        if i < n:
            code = codes[i]
            next_back, there = back - _back(code, to_end[at[i + 1]])[0], to_end[at[i + 1]]
            tight += [(x, to) for q in frontier for x, c, to in _arcs(code, q) if fore + fore_rel[q] + c + next_back + there[to] == total]
        letter = min(tight)[0]
        frontier = {to for x, to in tight if x == letter}
        letters += letter.encode()
        if letter != "I":
            more, fore_rel = _fore(code, fore_rel)
            fore, back, i = fore + more, next_back, i + 1


class Row(NamedTuple):
    """What an edit makes of a row: its letter, fault ('' for none), and its role and text, null where it is deleted."""

    edit: str
    fault: str
    role: str | None
    text: str | None


class Audit(NamedTuple):
    gaps: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    cost: int
    audit: str


FAULTS = ("", "blank", "duplicate", "truncated")


class _Scan:
    """The first pass over a conversation: a byte for each row, its counts, its edits."""

    def __init__(self) -> None:
        self.codes, self.faults = bytearray(), bytearray()
        self.last_initial, self.fresh, self.low, self.turn, self.turns, self.illegal = None, None, None, None, 0, 0

    def add(self, key: tuple, kind: int, role: str, blank: bool, truncated: bool) -> None:
        if kind == 0:
            self.fresh = key
            return
        fault = 1 if blank else 2 if key != self.fresh else 3 if truncated else 0
        self.fresh = None if key == self.fresh else self.fresh
        initial = role[:1]
        code = max(_INITIALS.find(initial, 1), 0) if initial else 0
        self.codes.append(code | (_MUST_DELETE if fault in (1, 2) else _IS_TRUNCATED if fault == 3 else 0))
        self.faults.append(fault)
        if self.last_initial is not None and self.last_initial + initial not in LEGAL:
            self.illegal += 1
        self.last_initial = initial
        if (turn := key[0]) is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn, self.turns = turn, self.turns + 1

    def audit(self) -> Audit:
        cost, letters = edits(bytes(self.codes))
        gaps = self.turn - self.low + 1 - self.turns if self.turns else 0
        return Audit(gaps, *(self.faults.count(k) for k in (1, 2, 3)), self.illegal, cost, letters)


def _repaired(audit: str, faults: bytes, texts: Iterator[tuple[str, str]]) -> Iterator[Row]:
    """The rows of a conversation and the inserted ones, in order, as the letters have it."""
    q, k = _START, 0
    for letter in audit:
        if letter == "I":
            q = _TURN[q]
            yield Row("I", "", _ROLE[q], "")
            continue
        role, text = next(texts)
        fault, k = FAULTS[faults[k]], k + 1
        if letter == "D":
            yield Row("D", fault, None, None)
        elif letter == "K":
            q = _NEXT[q, role[:1]]
            yield Row("K", fault, role, text)
        else:
            q = _TURN[q]
            yield Row("R", fault, _ROLE[q], text)


def _scanned(items: Iterator[tuple]) -> Iterator[tuple[int | None, Audit, Iterator[Row]]]:
    """Sorted items to (conv_id, audit, rows); rows must be used up before the next conversation is asked for."""
    item = next(items, None)
    while item is not None:
        conv, scan = item[0], _Scan()
        while item is not None and item[0] == conv and item[1] == 0:
            _, _, turn, role, _, digest, kind, blank, truncated, _ = item
            if kind < 2:
                scan.add((turn, role, digest), kind, role, blank, truncated)
            item = next(items, None)
        audit = scan.audit()

        def texts() -> Iterator[tuple[str, str]]:
            nonlocal item
            while item is not None and item[0] == conv:
                yield item[3], item[9]
                item = next(items, None)

        left = texts()
        yield conv, audit, _repaired(audit.audit, bytes(scan.faults), left)
        for _ in left:
            pass


def _items(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Of each conversation, in order: the narrow rows (kind 1), each (role, text) announced before its first row
    (kind 0), one item for the conversation itself (kind 2); then the rows with their texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    trimmed = F.rtrim("text", F.lit(SPACE))
    rows = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    rows = rows.withColumns({
        "tie": F.substring("text", 1, TIE), "digest": F.unhex(F.sha2("text", 256)),
        "blank": trimmed == "", "truncated": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"),
    })
    none: Column = F.lit(None)
    narrow = [none.cast("string").alias("text")]
    base = ["turn", "role", "tie", "digest"]
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "tie")).alias("t"))
    flags = [F.lit(False).alias("blank"), F.lit(False).alias("truncated")]
    as_item = lambda df, phase, kind, *more: df.select("conv_id", F.lit(phase).alias("phase"), *base, F.lit(kind).alias("kind"), *more)
    nothing = [none.cast("bigint").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("tie"), none.cast("binary").alias("digest")]
    return (
        as_item(rows, 0, 1, "blank", "truncated", *narrow)
        .unionByName(as_item(first.select("conv_id", "t.turn", "role", "t.tie", "digest"), 0, 0, *flags, *narrow))
        .unionByName(as_item(ids.select(F.col("conv_id").cast("bigint")).distinct().select("conv_id", *nothing), 0, 2, *flags, *narrow))
        .unionByName(as_item(rows, 1, 1, "blank", "truncated", "text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "phase", *base, "kind")
    )


def _run(items: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64() if c.split()[1] == "bigint" else pa.string() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        block: list[tuple] = []
        for row in rows_of(_scanned(read)):
            block.append(row)
            if len(block) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], names=names)
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], names=names)

    return items.mapInArrow(run, schema)


def repair_turns(rows: DataFrame) -> DataFrame:
    """One row for each row of (conv_id, turn, role, text) and each inserted one: conv_id, position (from 0, in order of
    the edits), edit (K, R, D or I), fault (blank, duplicate, truncated or none), role and text after the repair, null
    where the row is deleted. Rules for nulls, ties and repeats as in repair_digests()."""

    def out(found):
        for conv, _, repaired in found:
            for i, r in enumerate(repaired):
                yield (conv, i, *r)

    return _run(_items(rows, rows), "conv_id bigint, position bigint, edit string, fault string, role string, text string", out)


def repair_digests(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation of
    rows, and for each of ids, which may have none left.

    Rows go by turn, null first; rows of one turn by role, then by the first TIE characters of their text, then by its
    digest. Null roles and texts count as one space, a null conv_id is a conversation of its own. Rows that repeat are
    duplicates, adjacent or not. A role of another initial than s, u and a, or an empty one, is never kept. A long
    conversation, or one with most of the rows, is streamed: a task keeps three bytes of each of its rows. Further
    columns are ignored; an empty table gives no rows.
    """

    def out(found):
        for conv, audit, repaired in found:
            sha, start = hashlib.sha256(), ""
            for r in repaired:
                if r.role is not None:
                    sha.update(f"{start}{r.role}:{r.text}".encode())
                    start = "\n"
            yield (conv, *audit, sha.hexdigest())

    schema = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return _run(_items(rows, rows if ids is None else ids), schema, out)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), nulls of the last two as one space, damaged by crc32(`conv_id:turn`) % 20: 0 drops a
    row, 1 empties its text, 2 takes `.`, `!` and `?` from it, 3 repeats it, 4 makes its role user. A null id or turn is
    one space in that key."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(hit == 4, "user").otherwise(part("role"))
    copies = F.sequence(F.lit(1), F.when(hit == 3, 2).otherwise(1))
    return rows.where(hit != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
