"""Conversation structure repair: the cheapest edits that make the turns well formed, by shortest paths over small integer costs."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused_names

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5  # CUT: an undeleted truncated row
OK, TRUNCATED, BLANK, DUPLICATE = 0, 1, 2, 3
OTHER, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3

# What has been put out ends in: nothing, s, u, a. Well formed is (s?(ua)+)?, so it may end at nothing and at a.
STATES = 4
ENDS = (0, 3)
SPOKEN = (USER, USER, ASSISTANT, USER)  # who may speak next, but for a system turn at the start
AFTER = (2, 2, 3, 2)  # the state behind that turn
BEFORE = {2: (0, 1, 3), 3: (2,)}
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40
PART = 1 << 16  # rows of a conversation whose distances are held at once


def distances(codes: bytes, low: int, high: int, exits: list[int]) -> array:
    """The least cost from (row, state) to the end, of the rows low to high, where exits are those of the states behind row high.

    Dial's algorithm from the exits backwards: costs are small integers, so the open nodes lie in buckets by distance, which are taken in turn and need no
    heap. It ends when the four nodes before row low are settled: what is farther lies on no cheapest path.
    """
    found = array("q", [FAR]) * (STATES * (high - low + 1))
    base, last = min(exits), STATES * (high - low)
    buckets: list[list[int]] = []

    def reach(node: int, cost: int) -> None:
        if cost < found[node]:
            found[node] = cost
            while len(buckets) <= cost - base:
                buckets.append([])
            buckets[cost - base].append(node)

    for state, cost in enumerate(exits):
        if cost < FAR:
            reach(last + state, cost)
    at, open_ = 0, STATES
    while at < len(buckets) and open_:
        cost = base + at
        for node in buckets[at]:
            if found[node] != cost:
                continue
            if node < STATES:
                open_ -= 1
            state = node % STATES
            for past in BEFORE.get(state, ()):
                reach(node - state + past, cost + INSERT)
            if node < STATES:
                continue
            code = codes[low + node // STATES - 1]
            kind, who, row = code >> 2, code & 3, node - state - STATES
            reach(row + state, cost + DELETE)
            if kind >= BLANK:
                continue
            more = cost + CUT * (kind == TRUNCATED)
            if state == 1:
                if who == SYSTEM:
                    reach(row, more + KEEP)
            elif state:
                price = KEEP if who == SPOKEN[BEFORE[state][0]] else REROLE
                for past in BEFORE[state]:
                    reach(row + past, more + price)
        buckets[at] = []
        at += 1
    return found


def walk(codes: bytes, low: int, high: int, states: set[int], found: array, final: bool) -> tuple[str, set[int]]:
    """The least letters in ASCII along arcs that lose no distance, from all of the states at once, and the states behind row high.

    Letters fix the rows they use and what they cost, so all states that one prefix reaches have the same distance left.
    """
    out, row = [], low
    while row < high or (final and any(found[STATES * (high - low) + s] for s in states)):
        at = STATES * (row - low)
        behind = at + STATES
        code = codes[row] if row < high else BLANK << 2
        kind, who = code >> 2, code & 3
        more = CUT * (kind == TRUNCATED)
        if row < high and (to := {s for s in states if found[at + s] == found[behind + s] + DELETE}):
            out.append("D")
            row += 1
        elif to := {AFTER[s] for s in states if found[at + s] == found[at + AFTER[s]] + INSERT}:
            out.append("I")
        else:
            kept = {(s, AFTER[s]) for s in states if who == SPOKEN[s]} | ({(0, 1)} if who == SYSTEM and 0 in states else set())
            to = {t for s, t in kept if found[at + s] == found[behind + t] + KEEP + more}
            letter = "K"
            if not to:
                to, letter = {AFTER[s] for s in states if found[at + s] == found[behind + AFTER[s]] + REROLE + more}, "R"
            out.append(letter)
            row += 1
        states = to
    return "".join(out), states


def cheapest(codes: bytes) -> tuple[int, str]:
    """The cost and the audit of a conversation's codes (kind * 4 + speaker). Distances are held for PART rows at a time; those at the borders are kept."""
    n = len(codes)
    borders = [*range(0, n, PART), n] if n else [0, 0]
    exits = [[0 if s in ENDS else FAR for s in range(STATES)]]
    whole = None
    for low, high in zip(borders[-2::-1], borders[:0:-1], strict=True):
        whole = distances(codes, low, high, exits[-1])
        exits.append(whole[:STATES].tolist())
    exits.reverse()
    audit, states = [], {0}
    for k, (low, high) in enumerate(zip(borders, borders[1:], strict=False)):
        found = whole if k == 0 else distances(codes, low, high, exits[k + 1])
        letters, states = walk(codes, low, high, states, found, high == n)
        audit.append(letters)
    return exits[0][0], "".join(audit)


class Conversation:
    """One conversation as its rows go by: first all rows' codes, turns and digests, then, when the edits are known, their texts."""

    def __init__(self, key):
        self.key, self.codes, self.digests, self.audit = key, bytearray(), bytearray(), None
        self.low = self.high = self.turn = None
        self.turns = self.illegal = self.at = self.state = self.place = 0
        self.sha = hashlib.sha256()

    def note(self, code: int, turn: int | None, digest: bytes, copies: int) -> None:
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            self.turns += 1
        for _ in range(copies):
            if self.codes and (self.codes[-1] & 3, code & 3) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
                self.illegal += 1
            self.codes.append(code)
            self.digests += digest

    def solve(self) -> None:
        codes = np.frombuffer(bytes(self.codes), np.uint8).copy()
        again = np.ones(len(codes), bool)
        if len(codes):
            again[np.unique(np.frombuffer(bytes(self.digests), "S16"), return_index=True)[1]] = False
        self.digests = bytearray()
        again &= codes >> 2 != BLANK
        codes[again] = DUPLICATE << 2 | codes[again] & 3
        self.counts = np.bincount(codes >> 2, minlength=4).tolist()
        self.codes = codes.tobytes()
        self.cost, self.audit = cheapest(self.codes)

    def put(self, role: str, text: str) -> tuple[int, str, str]:
        self.sha.update(f"{chr(10) * bool(self.place)}{role}:{text}".encode())
        self.place += 1
        return self.place, role, text

    def inserted(self) -> Iterator[tuple]:
        """What the audit inserts before the next row."""
        if self.audit is None:
            self.solve()
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield *self.put(NAMES[SPOKEN[self.state]], ""), "I"
            self.state = AFTER[self.state]

    def edited(self, code: int, role: str, text: str, copies: int) -> Iterator[tuple]:
        for _ in range(copies):
            yield from self.inserted()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                yield *self.put(role, text), letter
                self.state = 1 if code & 3 == SYSTEM else AFTER[self.state]
            elif letter == "R":
                yield *self.put(NAMES[SPOKEN[self.state]], text), letter
                self.state = AFTER[self.state]

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.key, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.cost, self.audit, self.sha.hexdigest())


def _rows(conversations: DataFrame, present: Column | None, copies: Column | None, key: str) -> tuple[DataFrame, str]:
    """Every row twice, first without and then with its text, by conversation in order of turn (nulls first), role and digest."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    body = F.rtrim(text, F.lit(SPACE))
    kind = F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    who = F.when(role.startswith("s"), SYSTEM).when(role.startswith("u"), USER).when(role.startswith("a"), ASSISTANT).otherwise(OTHER)
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    light, full = F.struct(F.lit(0).alias("part"), F.lit(None).cast("string").alias("text")), F.struct(F.lit(1).alias("part"), text.alias("text"))
    flat = conversations.select(
        F.col(key).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.when(there, kind * 4 + who).otherwise(-1).alias("code"),
        (F.lit(1) if copies is None else copies).alias("copies"),
        # one inline takes the place of a union, which would read the input twice
        F.inline(F.when(there, F.array(light, full)).otherwise(F.array(light))),
    )
    kind_of_key = conversations.schema[key].dataType.simpleString()
    return flat.repartition("key").sortWithinPartitions("key", "part", F.col("turn").asc_nulls_first(), "role", "digest"), kind_of_key


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Conversation, list | None]]:
    """The conversations in turn: with each of its rows' output, and at its end with None."""
    now = None
    for batch in batches:
        cells = batch.to_pydict()
        for key, _part, turn, role, digest, code, copies, text in zip(*(cells[c] for c in ("key", "part", "turn", "role", "digest", "code", "copies", "text")), strict=True):
            if now is None or now.key != key:
                if now is not None:
                    yield now, list(now.inserted())
                    yield now, None
                now = Conversation(key)
            if code < 0:
                continue
            if text is None:
                now.note(code, turn, digest, copies)
            else:
                yield now, list(now.edited(code, role, text, copies))
    if now is not None:
        yield now, list(now.inserted())
        yield now, None


def _batches(batches: Iterable[pa.RecordBatch], names: list[str], types: list[pa.DataType], rows_of, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the rows that rows_of(conversation, output) gives; the first column is of the key's type."""
    key: list[pa.DataType] = []
    held: list[tuple] = []

    def seen() -> Iterator[pa.RecordBatch]:
        for b in batches:
            key[:] = [b.schema.field("key").type]
            yield b

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), key + types, strict=True)], names)

    for conversation, output in _stream(seen()):
        held.extend(rows_of(conversation, output))
        if len(held) >= most:
            yield table()
            held.clear()
    if held:
        yield table()


def audits(conversations: DataFrame, present: Column | None = None, copies: Column | None = None, key: str = "conv_id") -> DataFrame:
    """Per conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of the columns key, turn, role and text.

    A row has at most one fault: blank (no character but white space), duplicate (role and text came earlier) or truncated (ends in none of .!?). Rows
    are kept (0), given the role user or assistant (1) or deleted (2, which blank and duplicate ones must be); empty turns may be inserted (5); undeleted
    truncated rows cost 5 more. The roles' initials must then read (s?(ua)+)?. The audit holds the letters of the cheapest edits, of several the least.

    present tells which rows count; a conversation of which none does still has its row, of zeros. copies is how often a row is read, at once. Null role
    and text are one space; null turns come first; rows of one turn come by role, then by a digest of the text; a null key is a conversation like others.
    An empty table gives no rows. Other columns are not read.

    One shuffle carries each row's text once. The rows of a conversation pass through a task in order, first without texts: that leaves 17 bytes a row,
    from which the edits are found; then with texts, which are digested as they pass. So a task holds no conversation's texts, however long it is; its
    audit and its digest are one value and one stream by definition.
    """
    names = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [*[pa.int64()] * 6, pa.string(), pa.string()]
    rows, kind = _rows(conversations, present, copies, key)
    found = rows.mapInArrow(lambda batches: _batches(batches, names, types, lambda c, out: [c.summary()] if out is None else []), f"key {kind}, {', '.join(f'{n} long' for n in names[1:7])}, audit string, repaired_sha256 string")
    return found.withColumnRenamed("key", key)


def repaired(conversations: DataFrame, present: Column | None = None, copies: Column | None = None, key: str = "conv_id") -> DataFrame:
    """The turns after the edits of audits(): key, place (from 1 in each conversation), role, text and edit (K, R or I)."""
    names, types = ["key", "place", "role", "text", "edit"], [pa.int64(), pa.string(), pa.string(), pa.string()]
    rows, kind = _rows(conversations, present, copies, key)
    found = rows.mapInArrow(lambda batches: _batches(batches, names, types, lambda c, out: [(c.key, *r) for r in out or ()]), f"key {kind}, place long, role string, text string, edit string")
    return found.withColumnRenamed("key", key)


def damaged(conversations: DataFrame, key: str = "conv_id") -> tuple[DataFrame, Column, Column]:
    """A copy of the table with planted faults, by the CRC-32 of `key:turn` modulo 20, with the columns for present and copies of audits().

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    (fault,) = unused_names(conversations, "fault")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = conversations.withColumn(fault, F.crc32(F.concat(blank(key), F.lit(":"), blank("turn")).cast("binary")) % 20)
    how = F.col(fault)
    text = F.when(how == 1, "").when(how == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    out = out.withColumns({"text": text, "role": F.when(how == 4, "user").otherwise(blank("role"))})
    return out, how != 0, F.when(how == 3, 2).otherwise(1)
