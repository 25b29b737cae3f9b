"""Repair of the turn structure of conversations by checkpointed dynamic programming.

A conversation's rows are kept (cost 0), given the role user or assistant (2) or deleted (3, the only choice for blank
and repeated rows), and empty turns are inserted (2), so that the role initials read ``(s?(ua)+)?``; truncated rows that
stay add 1. Of the cheapest edit lists the ASCII-least (D < I < K < R) counts.

The pattern is an automaton of four states. A vector of four costs, one for each state before a row, tells what the
rest of the conversation takes; it follows from the vector behind the row. Vectors are kept at every square root of the
rows only. The way forward recomputes the vectors between two of them and emits, at each step, the least edit that is
tight. Vectors less their least element are few, so a step is one look-up in a table that fills itself.

Spark sorts rows by conversation and turn into ranges, so a conversation with a third of all rows spreads over many
tasks. A task solves the conversations that begin and end in its range at once. Of the others (two for each task, and
those longer than a block) it writes blocks of bounded size. Each block then gives a matrix of four by four costs;
products from the end give the vector behind every block, walks from all four states give the state before it, and
blocks emit their edits independently. Rows that repeat one of an earlier block are found by digest. Only the last step,
one SHA-256 over all repaired rows, is sequential by definition: its task streams the blocks and holds one at a time.

Defined results: rows with equal turns go by role and then by the SHA-256 of role and text; a null turn comes before all
others; a null conv_id is a conversation; null roles and texts count as one blank; a row whose role is empty or has
another initial fits nowhere as it is; ``gaps`` beyond a long is the greatest long; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.storage import materialise, stable

Vector = tuple[int, int, int, int]
#: States: nothing yet, after s, after u, after a. Where initials lead; where an added or renamed turn leads, and its role.
NEXT: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ADDED, ROLES = (2, 2, 3, 2), ("user", "user", "assistant", "user")
RENAME, INSERT, DELETE, TRUNCATED = 2, 2, 3, 1
FAR = 1 << 50
#: Rows and bytes of text of a block of a conversation.
BLOCK_ROWS, BLOCK_BYTES = 4096, 2_000_000
#: Bits of a row's code: blank or repeated (must go), truncated; above them its initial.
GONE, CUT = 1, 2
INITIALS = ("s", "u", "a", "")

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
BLOCK = "seq long, rows long, low long, high long, turns long, codes binary, digests array<binary>, roles array<string>, texts array<string>"
PART = "conv_id long, seq long, rows long, low long, high long, turns long, first string, last string, illegal long, blank long, duplicate long, truncated long, cost long, audit string, body string"
_LONG = (1 << 63) - 1


def _closed(b: list[int]) -> Vector:
    two, three = min(b[2], INSERT + b[3]), min(b[3], INSERT + b[2])
    return min(b[0], INSERT + two), min(b[1], INSERT + two), two, three


END = _closed([0, FAR, FAR, 0])


@lru_cache(None)
def _before(after: Vector, code: int) -> tuple[Vector, int]:
    """The vector before a row, less its least element, and that element."""
    b = [DELETE + x for x in after]
    if not code & GONE:
        extra, initial = TRUNCATED * bool(code & CUT), INITIALS[code >> 2]
        for q in range(4):
            b[q] = min(b[q], RENAME + extra + after[ADDED[q]])
            if initial in NEXT[q]:
                b[q] = min(b[q], extra + after[NEXT[q][initial]])
    c = _closed(b)
    least = min(c)
    return tuple(FAR if x >= FAR else x - least for x in c), least


@lru_cache(None)
def _step(state: int, code: int, after: Vector) -> tuple[str, int, int, tuple[str, ...]]:
    """The least tight edits up to and with a row's own: letters, the state after them, cost, roles of turns (the row's own last)."""
    now, less = _before(after, code)
    cost, letters, roles = 0, "", []
    while True:
        rest = now[state] + less
        if rest == DELETE + after[state]:
            return letters + "D", state, cost + DELETE, tuple(roles)
        if rest == INSERT + now[ADDED[state]] + less:
            letters, cost = letters + "I", cost + INSERT
            roles.append(ROLES[state])
            state = ADDED[state]
            continue
        extra, initial = TRUNCATED * bool(code & CUT), INITIALS[code >> 2]
        if initial in NEXT[state] and rest == extra + after[NEXT[state][initial]]:
            return letters + "K", NEXT[state][initial], cost + extra, (*roles, "")
        return letters + "R", ADDED[state], cost + RENAME + extra, (*roles, ROLES[state])


def _vectors(codes: bytes, after: Vector) -> list[Vector]:
    """Vectors before every row and behind the last, each less its least element."""
    out = [after]
    for code in reversed(codes):
        after = _before(after, code)[0]
        out.append(after)
    return out[::-1]


def edits(codes: bytes, after: Vector, state: int) -> Iterator[tuple[str, int, int, tuple[str, ...]]]:
    """``_step`` of every row, from vectors kept at every square root of the rows."""
    size = max(1, math.isqrt(len(codes)))
    marks = list(range(0, len(codes), size))
    kept = {len(codes): after}
    for lo in reversed(marks):
        hi = min(len(codes), lo + size)
        vector = kept[hi]
        for code in reversed(codes[lo:hi]):
            vector = _before(vector, code)[0]
        kept[lo] = vector
    for lo in marks:
        hi = min(len(codes), lo + size)
        for code, behind in zip(codes[lo:hi], _vectors(codes[lo:hi], kept[hi])[1:], strict=True):
            found = _step(state, code, behind)
            state = found[1]
            yield found


def _tail(state: int) -> tuple[str, int, list[str]]:
    """Turns to insert behind the last row."""
    letters, roles = "", []
    while state in (1, 2):
        letters += "I"
        roles.append(ROLES[state])
        state = ADDED[state]
    return letters, INSERT * len(letters), roles


def matrix(codes: bytes) -> list[int]:
    """Costs through the rows from each state (row) to each state (column); inserts before rows only."""
    out = [0] * 16
    for q in range(4):
        vector, total = tuple(0 if x == q else FAR for x in range(4)), 0
        for code in reversed(codes):
            vector, less = _before(vector, code)
            total += less
        for p in range(4):
            out[4 * p + q] = min(FAR, vector[p] + total)
    return out


def coded(codes: bytes, digests: list[bytes], seen: set[bytes]) -> tuple[bytes, int, int, int]:
    """Codes with repeated rows marked; numbers of blank, repeated and truncated rows by first fault. ``seen`` gets the digests."""
    out, blank, duplicate, truncated = bytearray(codes), 0, 0, 0
    for i, (code, digest) in enumerate(zip(codes, digests, strict=True)):
        if code & GONE:
            blank += 1
        elif digest in seen:
            duplicate += 1
            out[i] |= GONE
        else:
            truncated += bool(code & CUT)
        seen.add(digest)
    return bytes(out), blank, duplicate, truncated


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _emit(codes: bytes, roles: list[str], texts: list[str], after: Vector, state: int, last: bool) -> tuple[int, str, str]:
    """Cost, audit and repaired rows of a block."""
    cost, audit, lines = 0, [], []
    for (letters, state, took, turns), role, text in zip(edits(codes, after, state), roles, texts, strict=True):
        cost += took
        audit.append(letters)
        if turns:
            inserted = turns if letters[-1] == "D" else turns[:-1]
            lines.extend(x + ":" for x in inserted)
            if letters[-1] != "D":
                lines.append(f"{turns[-1] or role}:{text}")
    if last:
        letters, took, turns = _tail(state)
        cost, lines = cost + took, lines + [x + ":" for x in turns]
        audit.append(letters)
    return cost, "".join(audit), "\n".join(lines)


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(_LONG, high - low + 1 - turns)


class _Open:
    """Rows of the block that is being read."""

    def __init__(self) -> None:
        self.codes, self.digests, self.roles, self.texts = bytearray(), [], [], []
        self.bytes = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, code: int, digest: bytes) -> None:
        self.codes.append(code)
        self.digests.append(digest)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def solved(self, conv_id: int | None) -> tuple:
        codes, blank, duplicate, truncated = coded(bytes(self.codes), self.digests, set())
        cost, audit, body = _emit(codes, self.roles, self.texts, END, 0, True)
        illegal = _illegal([x[:1] for x in self.roles])
        return (conv_id, _gaps(self.low, self.high, self.turns), blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())

    def block(self, seq: int) -> tuple:
        return (seq, len(self.codes), self.low, self.high, self.turns, bytes(self.codes), self.digests, self.roles, self.texts)


def _fields(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that begin and end in this range, blocks of the others."""
    fields, part, number = _fields(f"{RESULT}, {BLOCK}"), TaskContext.get().partitionId(), 0
    none, blank = (None,) * len(BLOCK.split(", ")), (None,) * (len(RESULT.split(", ")) - 1)
    rows: list[tuple] = []
    conv, now, whole, begun = None, _Open(), False, False

    def close(end: bool) -> None:
        nonlocal number
        if begun and whole and end:
            rows.append(now.solved(conv) + none)
        elif begun:
            rows.append((conv, *blank, *now.block(part << 33 | number)))
            number += 1

    for b in batches:
        for conv_id, turn, role, text, code, digest, present in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not begun or conv_id != conv:
                close(True)
                conv, now, whole, begun = conv_id, _Open(), begun, True  # the first of a range may have begun before it
            elif len(now.codes) >= BLOCK_ROWS or now.bytes >= BLOCK_BYTES:
                whole = False
                close(False)
                now = _Open()
            if present:
                now.add(turn, role, text, code, digest)
        if rows:
            yield _batch(rows, fields)
            rows = []
    whole = False  # the last may go on behind it
    close(False)
    yield _batch(rows, fields)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of blocks with repeated rows marked, fault counts and the block's matrix."""
    fields = _fields(MARKED)
    for b in batches:
        rows = []
        for conv_id, seq, codes, digests, earlier in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found, blank, duplicate, truncated = coded(codes, digests, set(earlier or ()))
            rows.append((conv_id, seq, found, blank, duplicate, truncated, matrix(found)))
        yield _batch(rows, fields)


MARKED = "conv_id long, seq long, codes binary, blank long, duplicate long, truncated long, matrix array<long>"
BEHIND = "seq long, after array<long>, last long"
GOES = "conv_id long, seq long, goes array<long>"


def _behind(table: pa.Table) -> pa.Table:
    """Of one conversation: the vector behind each of its blocks, from a row per block."""
    blocks = sorted(zip(table["seq"].to_pylist(), table["matrix"].to_pylist(), strict=True), reverse=True)
    after, rows = list(END), []
    for k, (seq, m) in enumerate(blocks):
        rows.append((seq, after, int(k == 0)))
        after = [min(m[4 * p + q] + after[q] for q in range(4)) for p in range(4)]
        after = [min(FAR, x - min(after)) for x in after]
    return pa.Table.from_batches([_batch(rows, _fields(BEHIND))])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the tight way through a block leads from each state."""
    fields = _fields(GOES)
    for b in batches:
        rows = []
        for conv_id, seq, codes, after in zip(*(c.to_pylist() for c in b.columns), strict=True):
            goes = []
            for state in range(4):
                for found in edits(codes, tuple(after), state):
                    state = found[1]
                goes.append(state)
            rows.append((conv_id, seq, goes))
        yield _batch(rows, fields)


def _entered(table: pa.Table) -> pa.Table:
    """Of one conversation: the state before each of its blocks, from a row per block."""
    state, rows = 0, []
    for seq, goes in sorted(zip(table["seq"].to_pylist(), table["goes"].to_pylist(), strict=True)):
        rows.append((seq, state))
        state = goes[state]
    return pa.Table.from_batches([_batch(rows, _fields("seq long, state long"))])


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and repaired rows of each block."""
    fields = _fields(PART)
    for b in batches:
        rows = []
        for r in b.to_pylist():
            initials = [x[:1] for x in r["roles"]]
            cost, audit, body = _emit(r["codes"], r["roles"], r["texts"], tuple(r["after"]), r["state"], bool(r["last"]))
            ends = (initials[0], initials[-1]) if initials else (None, None)
            rows.append((r["conv_id"], r["seq"], r["rows"], r["low"], r["high"], r["turns"], *ends, _illegal(initials), r["blank"], r["duplicate"], r["truncated"], cost, audit, body))
        yield _batch(rows, fields)


class _Total:
    """One conversation's blocks, in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.hash, self.audit, self.any = conv_id, hashlib.sha256(), [], False
        self.low = self.high = self.initial = None
        self.turns, self.sums = 0, [0] * 5

    def add(self, r: dict) -> None:
        self.sums = [a + r[k] for a, k in zip(self.sums, ("blank", "duplicate", "truncated", "illegal", "cost"), strict=True)]
        self.audit.append(r["audit"])
        if r["body"]:
            self.hash.update((("\n" if self.any else "") + r["body"]).encode())
            self.any = True
        if r["low"] is not None:
            self.turns += r["turns"] - (r["low"] == self.high)
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
        if r["first"] is not None:
            self.sums[3] += self.initial is not None and self.initial + r["first"] not in ("su", "ua", "au")
            self.initial = r["last"]

    def row(self) -> tuple:
        return (self.conv_id, _gaps(self.low, self.high, self.turns), *self.sums, "".join(self.audit), self.hash.hexdigest())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose blocks come one after another."""
    fields, total = _fields(RESULT), None
    for b in batches:
        rows = []
        for r in b.to_pylist():
            if total is None or r["conv_id"] != total.conv_id:
                if total is not None:
                    rows.append(total.row())
                total = _Total(r["conv_id"])
            total.add(r)
        yield _batch(rows, fields)
    if total is not None:
        yield _batch([total.row()], fields)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def repair(rows: DataFrame, present: str | None = None) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): RESULT's columns.

    Rows whose column ``present`` is false only name their conversation.
    """
    there = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), there.alias("present"))
    last = F.right(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), F.lit(1))  # blanks only: empty
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) * 4 + F.when(last == "", GONE).when(last.isin(".", "!", "?"), 0).otherwise(CUT)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = stable(rows.withColumns({"code": code.cast("int"), "digest": digest}).select("conv_id", "turn", "role", "text", "code", "digest", "present"))
    order = ["conv_id", "turn", "role", "digest"]
    ranges = rows.repartitionByRange(*order, F.xxhash64(F.monotonically_increasing_id()))  # equal rows may part
    read = materialise(ranges.sortWithinPartitions(*order).mapInArrow(_read, f"{RESULT}, {BLOCK}"), "conversations")
    names = [x.split()[0] for x in RESULT.split(", ")]
    solved, blocks = read.where("seq IS NULL").select(*names), read.where("seq IS NOT NULL")

    seen = blocks.select("conv_id", "seq", F.explode(F.array_distinct("digests")).alias("digest"))
    earlier = seen.withColumn("first", F.min("seq").over(Window.partitionBy("conv_id", "digest"))).where("seq > first")  # a row per block at most
    earlier = earlier.groupBy("seq").agg(F.collect_list("digest").alias("earlier"))
    marked = blocks.join(earlier, "seq", "left").select("conv_id", "seq", "codes", "digests", "earlier").mapInArrow(_marked, MARKED)
    marked = materialise(marked, "marked")
    behind = materialise(marked.select("conv_id", "seq", "matrix").groupBy("conv_id").applyInArrow(_behind, BEHIND), "behind")
    goes = marked.join(behind, "seq").select("conv_id", "seq", "codes", "after").mapInArrow(_walked, GOES)
    entered = goes.groupBy("conv_id").applyInArrow(_entered, "seq long, state long")
    ready = blocks.select("conv_id", "seq", "rows", "low", "high", "turns", "roles", "texts").join(marked.drop("conv_id", "matrix"), "seq").join(behind, "seq").join(entered, "seq")
    parts = ready.mapInArrow(_emitted, PART).repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return solved.unionByName(parts.mapInArrow(_joined, RESULT))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by crc32(conv_id:turn) % 20: dropped (``present`` is false), emptied, without marks, twice, user."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_text("text"), ".!?", "")).otherwise(_text("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(_text("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), copies.alias("copy"))
    return out.drop("copy")
