"""Repair of conversation structure by iterative-deepening A*.

A repaired conversation is empty, or an optional system turn followed by user-assistant pairs. The search goes through the rows of a conversation depth
first, tries edits in ASCII order (Delete, Insert, Keep, Rerole) and gives up where cost so far plus a lower bound of the rest exceeds the
bound of the round; the next round's bound is the least such sum. A transposition table keeps, for each (row, state) that failed, the cost it
is proven to need at least, and serves all rounds. The first accepting path of the last round is the cheapest and among these the ASCII-least.

Rows meet in order, never as a whole: identical rows are counted before the shuffle; conversations of at most ``LONG_ROWS`` rows are streamed one
after the other through sorted partitions, and longer ones are cut by turn into range partitions, where every ``SEGMENT_ROWS`` rows are searched
for all pairs of entry and exit states. A fold over the segments of a conversation keeps the best edits per state and a running hash of the
repaired text for each. Equally cheap edits of the same rows never begin one another, so least strings of segments join to the least string.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

LONG_ROWS, SEGMENT_ROWS = 1_024, 64
BATCH_ROWS = 256
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
# States by what stands before: nothing, the system turn, a user turn, an assistant turn. Nothing and an assistant turn may end a conversation.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
KEEPS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {EMPTY: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}

_MARK = re.compile(r"[^\x20\x09-\x0D]")


def fault(text: str, seen: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated or none."""
    if not _MARK.search(text):
        return "blank"
    if seen:
        return "duplicate"
    end = text.rstrip(" \t\n\x0b\x0c\r")
    return "" if end[-1] in ".!?" else "truncated"


def search(rows: list[tuple[str, str, int]], start: int, ends: tuple[int, ...]) -> tuple[int, int, str] | None:
    """(end state, cost, edits) of the cheapest, then ASCII-least edits that lead from ``start`` through all rows to one of ``ends``; None if none do.

    A row is (role initial, fault, copies); copies beyond the first are duplicates, which must be deleted.
    """
    forced = [f in ("blank", "duplicate") for _, f, _ in rows]
    extra = [TRUNCATED if f == "truncated" else 0 for _, f, _ in rows]
    begins = start == EMPTY and any(initial == "s" and not f for (initial, _, _), f in zip(rows, forced))
    ends = tuple(e for e in ends if e in (USER, ASSISTANT) or e == start or e == SYSTEM and begins)
    if not ends:
        return None
    rest = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if forced[i] else min(DELETE, extra[i])) + DELETE * (rows[i][2] - 1)
    proven: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def edits(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(letters, cost, next row, next state) in ASCII order."""
        then = NEXT[state][0]
        if i < len(rows):
            initial, _, copies = rows[i]
            dropped, more = "D" * (copies - 1), DELETE * (copies - 1)
            yield "D" + dropped, DELETE + more, i + 1, state
        yield "I", INSERT, i, then
        if i < len(rows) and not forced[i]:
            if (state, initial) in KEEPS:
                yield "K" + dropped, extra[i] + more, i + 1, KEEPS[state, initial]
            yield "R" + dropped, REROLE + extra[i] + more, i + 1, then

    def descend(i: int, state: int, left: int) -> int:
        """0 or more: what is proven to be needed from here, as it is above ``left``; else -1 - the accepting state, with the edits in ``path``."""
        need = proven.get((i, state), rest[i])
        if need > left:
            return need
        if i == len(rows) and state in ends:
            return -1 - state
        least = None
        for letters, price, row, then in edits(i, state):
            path.append(letters)
            need = descend(row, then, left - price)
            if need < 0:
                return need
            path.pop()
            least = price + need if least is None else min(least, price + need)
        proven[i, state] = max(least, rest[i])
        return proven[i, state]

    bound = rest[0]
    while (need := descend(0, start, bound)) >= 0:
        bound = need
    return -1 - need, bound, "".join(path)


def apply(rows: list[tuple[str, str]], edits: str, state: int) -> tuple[list[str], int]:
    """(repaired ``role:text`` turns, state after them) of (role, text) rows, copies written out."""
    out, at = [], 0
    for edit in edits:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = KEEPS[state, role[:1]]
        else:
            state, role = NEXT[state]
        out.append(f"{role}:{text}")
    return out, state


class Segment:
    """Some consecutive rows of one conversation: counts, and the best edits from each entry state to each exit state."""

    def __init__(self, rows: list[dict]):
        """``rows`` hold turn, role, text, copies and fault (of the first copy)."""
        self.rows = rows
        self.counts = {k: sum((r["fault"] == k) + (r["copies"] - 1) * (k == ("blank" if r["fault"] == "blank" else "duplicate")) for r in rows) for k in ("blank", "duplicate", "truncated")}
        roles = [(r["role"][:1], r["copies"]) for r in rows]
        self.illegal = sum(c - 1 for _, c in roles) + sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(roles, roles[1:]))
        self.first, self.last = roles[0][0], roles[-1][0]
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        self.turns = (turns[0], turns[-1], len(set(turns))) if turns else None
        self.steps = [(r["role"][:1], r["fault"], r["copies"]) for r in rows]

    def solve(self, entries=(EMPTY, SYSTEM, USER, ASSISTANT), ends=None) -> list[tuple[int, int, int, str]]:
        """(entry, exit, cost, edits): to each exit state, or with ``ends`` to the best of these only."""
        found = [(entry, search(self.steps, entry, goal)) for entry in entries for goal in ([ends] if ends else [(s,) for s in range(4)])]
        return [(entry, *best) for entry, best in found if best]

    def copies(self) -> list[tuple[str, str]]:
        return [(r["role"], r["text"]) for r in self.rows for _ in range(r["copies"])]


class Fold:
    """Best edits, their cost and the running hash of the repaired text per state, over the segments of one conversation so far."""

    def __init__(self):
        self.best = {EMPTY: (0, "", hashlib.sha256(), False)}
        self.counts, self.illegal, self.last, self.turns = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None, None

    def add(self, segment: Segment, table: list[tuple[int, int, int, str]]) -> None:
        for k, n in segment.counts.items():
            self.counts[k] += n
        self.illegal += segment.illegal + (self.last is not None and self.last + segment.first not in ("su", "ua", "au"))
        self.last = segment.last
        if segment.turns:
            first, last, distinct = segment.turns
            low, high, count = self.turns or (first, None, 0)
            self.turns = (low, last, count + distinct - (high == first))
        chosen: dict[int, tuple] = {}
        for entry, then, cost, edits in table:
            if entry in self.best:
                before = self.best[entry]
                key = (before[0] + cost, before[1] + edits)
                if then not in chosen or key < chosen[then][0]:
                    chosen[then] = (key, entry, edits)
        rows, best = segment.copies(), {}
        for then, ((cost, audit), entry, edits) in chosen.items():
            _, _, digest, begun = self.best[entry]
            turns, _ = apply(rows, edits, entry)
            digest = digest.copy()
            for turn in turns:
                digest.update(("\n" * begun + turn).encode("utf-8", "surrogatepass"))
                begun = True
            best[then] = (cost, audit, digest, begun)
        self.best = best

    def result(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
        cost, audit, digest, _ = min((self.best[s] for s in ENDS if s in self.best), key=lambda b: b[:2])
        low, high, distinct = self.turns or (0, -1, 0)
        return max(high - low + 1 - distinct, 0), *self.counts.values(), self.illegal, cost, audit, digest.hexdigest()


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _groups(batches, keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal keys in a sorted stream of Arrow batches; a run must be read before the next."""
    rows = (row for batch in batches for at in range(0, batch.num_rows, BATCH_ROWS) for row in batch.slice(at, BATCH_ROWS).to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _segments(rows: Iterator[dict], size: int) -> Iterator[list[dict]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _repair_short(schema: pa.Schema, segment_rows: int):
    """Conversations one after the other; their faults are found on the way, as no conversation has many rows."""
    def run(batches):
        out = []
        for (_, conv), rows in _groups(batches, ["ck", "conv_id"]):
            fold, seen, real = Fold(), set(), []
            for row in rows:
                if row["copies"]:
                    key = (row["role"], row["text"])
                    row["fault"] = fault(row["text"], key in seen)
                    seen.add(key)
                    real.append(row)
            whole = len(real) <= 2 * segment_rows
            for part in _segments(iter(real), 2 * segment_rows if whole else segment_rows):
                segment = Segment(part)
                fold.add(segment, segment.solve((EMPTY,), ENDS) if whole else segment.solve(tuple(fold.best)))
            out.append((conv, *fold.result()))
            if len(out) == BATCH_ROWS:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_PIECE = pa.schema([("ck", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("rows", pa.list_(pa.struct(
    [("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("fault", pa.string())]))),
    ("table", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])))])

_PIECES = ("ck string, conv_id long, part int, seq long, rows array<struct<turn: long, role: string, text: string, copies: long, fault: string>>, "
           "table array<struct<entry: int, exit: int, cost: long, edits: string>>")


def _cut_long(segment_rows: int):
    """Segments of long conversations with their tables of best edits, solved wherever a range partition lies."""
    def run(batches):
        for (ck, conv, part), rows in _groups(batches, ["ck", "conv_id", "part"]):
            def real():
                for row in rows:
                    if row["copies"]:
                        row["fault"] = fault(row["text"], row["later"])
                        yield row
            for seq, piece in enumerate(_segments(real(), segment_rows)):
                kept = [{k: r[k] for k in ("turn", "role", "text", "copies", "fault")} for r in piece]
                table = [dict(zip(("entry", "exit", "cost", "edits"), t)) for t in Segment(piece).solve()]
                yield pa.RecordBatch.from_pylist([{"ck": ck, "conv_id": conv, "part": part, "seq": seq, "rows": kept, "table": table}], _PIECE)
    return run


def _fold_long(schema: pa.Schema):
    def run(batches):
        for (_, conv), pieces in _groups((b.slice(i, 1) for b in batches for i in range(b.num_rows)), ["ck", "conv_id"]):
            fold = Fold()
            for piece in pieces:
                fold.add(Segment(piece["rows"]), [(t["entry"], t["exit"], t["cost"], t["edits"]) for t in piece["table"]])
            yield _batch([(conv, *fold.result())], schema)
    return run


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after the damage that crc32 of ``conv_id:turn`` modulo 20 calls for.

    0 drops the row (copies 0), 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    A null role or text is one space, and so is a null part of the hashed string.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(kind == 4, "user").otherwise(text_of("role"))
    there = kind != 0
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(there, F.col("turn")).cast("long").alias("turn"), F.when(there, role).alias("role"),
                                F.when(there, text).alias("text"), F.when(kind == 3, 2).otherwise(there.cast("int")).alias("copies"))


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conv_id of ``rows``.

    ``rows`` are (conv_id, turn, role, text, copies) without null roles or texts; rows of 0 copies only say that the conversation exists. Rows are
    taken by turn, nulls first; rows of the same turn by role, then text, and equal ones next to each other. A null conv_id is a conversation. A role
    that is empty or begins otherwise than s, u or a can't be kept. Empty conversations give zeros, an empty audit and the hash of an empty text.
    """
    ck = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    rows, order = rows.select(ck.alias("ck"), "conv_id", "turn", "role", "text", "copies"), [F.asc_nulls_first("turn"), "role", "text"]
    long_ones = stored(rows.groupBy("ck").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > long_rows).select("ck"), "long-conversations")
    schema = pa.schema([("conv_id", pa.int64()), *[(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _RESULT.split(", ")]])
    none_long = long_ones.isEmpty()
    short = rows if none_long else rows.join(broadcast_if_small(long_ones), "ck", "left_anti").select(*rows.columns)
    out = short.repartition("ck").sortWithinPartitions("ck", *order).mapInArrow(_repair_short(schema, segment_rows), "conv_id long, " + _RESULT)
    if none_long:
        return out
    keys = ["ck", "conv_id", "turn", "role", "text"]
    many = rows.join(broadcast_if_small(long_ones), "ck", "left_semi").groupBy(*keys).agg(F.sum("copies").alias("copies"))
    many = many.withColumn("key", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    rank = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = many.filter("copies > 0").groupBy("ck", "key").agg(F.min(rank).alias("first"))
    many = many.join(first, ["ck", "key"], "left").withColumn("later", F.coalesce(rank > F.col("first"), F.lit(False))).select(*keys, "copies", "later")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    many = many.repartitionByRange(parts, "ck", F.asc_nulls_first("turn"), "role").sortWithinPartitions("ck", *order).withColumn("part", F.spark_partition_id())
    pieces = stored(many.mapInArrow(_cut_long(segment_rows), _PIECES), "segments").repartition("ck").sortWithinPartitions("ck", "part", "seq")
    return out.unionByName(pieces.mapInArrow(_fold_long(schema), "conv_id long, " + _RESULT))
