"""Repair of conversations: the cheapest edits that make turns alternate.

Rows of a conversation are kept, given the other role, deleted, or joined by
inserted empty turns, so that the initials of the roles read ``(s?(ua)+)?``.
What is still allowed depends on the last role only, so the state is one of
four: START (nothing yet), SYSTEM, USER, ASSISTANT. Every edit leads from a
state to one state, and a cheapest list of edits is a shortest path through
(row, state). Among the shortest the one whose initials (D, I, K, R) come first
in ASCII order is taken, by walking forward along tight edits only.

Long conversations are worked on in blocks of at most ``BLOCK`` rows, on one
byte a row:

1. Each block's costs between its first and last states, a 4 x 4 table.
2. Backward over a conversation's blocks: the cost vector at every block's end,
   the checkpoints. Vectors of single rows are not stored.
3. Each block's vectors again, from its checkpoint, and the state that the walk
   leaves it in for every state it may enter in.
4. Forward over the blocks: the state each is entered in.
5. Each block again, walked from that state, giving every row's edits. Inside
   a block vectors are kept at every 64th row only and made again in between.

Steps 1, 3 and 5 are spread by block, 2 and 4 pass a few numbers a block. Rows
are numbered by a range sort over the whole table, so a conversation of any
size is sorted by many tasks. Only ``summary`` reads a whole conversation in
one task: its digest is sequential, and rows stream through it.

Faults, the first of: blank (no character besides white space), duplicate (role
and text of an earlier row of the conversation), truncated (last such character
none of ``.!?``). Blank and duplicate rows must go; a truncated row that stays
costs 1 more.

Defined results: null roles and texts are one space; rows are ordered by turn
(nulls first), role and the text's SHA-256; equal rows of one turn are neighbours; a null
conv_id is a conversation of its own; other input columns are ignored; texts and
conversations of any length are whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.text import list_array, map_batches
from paddock.session import materialize

BLOCK = 4_096
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
OWN = None  # in a list of roles: the row's own
NEXT = np.array([USER, USER, ASSISTANT, USER])  # of every state, the turn that may be inserted
KEEP = np.array([[SYSTEM, USER, -1], [-1, USER, -1], [-1, -1, ASSISTANT], [-1, USER, -1]])  # by initial s, u, a
FAR = 1 << 40
COST = {"I": 2, "R": 2, "D": 3, "truncated": 1}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
# a row's code: initial (0 s, 1 u, 2 a, 3 other) and fault (0 none), as initial + 4 * fault
NO_ROW = 16


@lru_cache(maxsize=1)
def row_costs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code and state: cost of keeping, its next state, and the cost of a new role."""
    keep = np.full((NO_ROW + 1, 4), FAR, dtype=np.int64)
    role = np.full((NO_ROW + 1, 4), FAR, dtype=np.int64)
    to = np.tile(np.arange(4), (NO_ROW + 1, 1))
    for code in range(NO_ROW):
        initial, fault = code % 4, code // 4
        if fault in (BLANK, DUPLICATE):
            continue
        extra = COST["truncated"] if fault == TRUNCATED else 0
        role[code] = COST["R"] + extra
        for state in range(4):
            if initial < 3 and KEEP[state, initial] >= 0:
                keep[code, state], to[code, state] = extra, KEEP[state, initial]
    keep[NO_ROW] = 0  # rows past a shorter block's end change nothing
    return keep, to, role


def before_row(after: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Cost vectors (block, ..., state) before one row of every block, from those after it."""
    keep, to, role = row_costs()
    shape = (len(codes),) + (1,) * (after.ndim - 2) + (4,)
    kept = keep[codes].reshape(shape) + np.take_along_axis(after, np.broadcast_to(to[codes].reshape(shape), after.shape), -1)
    real = (codes != NO_ROW).reshape(shape[:-1] + (1,))
    cost = np.minimum(kept, role[codes].reshape(shape) + after[..., NEXT])
    cost = np.where(real, np.minimum(cost, COST["D"] + after), cost)
    return np.where(real, with_inserts(cost), cost)


def with_inserts(cost: np.ndarray) -> np.ndarray:
    for _ in range(2):  # two turns may be wanted at one place, never three
        cost = np.minimum(cost, COST["I"] + cost[..., NEXT])
    return cost


def last_vector() -> np.ndarray:
    """Costs after the last row: an empty conversation or an assistant's turn may end it."""
    return with_inserts(np.array([0, FAR, FAR, 0], dtype=np.int64))


def tables(codes: np.ndarray) -> np.ndarray:
    """(block, last state, first state): cheapest costs through every block of padded codes."""
    cost = np.full((len(codes), 4, 4), FAR, dtype=np.int64)
    cost[:, np.arange(4), np.arange(4)] = 0
    for i in range(codes.shape[1] - 1, -1, -1):
        cost = before_row(cost, codes[:, i])
    return cost


def walk(codes: np.ndarray, after: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ASCII-least of the cheapest edits of padded codes, from the entered states: of every (block, row)
    the state before it, the number of turns inserted there and the row's own edit; and the states after."""
    n, length = codes.shape
    step = max(64, int(length ** 0.5))
    marks = list(range(0, length, step))
    vectors, here = {}, after
    for low in reversed(marks):
        vectors[low] = here  # the checkpoint behind rows low .. low + step - 1
        for i in range(min(low + step, length) - 1, low - 1, -1):
            here = before_row(here, codes[:, i])
    states, inserted = np.zeros((n, length), dtype=np.int8), np.zeros((n, length), dtype=np.int8)
    edits = np.zeros((n, length), dtype="U1")
    state, rows = entry.copy(), np.arange(n)
    keep, to, _ = row_costs()
    for low in marks:
        stop = min(low + step, length)
        block = [vectors[low]]
        for i in range(stop - 1, low - 1, -1):
            block.append(before_row(block[-1], codes[:, i]))
        block.reverse()
        for i in range(low, stop):
            now, then, code = block[i - low], block[i - low + 1], codes[:, i]
            real = code != NO_ROW
            states[:, i] = state
            for _ in range(2):
                cost = now[rows, state]
                drop = COST["D"] + then[rows, state] == cost
                more = real & ~drop & (COST["I"] + now[rows, NEXT[state]] == cost)
                inserted[more, i] += 1
                state = np.where(more, NEXT[state], state)
            cost = now[rows, state]
            drop = real & (COST["D"] + then[rows, state] == cost)
            kept = real & ~drop & (keep[code, state] + then[rows, to[code, state]] == cost)
            edits[:, i] = np.where(drop, "D", np.where(kept, "K", np.where(real, "R", "")))
            state = np.where(kept, to[code, state], np.where(drop | ~real, state, NEXT[state]))
    return states, inserted, edits, state


@lru_cache(maxsize=1024)
def roles_left(state: int, edit: str) -> tuple[str | None, ...]:
    """Roles of the turns that a row's edits leave, in order, from the state before them."""
    out = []
    for kind in edit:
        if kind in "IR":
            state = int(NEXT[state])
            out.append(ROLES[state])
        elif kind == "K":  # turns inserted behind a kept row end the conversation
            state = SYSTEM if edit.endswith("KII") else USER
            out.append(OWN)
    return tuple(out)


def padded(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of blocks with their codes as one array, of about a million codes together."""
    size = np.diff(batch.column("codes").offsets.to_numpy())
    at = 0
    while at < batch.num_rows:
        width = np.maximum.accumulate(size[at:])
        most = int(np.searchsorted(width * np.arange(1, len(width) + 1), 1 << 20, side="right"))
        part = batch.slice(at, max(1, most))
        n = size[at:at + part.num_rows]
        codes = np.full((len(n), int(n.max())), NO_ROW, dtype=np.int64)
        codes[np.arange(codes.shape[1]) < n[:, None]] = part.column("codes").flatten().to_numpy()
        yield part, codes
        at += part.num_rows


def scan(rows: DataFrame, start, step, kind: str) -> DataFrame:
    """(at, value, begins) of (conv, at, pass) rows sorted by conversation: a value goes along the rows of each
    conversation, ``step(value, pass)`` being the next; ``begins`` marks the first row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, value, begun = None, None, False
        for batch in batches:
            values, begins = [], []
            for conv, row in zip(batch.column("conv").to_pylist(), batch.column("pass").to_pylist(), strict=True):
                begins.append(not begun or conv != current)
                if begins[-1]:
                    current, value, begun = conv, start, True
                values.append(value)
                value = step(value, row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), pa.array(values, pa.list_(pa.int64()) if isinstance(start, list) else pa.int64()),
                 pa.array(begins, pa.bool_())], ["at", "value", "begins"])

    return map_batches(rows.select("conv", "at", "pass"), run, f"at long, value {kind}, begins boolean")


def numbered(turns: DataFrame) -> DataFrame:
    """(seq, conv, turn, role, text): all rows of the table, numbered in order of conversation, turn, role and
    text digest."""
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    # equal rows may be told apart in any way: the salt splits a large group of them
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("salt", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "digest", "salt"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.select(F.monotonically_increasing_id().alias("seq"), "conv", "turn", "role", "text"),
                       "turns")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, seq, code) of every numbered row."""
    said = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    initial = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = rows.groupBy("conv", digest.alias("digest")).agg(F.min("seq").alias("first")).select("first")
    marked = rows.select("conv", "seq", initial.alias("initial"), (said == "").alias("blank"),
                         F.substring(said, -1, 1).alias("end")).join(first, F.col("seq") == F.col("first"), "left")
    fault = (F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE)
             .when(~F.col("end").isin(".", "!", "?"), TRUNCATED).otherwise(0))
    code = F.when(F.col("initial") > 0, F.col("initial") - 1).otherwise(3) + 4 * fault
    return marked.select("conv", "seq", code.cast("int").alias("code"))


def cheapest_edits(codes: DataFrame) -> DataFrame:
    """(seq, code, state, edit) of every (conv, seq, code) row: initials of its edits in order, the turns inserted
    before it first (behind a conversation's last row, those at the end), and the state before them."""
    blocks = codes.groupBy("conv", F.floor(F.col("seq") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "code"))).alias("rows"))
    blocks = materialize(blocks.select("conv", F.col("rows.seq")[0].alias("at"), F.col("rows.seq").alias("seqs"),
                                       F.col("rows.code").alias("codes")), "blocks")
    conv = codes.schema["conv"].dataType.simpleString()

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, c in padded(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv"), part.column("at"),
                     list_array(pa.array(tables(c).ravel()), np.full(len(c), 16))], ["conv", "at", "pass"])

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, c in padded(batch):
                after = part.column("after").flatten().to_numpy().reshape(-1, 4)
                out = np.stack([walk(c, after, np.full(len(c), s))[3] for s in range(4)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv"), part.column("at"),
                     list_array(pa.array(out.ravel().astype(np.int64)), np.full(len(c), 4))], ["conv", "at", "pass"])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, c in padded(batch):
                after = part.column("after").flatten().to_numpy().reshape(-1, 4)
                states, inserted, edits, state = walk(c, after, part.column("entry").to_numpy())
                real = c != NO_ROW
                text = np.char.add(np.array(["", "I", "II"])[inserted[real]], edits[real]).astype(object)
                ends = np.flatnonzero(part.column("ends").to_numpy(zero_copy_only=False))
                at = np.cumsum(real.sum(axis=1))[ends] - 1
                text[at] += np.array(["", "II", "I", ""], dtype=object)[state[ends]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("seqs").flatten(), part.column("codes").flatten(), pa.array(states[real]),
                     pa.array(text, pa.string())], ["seq", "code", "state", "edit"])

    def back(vector: list[int], table: list[int]) -> list[int]:
        return (np.array(table).reshape(4, 4) + np.array(vector)[:, None]).min(axis=0).tolist()

    costs = map_batches(blocks.select("conv", "at", "codes"), through, f"conv {conv}, at long, pass array<long>")
    vectors = scan(costs.repartition("conv").sortWithinPartitions("conv", F.desc("at")), last_vector().tolist(), back,
                   "array<long>")
    known = materialize(blocks.join(vectors.select("at", F.col("value").alias("after"), F.col("begins").alias("ends")),
                                    "at"), "checkpoints")
    left = map_batches(known.select("conv", "at", "codes", "after"), leave, f"conv {conv}, at long, pass array<long>")
    entered = scan(left.repartition("conv").sortWithinPartitions("conv", "at"), START, lambda state, out: out[state],
                   "long")
    ready = known.join(entered.select("at", F.col("value").alias("entry")), "at")
    return map_batches(ready.select("seqs", "codes", "after", "ends", "entry"), give,
                       "seq long, code int, state byte, edit string")


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, turn, role, text, fault, state, edit) of every row of (conv_id, turn, role, text): its fault (0
    none, 1 blank, 2 duplicate, 3 truncated) and its cheapest edits, of which ``roles_left`` makes the new turns."""
    rows = numbered(turns)
    edits = materialize(cheapest_edits(faults(rows)), "edits")
    return rows.join(edits, "seq").select(F.col("conv").alias("conv_id"), "seq", "turn", "role", "text",
                                          F.floor(F.col("code") / 4).cast("int").alias("fault"), "state", "edit")


def summary(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: gaps in its turns, its faults, neighbours in illegal order, the cost
    and initials of the edits, and the digest of the repaired turns."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    conv = repaired.schema["conv_id"].dataType.simpleString()

    def result(key, s: dict, kind: pa.DataType) -> pa.RecordBatch:
        gaps = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
        cells = [key, gaps, *s["faults"][1:], s["illegal"], s["cost"], "".join(s["audit"]), s["hash"].hexdigest()]
        types = [kind] + [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, s, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conv_id, turn, role, text, fault, state, edit in zip(*(c.to_pylist() for c in batch.columns),
                                                                     strict=True):
                if s is None or conv_id != key:
                    if s is not None:
                        done.append(result(key, s, kind))
                    key = conv_id
                    s = {"low": None, "high": None, "turns": 0, "faults": [0] * 4, "illegal": 0, "cost": 0, "audit": [],
                         "hash": hashlib.sha256(), "lines": 0, "before": None}
                if turn is not None and turn != s["high"]:
                    s["low"] = turn if s["low"] is None else s["low"]
                    s["high"], s["turns"] = turn, s["turns"] + 1
                s["faults"][fault] += 1
                if s["before"] is not None and s["before"] + role[:1] not in ("su", "ua", "au"):
                    s["illegal"] += 1
                s["before"] = role[:1]
                s["audit"].append(edit)
                s["cost"] += sum(COST.get(e, 0) for e in edit)
                s["cost"] += COST["truncated"] if fault == TRUNCATED and "D" not in edit else 0
                for kind_of, left in zip(edit.replace("D", ""), roles_left(state, edit), strict=True):
                    line = f"{role if left is OWN else left}:{'' if kind_of == 'I' else text}"
                    s["hash"].update((("\n" if s["lines"] else "") + line).encode())
                    s["lines"] += 1
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if s is not None:
            yield result(key, s, kind)

    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return map_batches(ordered.select("conv_id", "turn", "role", "text", "fault", "state", "edit"), run,
                       f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                       "audit string, repaired_sha256 string")
