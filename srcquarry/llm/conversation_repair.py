"""Conversation structure repair (operator 13): the cheapest edits that make roles follow ``(s?(ua)+)?``, by a DP on ranks.

Edits.  A turn is kept (0), given role user or assistant (1), or deleted (2, the only choice for blank and duplicate turns);
a truncated turn that is not deleted adds 5; turns with empty texts may be inserted anywhere (5 each).  The audit is the
edits' initials in order; of the cheapest ones the ASCII-least counts.

Macro edits.  An insert-run and the turn after it form one edit: its code, ``I`` for each insert and the turn's initial, ends
with the only letter that is not ``I``.  Such codes are free of prefixes, so audits of equally many turns compare as their
lists of codes do.  The DP therefore holds no audits: a layer has, for each of the four states (nothing yet, after system,
after user, after assistant), its cost and the rank of its audit among the layer's.  The next layer's audits are ranked by
(rank before, code).  Costs count from the layer's least, and a state that is more than ``SLACK`` dearer can never win, so
there are finitely many layers; transitions between them are made once and kept, and a turn costs one table lookup.  The
audit is rebuilt afterwards from parent pointers.

Spread.  Turns are ordered by ranges; repeats are found by an aggregation on (conversation, digest).  A conversation's turns
then pass in order through one task as numbers, of which it holds four bytes a turn, less than the audit takes with its
edits; texts are never held, they meet their edits by a join and pass one by one through the hash of the result.

Cases: null roles and texts are one space, a null conversation id is an id of its own; turns go by turn (nulls first), then
role, then text; role initials are case-sensitive; empty roles have no initial and can only be changed or deleted; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcquarry.llm.common import discard, pa_schema, slices, stored
from srcquarry.llm.sequences import joined_sha256, running

SPACE = r" \t\n\u000b\u000c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SLACK = 20
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a turn with this role leads to from each state; roles that may not follow are left out.
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
CODES = sorted(["D", "K", "R", "ID", "IK", "IR"])
INITIALS = "sua"  # class of a turn: initial, 3 for others; plus 4 if it must go; plus 8 if it is truncated
MUST_GO, CUT = 4, 8
BLANK, REPEATED = 16, 32


def inserted(state: int) -> int:
    """The state after the one turn that can be inserted here."""
    return ASSISTANT if state == USER else USER


class Layers:
    """Layers of the DP by number, and the steps between them."""

    def __init__(self):
        self.layers: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int, tuple]] = {}
        self.first = self.known(((0, 0), None, None, None))

    def known(self, layer: tuple) -> int:
        if layer not in self.number:
            self.number[layer] = len(self.layers)
            self.layers.append(layer)
        return self.number[layer]

    def edits(self, state: int, turn: int) -> Iterator[tuple[int, int, int]]:
        """(state after, cost, code) of the macro edits of a turn of class ``turn``."""
        extra = TRUNCATED if turn & CUT else 0
        initial = (*INITIALS, "")[turn & 3]
        for run in ("", "I"):
            at, cost = (inserted(state), INSERT) if run else (state, 0)
            yield at, cost + DELETE, CODES.index(f"{run}D")
            if not turn & MUST_GO:
                if initial in FOLLOWS[at]:
                    yield FOLLOWS[at][initial], cost + KEEP + extra, CODES.index(f"{run}K")
                yield inserted(at), cost + REROLE + extra, CODES.index(f"{run}R")

    def step(self, layer: int, turn: int) -> tuple[int, int, tuple]:
        """(next layer, cost that all its states gained, (state before, code) of each state)."""
        known = self.steps.get((layer, turn))
        if known:
            return known
        best: dict[int, tuple] = {}
        for state, x in enumerate(self.layers[layer]):
            if x is not None:
                for to, cost, code in self.edits(state, turn):
                    new = (x[0] + cost, x[1], code, state)
                    if to not in best or new < best[to]:
                        best[to] = new
        least = min(b[0] for b in best.values())
        best = {to: b for to, b in best.items() if b[0] <= least + SLACK}
        ranks = {audit: i for i, audit in enumerate(sorted({b[1:3] for b in best.values()}))}
        after = tuple((best[s][0] - least, ranks[best[s][1:3]]) if s in best else None for s in range(4))
        pointers = tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))
        self.steps[layer, turn] = out = (self.known(after), least, pointers)
        return out

    def end(self, layer: int) -> tuple[int, int, int]:
        """(cost, inserts, state) of the best way to end here."""
        ways = []
        for state, x in enumerate(self.layers[layer]):
            if x is not None:
                n = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state]
                ways.append((x[0] + INSERT * n, x[1], n, state))
        cost, _, n, state = min(ways)
        return cost, n, state

    def repair(self, turns: np.ndarray) -> tuple[int, list[int], list[int], int, int]:
        """(cost, code of each turn, state before each turn, inserts at the end, state before those)."""
        layer, total, step, steps = self.first, 0, self.step, self.steps
        path = np.empty(len(turns), np.int32)
        for i, t in enumerate(turns.tolist()):
            path[i] = layer
            layer, cost, _ = steps.get((layer, t)) or step(layer, t)
            total += cost
        cost, n, state = self.end(layer)
        codes, states, last = [0] * len(turns), [0] * len(turns), state
        for i in range(len(turns) - 1, -1, -1):
            state, codes[i] = steps[int(path[i]), int(turns[i])][2][state]
            states[i] = state
        return total + cost, codes, states, n, last


def classified(messages: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, class) of messages (conv_id, turn, role, text), null roles and texts one space."""
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = running(m, "conv_id", [F.col("turn"), F.col("role"), F.col("text")], ["conv_id", "turn", "role", "text"], {}, "messages")
    size = F.octet_length("role").cast("string")
    label = rows.withColumn("digest", F.unhex(F.md5(F.concat(size, F.lit(":"), F.col("role"), F.col("text")))))
    again = label.groupBy("conv_id", "digest").agg(F.min("position").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    label = label.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")

    trimmed = F.expr(f"trim(BOTH '{SPACE}' FROM text)")
    blank, repeated, cut = trimmed == "", F.col("position") > F.coalesce("first", F.col("position")), ~F.right(trimmed, F.lit(1)).isin(*".!?")
    fault = F.when(blank, MUST_GO + BLANK).when(repeated, MUST_GO + REPEATED).when(cut, CUT).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    out = label.select("conv_id", "position", "turn", "role", "text", (kind + fault).cast("int").alias("class"))
    out.scratch_path = rows.scratch_path
    return out


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
EDIT = "code string, after int"


def edited(rows: DataFrame) -> DataFrame:
    """For each conversation a row with position 0 and its summary, for each turn one with its edits' initials and the state
    that they start from, and one after the last turn for inserts at the end (no initial of a turn)."""
    schema = f"conv_id long, position long, {SUMMARY}, {EDIT}"
    out = pa_schema(rows.sparkSession, schema)
    counted = [f.split()[0] for f in SUMMARY.split(", ")]
    legal = np.zeros(16, bool)
    legal[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True  # su, ua, au

    def summary(turns: np.ndarray, missing: np.ndarray, classes: np.ndarray, cost: int, audit: str) -> tuple:
        known = turns[~missing]  # in order, so equal turns stand together
        gaps = int(known[-1]) - int(known[0]) + 1 - (1 + int(np.count_nonzero(known[1:] != known[:-1]))) if len(known) else 0
        kind = classes & 3
        illegal = int(np.count_nonzero(~legal[kind[:-1] * 4 + kind[1:]]))
        return gaps, *(int(np.count_nonzero(classes & f)) for f in (BLANK, REPEATED, CUT)), illegal, cost, audit

    def repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        """Columns of whole conversations' rows, those of a long conversation in parts."""
        layers = Layers()
        for conv_id, turns, missing, classes in whole(batches):
            cost, codes, states, n, last = layers.repair(classes & (3 | MUST_GO | CUT))
            codes, states = [CODES[c] for c in codes] + ["I" * n], states + [last]
            yield {"conv_id": [conv_id], "position": [0]} | {c: [v] for c, v in zip(counted, summary(turns, missing, classes, cost, "".join(codes)))}
            for k in range(0, len(codes), 20_000):
                part = codes[k : k + 20_000]
                yield {"conv_id": [conv_id] * len(part), "position": range(k + 1, k + 1 + len(part)), "code": part, "after": states[k : k + 20_000]}

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in out.names}
        for rows_of in repaired(batches):
            n = len(rows_of["conv_id"])
            for c, column in held.items():
                column += rows_of.get(c) or [None] * n
            if len(held["conv_id"]) >= 20_000:
                yield pa.RecordBatch.from_pydict(held, schema=out)
                held = {c: [] for c in out.names}
        if held["conv_id"]:
            yield pa.RecordBatch.from_pydict(held, schema=out)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many tasks even if the numbers are few bytes
    by_order = rows.select("conv_id", "position", "turn", "class").repartition(n, "conv_id").sortWithinPartitions("conv_id", "position")
    return by_order.mapInArrow(packed, schema)


def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turns, which of them are null, classes) of each conversation of sorted batches."""
    parts, open_id = [], None
    for b in slices(batches, 20_000):
        ids, null = b.column("conv_id").fill_null(0).to_numpy(), b.column("conv_id").is_null().to_numpy(zero_copy_only=False)
        turns, classes = b.column("turn"), b.column("class").to_numpy()
        missing, turns = turns.is_null().to_numpy(zero_copy_only=False), turns.fill_null(0).to_numpy()
        starts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1).tolist(), len(ids)]
        for a, e in zip(starts, starts[1:]):
            this = None if null[a] else int(ids[a])
            if parts and this != open_id:
                yield open_id, *map(np.concatenate, zip(*parts))
                parts = []
            open_id = this
            parts.append((turns[a:e], missing[a:e], classes[a:e]))
    if parts:
        yield open_id, *map(np.concatenate, zip(*parts))


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, position, turns): the (role, text) that each turn became, after what was inserted before it."""
    e = edits.where((F.col("position") > 0) & (F.col("code") != "D")).select(F.col("conv_id").alias("c"), F.col("position").alias("p"), "code", "after")
    own = rows.select("conv_id", "position", "role", "text")
    both = e.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("position") == F.col("p")), "left")
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    name = lambda flip: F.when((F.col("after") == USER) != flip, "assistant").otherwise("user")
    runs = F.length("code") - F.length(F.ltrim("code", F.lit("I")))
    put = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: turn(F.when((F.col("after") == USER) != (i == 1), "assistant").otherwise("user"), F.lit("")))
    kept = F.when(F.col("code").endswith("K"), F.array(turn(F.col("role"), F.col("text")))).when(F.col("code").endswith("R"), F.array(turn(name(runs % 2 == 1), F.col("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return both.select(F.col("c").alias("conv_id"), F.col("p").alias("position"), F.concat(F.slice(put, F.lit(1), runs), kept).alias("turns")).where(F.size("turns") > 0)


def repair(messages: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of
    ``messages`` and of ``ids``, with zeros, an empty audit and the hash of nothing for those without messages."""
    rows = classified(messages)
    turns = stored(rows, "turns")
    edits = stored(edited(turns), "edits")
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    lines = repaired_turns(turns, edits).select("conv_id", "position", line.alias("lines"))
    hashes = joined_sha256(lines, ["conv_id"], "position", "lines", "\n").withColumnRenamed("conv_id", "h")
    every = (messages if ids is None else ids).select(F.col("conv_id").cast("long").alias("c")).distinct()
    out = every.join(edits.where("position = 0"), F.col("c").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("c").eqNullSafe(F.col("h")), "left")
    out = out.select(
        F.col("c").alias("conv_id"),
        *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    out = stored(out, "repair")
    discard(rows, turns, edits)
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20: 0 is dropped, 1 loses its text, 2 its ends of sentences, 3 comes
    twice, 4 gets role user; nulls are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    c = c.where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return c.drop("copy")
