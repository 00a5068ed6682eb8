"""Repair of conversation structure by a min-plus program over runs.

A conversation should read ``s?(ua)+`` in role initials, or be empty. ``repair`` finds for each
the cheapest edits: Keep a row, Rerole it to user or assistant, Delete it (forced for blank and
duplicate rows), Insert an empty turn; truncated rows that stay cost extra. Of the cheapest edit
strings the least in ASCII is taken.

Each row is a symbol (role initial and fault). A symbol's costs form a matrix between the four
states of the pattern; equal consecutive symbols form a run, and a run is advanced by cached
binary powers of its matrix in (min, +). Walking forward, the costs to go unroll into choices.

Rows are first counted by (conv_id, turn, role, text), so that any number of equal rows is one;
texts stay in that stored table and the program runs on narrow rows. These are dealt by range
into sorted blocks (a reliable checkpoint), so a conversation of any length spreads over many
tasks. Only the first and the last conversation of a block can go on in others: their matrices,
two per block, are joined on the driver (as many as tasks, whatever the rows), which gives every
block its costs to go, and a second pass the state in which it starts. The digest of a repaired
conversation is one hash over all its text, so a conversation is streamed through one task
there, row by row, sorted, with only its edit string held.

Rows are taken by turn (nulls first), then role, then text digest. A null role or text is one
space. A null conv_id is a conversation of its own. A row is a duplicate when its role and text
occur in an earlier row; of equal rows the first is not. Original conversations without rows
left give zeros and empty results; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import stored
from scriptorium.session import checkpoint_dir

#: ASCII white space; everything else counts as a character.
BLANKS = " \t\n\x0b\x0c\r"
OK, TRUNCATED, BLANK, DUPLICATE, ORIGINAL = range(5)
INFINITY = 1 << 60
#: States: nothing yet, after s, after u, after a. The role that must come next in each.
NEXT = "uuau"
ACCEPT = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Steps of a run whose costs to go are held together when choices are unrolled.
STRIDE = 1024
#: What orders rows; every pass sorts by these.
ORDER = ("conv_id", "turn", "role", "digest")

Vector = tuple[int, int, int, int]


class Costs(NamedTuple):
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


#: Initial of the role (other than s, u, a: a space) and whether the row must go or is truncated.
Symbol = tuple[str, int]


def after(state: int, role: str) -> int | None:
    """The state after a turn of ``role``; none where the pattern forbids it."""
    if role == "s":
        return 1 if state == 0 else None
    return {"u": 2, "a": 3}[role] if role == NEXT[state] else None


@cache
def choices(symbol: Symbol, costs: Costs) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the single edits, as (letter, cost, next state): insertions before the row, or the row's own."""
    role, fault = symbol
    out = []
    for state in range(4):
        edits = [("D", costs.delete, state), ("I", costs.insert, after(state, NEXT[state]))]
        if fault != BLANK:
            more = costs.truncated if fault == TRUNCATED else 0
            if role != " " and (to := after(state, role)) is not None:
                edits.append(("K", costs.keep + more, to))
            edits.append(("R", costs.rerole + more, after(state, NEXT[state])))
        out.append(tuple(edits))
    return tuple(out)


@cache
def ending(costs: Costs) -> Vector:
    """Costs from each state to the end when no row is left: insertions only."""
    out = [0 if s in ACCEPT else INFINITY for s in range(4)]
    for _ in range(4):
        out = [min(out[s], costs.insert + out[after(s, NEXT[s])]) for s in range(4)]
    return tuple(out)


@cache
def step(symbol: Symbol, costs: Costs) -> tuple[Vector, ...]:
    """Matrix of one row: least cost from each state before it to each state after it."""
    table = choices(symbol, costs)
    rows = [[min((c for e, c, to in table[s] if e != "I" and to == t), default=INFINITY) for t in range(4)] for s in range(4)]
    for _ in range(4):
        rows = [[min(rows[s][t], costs.insert + rows[after(s, NEXT[s])][t]) for t in range(4)] for s in range(4)]
    return tuple(map(tuple, rows))


def times(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(INFINITY, *(a[s][k] + b[k][t] for k in range(4))) for t in range(4)) for s in range(4))


def onto(a: tuple[Vector, ...], v: Vector) -> Vector:
    return tuple(min(INFINITY, *(a[s][k] + v[k] for k in range(4))) for s in range(4))


@cache
def doubled(symbol: Symbol, k: int, costs: Costs) -> tuple[Vector, ...]:
    """The matrix of 2 ** k equal rows."""
    if k == 0:
        return step(symbol, costs)
    half = doubled(symbol, k - 1, costs)
    return times(half, half)


def powers(symbol: Symbol, length: int, costs: Costs) -> Iterator[tuple[Vector, ...]]:
    return (doubled(symbol, k, costs) for k in range(length.bit_length()) if length >> k & 1)


def advance(symbol: Symbol, length: int, v: Vector, costs: Costs) -> Vector:
    """Costs to go before a run, from those after it."""
    least = min(v)
    return tuple(min(INFINITY, x + least) for x in _advance(symbol, length, tuple(min(INFINITY, x - least) for x in v), costs))


@lru_cache(1 << 16)
def _advance(symbol: Symbol, length: int, v: Vector, costs: Costs) -> Vector:
    for matrix in powers(symbol, length, costs):
        v = onto(matrix, v)
    return v


@cache
def choose(symbol: Symbol, state: int, v: Vector, costs: Costs) -> tuple[str, int]:
    """Least cheapest edits of one row from ``state`` when ``v`` are the costs after it, and the state they lead to."""
    table, here, out = choices(symbol, costs), onto(step(symbol, costs), v), ""
    while True:
        for letter, cost, to in sorted(table[state]):
            if cost + (here if letter == "I" else v)[to] == here[state]:
                out, state = out + letter, to
                break
        if letter != "I":
            return out, state


def finish(state: int, costs: Costs) -> tuple[str, int]:
    out, v = "", ending(costs)
    while state not in ACCEPT or v[state]:
        out, state = out + "I", after(state, NEXT[state])
    return out, state


def unroll(symbol: Symbol, length: int, state: int, v: Vector, costs: Costs) -> Iterator[tuple[str, int]]:
    """Edits of each row of a run and the state after it; ``v`` are the costs after the run."""
    done = 0
    while done < length:
        n = min(STRIDE, length - done)
        to_go = [advance(symbol, length - done - n, v, costs)]
        for _ in range(n - 1):
            to_go.append(advance(symbol, 1, to_go[-1], costs))
        for costs_after in reversed(to_go):
            least = min(costs_after)
            edits, state = choose(symbol, state, tuple(min(INFINITY, x - least) for x in costs_after), costs)
            yield edits, state
        done += n


def roles(initial: str, text: str, state: int) -> tuple[str, int]:
    """Role initials of the turns that edits leave of a row, from ``state``, and the state after them."""
    out = ""
    for edit in text.replace("D", ""):
        out += initial if edit == "K" else NEXT[state]
        state = after(state, out[-1])
    return out, state


def runs(rows: list[tuple[str, int, int]]) -> list[tuple[Symbol, int]]:
    """Equal consecutive symbols of rows (role initial, fault, copies), collapsed; further copies must go."""
    out: list[list] = []
    for role, fault, copies in rows:
        must = fault in (BLANK, DUPLICATE)
        for symbol, n in ((("", BLANK) if must else (role, fault), copies if must else 1), (("", BLANK), 0 if must else copies - 1)):
            if not n:
                continue
            if out and out[-1][0] == symbol:
                out[-1][1] += n
            else:
                out.append([symbol, n])
    return [(s, n) for s, n in out]


def solve(rows: list[tuple[str, int, int]], state: int, v: Vector, costs: Costs) -> tuple[list[str], int]:
    """Edits of each row (with its copies) from ``state``, when ``v`` are the costs after the last, and the state after it."""
    parts = runs(rows)
    ends = [v]
    for symbol, n in reversed(parts):
        ends.append(advance(symbol, n, ends[-1], costs))
    ends.reverse()

    def edits() -> Iterator[tuple[str, int]]:
        at = state
        for (symbol, n), end in zip(parts, ends[1:], strict=True):
            for text, at in unroll(symbol, n, at, end, costs):
                yield text, at

    out, each = [], edits()
    for _, _, copies in rows:
        pieces = [next(each) for _ in range(copies)]
        out.append("".join(p for p, _ in pieces))
        state = pieces[-1][1]
    return out, state


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple], bool]]:
    """The conversations of a sorted block: id, its rows (all columns), and whether it is the block's last."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held = None
    for conv, own in groupby(rows, key=lambda r: r[0]):
        if held is not None:
            yield *held, False
        held = conv, list(own)
    if held is not None:
        yield *held, True


# --- Spark ---------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Faults dealt by crc32 of ``conv_id:turn``: dropped, emptied, stops removed, repeated, or made a user's."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text"), (F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20).alias("_deal"))
    deal = F.col("_deal")
    text = F.when(deal == 1, "").when(deal == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(deal == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter(deal != 0).select("conv_id", "turn", F.when(deal == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def counted(rows: DataFrame) -> DataFrame:
    """Different rows with their number, text digest and own fault. Written to the shared folder."""
    say = lambda c: F.coalesce(F.col(c), F.lit(" "))
    different = rows.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    return stored(different.select("*", F.sha2("text", 256).alias("digest"), fault.alias("fault")))


def blocks(different: DataFrame) -> DataFrame:
    """Narrow rows in blocks sorted by ``ORDER``, with repeats of earlier rows marked as duplicates."""
    narrow = different.select(*ORDER, "fault", "copies")
    seen = narrow.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("_n"), F.min("turn").alias("_first"), F.max(F.col("turn").isNull()).alias("_null")).filter("_n > 1")
    seen = seen.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "_first", "_null")
    joined = narrow.join(seen, narrow["conv_id"].eqNullSafe(F.col("_conv")) & (narrow["role"] == F.col("_role")) & (narrow["digest"] == F.col("_digest")), "left")
    later = F.col("_digest").isNotNull() & F.col("turn").isNotNull() & (F.col("_null") | (F.col("turn") > F.col("_first")))
    initial = F.substring("role", 1, 1)
    marked = joined.select(*ORDER, F.when(initial.isin("s", "u", "a"), initial).otherwise(" ").alias("initial"), F.when((F.col("fault") != BLANK) & later, DUPLICATE).otherwise(F.col("fault")).alias("fault"), "copies")
    checkpoint_dir(different.sparkSession)
    return marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).checkpoint()


def facts(rows: list[tuple]) -> list[tuple[str, int, int]]:
    """(role initial, fault, copies) of block rows."""
    return [(r[4], r[5], r[6]) for r in rows]


EDGE = pa.schema({"block": pa.int32(), "last": pa.bool_(), "first": pa.bool_(), "conv_id": pa.string(), "matrix": pa.list_(pa.int64())})
LEAD = pa.schema({"block": pa.int32(), "to": pa.list_(pa.int32())})


def _with_block(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, Iterator[pa.RecordBatch]]:
    from pyspark import TaskContext

    return TaskContext.get().partitionId(), batches


def edges(sorted_blocks: DataFrame, costs: Costs) -> list:
    """The matrices of the first and the last conversation of each block, in order."""

    def batches(source):
        block, source = _with_block(source)
        first = True
        for conv, rows, last in segments(source):
            if first or last:
                matrix = None
                for symbol, n in runs(facts(rows)):
                    for part in powers(symbol, n, costs):
                        matrix = part if matrix is None else times(matrix, part)
                yield pa.RecordBatch.from_pylist([{"block": block, "last": last, "first": first, "conv_id": None if conv is None else str(conv), "matrix": [x for row in matrix for x in row]}], EDGE)
            first = False

    return sorted_blocks.mapInArrow(batches, "block int, last boolean, first boolean, conv_id string, matrix array<bigint>").orderBy("block", F.desc("first")).collect()


def carried(sorted_blocks: DataFrame, costs: Costs) -> dict[int, dict]:
    """For blocks whose conversations go on in others: costs after the last one, state before the first one."""
    found = edges(sorted_blocks, costs)
    after_last: dict[int, Vector] = {}
    goes_on = [a["block"] != b["block"] and a["conv_id"] == b["conv_id"] for a, b in zip(found, found[1:])]
    v = ending(costs)
    for k in range(len(found) - 1, -1, -1):
        v = v if k < len(goes_on) and goes_on[k] else ending(costs)
        if k < len(goes_on) and goes_on[k]:
            after_last[found[k]["block"]] = v
        m = found[k]["matrix"]
        v = onto(tuple(tuple(m[4 * s : 4 * s + 4]) for s in range(4)), v)
    if not after_last:
        return {}

    def batches(source):
        block, source = _with_block(source)
        if block in after_last:
            for _, rows, last in segments(source):
                if last:
                    yield pa.RecordBatch.from_pylist([{"block": block, "to": [solve(facts(rows), s, after_last[block], costs)[1] for s in range(4)]}], LEAD)

    lead = {r["block"]: r["to"] for r in sorted_blocks.mapInArrow(batches, "block int, to array<int>").collect()}
    before_first, state = {}, 0
    for k, edge in enumerate(found):
        if not (k and goes_on[k - 1]):
            state = 0
        elif edge["first"]:
            before_first[edge["block"]] = state
        if k < len(goes_on) and goes_on[k]:
            state = lead[edge["block"]][state]
    return {"after": after_last, "before": before_first}


def edits(different: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``ORDER``, initial, fault, copies, ``edits`` and ``roles`` (initials left) of each different row; insertions at the end belong to the last."""
    sorted_blocks = blocks(different)
    carry = carried(sorted_blocks, costs)
    after_last, before_first, names = carry.get("after", {}), carry.get("before", {}), sorted_blocks.columns

    def batches(source):
        block, source = _with_block(source)
        first = True
        for _, rows, last in segments(source):
            open_end = last and block in after_last
            each, state = solve(facts(rows), before_first.get(block, 0) if first else 0, after_last[block] if open_end else ending(costs), costs)
            if not open_end:
                each[-1] += finish(state, costs)[0]
            state, left = before_first.get(block, 0) if first else 0, []
            for row, text in zip(rows, each, strict=True):
                own, state = roles(row[4], text, state)
                left.append(own)
            first = False
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(each, pa.string()), pa.array(left, pa.string())], [*names, "edits", "roles"])

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = list(to_arrow_schema(sorted_blocks.schema).types)
    return sorted_blocks.mapInArrow(batches, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_blocks.schema) + ", edits string, roles string")


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


class Tally:
    """What one conversation adds up to while its rows stream by in order."""

    def __init__(self, costs: Costs):
        self.costs, self.sha, self.audit, self.lines = costs, hashlib.sha256(), [], 0
        self.faults, self.illegal, self.cost, self.before = [0] * 5, 0, 0, None
        self.turns, self.least, self.most = 0, None, None

    def row(self, turn: int | None, role: str, initial: str, fault: int, copies: int, edits: str, left: str, text: str) -> None:
        self.faults[fault] += 1 if fault != BLANK and fault != DUPLICATE else copies
        if fault != BLANK and fault != DUPLICATE:
            self.faults[DUPLICATE] += copies - 1
        self.illegal += (self.before is not None and self.before + initial not in LEGAL) + copies - 1
        self.before = initial
        if turn is not None and turn != self.most:
            self.turns, self.least, self.most = self.turns + 1, turn if self.least is None else self.least, turn
        self.audit.append(edits)
        self.cost += sum(edits.count(e) * c for e, c in zip("KRDI", self.costs[:4], strict=True))
        kept = edits.replace("D", "")
        if fault == TRUNCATED:
            self.cost += self.costs.truncated * (len(kept) - kept.count("I"))
        for edit, initial in zip(kept, left, strict=True):
            self.sha.update(("\n" * (self.lines > 0) + f"{role if edit == 'K' else ROLES[initial]}:{'' if edit == 'I' else text}").encode())
            self.lines += 1

    def values(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def streamed(conversations: DataFrame, different: DataFrame, costs: Costs) -> DataFrame:
    """All that a conversation's report needs, sorted: a marker per original, then for each row its edits and its text."""
    marker = conversations.select("conv_id").union(different.select("conv_id")).distinct().withColumn("fault", F.lit(ORIGINAL))
    both = edits(different, costs).unionByName(different.select(*ORDER, "text"), allowMissingColumns=True).unionByName(marker, allowMissingColumns=True)
    kind = F.when(F.col("fault") == ORIGINAL, 0).when(F.col("text").isNull(), 1).otherwise(2)
    rows = both.select("conv_id", (kind > 0).alias("_row"), "turn", "role", "digest", kind.alias("_kind"), "initial", "fault", "copies", "edits", "roles", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "_row", "turn", "role", "digest", "_kind")


def repair(rows: DataFrame, originals: DataFrame | None = None, costs: Costs = Costs()) -> DataFrame:
    """One row per conv_id of ``originals`` (default ``rows``): its faults, the edits as ``audit``, their cost and the digest of the result."""
    originals = rows if originals is None else originals
    conv = originals.schema["conv_id"].dataType

    def batches(source):
        held, out, pending = None, None, None

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([held[0]], kinds[0]), *(pa.array([v], t) for v, t in zip(out.values(), kinds[1:], strict=True))], ["conv_id", *(c.split()[0] for c in REPORT.split(", "))])

        for batch in source:
            for conv_id, is_row, turn, role, _, kind, initial, fault, copies, edit, left, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_row:
                    if held is not None:
                        yield closed()
                    held, out = (conv_id,), Tally(costs)
                elif kind == 1:
                    pending = turn, role, initial, fault, copies, edit, left
                else:
                    out.row(*pending, text)
        if held is not None:
            yield closed()

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(conv), *([pa.int64()] * 6), pa.string(), pa.string()]
    return streamed(originals, counted(rows), costs).mapInArrow(batches, f"conv_id {conv.simpleString()}, {REPORT}")


def repaired(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The repaired turns themselves, ordered by conv_id, turn, role_before, digest, at: edit, role and text."""
    different = counted(rows)
    texts = different.select(*(F.col(c).alias(f"_{c}") for c in ORDER), "text")
    same = F.lit(True)
    for c in ORDER:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    turns = edits(different, costs).filter("roles <> ''").join(texts, same)
    letters = F.arrays_zip(F.split(F.translate("edits", "D", ""), "").alias("edit"), F.split("roles", "").alias("initial"))
    each = turns.select("conv_id", "turn", F.col("role").alias("role_before"), "digest", "text", F.posexplode(letters).alias("at", "_each"))
    role = F.when(F.col("_each.edit") == "K", F.col("role_before")).when(F.col("_each.initial") == "u", ROLES["u"]).otherwise(ROLES["a"])
    return each.select("conv_id", "turn", "role_before", "digest", "at", F.col("_each.edit").alias("edit"), role.alias("role"), F.when(F.col("_each.edit") == "I", "").otherwise(F.col("text")).alias("text"))
