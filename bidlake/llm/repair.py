"""Repair of conversation structure by least-cost edits, with Four-Russians block tables.

Roles must read ``(s?(ua)+)?`` by their initials: perhaps one system turn, then pairs of user and assistant.
Rows may be kept (0), given the role that is due (``REROLE``), deleted (``DELETE``), and empty turns inserted
(``INSERT``); an undeleted row without end mark costs ``UNENDED`` more, blank and repeated rows must go.

A row is one of nine symbols. What a suffix of a conversation costs from each of the four states of the
pattern is a cost vector; less its least entry it is one of a few hundred, because each state reaches the
others by few edits. ``tables`` holds, for each such vector and each block of ``BLOCK`` symbols, the vector
before the block and what was taken off, so a conversation is costed by one look-up a block, from its end to its
start. Going forward again, each block is expanded backwards from the vector behind it, and of the edits that
keep the least cost the one with the least initial is taken, which gives the least audit among ties.

Rows are sorted by a range exchange, so a long conversation spans many tasks. What lies whole in one task is
finished there. The rest is cut into slices of bounded size; a slice is a 4 x 4 matrix of least costs, the few
matrices of a conversation give the vector behind each slice, and then where each slice is entered, so
that slices are repaired side by side. Only a digest of a whole conversation reads its slices in turn, one
at a time.

Defined results: null role and text are one space; rows go by turn, nulls first, then by role and text; rows that
agree in all are copies, of which all but the first are duplicates; a null conv_id is a conversation; a
conversation without rows has zeros, no edits and no turns; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.common import materialize, small_batches

REROLE, DELETE, INSERT, UNENDED = 3, 4, 3, 3
BLOCK = 4
SLICE_ROWS, SLICE_CHARS = 16_384, 1 << 22
FAR = 1 << 20  # no way from here to there

# States: nothing yet, after system, after user, after assistant; classes of a role by its initial.
START, SYSTEM, USER, ASSISTANT = range(4)
S, U, A, O = range(4)
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP = {(START, S): SYSTEM, (START, U): USER, (SYSTEM, U): USER, (ASSISTANT, U): USER, (USER, A): ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
GONE = 8  # the symbol of a row that must be deleted; 2 * class + (1 if it lacks an end mark) for others
SYMBOLS = 9
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {(S, U), (U, A), (A, U)}
WHITE = r"\x20\x09-\x0D"


def closed(direct: list[int]) -> tuple[int, ...]:
    """Cost vector with insertions in front."""
    out = list(direct)
    out[USER], out[ASSISTANT] = min(direct[USER], INSERT + direct[ASSISTANT]), min(direct[ASSISTANT], INSERT + direct[USER])
    for s in (START, SYSTEM):
        out[s] = min(direct[s], INSERT + out[USER])
    return tuple(min(x, FAR) for x in out)


def edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of each edit of a row, by initial."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        kind, extra = symbol // 2, UNENDED * (symbol % 2)
        if (state, kind) in KEEP:
            out.append(("K", extra, KEEP[state, kind]))
        out.append(("R", REROLE + extra, TURN[state]))
    return out


def before(vector: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    return closed([min(cost + vector[to] for _, cost, to in edits(s, symbol)) for s in range(4)])


END = closed([0, FAR, FAR, 0])
UNIT = [tuple(0 if s == t else FAR for s in range(4)) for t in range(4)]


def normal(vector: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(vector)
    return tuple(FAR if x >= FAR else x - least for x in vector), least


@dataclass(frozen=True)
class Tables:
    vectors: list[tuple[int, ...]]
    ids: dict[tuple[int, ...], int]
    step: tuple[np.ndarray, np.ndarray]  # by vector, symbol: vector before it, what was taken off
    block: tuple[np.ndarray, np.ndarray]  # the same by vector, block code

    def back(self, vector: int, symbols: bytes) -> tuple[list[int], int]:
        """Vectors at the block ends from the end of ``symbols`` to their start, and the sum of what was taken off."""
        head = len(symbols) % BLOCK
        codes = np.frombuffer(symbols[head:], np.uint8).reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
        at, total = [vector], 0
        for code in codes[::-1].tolist():
            total += int(self.block[1][vector, code])
            vector = int(self.block[0][vector, code])
            at.append(vector)
        for symbol in symbols[:head][::-1]:
            total += int(self.step[1][vector, symbol])
            vector = int(self.step[0][vector, symbol])
        if head:
            at.append(vector)
        return at, total


@lru_cache(maxsize=1)
def tables() -> Tables:
    """All normalised vectors that suffixes can have, and their transitions by symbol and by block."""
    vectors = [normal(END)[0], *UNIT]
    ids = {v: k for k, v in enumerate(vectors)}
    to, off = [], []
    for vector in vectors:  # grows while it is read
        for symbol in range(SYMBOLS):
            earlier, least = normal(before(vector, symbol))
            if earlier not in ids:
                ids[earlier] = len(vectors)
                vectors.append(earlier)
            to.append(ids[earlier])
            off.append(least)
    step = np.array(to, np.int32).reshape(-1, SYMBOLS), np.array(off, np.int32).reshape(-1, SYMBOLS)
    block = step
    for _ in range(BLOCK - 1):  # one more symbol in front
        grow = lambda x: x.transpose(0, 2, 1).reshape(len(vectors), -1)
        block = grow(step[0][block[0]]), grow(step[1][block[0]] + block[1][:, :, None])
    return Tables(vectors, ids, step, block)


@lru_cache(maxsize=200_000)
def trace_block(symbols: bytes, vector: int, state: int) -> tuple[str, int]:
    """Least audit through a block with ``vector`` behind it, from ``state``; and the state after it."""
    t = tables()
    behind = [vector]
    for symbol in symbols[::-1]:
        behind.append(int(t.step[0][behind[-1], symbol]))
    behind.reverse()
    out = []
    for k, symbol in enumerate(symbols):
        here, after, taken = t.vectors[behind[k]], t.vectors[behind[k + 1]], int(t.step[1][behind[k + 1], symbol])
        while True:
            ways = {letter: to for letter, cost, to in edits(state, symbol) if cost + after[to] == here[state] + taken}
            if "D" not in ways and INSERT + here[TURN[state]] == here[state]:
                out.append("I")
                state = TURN[state]
                continue
            letter = min(ways)
            out.append(letter)
            state = ways[letter]
            break
    return "".join(out), state


def trace(symbols: bytes, vector: int, state: int) -> tuple[str, int]:
    """Least audit of a run of symbols, and the state after it."""
    at = tables().back(vector, symbols)[0]
    head = len(symbols) % BLOCK
    cuts = ([0] if head else []) + list(range(head, len(symbols) + 1, BLOCK))
    out = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        piece, state = trace_block(symbols[a:b], at[len(at) - 2 - k], state)
        out.append(piece)
    return "".join(out), state


def ending(state: int) -> str:
    """Insertions behind the last row."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def matrix(symbols: bytes) -> list[int]:
    """Least cost from each state before the symbols to each state behind them, row by row."""
    t = tables()
    out = []
    for unit in UNIT:
        at, total = t.back(t.ids[unit], symbols)
        out.append([FAR if x >= FAR else x + total for x in t.vectors[at[-1]]])
    return [out[to][s] for s in range(4) for to in range(4)]


def turns(audit: str, state: int, roles: list[str | None], texts: list[str | None]) -> list[dict[str, str]]:
    """The repaired turns of a run of rows whose edits are ``audit``."""
    out, row = [], 0
    classes = {"s": S, "u": U, "a": A}
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        to = KEEP[state, classes.get(roles[row][:1], O)] if letter == "K" else TURN[state]
        out.append({"role": roles[row] if letter == "K" else NAMES[to], "text": "" if letter == "I" else texts[row]})
        row += letter != "I"
        state = to
    return out


def faults(rows: DataFrame) -> DataFrame:
    """Sorted rows (conv_id, turn, role, text, n, fault, kind, part) of conversations; rows that agree in all are one, ``n`` times."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    same = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "n").groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    same = materialize(same.withColumn("_digest", F.md5("text")), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    again = same.where("n > 0").groupBy("conv_id", "role", "_digest").agg(F.count("*").alias("_often"), F.min(order).alias("_first")).where("_often > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_digest").alias("_same"), "_first")
    met = same.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_digest") == F.col("_same")), "left")
    last = F.regexp_extract("text", rf"([^{WHITE}])[{WHITE}]*\z", 1)
    fault = F.when(last == "", BLANK).when(F.col("_first").isNotNull() & (F.col("_first") < order), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(O)
    found = met.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), kind.alias("kind"))
    keys = ["conv_id", "turn", "role", "text"]
    return found.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())


class Run:
    """Rows of one conversation, in order, up to the size of a slice."""

    def __init__(self, conv, most: int) -> None:
        self.conv, self.most, self.symbols, self.roles, self.texts, self.chars = conv, most, bytearray(), [], [], 0
        self.count, self.illegal, self.first, self.last = [0, 0, 0, 0], 0, None, None
        self.low = self.high = None
        self.distinct = 0

    def add(self, turn, role: str, text: str, n: int, fault: int, kind: int) -> None:
        """``n`` copies of a row; the first has the fault ``fault``, others are duplicates unless blank."""
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        self.illegal += (self.last is not None and (self.last, kind) not in LEGAL) + (n - 1)
        self.first = kind if self.first is None else self.first
        self.last = kind
        self.count[fault] += 1
        self.count[BLANK if fault == BLANK else DUPLICATE] += n - 1
        gone = fault in (BLANK, DUPLICATE)
        self.symbols += bytes([GONE if gone else 2 * kind + (fault == TRUNCATED)]) + bytes([GONE]) * (n - 1)
        self.roles += [None if gone else role] + [None] * (n - 1)
        self.texts += [None if gone else text] + [None] * (n - 1)
        self.chars += 0 if gone else len(text)

    def full(self) -> bool:
        return len(self.symbols) >= self.most or self.chars >= SLICE_CHARS


TURNS = "array<struct<role:string,text:string>>"
SUMS = "low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long"
SLICES = f"part int, seq long, whole boolean, {SUMS}, first int, last int, cost long, audit string, repaired {TURNS}, costs array<int>, symbols binary, roles array<string>, texts array<string>"


def _slices(rows: DataFrame, most: int) -> DataFrame:
    """Slices of conversations of at most so many rows; ``whole`` ones are repaired, the others hold their rows."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, seq = tables(), None, 0
        run, opened = None, True  # ``opened``: the conversation may have rows before this slice

        def out(open_: bool) -> dict:
            nonlocal seq
            row = {"conv_id": run.conv, "part": part, "seq": seq, "whole": not open_, "low": run.low, "high": run.high, "distinct": run.distinct, "illegal": run.illegal, "first": run.first, "last": run.last}
            row |= {"blank": run.count[BLANK], "duplicate": run.count[DUPLICATE], "truncated": run.count[TRUNCATED]}
            symbols = bytes(run.symbols)
            seq += 1
            if open_:
                return row | {"costs": matrix(symbols), "symbols": symbols, "roles": run.roles, "texts": run.texts}
            at, total = t.back(0, symbols)
            audit, state = trace(symbols, 0, START)
            audit += ending(state)
            return row | {"cost": t.vectors[at[-1]][START] + total, "audit": audit, "repaired": turns(audit, START, run.roles, run.texts)}

        schema = None
        for batch in batches:
            if not len(batch):
                continue
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *_arrow_fields()])
            part = batch.column("part")[0].as_py()
            done, size = [], 0
            for conv_id, turn, role, text, n, fault, kind in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fault", "kind")), strict=True):
                if run is not None and run.conv != conv_id:
                    size += run.chars
                    done.append(out(opened))
                    run, opened = Run(conv_id, most), False
                elif run is None:
                    run = Run(conv_id, most)
                while n:
                    some = min(n, most)
                    run.add(turn, role, text, some, fault, kind)
                    n -= some
                    fault = BLANK if fault == BLANK else DUPLICATE
                    if run.full():
                        opened, size = True, size + run.chars
                        done.append(out(True))
                        run = Run(conv_id, most)
                if size > SLICE_CHARS:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, size = [], 0
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if run is not None:
            yield pa.RecordBatch.from_pylist([out(True)], schema)

    return rows.mapInArrow(cut, f"conv_id {conv}, {SLICES}")


def _arrow_fields() -> list[tuple[str, pa.DataType]]:
    whole, text = pa.int64(), pa.string()
    fields = [("part", pa.int32()), ("seq", whole), ("whole", pa.bool_()), *[(c.split()[0], whole) for c in SUMS.split(", ")], ("first", pa.int32()), ("last", pa.int32()), ("cost", whole), ("audit", text)]
    fields.append(("repaired", pa.list_(pa.struct([("role", text), ("text", text)]))))
    return [*fields, ("costs", pa.list_(pa.int32())), ("symbols", pa.binary()), ("roles", pa.list_(text)), ("texts", pa.list_(text))]


def _by_conversation(slices: DataFrame, fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Folds the small rows of the slices of each conversation, in order."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        out = fold(rows.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist())
        return pa.table({c: pa.array([r[c] for r in out], rows.schema.field(c).type if c in rows.schema.names else kinds[c]) for c in names})

    kinds = {"behind": pa.list_(pa.int32()), "cost": pa.int64(), "enter": pa.int32(), "final": pa.bool_(), "gaps": pa.int64()}
    return slices.groupBy("conv_id").applyInArrow(run, schema)


def _behind(slices: list[dict]) -> list[dict]:
    """The cost vector behind each slice, from the last to the first."""
    vector, out = END, []
    for row in reversed(slices):
        out.append({"part": row["part"], "seq": row["seq"], "behind": list(normal(vector)[0]), "final": not out})
        costs = np.array(row["costs"], np.int64).reshape(4, 4)
        vector = tuple(int(min(x, FAR)) for x in (costs + np.array(normal(vector)[0])).min(axis=1))
    return out


def _entered(slices: list[dict]) -> list[dict]:
    state, out = START, []
    for row in slices:
        out.append({"part": row["part"], "seq": row["seq"], "enter": state})
        state = row["exits"][state]
    return out


def _totals(slices: list[dict]) -> list[dict]:
    """Sums of a conversation: what its slices hold, and what lies between two of them."""
    add = lambda c: sum(r[c] for r in slices)
    held = [r for r in slices if r["first"] is not None]
    timed = [r for r in slices if r["high"] is not None]
    distinct = add("distinct") - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:], strict=False))
    illegal = add("illegal") + sum((a["last"], b["first"]) not in LEGAL for a, b in zip(held, held[1:], strict=False))
    vector, total = END, 0
    for row in reversed(slices):
        vector, least = normal(tuple(int(min(x, FAR)) for x in (np.array(row["costs"], np.int64).reshape(4, 4) + np.array(vector)).min(axis=1)))
        total += least
    gaps = timed[-1]["high"] - timed[0]["low"] + 1 - distinct if timed else 0
    return [{"conv_id": slices[0]["conv_id"], "gaps": gaps, "blank": add("blank"), "duplicate": add("duplicate"), "truncated": add("truncated"), "illegal": illegal, "cost": vector[START] + total}]


def _exits(slices: DataFrame) -> DataFrame:
    """part, seq, exits: the state behind a slice by the state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exits = [[trace(s, tables().ids[tuple(v)], k)[1] for k in range(4)] for s, v in zip(batch.column("symbols").to_pylist(), batch.column("behind").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("seq"), pa.array(exits, pa.list_(pa.int32()))], names=["conv_id", "part", "seq", "exits"])

    conv = slices.schema["conv_id"].dataType.simpleString()
    return slices.select("conv_id", "part", "seq", "symbols", "behind").mapInArrow(run, f"conv_id {conv}, part int, seq long, exits array<int>")


def _pieces(slices: DataFrame) -> DataFrame:
    """conv_id, part, seq, audit, repaired of slices whose state before and vector behind are known."""
    conv = slices.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                audit, state = trace(row["symbols"], tables().ids[tuple(row["behind"])], row["enter"])
                audit += ending(state) if row["final"] else ""
                repaired = turns(audit, row["enter"], row["roles"], row["texts"])
                columns = [batch.column(c).slice(k, 1) for c in ("conv_id", "part", "seq")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([audit]), pa.array([repaired], dict(_arrow_fields())["repaired"])], names=["conv_id", "part", "seq", "audit", "repaired"])

    wanted = slices.select("conv_id", "part", "seq", "symbols", "behind", "enter", "final", "roles", "texts")
    return wanted.mapInArrow(run, f"conv_id {conv}, part int, seq long, audit string, repaired {TURNS}")


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


@dataclass(frozen=True)
class Repairs:
    """``whole``: conversations with counts, audit and repaired turns. Conversations that span tasks: ``totals``, and their ``pieces`` by part and seq."""

    whole: DataFrame
    totals: DataFrame
    pieces: DataFrame


def repair(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> Repairs:
    """``rows``: conv_id, turn, role, text, n (how often the row stands there; 0: only the conversation is known)."""
    slices = materialize(_slices(small_batches(faults(rows)), slice_rows), "slices")
    names = [c.split()[0] for c in COUNTS.split(", ")]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")
    whole = slices.where("whole").select("conv_id", gaps, *names[1:], "audit", "repaired")
    parts = slices.where("not whole")
    conv = rows.schema["conv_id"].dataType.simpleString()
    small = parts.select("conv_id", "part", "seq", "low", "high", "distinct", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs")
    totals = _by_conversation(small, _totals, f"conv_id {conv}, {COUNTS}")
    behind = _by_conversation(small, _behind, "part int, seq long, behind array<int>, final boolean")
    parts = materialize(parts.select("conv_id", "part", "seq", "symbols", "roles", "texts").join(behind, ["part", "seq"]), "slices")
    entered = _by_conversation(_exits(parts), _entered, "part int, seq long, enter int")
    return Repairs(whole, totals, _pieces(parts.join(entered, ["part", "seq"])))


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of conversations in pieces: each is read in order, one piece at a time."""
    conv = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, audit, digest, started = None, [], sha256(), None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for k in range(len(batch)):
                conv_id = batch.column("conv_id")[k].as_py()
                if started is None or conv_id != current:
                    if started is not None:
                        yield out()
                    current, audit, digest, started = conv_id, [], sha256(), False
                audit.append(batch.column("audit")[k].as_py())
                for turn in batch.column("repaired")[k].as_py():
                    digest.update((("\n" if started else "") + f"{turn['role']}:{turn['text']}").encode())
                    started = True
        if started is not None:
            yield out()

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, f"conv_id {conv}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by the hash of conversation and turn: conv_id, turn, role, text, n."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))), F.lit(20)).alias("hit")
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), hit)
    at = lambda k: F.col("hit") == k
    when = lambda k, value, column: F.when(at(k), value).otherwise(column)
    text = F.when(at(0) | at(1), "").when(at(2), F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = when(4, "user", when(0, "", F.col("role")))
    return rows.select("conv_id", when(0, None, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), when(0, 0, when(3, 2, F.lit(1))).cast("long").alias("n"))


def repair_report(conversations: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Counts, cost, audit and digest of the repaired turns of each damaged conversation."""
    done = repair(damaged(conversations), slice_rows)
    line = lambda turn: F.concat(turn["role"], F.lit(":"), turn["text"])
    sha: Column = F.sha2(F.array_join(F.transform("repaired", line), "\n"), 256).alias("repaired_sha256")
    whole = done.whole.select(*[c for c in done.whole.columns if c != "repaired"], sha)
    sums = done.totals.withColumnRenamed("conv_id", "_conv")
    rest = digests(done.pieces).join(sums, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*whole.columns)
    return whole.unionByName(rest)
