"""Repair of the structure of conversations: the cheapest edits that make the roles alternate.

A conversation is in order if its role initials read `(s?(ua)+)?`. Each turn is kept, given another role or deleted, and
empty turns may be inserted; blank and repeated turns must go, and a truncated one that stays costs more. The cheapest edits
come from a dynamic program over the turns, from the last to the first, with four states (nothing yet, after the system's,
a user's or an assistant's turn). Vectors of its costs are stored at every square root of the turns only and worked out
again, block by block, while a walk from the front takes the first letter that is still tight.

Turns are sorted by ranges, so a conversation of any length is spread over tasks. A task cuts what it has of one into bounded
blocks; a conversation in one block is finished there. Blocks of longer ones send a 4 x 4 table of costs, which one pass
backwards turns into the cost vectors at their ends (the program's checkpoints); then every block is walked on its
own from each state, and one pass forwards picks the walks that fit together.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhead.llm.common import partitions, with_key, written

# The costs of edits, and how the text of a turn is judged.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

#: Turns and bytes that a block holds at most (a longer turn is a block of its own).
BLOCK_TURNS, BLOCK_BYTES = 1024, 1 << 20
#: First characters of a text that ranges of turns may be cut by.
HEAD = 64

START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: A turn's code is 3 x role + fault.
OTHER_ROLE, S_ROLE, U_ROLE, A_ROLE = range(4)
FINE, CUT, GONE = range(3)

# The state after a user's or an assistant's turn, and after a turn of each kind of role that is kept (-1: not possible).
_NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = ((-1, SYSTEM, USER, -1), (-1, -1, USER, -1), (-1, -1, -1, ASSISTANT), (-1, -1, USER, -1))
_FINAL = (0, 2 * INSERT, INSERT, 0)


def _settled(costs: list[int]) -> tuple[int, ...]:
    """The costs from each state once turns may be inserted as well."""
    u = min(costs[USER], costs[ASSISTANT] + INSERT)
    return min(costs[START], u + INSERT), min(costs[SYSTEM], u + INSERT), u, min(costs[ASSISTANT], costs[USER] + INSERT)


def _before(code: int, after: Sequence[int]) -> tuple[int, ...]:
    """The costs from each state before a turn, from those behind it."""
    role, fault = divmod(code, 3)
    if fault == GONE:
        return _settled([DELETE + a for a in after])
    more = TRUNCATED if fault == CUT else 0
    costs = []
    for state in range(4):
        best = min(DELETE + after[state], REROLE + more + after[_NEXT[state]])
        kept = _KEPT[state][role]
        costs.append(best if kept < 0 else min(best, more + after[kept]))
    return _settled(costs)


def transfer(codes: bytes) -> list[list[int]]:
    """The least cost of a block from each state before it to each state behind it."""
    unit = [tuple(0 if a == b else FAR for b in range(4)) for a in range(4)]
    columns = []
    for costs in unit:
        for code in reversed(codes):
            costs = _before(code, costs)
        columns.append(costs)
    return [[min(c[a], FAR) for c in columns] for a in range(4)]


def walks(codes: bytes, after: Sequence[int], states: Sequence[int]) -> tuple[tuple[int, ...], list[tuple[str, int]]]:
    """The costs before a block, and from each of `states` the ASCII-least cheapest edits and the state behind them.

    `after` are the costs behind the block. Turns inserted right behind the block belong to what follows. Of the cost vectors
    only every square root is stored; those of one stretch at a time are worked out again.
    """
    n = len(codes)
    step = max(1, math.isqrt(n))
    stored = {n: tuple(after)}
    costs = tuple(after)
    for i in range(n - 1, -1, -1):
        costs = _before(codes[i], costs)
        if i % step == 0:
            stored[i] = costs
    live = [(state, []) for state in states]
    for first in range(0, n, step):
        last = min(first + step, n)
        vectors = [stored[last]]
        for i in range(last - 1, first - 1, -1):
            vectors.append(_before(codes[i], vectors[-1]))
        vectors.reverse()
        live = [(_walk(codes[first:last], vectors, state, edits), edits) for state, edits in live]
    return costs, [("".join(edits), state) for state, edits in live]


def _walk(codes: bytes, vectors: Sequence[Sequence[int]], state: int, edits: list[str]) -> int:
    """Walks over turns with the costs before and behind each, adds the letters and returns the state at the end."""
    for code, here, after in zip(codes, vectors, vectors[1:], strict=False):
        role, fault = divmod(code, 3)
        more = TRUNCATED if fault == CUT else 0
        while True:  # letters in ASCII order: the first that is tight
            rest = here[state]
            if DELETE + after[state] == rest:
                edits.append("D")
            elif INSERT + here[_NEXT[state]] == rest:
                edits.append("I")
                state = _NEXT[state]
                continue
            elif fault != GONE and _KEPT[state][role] >= 0 and more + after[_KEPT[state][role]] == rest:
                edits.append("K")
                state = _KEPT[state][role]
            else:
                edits.append("R")
                state = _NEXT[state]
            break
    return state


def closing(state: int) -> str:
    """The edits behind the last turn."""
    return "I" * (_FINAL[state] // INSERT)


def applied(edits: str, turns: Sequence[tuple[bytes, bytes]], state: int) -> tuple[list[tuple[bytes, bytes]], int]:
    """The turns (role, text) that the edits leave, and the state behind them."""
    rows, out = iter(turns), []
    for edit in edits:
        role, text = (b"", b"") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = _KEPT[state][{b"s": S_ROLE, b"u": U_ROLE, b"a": A_ROLE}[role[:1]]]
        else:
            state = _NEXT[state]
            role = b"user" if state == USER else b"assistant"
        out.append((role, text))
    return out, state


# --- turns, judged and sorted ---


def judged(rows: DataFrame, absent: str | None = None) -> DataFrame:
    """`rows` (see `repair`) with their `code`, and slim records (`marker`) that say which of them repeat an earlier turn.

    Repeats are found by digests, counted before they are shuffled; the texts stay out of that join. A marker has the place
    (conv_id, turn, role, head) of its turn, so that it arrives where the turn does. Blank and absent turns, of which a
    table may hold any number of copies, are counted first as well (`copies`).
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    gone = F.lit(False) if absent is None else F.coalesce(F.col(absent), F.lit(False))
    given = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(gone, "").otherwise(role).alias("role"), F.when(gone, "").otherwise(text).alias("text"), gone.alias("gone"))
    given = given.withColumn("head", F.substring("text", 1, HEAD)).withColumn("bare", F.rtrim("text", F.lit(BLANKS)))
    full = given.where("bare <> ''")
    empty = given.where("bare = ''").groupBy("conv_id", "turn", "role", "text", "gone", "head", "bare").agg(F.count("*").alias("copies"))
    every = full.withColumn("copies", F.lit(1).cast("bigint")).unionByName(empty)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", S_ROLE).when(initial == "u", U_ROLE).when(initial == "a", A_ROLE).otherwise(OTHER_ROLE)
    blank = F.col("bare") == ""
    fault = F.when(blank, GONE).when(~F.substring("bare", -1, 1).isin(*ENDS), CUT).otherwise(FINE)
    coded = every.select("conv_id", "turn", "role", "head", "text", "gone", "copies", (kind * 3 + fault).cast("int").alias("code"), blank.alias("blank"), F.lit(None).cast("string").alias("marker"))

    slim = full.select("conv_id", "turn", "role", "head", F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256).alias("digest"))
    # the first turn of each text that comes again: null before all numbers
    again = slim.groupBy("conv_id", "digest").agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("least"))
    again = again.where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), F.when(~F.col("no_turn"), F.col("least")).alias("first"))
    later = slim.join(written(again, "turns-again"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))).where(~F.col("turn").eqNullSafe(F.col("first")))
    marks = later.groupBy("conv_id", "turn", "role", "head", "digest").agg(F.lit(0).alias("code"))
    none = {"text": F.lit(""), "gone": F.lit(False), "copies": F.lit(0).cast("bigint"), "blank": F.lit(False)}
    return coded.unionByName(marks.withColumnRenamed("digest", "marker").withColumns(none))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPORT = ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_REPORT_KINDS = {**dict.fromkeys(_COUNTS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}


_BLOCK = """piece int, block int, whole boolean, n int, codes binary, turns array<struct<role:binary,text:binary>>, blank bigint, duplicate bigint, truncated bigint,
    illegal bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint, n_turns bigint, transfer array<bigint>, report struct<""" + _REPORT + ">"
_TURNS = pa.list_(pa.struct([("role", pa.binary()), ("text", pa.binary())]))
_KINDS = {
    "piece": pa.int32(), "block": pa.int32(), "whole": pa.bool_(), "n": pa.int32(), "codes": pa.binary(), "turns": _TURNS, "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(),
    "illegal": pa.int64(), "first_initial": pa.string(), "last_initial": pa.string(), "first_turn": pa.int64(), "last_turn": pa.int64(), "n_turns": pa.int64(), "transfer": pa.list_(pa.int64()), "report": pa.struct(list(_REPORT_KINDS.items())),
}
_LEGAL = {"su", "ua", "au"}


def digest(role: bytes, text: bytes) -> str:
    """As `judged` has it."""
    return hashlib.sha256(b"%d:%b:%b" % (len(role), role, text)).hexdigest()


def _initial(role: bytes) -> str:
    return role[:4].decode(errors="replace")[:1]


class _Block:
    """Turns of one conversation that follow each other."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.codes = bytearray()
        self.turns: list[tuple[bytes, bytes]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first_initial = self.last_initial = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, role: bytes, text: bytes, code: int, blank: bool) -> None:
        initial = _initial(role)
        if self.codes:
            self.illegal += self.last_initial + initial not in _LEGAL
        else:
            self.first_initial = initial
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        fault = code % 3
        self.blank += blank
        self.duplicate += fault == GONE and not blank
        self.truncated += fault == CUT
        self.codes.append(code)
        self.turns.append((role, text))
        self.size += len(role) + len(text)

    def row(self, piece: int, whole: bool, report: bool) -> tuple:
        """The block's record; of a whole conversation the report alone, if that is all that is asked for."""
        codes = bytes(self.codes)
        if whole and report:
            told = _Told()
            costs, ((edits, state),) = walks(codes, _FINAL, [START])
            told.add(vars(self) | {"n": len(codes)}, self.turns, edits, state, costs[START])
            return (piece, self.number, whole, *[None] * (len(_KINDS) - 4), dict(zip(_REPORT_KINDS, told.close()[1], strict=True)))
        table = [] if whole else list(itertools.chain(*transfer(codes)))
        turns = [{"role": r, "text": t} for r, t in self.turns]
        return (piece, self.number, whole, len(codes), codes, turns, self.blank, self.duplicate, self.truncated, self.illegal, self.first_initial, self.last_initial, self.first_turn, self.last_turn, self.n_turns, table, None)


def _blocks(batches: Iterator[pa.RecordBatch], kind: pa.DataType, block_turns: int, report: bool) -> Iterator[pa.RecordBatch]:
    """Sorted turns of one range to blocks. The range's first and last conversation may go on in others, so they are never `whole`."""
    from pyspark import TaskContext

    piece = TaskContext.get().partitionId()
    out: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal out, held
        keys, rows = [k for k, _ in out], [r for _, r in out]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)]
        out, held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *columns], names=["conv_id", *_KINDS])

    key, block, first, started = None, None, True, False
    marks: set[str] = set()  # of the place at hand
    marked = before = None

    def close(whole: bool) -> None:
        nonlocal held
        out.append((key, block.row(piece, whole, report)))
        held += block.size + 200 * len(block.codes)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv, turn, role, head, text, gone, copies, code, blank, marker in zip(*columns, strict=True):
            place = (conv, turn, role, head)
            if marker is not None:
                if marked != place:
                    marks.clear()
                    marked = place
                marks.add(marker)
                continue
            if not started or conv != key:
                if started:
                    close(block.number == 0 and not first)
                    first = False
                key, block, started = conv, _Block(0), True
            if gone:
                continue
            # equal turns follow each other
            repeated = before == (place, text) or (marked == place and digest(role, text) in marks)
            before = (place, text)
            for k in range(copies):
                if block.codes and (len(block.codes) == block_turns or block.size + len(text) > BLOCK_BYTES):
                    close(False)
                    block = _Block(block.number + 1)
                block.add(turn, role, text, code - code % 3 + GONE if repeated or k else code, blank)
                if held > BLOCK_BYTES:
                    yield flush()
    if started:
        close(False)
    if out:
        yield flush()


def blocks(rows: DataFrame, block_turns: int = BLOCK_TURNS, absent: str | None = None, report: bool = False) -> DataFrame:
    """The turns of `rows` (see `repair`) as a table of blocks (see `_BLOCK`), in the order of (piece, block) within a conversation."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    ranges = judged(rows, absent).repartitionByRange(partitions(rows), *keys, "head")
    ordered = ranges.sortWithinPartitions(*keys, "head", F.col("marker").desc_nulls_last(), "text")
    ordered = ordered.select("conv_id", "turn", *(F.col(c).cast("binary") for c in ("role", "head", "text")), "gone", "copies", "code", "blank", "marker")
    schema = with_key(rows, "conv_id", _BLOCK)
    kind = _arrow(rows)
    return written(ordered.mapInArrow(lambda batches: _blocks(batches, kind, block_turns, report), schema), "turns-blocks")


def _arrow(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv_id"].dataType)


# --- conversations of several blocks ---

_ENDS = "piece int, block int, after array<bigint>"
_WALKED = "piece int, block int, cost bigint, edits array<string>, ends array<int>"


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (conv_id, piece, block, transfer), the last of a conversation first, to the costs behind each."""
    key, after, started = None, _FINAL, False
    for batch in batches:
        behind = []
        for conv, table in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if not started or conv != key:
                key, after, started = conv, _FINAL, True
            behind.append(list(after))
            after = [min(table[4 * a + b] + after[b] for b in range(4)) for a in range(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(behind, pa.list_(pa.int64()))], names=["conv_id", "piece", "block", "after"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (conv_id, piece, block, codes, after) to their cost from the start and the walks from all states."""
    for batch in batches:
        made = [walks(codes, after, range(4)) for codes, after in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        columns = [pa.array([c[START] for c, _ in made], pa.int64()), pa.array([[e for e, _ in w] for _, w in made], pa.list_(pa.string())), pa.array([[s for _, s in w] for _, w in made], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["conv_id", "piece", "block", "cost", "edits", "ends"])


class _Told:
    """The report of a conversation, from its blocks in order."""

    def __init__(self):
        self.digest, self.any = hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.last_initial = self.first_turn = self.last_turn = self.cost = None
        self.state, self.audit = START, []

    def add(self, b: dict, rows: list[tuple[bytes, bytes]], edits: str, state: int, cost: int) -> list[tuple[bytes, bytes]]:
        self.blank, self.duplicate, self.truncated = self.blank + b["blank"], self.duplicate + b["duplicate"], self.truncated + b["truncated"]
        self.illegal += b["illegal"]
        if self.last_initial is not None and b["n"]:
            self.illegal += self.last_initial + b["first_initial"] not in _LEGAL
        if b["n"]:
            self.last_initial = b["last_initial"]
        if b["n_turns"]:
            self.n_turns += b["n_turns"] - (self.last_turn == b["first_turn"])
            self.first_turn = b["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = b["last_turn"]
        self.cost = cost if self.cost is None else self.cost
        turns, end = applied(edits, rows, self.state)
        assert end == state
        self.state = state
        self.audit.append(edits)
        self.tell(turns)
        return turns

    def tell(self, turns: list[tuple[bytes, bytes]]) -> None:
        for role, text in turns:
            self.digest.update((b"\n" if self.any else b"") + role + b":" + text)
            self.any = True

    def close(self) -> tuple[list[tuple[bytes, bytes]], tuple]:
        """The turns added at the end, and the report."""
        edits = closing(self.state)
        turns, _ = applied(edits, [], self.state)
        self.tell(turns)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.n_turns
        return turns, (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join([*self.audit, edits]), self.digest.hexdigest())


_REPAIRED = "part int, turns array<struct<role:binary,text:binary>>"


def _batch(keys: list, rows: list[tuple], kind: pa.DataType, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True))], names=["conv_id", *kinds])


def _told(batches: Iterator[pa.RecordBatch], kind: pa.DataType, report: bool) -> Iterator[pa.RecordBatch]:
    """Blocks in order, with their walks unless they are whole conversations, to reports or to the repaired turns of each block.

    One batch of blocks is held at a time.
    """
    kinds = _REPORT_KINDS if report else {"part": pa.int32(), "turns": _TURNS}
    key, told, part = None, None, 0

    def close() -> tuple:
        turns, line = told.close()
        return line if report else (part, [{"role": r, "text": t} for r, t in turns])

    for batch in batches:
        keys, rows = [], []
        for b in batch.to_pylist():
            if told is None or b["whole"] or b["conv_id"] != key:
                if told is not None:
                    keys.append(key)
                    rows.append(close())
                key, told, part = b["conv_id"], _Told(), 0
            if b["whole"]:
                costs, ((edits, state),) = walks(b["codes"], _FINAL, [START])
                cost = costs[START]
            else:
                edits, state, cost = b["edits"][told.state], b["ends"][told.state], b["cost"]
            turns = told.add(b, [(t["role"], t["text"]) for t in b["turns"]], edits, state, cost)
            if not report:
                keys.append(key)
                rows.append((part, [{"role": r, "text": t} for r, t in turns]))
                part += 1
        yield _batch(keys, rows, kind, kinds)
    if told is not None:
        yield _batch([key], [close()], kind, kinds)


def _in_order(rows: DataFrame, report: bool, block_turns: int, absent: str | None) -> DataFrame:
    kind = _arrow(rows)
    found = blocks(rows, block_turns, absent, report)
    out = with_key(rows, "conv_id", _REPORT if report else _REPAIRED)
    if report:
        done = found.where("whole").select("conv_id", "report.*")
    else:
        done = found.where("whole").drop("transfer", "report").mapInArrow(lambda batches: _told(batches, kind, report), out)
    parts = found.where(~F.col("whole"))
    n = partitions(rows)
    back = parts.select("conv_id", "piece", "block", "transfer").repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("piece"), F.desc("block"))
    place = {"conv_id": "_conv", "piece": "_piece", "block": "_block"}
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece")) & (F.col("block") == F.col("_block"))
    ends = back.mapInArrow(_backwards, with_key(rows, "conv_id", _ENDS)).withColumnsRenamed(place)
    walked = parts.select("conv_id", "piece", "block", "codes").join(ends, same).select("conv_id", "piece", "block", "codes", "after")
    walked = walked.mapInArrow(_walked, with_key(rows, "conv_id", _WALKED)).withColumnsRenamed(place)
    whole = parts.drop("transfer", "codes", "report").join(walked, same).drop(*place.values())
    front = whole.repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece", "block")
    return done.unionByName(front.mapInArrow(lambda batches: _told(batches, kind, report), out))


def repaired_turns(rows: DataFrame, block_turns: int = BLOCK_TURNS, absent: str | None = None) -> DataFrame:
    """The turns that the cheapest edits leave: `conv_id, part, place, role, text`, in the order of (part, place) from 0; see `repair`."""
    spread = _in_order(rows, False, block_turns, absent).select("conv_id", "part", F.posexplode("turns").alias("place", "t"))
    return spread.select("conv_id", "part", "place", F.col("t.role").cast("string").alias("role"), F.col("t.text").cast("string").alias("text"))


def repair(rows: DataFrame, block_turns: int = BLOCK_TURNS, absent: str | None = None) -> DataFrame:
    """Per conversation of `rows` (conv_id, turn, role, text): `conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`.

    Turns are taken by number, null first, then by role and text (bytewise); a null role or text is one space. `audit` holds the
    initials of the cheapest edits (Keep, Rerole, Delete, Insert) in order, the ASCII-least of equally cheap ones, and
    `repaired_sha256` the digest of the repaired turns as `role:text` lines. A role counts by its first character; an empty
    role fits nowhere and is never kept. A turn for which the boolean column `absent` is true does not take part, but
    its conversation is answered. Rows without a conversation are one. A conversation without turns has zeros and an
    empty audit; an empty table gives an empty one. Repeated rows are duplicates, texts need not be valid UTF-8, and further
    columns, whatever their names, are not read.

    The digest of a conversation can only be taken from front to back, so the forward pass reads each conversation of several
    blocks in one task, a block at a time; everything else about a long conversation is spread over tasks.
    """
    return _in_order(rows, True, block_turns, absent)
