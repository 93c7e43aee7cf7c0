"""Repair of conversations whose turns were lost, repeated or cut: the cheapest edits that give an optional system turn and
then user and assistant in turns.

Edits. Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty turn) 5; a truncated turn that isn't
deleted costs 5 more, blank and repeated ones have to be deleted. Of the cheapest edits the ASCII-least string of initials
counts.

Method. Every turn is one layer of a dynamic programme over what stands so far: nothing, a system turn last, a user turn
last, an assistant turn last. A step is a macro edit, a run of inserts and the edit of the turn itself. Written as
initials (`D`, `IK`, ..) macro edits are a prefix-free code, so strings of one layer compare as pairs (rank of the string
before, code): each state keeps its cost, the rank of its string in the layer and its parent, never the string, which is
read off the parents in the end. Runs of more than two inserts return to a state that was had for less.

Turns are sorted by ranges of (conversation, turn), and a conversation that lies in one range is repaired where it lies.
What may go on in the next range, or has more than BLOCK turns, is cut into blocks of consecutive turns. A block is itself
a macro edit for each pair of states before and after it, with a cost and a rank among the strings of the block, so the
same programme joins the blocks of a range, then the ranges of a conversation; the states chosen go back down to the
blocks, which read off their edits. So no conversation, however long, is one task's but for its final string and digest,
which are streamed.

Defined cases: null roles and texts are one space, null turns come first, null conv_ids are one conversation; turns of
equal number are ordered by role, then sha256 of the text; a conversation without turns has zeros, an empty audit and the
digest of the empty string; roles other than the three begin no legal turn and can be kept nowhere; very long texts are
taken whole, in blocks of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .merkle import crc32_sql

#: Turns and bytes of a block.
BLOCK, BLOCK_BYTES = 256, 1 << 20
#: States: nothing yet, and after a system, a user and an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Macro edits in ASCII order.
CODES = sorted("I" * run + edit for run in range(3) for edit in "DKR")
#: Inserts that make an end legal.
TAIL = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Role initials that may follow each other.
LEGAL = ("su", "ua", "au")
NAMES = {USER: "user", ASSISTANT: "assistant"}
_WORD = re.compile(r"[^\x20\x09-\x0D]")

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
Steps = list[list[tuple[int, int, int]]]


def _next(state: int) -> int:
    """After one more turn in order."""
    return ASSISTANT if state == USER else USER


def _steps(initial: str, gone: bool, cut: bool) -> Steps:
    """From each state: (state after, cost, code) of the best macro edits."""
    out: Steps = []
    for state in range(4):
        best: dict[int, tuple[int, int]] = {}
        at = state
        for run in range(3):
            options = [("D", at, DELETE)]
            if not gone:
                options.append(("R", _next(at), REROLE + TRUNCATED * cut))
                if (initial == "s" and at == NONE) or initial == ("a" if at == USER else "u"):
                    options.append(("K", SYSTEM if initial == "s" else _next(at), TRUNCATED * cut))
            for edit, to, cost in options:
                found = cost + INSERT * run, CODES.index("I" * run + edit)
                best[to] = min(best.get(to, found), found)
            at = _next(at)
        out.append([(to, *v) for to, v in sorted(best.items())])
    return out


#: By kind of turn: role initial, whether it has to go, whether it is truncated.
KINDS = [(i, g, c) for i in ("s", "u", "a", "") for g in (False, True) for c in (False, True)]
STEPS = [_steps(*k) for k in KINDS]
_KIND = {k: n for n, k in enumerate(KINDS)}


def programme(layers: Iterable[Steps], entries: Iterable[int]) -> tuple[dict[tuple[int, int], tuple[int, int]], list[dict]]:
    """(cost, rank) by (entry, state) after all layers, and each layer's parents: (state before, code)."""
    cells = {(e, e): (0, 0) for e in entries}
    parents = []
    for steps in layers:
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for (entry, state), (cost, rank) in cells.items():
            for to, more, code in steps[state]:
                found = (cost + more, rank, code, state)
                if (entry, to) not in best or found < best[entry, to]:
                    best[entry, to] = found
        rank_of = {v: k for k, v in enumerate(sorted({v[1:3] for v in best.values()}))}
        cells = {k: (v[0], rank_of[v[1:3]]) for k, v in best.items()}
        parents.append({k: (v[3], v[2]) for k, v in best.items()})
    return cells, parents


def path(parents: list[dict], entry: int, state: int) -> list[tuple[int, int, int]]:
    """(state before, state after, code) of each layer."""
    out = []
    for p in reversed(parents):
        before, code = p[entry, state]
        out.append((before, state, code))
        state = before
    return out[::-1]


def finish(cells: dict[tuple[int, int], tuple[int, int]]) -> tuple[int, int]:
    """(cost, last state) of the best end from the start."""
    cost, _, state = min((cost + INSERT * TAIL[s], rank, s) for (e, s), (cost, rank) in cells.items() if e == NONE)
    return cost, state


class Tally:
    """What is counted along a stretch of turns, so that stretches add up."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.head = self.last = self.low = self.high = None

    def add(self, other: Tally) -> None:
        for k in ("blank", "duplicate", "truncated", "illegal", "distinct"):
            setattr(self, k, getattr(self, k) + getattr(other, k))
        if self.last is not None and other.head is not None:
            self.illegal += self.last + other.head not in LEGAL
        if self.high is not None and other.low is not None:
            self.distinct -= self.high == other.low
        self.head = self.head if self.head is not None else other.head
        self.low = self.low if self.low is not None else other.low
        self.last = other.last if other.last is not None else self.last
        self.high = other.high if other.high is not None else self.high

    def turn(self, turn: int | None, role: str, fault: str | None) -> None:
        """One more turn."""
        one = Tally()
        one.head = one.last = role[:1]
        one.low = one.high = turn
        one.distinct = int(turn is not None)
        if fault:
            setattr(one, fault, 1)
        self.add(one)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "distinct", "head", "last", "low", "high")
    TYPE = "struct<blank:long,duplicate:long,truncated:long,illegal:long,distinct:long,head:string,last:string,low:long,high:long>"

    def row(self) -> dict:
        return {k: getattr(self, k) for k in self.FIELDS}

    @classmethod
    def of(cls, row: dict) -> Tally:
        out = cls()
        for k in cls.FIELDS:
            setattr(out, k, row[k])
        return out


def judge(turns: list[tuple], first: list[bool]) -> tuple[list[int], Tally]:
    """Each turn's kind, and the tally, of (turn, role, text); `first`: whether role and text weren't seen before."""
    kinds, tally = [], Tally()
    for (turn, role, text), fresh in zip(turns, first):
        word = _WORD.search(text)
        cut = bool(word) and text.rstrip(" \t\n\v\f\r")[-1] not in ".!?"
        fault = "blank" if not word else "duplicate" if not fresh else "truncated" if cut else None
        tally.turn(turn, role, fault)
        kinds.append(_KIND[role[:1] if role[:1] in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated"])
    return kinds, tally


def rewrite(turns: list[tuple], codes: list[str], state: int) -> list[str]:
    """The lines that the edits make of the turns; `state` is what stands before them."""
    out = []
    for (_, role, text), code in zip(turns, codes):
        for edit in code:
            if edit == "D":
                continue
            if edit == "K":
                out.append(f"{role}:{text}")
                state = SYSTEM if role[:1] == "s" else _next(state)
            else:
                state = _next(state)
                out.append(f"{NAMES[state]}:{text if edit == 'R' else ''}")
    return out


def tail(state: int) -> list[str]:
    out = []
    for _ in range(TAIL[state]):
        state = _next(state)
        out.append(f"{NAMES[state]}:")
    return out


def repair_one(turns: list[tuple]) -> tuple[Tally, int, str, list[str]]:
    """Tally, cost, audit and lines of a conversation's (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    first = []
    for _, role, text in turns:
        first.append((role, text) not in seen)
        seen.add((role, text))
    kinds, tally = judge(turns, first)
    cells, parents = programme((STEPS[k] for k in kinds), (NONE,))
    cost, state = finish(cells)
    codes = [CODES[c] for _, _, c in path(parents, NONE, state)]
    lines = rewrite(turns, codes, NONE) + tail(state)
    return tally, cost, "".join(codes) + "I" * TAIL[state], lines


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `dropped` of the turns after the damage that their numbers' checksum brings."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("d"))
    d = F.col("d")
    rows = rows.withColumn("role", F.when(d == 4, F.lit("user")).otherwise(F.col("role")))
    rows = rows.withColumn("text", F.when(d <= 1, F.lit("")).when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", "role", "text", (d == 0).alias("dropped"), F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


_TURNS = "array<struct<turn:long,role:string,text:string>>"
_PACKED = pa.schema([("conv_id", pa.int64()), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("turns", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))])


def _digest(lines: list[str]) -> str:
    return sha256("\n".join(lines).encode()).hexdigest()


def _counts(conv_id: int | None, tally: Tally) -> dict:
    return {"conv_id": conv_id, "gaps": tally.gaps(), **{k: getattr(tally, k) for k in ("blank", "duplicate", "truncated", "illegal")}}


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A sorted range: results of the conversations that lie in it wholly, blocks of turns of the others."""
    part, seq, out, size = TaskContext.get().partitionId(), 0, [], 0
    conv, turns, held, open_, begun = None, [], 0, True, False

    def block() -> dict:
        nonlocal seq
        seq += 1
        return {"conv_id": conv, "part": part, "seq": seq, "turns": [dict(zip(("turn", "role", "text"), t)) for t in turns]}

    def closed() -> dict:
        tally, cost, audit, lines = repair_one(turns)
        return {**_counts(conv, tally), "cost": cost, "audit": audit, "repaired_sha256": _digest(lines)}

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped"))):
            if not begun or row[0] != conv:
                if begun:
                    out.append(block() if open_ else closed())
                    open_ = False  # it starts in this range
                conv, turns, held, begun = row[0], [], 0, True
            if len(turns) >= most or held > BLOCK_BYTES:
                out.append(block())
                turns, held, open_ = [], 0, True
            if not row[4]:
                turns.append(row[1:4])
                held += len(row[3])
                size += len(row[3])
            if len(out) >= 1000 or size > 4 * BLOCK_BYTES:
                yield pa.RecordBatch.from_pylist(out, _PACKED)
                out, size = [], 0
    if begun:
        out.append(block())  # the next range may go on
    yield pa.RecordBatch.from_pylist(out, _PACKED)


_SUM = "cost array<long>, rank array<long>, tally " + Tally.TYPE


def _matrix(cells: dict[tuple[int, int], tuple[int, int]]) -> tuple[list, list]:
    """Costs and ranks by entry and state; null where no edits lead."""
    both = [cells.get((e, s), (None, None)) for e in range(4) for s in range(4)]
    return [c for c, _ in both], [r for _, r in both]


def _layer(x: dict) -> Steps:
    return [[(to, x["cost"][4 * e + to], x["rank"][4 * e + to]) for to in range(4) if x["cost"][4 * e + to] is not None] for e in range(4)]


_TALLY = pa.struct([*[(k, pa.int64()) for k in Tally.FIELDS[:5]], ("head", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64())])
_MATRIX = [("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64())), ("tally", _TALLY)]
_CHOSEN = pa.list_(pa.struct([("child", pa.int32()), ("entry", pa.int32()), ("state", pa.int32())]))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of turns as macro edits, with the turns' kinds."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("kinds", pa.list_(pa.int32())), *_MATRIX])
    for b in batches:
        out = []
        for conv, part, seq, turns, firsts in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "seq", "turns", "firsts"))):
            fresh = set(firsts or ())
            kinds, tally = judge([(t["turn"], t["role"], t["text"]) for t in turns], [k in fresh for k in range(len(turns))])
            cost, rank = _matrix(programme((STEPS[k] for k in kinds), range(4))[0])
            out.append({"conv_id": conv, "part": part, "seq": seq, "kinds": kinds, "cost": cost, "rank": rank, "tally": tally.row()})
        yield pa.RecordBatch.from_pylist(out, schema)


def _total(children: list[dict]) -> Tally:
    tally = Tally()
    for c in children:
        tally.add(Tally.of(c["tally"]))
    return tally


def _of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a range as one macro edit."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), *_MATRIX])
    for b in batches:
        out = []
        for conv, part, children in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "children"))):
            cost, rank = _matrix(programme(map(_layer, children), range(4))[0])
            out.append({"conv_id": conv, "part": part, "cost": cost, "rank": rank, "tally": _total(children).row()})
        yield pa.RecordBatch.from_pylist(out, schema)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of a conversation: its counts and cost, its last state, and the states around each range."""
    schema = pa.schema([*[(k, pa.int64()) for k in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("final", pa.int32()), ("chosen", _CHOSEN)])
    for b in batches:
        out = []
        for conv, children in zip(b.column("conv_id").to_pylist(), b.column("children").to_pylist()):
            cells, parents = programme(map(_layer, children), (NONE,))
            cost, state = finish(cells)
            chosen = [{"child": c["child"], "entry": e, "state": s} for c, (e, s, _) in zip(children, path(parents, NONE, state))]
            out.append({**_counts(conv, _total(children)), "cost": cost, "final": state, "chosen": chosen})
        yield pa.RecordBatch.from_pylist(out, schema)


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the states around a range to those around its blocks."""
    for b in batches:
        out = []
        for part, children, entry, state in zip(*(b.column(c).to_pylist() for c in ("part", "children", "entry", "state"))):
            _, parents = programme(map(_layer, children), (entry,))
            out += [{"part": part, "seq": c["child"], "entry": e, "state": s} for c, (e, s, _) in zip(children, path(parents, entry, state))]
        yield pa.RecordBatch.from_pylist(out, pa.schema([(k, pa.int32()) for k in ("part", "seq", "entry", "state")]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' edits and lines; without lines, the text is null."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("audit", pa.string()), ("text", pa.string())])
    for b in batches:
        out = []
        for conv, part, seq, turns, kinds, entry, state in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "seq", "turns", "kinds", "entry", "state"))):
            _, parents = programme((STEPS[k] for k in kinds), (entry,))
            codes = [CODES[c] for _, _, c in path(parents, entry, state)]
            lines = rewrite([(t["turn"], t["role"], t["text"]) for t in turns], codes, entry)
            out.append({"conv_id": conv, "part": part, "seq": seq, "audit": "".join(codes), "text": "\n".join(lines) if lines else None})
        yield pa.RecordBatch.from_pylist(out, schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to audits and digests, a piece at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    conv, audit, digest, some, state, begun = None, [], None, False, NONE, False

    def done() -> pa.RecordBatch:
        end = tail(state)
        if end:
            digest.update(("\n" * some + "\n".join(end)).encode())
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit) + "I" * len(end), "repaired_sha256": digest.hexdigest()}], schema)

    for b in batches:
        for c, a, text, final in zip(*(b.column(k).to_pylist() for k in ("conv_id", "audit", "text", "final"))):
            if not begun or c != conv:
                if begun:
                    yield done()
                conv, audit, digest, some, state, begun = c, [], sha256(), False, final, True
            audit.append(a)
            if text is not None:
                digest.update(("\n" * some + text).encode())
                some = True
    if begun:
        yield done()


def _open(blocks: DataFrame) -> DataFrame:
    """Results of the conversations that are blocks of turns."""
    every = blocks.select("conv_id", "part", "seq", F.posexplode("turns").alias("i", "t"))
    said = every.where(F.rlike("t.text", F.lit(_WORD.pattern))).select("conv_id", F.col("t.role").alias("role"), F.sha2(F.col("t.text").cast("binary"), 256).alias("h"), F.struct("part", "seq", "i").alias("at"))
    firsts = said.groupBy("conv_id", "role", "h").agg(F.min("at").alias("at")).groupBy("at.part", "at.seq").agg(F.collect_list("at.i").alias("firsts"))
    summed = materialize(blocks.join(firsts, ["part", "seq"], "left").select("conv_id", "part", "seq", "turns", "firsts").mapInArrow(_summed, f"conv_id long, part int, seq int, kinds array<int>, {_SUM}"), "repair-blocks")
    child = lambda k: F.array_sort(F.collect_list(F.struct(F.col(k).alias("child"), "cost", "rank", "tally"))).alias("children")
    parts = materialize(summed.groupBy("conv_id", "part").agg(child("seq")), "repair-parts")
    whole = parts.mapInArrow(_of_parts, f"conv_id long, part int, {_SUM}").groupBy("conv_id").agg(child("part"))
    kinds = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, final int, chosen array<struct<child:int,entry:int,state:int>>"
    whole = materialize(whole.mapInArrow(_whole, kinds), "repair-whole")
    chosen = whole.select(F.col("conv_id").alias("c"), "final", F.explode("chosen").alias("x")).select("c", "final", F.col("x.child").alias("p"), "x.entry", "x.state")
    met = parts.join(chosen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("part", "children", "entry", "state")
    states = met.mapInArrow(_down, "part int, seq int, entry int, state int")
    cut = blocks.select("part", "seq", "turns").join(summed.select("conv_id", "part", "seq", "kinds"), ["part", "seq"]).join(states, ["part", "seq"])
    pieces = cut.mapInArrow(_pieces, "conv_id long, part int, seq int, audit string, text string")
    ends = whole.select(F.col("conv_id").alias("c"), "final")
    ended = pieces.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "part", "seq", "audit", "text", "final")
    ready = ended.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_streamed, "conv_id long, audit string, repaired_sha256 string")
    told = ready.withColumnRenamed("conv_id", "c")
    return whole.join(told, F.col("conv_id").eqNullSafe(F.col("c"))).select(*_PACKED.names[:9])


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text and, if there is one, dropped): its counts of gaps, faults
    and illegal neighbours, the cost and initials of the cheapest edits, and the digest of what they give."""
    dropped = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped"))
    rows = rows.withColumn("h", F.sha2(F.col("text").cast("binary"), 256)).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h", "tie"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "dropped")
    packed = materialize(sorted_.mapInArrow(partial(_pack, most=block), f"{RESULT}, part int, seq int, turns {_TURNS}"), "repair-packed")
    blocks = packed.where("turns is not null").select("conv_id", "part", "seq", "turns")
    return packed.where("turns is null").select(*_PACKED.names[:9]).unionByName(_open(blocks))


def oracle() -> str:
    """repair(damage()) over `conversations` as DuckDB SQL: the programme with its strings, by recursion over turns."""
    ws = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    word = "regexp_matches(text, '[^\\x20\\x09-\\x0D]')"
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS d FROM conversations),
x AS MATERIALIZED (SELECT g, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM o, range(CASE WHEN d = 3 THEN 2 ELSE 1 END) WHERE d > 0),
i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM x),
f AS MATERIALIZED (SELECT *, role[1:1] AS c, CASE WHEN NOT {word} THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(rtrim(text, {ws}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(role[1:1]) OVER (PARTITION BY g ORDER BY i) AS before FROM i),
n AS MATERIALIZED (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, {', '.join(f"count(*) FILTER (fault = '{k}')::BIGINT AS {k}" for k in ('blank', 'duplicate', 'truncated'))}, count(*) FILTER (before IS NOT NULL AND before || c NOT IN {LEGAL})::BIGINT AS illegal, max(i) AS n FROM f GROUP BY g),
inserted(s, runs, m, added) AS (VALUES (0, 0, 0, []::VARCHAR[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']), (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])),
w(g, i, s, best) AS (SELECT DISTINCT g, 0::BIGINT, 0, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} FROM f UNION ALL
  SELECT g, i, t, min({{'c': c, 'a': a, 'l': l}}) FROM (
    SELECT w.g, f.i, CASE e WHEN 'D' THEN m WHEN 'K' THEN CASE f.c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE m WHEN 2 THEN 3 ELSE 2 END END AS t,
      best.c + 5 * runs + CASE e WHEN 'D' THEN 2 ELSE (e = 'R')::BIGINT + 5 * (fault = 'truncated')::BIGINT END AS c, best.a || repeat('I', runs) || e AS a,
      best.l || added || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE m WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END AS l
    FROM w JOIN f ON f.g = w.g AND f.i = w.i + 1 JOIN inserted ON inserted.s = w.s, (VALUES ('D'), ('K'), ('R')) AS edits(e)
    WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR (f.c = 's' AND m = 0) OR (f.c = 'u' AND m <> 2) OR (f.c = 'a' AND m = 2)))) GROUP BY g, i, t),
e AS (SELECT g, min({{'c': best.c + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'a': best.a || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 'l': best.l || CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END}}) AS r FROM w JOIN n USING (g) WHERE i = n GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, {', '.join(f'coalesce({k}, 0) AS {k}' for k in ('blank', 'duplicate', 'truncated', 'illegal'))}, coalesce(r.c, 0) AS cost, coalesce(r.a, '') AS audit, sha256(coalesce(array_to_string(r.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM o) LEFT JOIN n USING (g) LEFT JOIN e USING (g)"""
