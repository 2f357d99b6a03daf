"""Conversation structure repair by weighted finite-state composition.

Three machines are composed: an acceptor of a conversation's rows in turn order, a transducer of edits
(Keep 0, Rerole 1, Delete 2, Insert 5; a truncated row that stays costs 5 more) and an acceptor of the
role grammar (s?(ua)+)?. The composition is lazy: its states are (row, grammar state) and arcs are made
as the shortest path asks for them. Weights are (cost, label string), least first by cost, then by ASCII.
The path is found in topological order from the last row: least costs to the end first, then, going
forward, the least label among the arcs that keep to them. That is the least label string, as all
cheapest paths from a state differ first in some label, and a label decides the next state.

Rows are range-sorted by conversation and turn, so that a long conversation lies in many tasks. What
begins and ends inside one segment of a task is repaired there. The segments of other conversations
give a table of least costs from each grammar state to each; these small tables are chained by
conversation, which tells each segment the costs behind it, and the segments are then repaired apart.

Defined cases: null roles and texts are one space; null turns come first; rows of one turn go by role,
then text; identical rows are duplicates but for one; a null conv_id is a conversation of its own; an empty table gives
no rows; columns other than conv_id, turn, role and text are left out, whatever their names. The repaired
text is one string, so a conversation's text has to fit in one row; nothing else is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.session import written

BLANKS = " \t\n\x0b\x0c\r"
SEGMENT_ROWS, SEGMENT_CHARS = 1024, 1 << 20
#: States of the role grammar, the moves between them, and where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FINAL = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, STAYS = 0, 1, 2, 5, 5
FAR = 1 << 60
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


def edits(fault: int, initial: str) -> Iterator[tuple[str, int, str | None]]:
    """The edit transducer's arcs that read a row: (label, cost, initial written or None)."""
    yield "D", DELETE, None
    if fault in (BLANK, DUPLICATE):
        return
    more = STAYS if fault == TRUNCATED else 0
    yield "K", KEEP + more, initial
    yield "R", REROLE + more, "u"
    yield "R", REROLE + more, "a"


def arcs(fault: int, initial: str, state: int) -> list[tuple[str, int, int]]:
    """The composed arcs that read a row in a grammar state: (label, cost, next state), least label first."""
    found = [(label, cost, state if out is None else MOVES[state].get(out)) for label, cost, out in edits(fault, initial)]
    return sorted(x for x in found if x[2] is not None)


_arcs: dict[tuple[int, str], list[list[tuple[str, int, int]]]] = {}


def arcs_of(fault: int, initial: str) -> list[list[tuple[str, int, int]]]:
    """``arcs`` by state, made once for each kind of row."""
    key = (fault, initial if initial in ("s", "u", "a") else "")
    if key not in _arcs:
        _arcs[key] = [arcs(*key, state) for state in range(4)]
    return _arcs[key]


def with_inserts(costs: list[int]) -> list[int]:
    """Least costs from each state where rows may be inserted first; two suffice, as more come back to a state."""
    start, system, user, assistant = costs
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return [min(start, INSERT + user), min(system, INSERT + user), user, assistant]


END = with_inserts([0 if state in FINAL else FAR for state in range(4)])


def costs_before(rows: list[tuple[int, str]], behind: list[int]) -> list[list[int]]:
    """Least costs to the end before each of the rows (fault, initial) and behind the last one."""
    out = [behind]
    for fault, initial in reversed(rows):
        here = out[-1]
        out.append(with_inserts([min(cost + here[to] for _, cost, to in ways) for ways in arcs_of(fault, initial)]))
    return out[::-1]


def costs_between(rows: list[tuple[int, str]]) -> list[int]:
    """Least costs through the rows from each state (outer) to each state (inner)."""
    columns = [costs_before(rows, [0 if state == to else FAR for state in range(4)])[0] for to in range(4)]
    return [min(FAR, columns[to][state]) for state in range(4) for to in range(4)]


def path(rows: list[tuple[int, str]], behind: list[int], state: int, last: bool) -> tuple[str, int]:
    """(labels, state reached): the least cheapest way through the rows; ``last`` also inserts what the end asks for."""
    togo = costs_before(rows, behind)
    labels: list[str] = []
    i = 0
    while i < len(rows) or (last and state not in FINAL):
        here = togo[i][state]
        way = None
        if i < len(rows):
            way = next(((label, 1, to) for label, cost, to in arcs_of(*rows[i])[state] if cost + togo[i + 1][to] == here), None)
        if way is None or "I" < way[0]:
            inserted = [to for to in MOVES[state].values() if to in ROLES and INSERT + togo[i][to] == here]
            way = ("I", 0, inserted[0]) if inserted else way
        labels.append(way[0])
        i, state = i + way[1], way[2]
    return "".join(labels), state


def applied(labels: str, roles: list[str], texts: list[str], state: int) -> str | None:
    """The repaired rows that the labels give, joined by newlines; None without any."""
    out, i = [], 0
    for label in labels:
        if label == "K":
            state = MOVES[state][roles[i][:1]]
            out.append(f"{roles[i]}:{texts[i]}")
        elif label in "RI":
            state = next(to for to in MOVES[state].values() if to in ROLES)
            out.append(f"{ROLES[state]}:{texts[i] if label == 'R' else ''}")
        i += label != "I"
    return "\n".join(out) if out else None


COUNTS = ("first_turn", "last_turn", "n_turns", "blank", "duplicate", "truncated", "illegal")
SEGMENT = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("open", pa.bool_()),
        *[(c, pa.int64()) for c in COUNTS], ("first", pa.string()), ("last", pa.string()),
        ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.string()),
        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.int32())), ("between", pa.list_(pa.int64())),
    ]
)
SEGMENT_DDL = (
    "conv_id long, part int, seq long, open boolean, first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long, "
    "illegal long, first string, last string, cost long, audit string, repaired string, roles array<string>, texts array<string>, faults array<int>, between array<long>"
)


def _segment(conv_id, part: int, seq: int, rows: list[tuple], whole: bool) -> dict:
    """One run of a conversation's rows (turn, role, text, fault): repaired where it is the whole one."""
    turns = [t for t, *_ in rows if t is not None]
    initials = [role[:1] for _, role, *_ in rows]
    symbols = [(fault, c) for (*_, fault), c in zip(rows, initials)]
    out = {
        "conv_id": conv_id, "part": part, "seq": seq, "open": not whole,
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "n_turns": len(set(turns)),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
    }
    for name, kind in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)):
        out[name] = sum(fault == kind for fault, _ in symbols)
    roles, texts = [r for _, r, *_ in rows], [t for _, _, t, _ in rows]
    if whole:
        labels, _ = path(symbols, END, START, True)
        return out | {"cost": costs_before(symbols, END)[0][START], "audit": labels, "repaired": applied(labels, roles, texts, START)}
    return out | {"roles": roles, "texts": texts, "faults": [f for f, _ in symbols], "between": costs_between(symbols)}


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Segments of sorted rows, of ``most`` rows each. The first and the last conversation of a task may go on in others and stay open."""
    part, seq = TaskContext.get().partitionId(), 0
    rows, chars, now, begun, done, held = [], 0, None, False, [], 0

    def closed(ends: bool) -> None:
        nonlocal rows, chars, seq, held
        done.append(_segment(now, part, seq, rows, ends and begun and seq == 0 and now_first > 0))
        held += chars
        rows, chars, seq = [], 0, seq + 1

    now_first = 0  # conversations before this one in the task
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]
        for conv_id, *row in zip(*columns):
            if begun and conv_id != now:
                if rows:
                    closed(True)
                now_first, seq = now_first + 1, 0
            elif len(rows) >= most or chars >= SEGMENT_CHARS:
                closed(False)
            begun, now = True, conv_id
            rows.append(tuple(row))
            chars += len(row[2]) + 64
            if held >= 4 * SEGMENT_CHARS:
                yield pa.RecordBatch.from_pylist(done, SEGMENT)
                done, held = [], 0
    if rows:
        closed(False)
    if done:
        yield pa.RecordBatch.from_pylist(done, SEGMENT)


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation's segments in order, the least costs behind each one."""
    for batch in batches:
        out = []
        for segments in batch.column("segments").to_pylist():
            behind = END
            for i, s in enumerate(reversed(segments)):
                out.append({"part": s["part"], "seq": s["seq"], "conv_id": s["conv_id"], "behind": behind, "begins": i == len(segments) - 1, "ends": i == 0})
                m = s["between"]
                behind = [min(FAR, *[m[4 * state + to] + behind[to] for to in range(4)]) for state in range(4)]
        yield pa.RecordBatch.from_pylist(out, _BEHIND)


_BEHIND = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("behind", pa.list_(pa.int64())), ("begins", pa.bool_()), ("ends", pa.bool_())])
_WAY = pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("audit", pa.string()), ("repaired", pa.string())])
_PASSED = [f for f in SEGMENT if f.name in ("conv_id", "part", "seq", *COUNTS, "first", "last")]
_WAYS = pa.schema([*_PASSED, ("cost", pa.int64()), ("ways", pa.list_(_WAY))])


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment repaired from every grammar state that it may be entered in."""
    for batch in batches:
        for s in batch.to_pylist():
            symbols = [(f, r[:1]) for f, r in zip(s["faults"], s["roles"])]
            before = costs_before(symbols, s["behind"])[0]
            ways = []
            for state in (START,) if s["begins"] else range(4):
                if before[state] < FAR:
                    labels, leave = path(symbols, s["behind"], state, s["ends"])
                    ways.append({"enter": state, "leave": leave, "audit": labels, "repaired": applied(labels, s["roles"], s["texts"], state)})
            row = {f.name: s[f.name] for f in _PASSED} | {"cost": before[START] if s["begins"] else None, "ways": ways}
            yield pa.RecordBatch.from_pylist([row], _WAYS)


RESULT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in (*COUNTS, "cost")], ("audit", pa.string()), ("repaired", pa.string())])
RESULT_DDL = "conv_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, "cost")) + ", audit string, repaired string"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its repaired segments in order."""
    for batch in batches:
        for segments in batch.column("segments").to_pylist():
            out = {c: 0 for c in COUNTS} | {"conv_id": segments[0]["conv_id"], "cost": segments[0]["cost"], "first_turn": None, "last_turn": None}
            state, last, audits, texts = START, None, [], []
            for s in segments:
                for c in ("n_turns", "blank", "duplicate", "truncated", "illegal"):
                    out[c] += s[c]
                out["illegal"] += last is not None and last + s["first"] not in ("su", "ua", "au")
                if s["first_turn"] is not None:
                    out["n_turns"] -= out["last_turn"] == s["first_turn"]
                    out["first_turn"] = s["first_turn"] if out["first_turn"] is None else out["first_turn"]
                    out["last_turn"] = s["last_turn"]
                way = next(w for w in s["ways"] if w["enter"] == state)
                state, last = way["leave"], s["last"]
                audits.append(way["audit"])
                texts += [way["repaired"]] * (way["repaired"] is not None)
            out |= {"audit": "".join(audits), "repaired": "\n".join(texts) if texts else None}
            yield pa.RecordBatch.from_pylist([out], RESULT)


def faulty(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, id and fault of the rows: blank, else duplicate, else truncated, else sound."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    held = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"),
        F.monotonically_increasing_id().alias("id"),
    )
    # the ids have to be the same below, on both sides of the join
    held = written(held.withColumn("said", F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id")
    first = held.groupBy("conv_id", "said").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("first_conv"), F.col("said").alias("first_said"), "first")
    joined = held.join(first, held.conv_id.eqNullSafe(F.col("first_conv")) & (held.said == F.col("first_said")), "left")
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(bare == "", BLANK)
        .when(F.col("first").isNotNull() & (place != F.col("first")), DUPLICATE)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(SOUND)
    )
    return joined.select("conv_id", "turn", "role", "text", "id", fault.alias("fault"))


def repaired(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """A row a conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, the numbers of faults and of
    illegal neighbours, cost, audit (the edits' initials) and repaired (``role:text`` lines; null without any)."""
    order = ("conv_id", "turn", "role", "text", "id")
    ranged = faulty(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")
    segments = written(ranged.mapInArrow(partial(_segments, most=segment_rows), SEGMENT_DDL), "segments")
    opened = segments.where("open")
    chain = lambda df, *cols: df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "conv_id", *cols))).alias("segments"))
    behind = chain(opened, "between").select("segments").mapInArrow(_behind, "conv_id long, part int, seq long, behind array<long>, begins boolean, ends boolean")
    # a segment is named by its place, as conv_id may be null
    places = behind.select("part", "seq", F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("none"), "behind", "begins", "ends")
    asked = opened.withColumns({"conv": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull()}).join(places, ["part", "seq", "conv", "none"])
    ways_ddl = "conv_id long, part int, seq long, " + ", ".join(f"{c} long" for c in COUNTS) + ", first string, last string, cost long, ways array<struct<enter:int,leave:int,audit:string,repaired:string>>"
    solved = asked.drop("cost", "audit", "repaired", "between", "open").mapInArrow(_ways, ways_ddl)
    chained = chain(solved, *COUNTS, "first", "last", "cost", "ways").select("segments").mapInArrow(_chained, RESULT_DDL)
    every = segments.where("not open").select(*[f.name for f in RESULT]).unionByName(chained)
    gaps = F.coalesce(F.try_subtract("last_turn", "first_turn") + 1 - F.col("n_turns"), F.lit(0))
    return every.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` damaged by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes its ``[.!?]``,
    3 repeats it, 4 makes it the user's; nulls count as one space there and in role and text."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text: Column = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(as_text("role"))
    kept = rows.select("conv_id", "turn", "role", "text", draw.alias("draw")).where("draw != 0")
    kept = kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1))))
    return kept.select("conv_id", "turn", "role", "text")
