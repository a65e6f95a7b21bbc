"""Repair of conversations by the cheapest edits: an optional system turn, then pairs of user and assistant.

The structure is an automaton with four states: nothing yet, after a system turn, after a user turn, after
an assistant turn; the first and the last may end a conversation.  Edits, with their costs, lead from
state to state: Delete a row, Insert an empty user or assistant turn, Keep a row whose role fits, Rerole a
row to the role that fits.  Backwards from the end, a vector has the least cost to go from each state.  A
walk forward takes, of the edits that lose nothing, the one whose initial comes first in ASCII; as every
edit leads to one state, that gives the least string of initials of all cheapest repairs.

Only a square root of a piece's vectors is kept: those at checkpoints on the way back.  The walk computes
the vectors of one block between checkpoints again, walks through it, and forgets them.

A conversation is never one task's or one group's.  All rows, one small number each, are partitioned by
range of (conversation, turn) and sorted; consecutive rows of a conversation make pieces of at most
``PIECE`` rows.  A conversation inside one piece is walked at once.  Where it goes on in other pieces, the
piece is summed up by a 4 by 4 table of least costs between states.  A sweep backwards over these tables
gives the vector at the end of each piece, each piece finds where it leads from each state, and a sweep
forward over those says in which state it begins.  Sweeps hold one piece's summary at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillpanel.llm.batches import column, slices
from quillpanel.llm.text_columns import SPACES
from quillpanel.session import stage

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Rows of a piece.
PIECE = 1024
STARTS, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = "sua"
OTHER = 3
#: Faults: none, to be deleted (blank, duplicate), truncated.  A row's kind is its letter plus 4 times that.
FINE, DROP, CUT = range(3)
NEVER = 1 << 40
#: State after an inserted or reroled turn, and after a kept one by its letter.
FORCED = (USER, USER, ASSISTANT, USER)
FITS = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
END = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, int, int, int]


def row_edits(kind: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits of a row, in ASCII order."""
    letter, fault = kind % 4, kind // 4
    yield "D", DELETE, state
    if fault != DROP:
        more = TRUNCATED if fault == CUT else 0
        if letter in FITS[state]:
            yield "K", more, FITS[state][letter]
        yield "R", more + REROLE, FORCED[state]


def with_inserts(own: list[int]) -> Vector:
    """Costs where turns may be inserted first; more than two never pay."""
    user, assistant = own[USER], own[ASSISTANT]
    own[USER], own[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
    own[STARTS], own[SYSTEM] = min(own[STARTS], INSERT + own[USER]), min(own[SYSTEM], INSERT + own[USER])
    return tuple(own)


def stepped(kind: int, ahead: Vector) -> Vector:
    """The costs before a row from those after it."""
    return with_inserts([min(cost + ahead[to] for _, cost, to in row_edits(kind, state)) for state in range(4)])


def costs_between(kinds: bytes) -> list[int]:
    """16 least costs of leading the rows from a state to a state, row by row of the table."""
    columns = []
    for target in range(4):
        ahead = tuple(0 if s == target else NEVER for s in range(4))
        for kind in reversed(kinds):
            ahead = stepped(kind, ahead)
        columns.append(ahead)
    return [min(NEVER, columns[to][state]) for state in range(4) for to in range(4)]


def before_piece(table: list[int], ahead: Vector) -> Vector:
    return tuple(min(table[4 * s + t] + ahead[t] for t in range(4)) for s in range(4))


def walked(kinds: bytes, ahead: Vector, state: int, ends: bool) -> Iterator[tuple[int, str, int, int]]:
    """(row or -1 for an inserted turn, initial, cost, state after) of the least of the cheapest edits.

    ``ahead``: the costs after the last row; ``ends``: the conversation ends there, so that missing turns
    are inserted.  Vectors are kept at every ``stride``-th row, and for the rows of one block.
    """
    n = len(kinds)
    stride = max(1, math.isqrt(n))
    checkpoints, vector = {}, ahead
    for i in range(n - 1, -1, -1):
        vector = stepped(kinds[i], vector)
        if i % stride == 0:
            checkpoints[i] = vector
    for low in range(0, n, stride):
        high = min(n, low + stride)
        block = [ahead if high == n else checkpoints[high]]
        for i in range(high - 1, low - 1, -1):
            block.append(stepped(kinds[i], block[-1]))
        for i in range(low, high):
            after, here = block[high - i - 1], block[high - i]
            done = False
            while not done:
                if DELETE + after[state] != here[state] and INSERT + here[FORCED[state]] == here[state]:
                    state = FORCED[state]
                    yield -1, "I", INSERT, state
                    continue
                for initial, cost, to in row_edits(kinds[i], state):
                    if cost + after[to] == here[state]:
                        state, done = to, True
                        yield i, initial, cost, state
                        break
    while ends and state not in (STARTS, ASSISTANT):
        state = FORCED[state]
        yield -1, "I", INSERT, state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage that follows from a checksum of conv_id and turn.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes its marks ``.!?`` away, 3 repeats it, 4
    makes it a user turn.  A null counts as one blank, in the checksum as in role and text.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), mark.alias("_mark")).where("_mark <> 0")
    role = F.when(F.col("_mark") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_mark") == 1, "").when(F.col("_mark") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("_mark") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, row, letter, fault (null, blank, duplicate, truncated) of numbered ``rows``.

    A duplicate has an earlier row with its role and text.  First rows are found by grouping, which one
    common text can't crowd, and come back in a join by row number.
    """
    letter = F.instr(F.lit(LETTERS), F.substring("role", 1, 1)) - 1
    letter = F.when((F.col("role") == "") | (letter < 0), OTHER).otherwise(letter)
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    own = rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "row", letter.alias("letter"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
    )
    firsts = own.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "row")).alias("first"))
    firsts = firsts.select(F.col("first.row").alias("row"), F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    return own.join(firsts, "row", "left").select("conv_id", "turn", "role", "digest", "row", "letter", fault.alias("fault"))


PIECES = "conv_id {}, at long, whole boolean, rows array<long>, kinds binary, costs array<long>, illegal long"


def _rows(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in slices(batches, 4096):
        yield from zip(*[column(batch, n) for n in names], strict=True)


def _batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [f"c{i}" for i in range(len(types))])


def _illegal(kinds: bytes) -> int:
    return sum((a % 4, b % 4) not in LEGAL for a, b in zip(kinds, kinds[1:], strict=False))


def pieces(marks: DataFrame) -> DataFrame:
    """Consecutive rows of a conversation, at most PIECE, as one row; ``whole``: surely all its rows."""

    types = [to_arrow_type(marks.schema["conv_id"].dataType), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int64()]

    def pack(batches):
        out, held, rows, kinds, at, first_run, first_piece = [], None, [], bytearray(), 0, True, True

        def piece(whole: bool) -> tuple:
            costs = None if whole else costs_between(bytes(kinds))
            return held, at, whole, list(rows), bytes(kinds), costs, _illegal(bytes(kinds))

        for conv, place, row, kind in _rows(batches, ["conv_id", "place", "row", "kind"]):
            if rows and conv != held:
                out.append(piece(first_piece and not first_run))
                rows, kinds, first_run, first_piece = [], bytearray(), False, True
            elif len(rows) == PIECE:
                out.append(piece(False))
                rows, kinds, first_piece = [], bytearray(), False
            if not rows:
                held, at = conv, place
                if len(out) >= 512:
                    yield _batch(out, types)
                    out = []
            rows.append(row)
            kinds.append(kind)
        if rows:
            out.append(piece(False))
            yield _batch(out, types)

    tasks = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "digest", "row"]
    fault = F.when(F.col("fault").isNull(), FINE).when(F.col("fault") == "truncated", CUT).otherwise(DROP)
    ordered = marks.select(*order, (F.col("letter") + 4 * fault).alias("kind")).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ordered = ordered.select("conv_id", F.monotonically_increasing_id().alias("place"), "row", "kind")
    return stage(ordered.mapInArrow(pack, PIECES.format(_kind_of(marks, "conv_id"))), "pieces")


def _kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _swept(chain: DataFrame, backwards: bool, sweep, schema: str) -> DataFrame:
    """The rows that ``sweep`` makes of each conversation's pieces in order, one piece after the other."""
    tasks = int(chain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("at").desc() if backwards else F.col("at").asc()
    return chain.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", order).mapInArrow(sweep, schema)


def placed(found: DataFrame) -> DataFrame:
    """``found`` pieces with the state in which each begins, the costs at its end, and whether it is the last."""

    def back(batches):
        held, ahead, begun = None, END, False
        for batch in slices(batches, 4096):
            out = []
            for conv, at, costs in zip(*[column(batch, n) for n in ("conv_id", "at", "costs")], strict=True):
                last = not begun or conv != held
                ahead = END if last else ahead
                out.append((at, list(ahead), last))
                held, begun, ahead = conv, True, before_piece(costs, ahead)
            yield _batch(out, [pa.int64(), pa.list_(pa.int64()), pa.bool_()])

    def lead(batches):
        for batch in slices(batches, 256):
            names = [n for n in batch.schema.names if n != "kinds"]
            leads = []
            for kinds, ahead, last in zip(*[column(batch, n) for n in ("kinds", "ahead", "last")], strict=True):
                leads.append([[to for *_, to in walked(kinds, tuple(ahead), state, last)][-1] for state in range(4)])
            edge = [[k[0] % 4, k[-1] % 4] for k in column(batch, "kinds")]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(leads, pa.list_(pa.int64())), pa.array(edge, pa.list_(pa.int64()))], [*names, "leads", "edge"])

    def forward(batches):
        held, state, before = None, STARTS, None
        for batch in slices(batches, 4096):
            out = []
            names = ("conv_id", "at", "ahead", "last", "leads", "edge")
            for conv, at, ahead, last, leads, edge in zip(*[column(batch, n) for n in names], strict=True):
                if before is None or conv != held:
                    state, before = STARTS, None
                out.append((at, state, ahead, last, int(before is not None and (before, edge[0]) not in LEGAL)))
                held, state, before = conv, leads[state], edge[1]
            yield _batch(out, [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64()])

    conv = _kind_of(found, "conv_id")
    parts = found.where(~F.col("whole"))
    ends = stage(_swept(parts.select("conv_id", "at", "costs"), True, back, "at long, ahead array<long>, last boolean"), "ends")
    led = parts.select("conv_id", "at", "kinds").join(ends, "at").select("conv_id", "at", "ahead", "last", "kinds")
    led = led.mapInArrow(lead, f"conv_id {conv}, at long, ahead array<long>, last boolean, leads array<long>, edge array<long>")
    begun = stage(_swept(led, False, forward, "at long, state long, ahead array<long>, last boolean, border long"), "begun")
    out = ["conv_id", "at", "rows", "kinds", "illegal", "state", "ahead", "last"]
    broken = parts.join(begun, "at").withColumn("illegal", F.col("illegal") + F.col("border")).select(*out)
    alone = [F.lit(STARTS).cast("long").alias("state"), F.array(*[F.lit(x).cast("long") for x in END]).alias("ahead"), F.lit(True).alias("last")]
    return found.where("whole").select(*out[:5], *alone).union(broken)


EDITED = "conv_id {}, at long, audit string, cost long, illegal long, edits array<struct<row: long, before: array<string>, edit: string, role: string, after: array<string>>>"


def edited(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The marks of numbered ``rows``, and per piece of a conversation its edits, their initials and cost."""

    def edit(batches):
        for batch in slices(batches, 256):
            out = []
            for n in range(batch.num_rows):
                p = {name: batch.column(i)[n].as_py() for i, name in enumerate(batch.schema.names) if name != "conv_id"}
                audit, cost, edits, new = [], 0, [], []
                for i, initial, c, state in walked(p["kinds"], tuple(p["ahead"]), p["state"], p["last"]):
                    audit.append(initial)
                    cost += c
                    if i < 0:
                        new.append(ROLES[state])
                    else:
                        edits.append({"row": p["rows"][i], "before": new, "edit": initial, "role": ROLES[state] if initial == "R" else None, "after": []})
                        new = []
                edits[-1]["after"] = new
                out.append(("".join(audit), cost, edits))
            kind = pa.list_(pa.struct([("row", pa.int64()), ("before", pa.list_(pa.string())), ("edit", pa.string()), ("role", pa.string()), ("after", pa.list_(pa.string()))]))
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), kind))]
            same = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "at", "illegal")]
            yield pa.RecordBatch.from_arrays([same[0], same[1], made[0], made[1], same[2], made[2]], ["conv_id", "at", "audit", "cost", "illegal", "edits"])

    marks = stage(marked(rows), "marks")
    found = placed(pieces(marks))
    return marks, stage(found.mapInArrow(edit, EDITED.format(_kind_of(rows, "conv_id"))), "edited")


def numbered(conversations: DataFrame) -> DataFrame:
    """The four columns, nulls of role and text as one blank, with a stored row number."""
    own = ["conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]]
    return stage(conversations.select(*own).withColumn("row", F.monotonically_increasing_id()), "turns")


def _lines(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, at, i, j (a line's place), turn, role, text, edit of the repaired conversations."""
    each = edits.select("at", F.posexplode("edits").alias("i", "e")).select("at", "i", "e", F.col("e.row").alias("row"))
    line = lambda turn, role, text, edit: F.struct(turn.alias("turn"), role.alias("role"), text.alias("text"), edit.alias("edit"))
    none = F.lit(None).cast(_kind_of(rows, "turn"))
    new = lambda roles: F.transform(roles, lambda r: line(none, r, F.lit(""), F.lit("I")))
    own = F.array(line(F.col("turn"), F.coalesce("e.role", "role"), F.col("text"), F.col("e.edit")))
    kept = F.filter(own, lambda x: x["edit"] != "D")
    lines = each.join(rows, "row").select("conv_id", "at", "i", F.posexplode(F.concat(new(F.col("e.before")), kept, new(F.col("e.after")))).alias("j", "x"))
    return lines.select("conv_id", "at", "i", "j", "x.turn", "x.role", "x.text", "x.edit")


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired rows of ``conversations`` (conv_id, turn, role, text): conv_id, place, turn, role, text, edit.

    ``place`` orders a conversation's rows; edit is Keep, Rerole or Insert's initial, an inserted row has
    no turn and an empty text.  Rows are taken by turn (nulls first), ties by role and by the text's
    SHA-256; equal rows are duplicates.  A null role or text is one blank, so such a text is blank and
    deleted; a null conv_id is a conversation; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = numbered(conversations)
    _, edits = edited(rows)
    return _lines(rows, edits).select("conv_id", F.struct("at", "i", "j").alias("place"), "turn", "role", "text", "edit")


def _digests(lines: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines.

    A digest has to be fed in order, so a conversation's lines stream through one task, which holds none.
    """

    types = [to_arrow_type(lines.schema["conv_id"].dataType), pa.string()]

    def digest(batches):
        held, now = None, None
        for batch in slices(batches):
            out = []
            for conv, line in zip(column(batch, "conv_id"), column(batch, "line"), strict=True):
                if now is not None and conv == held:
                    now.update(b"\n")
                else:
                    if now is not None:
                        out.append((held, now.hexdigest()))
                    held, now = conv, hashlib.sha256()
                now.update(line.encode())
            yield _batch(out, types)
        if now is not None:
            yield _batch([(held, now.hexdigest())], types)

    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.concat("role", F.lit(":"), "text")
    ordered = lines.select("conv_id", "at", "i", "j", text.alias("line")).repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "at", "i", "j")
    return ordered.select("conv_id", "line").mapInArrow(digest, f"conv_id {_kind_of(lines, 'conv_id')}, repaired_sha256 string")


def report(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``ids`` (conv_id) names conversations that may have no row any more: zeros, an empty audit, the
    digest of nothing.  Rows' first fault counts; gaps are turns missing between the first and the last;
    illegal are neighbours that the structure doesn't allow; audit has the edits' initials.  Nulls, ties,
    repeats and other columns as in :func:`repaired`.
    """
    rows = numbered(conversations)
    marks, edits = edited(rows)
    faults = ["blank", "duplicate", "truncated"]
    # first by turn, so that a long conversation's rows are summed before they meet
    by_turn = marks.groupBy("conv_id", "turn").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in faults])
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = by_turn.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in faults])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda p: p["audit"])
    totals = edits.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(parts, "").alias("audit"))
    every = (conversations if ids is None else ids).select("conv_id")
    zeros = {c: F.lit(0).cast("long") for c in ("gaps", *faults, "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(None).cast("string")}
    both = every.select("conv_id", *[v.alias(c) for c, v in zeros.items()])
    for found in (counts, totals, _digests(_lines(rows, edits))):
        both = both.union(found.select("conv_id", *[(F.col(c) if c in found.columns else v).alias(c) for c, v in zeros.items()]))
    empty = hashlib.sha256().hexdigest()
    out = both.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in zeros])
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))
