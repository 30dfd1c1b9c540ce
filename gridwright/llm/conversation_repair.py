"""Repair of damaged conversations by the cheapest edits: Viterbi in parallel, by convergence of cost vectors.

A repaired conversation's roles read: nothing, or an optional system turn and then user and assistant in turns.
Four states say what may follow. For each row and state, a cost to go says what the cheapest edits of the rows
from there to the conversation's end cost. All rows of the table are put in order and cut into chunks of equal
size, so a conversation of any length is many pieces. Each piece starts, from its right end, with a speculative
cost vector, in parallel. Then fix-up passes: a piece whose right neighbour came out with another vector than the
piece has assumed runs again. Vectors that differ only by a constant lead to the same edits, so they count as
equal; a few different steps make any two vectors converge, so few passes are needed. At last each piece is traced
forward along the costs to go, always taking the least letter among the cheapest edits, from the state that the
pieces before it lead to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwright.functions.ranks import with_row_index
from gridwright.functions.storage import staged
from gridwright.llm.common import quoted

#: Rows of a chunk.
CHUNK = 1_024
#: Characters of a text by which rows of one turn and role are ordered.
OPENING = 100
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Nothing yet; a system turn; a user's turn; an assistant's. A conversation ends in the first or the last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
Vector = tuple[int, int, int, int]
#: Costs to go where no row follows: a missing answer, or question and answer, are put in.
END: Vector = (0, 2 * INSERT, INSERT, 0)
BLANK, DUPLICATE, CUT = 1, 2, 3
ROLE_OF = {"u": "user", "a": "assistant"}
NO_TEXT = r"^[\x20\x09-\x0D]*$"


# -- one row -----------------------------------------------------------------------


def _next(state: int) -> tuple[str, int]:
    """The role that is wanted in a state, and the state after it."""
    return ("a", ASSISTANT) if state == USER else ("u", USER)


def _options(state: int, role: str, fault: int, after: Vector) -> list[tuple[int, str, int]]:
    """Cost to go, letter and next state of each edit that uses up a row, by letter."""
    found = [(DELETE + after[state], "D", state)]
    if fault in (BLANK, DUPLICATE):
        return found
    extra = TRUNCATED if fault == CUT else 0
    wanted, then = _next(state)
    if role == wanted:
        found.append((extra + after[then], "K", then))
    elif role == "s" and state == EMPTY:
        found.append((extra + after[SYSTEM], "K", SYSTEM))
    found.append((REROLE + extra + after[then], "R", then))
    return found


def before(role: str, fault: int, after: Vector) -> Vector:
    """Costs to go in front of a row, from those behind it. Rows may also be put in."""
    own = [min(_options(state, role, fault, after))[0] for state in range(4)]
    user = min(own[USER], INSERT + own[ASSISTANT])
    return (
        min(own[EMPTY], INSERT + user), min(own[SYSTEM], INSERT + user), user, min(own[ASSISTANT], INSERT + own[USER])
    )


def scaled(vector: Vector) -> Vector:
    """The one of all vectors that differ by a constant whose last cost is 0."""
    return tuple(x - vector[ASSISTANT] for x in vector)


class Costs:
    """Costs to go along a piece. Scaled vectors are few, so each step is looked up once it is known."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, int, Vector], Vector] = {}

    def step(self, role: str, fault: int, after: Vector) -> Vector:
        at = (role, fault, after)
        found = self.known.get(at)
        if found is None:
            found = self.known[at] = scaled(before(role, fault, after))
        return found

    def along(self, rows: list[tuple[str, int]], end: Vector) -> list[Vector]:
        """The scaled vectors in front of each row and behind the last."""
        found = [scaled(end)]
        for role, fault in reversed(rows):
            found.append(self.step(role, fault, found[-1]))
        return found[::-1]


def trace(rows: list[tuple[str, int]], costs: list[Vector], state: int, last: bool) -> Iterator[tuple[list[str], str, str, int]]:
    """The cheapest edits from ``state``, of the least letters: for each row the roles put in, letter, role and state.

    After the ``last`` row of a conversation comes one more entry, of what is put in at the end, with no letter.
    """
    for (role, fault), after in zip(rows, costs[1:]):
        put: list[str] = []
        here = before(role, fault, after)
        while True:
            wanted, then = _next(state)
            _, letter, then = min([*_options(state, role, fault, after), (INSERT + here[then], "I", then)])
            state = then
            if letter != "I":
                break
            put.append(wanted)
        yield put, letter, {"D": "", "K": role, "R": wanted}[letter], state
    if last:
        put = []
        while state in (SYSTEM, USER):
            wanted, state = _next(state)
            put.append(wanted)
        yield put, "", "", state


# -- tables ------------------------------------------------------------------------


def filled(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``(g, conv, turn, role, text)``; ``g`` is the key as text, nulls of role and text are one space."""
    as_text = quoted(key).cast("string")
    return df.select(
        F.when(as_text.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), as_text)).alias("g"), quoted(key).alias("conv"),
        quoted(turn).alias("turn"), F.coalesce(quoted(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(quoted(text).cast("string"), F.lit(" ")).alias("text"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``filled`` rows, a fifth or so of them damaged as a checksum of key and turn says; ``copy`` numbers repeats."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv"), F.lit(":"), named("turn"))) % 20
    marked = rows.select("*", kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select("g", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (``g``, ``turn``, ``role``, ``text``, maybe ``copy``) with ``at``, their place in the whole table, and ``fault``.

    Conversations follow each other, each by turn (nulls first), then role, the first ``OPENING`` characters, a hash
    of the text, and copy. A conversation of any length lies in as many parts as needed; equal rows are put anywhere
    among each other.
    """
    rows = rows if "copy" in rows.columns else rows.withColumn("copy", F.lit(0))
    said = rows.withColumns(
        {
            "said": F.unhex(F.md5(F.concat_ws("\0", "role", "text"))), "opening": F.substring("text", 1, OPENING),
            "tie": F.xxhash64(F.monotonically_increasing_id()),
        }
    )
    placed = staged(with_row_index(said, ["g", "turn", "role", "opening", "said", "copy", "tie"], "at").drop("opening", "tie"))
    repeats = placed.groupBy("g", "said").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    blank = F.col("text").rlike(NO_TEXT)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*$")
    joined = placed.join(staged(repeats.select("g", "said", "first")), ["g", "said"], "left")
    fault = F.when(blank, BLANK).when(F.col("at") > F.col("first"), DUPLICATE).when(cut, CUT).otherwise(0)
    return joined.select(
        "g", "at", "turn", "role", "text", fault.alias("fault"), F.substring("role", 1, 1).alias("i"), F.floor(F.col("at") / CHUNK).alias("chunk")
    )


def _pieces(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each piece, ``(g, chunk)``; rows come sorted."""
    here, rows = None, []
    for batch in batches:
        for at, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "chunk", *columns))):
            at = (at, row.pop(0))
            if at != here:
                if rows:
                    yield here, rows
                here, rows = at, []
            rows.append(tuple(row))
    if rows:
        yield here, rows


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a chunk in one task and in order."""
    return rows.repartition("chunk").sortWithinPartitions("chunk", "g", "at")


VECTOR = pa.list_(pa.int32())


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece with the vector assumed behind it and the one that follows in front of it."""
    costs = Costs()
    for (g, chunk), rows in _pieces(batches, ["i", "fault", "assumed"]):
        end = tuple(rows[0][2])
        front = costs.along([(role, fault) for role, fault, _ in rows], end)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([g]), pa.array([chunk], pa.int64()), pa.array([end], VECTOR), pa.array([front], VECTOR)], ["g", "chunk", "assumed", "front"]
        )


RUN = "g string, chunk long, assumed array<int>, front array<int>"


def converged(rows: DataFrame, pieces: DataFrame) -> tuple[DataFrame, int]:
    """The vector behind each piece (``g``, ``chunk``, ``assumed``), up to a constant, and the number of passes.

    ``pieces`` (``g``, ``chunk``, ``last``) are those of conversations in several chunks; so are ``rows``.
    """
    spread = F.lit(list(scaled(END))).cast("array<int>")
    state = staged(_dealt(rows.withColumn("assumed", spread).select("g", "chunk", "at", "i", "fault", "assumed")).mapInArrow(_run, RUN))
    passes = 1
    while True:
        ahead = state.select("g", (F.col("chunk") - 1).alias("chunk"), F.col("front").alias("wanted"))
        wrong = staged(state.join(ahead, ["g", "chunk"]).where("wanted <> assumed").select("g", "chunk", F.col("wanted").alias("assumed")))
        if wrong.isEmpty():
            return state, passes
        again = _dealt(rows.join(wrong, ["g", "chunk"]).select("g", "chunk", "at", "i", "fault", "assumed")).mapInArrow(_run, RUN)
        state = staged(state.join(wrong, ["g", "chunk"], "left_anti").unionByName(again))
        passes += 1


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece traced from every state that it may start in: the state that it ends in."""
    costs = Costs()
    for (g, chunk), rows in _pieces(batches, ["i", "fault", "assumed", "last"]):
        symbols = [(role, fault) for role, fault, *_ in rows]
        vectors = costs.along(symbols, tuple(rows[0][2]))
        ends = []
        for state in range(4):
            for *_, end in trace(symbols, vectors, state, False):
                pass
            ends.append(end)
        yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([chunk], pa.int64()), pa.array([ends], VECTOR)], ["g", "chunk", "ends"])


def starts(ends: DataFrame) -> DataFrame:
    """``(g, chunk, state)``: the state that each piece starts in, from the end states ``ends`` of its forerunners.

    A conversation's list of pieces is one cell: four small numbers for ``CHUNK`` rows, far less than its audit.
    """
    listed = ends.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("chunk", "ends"))).alias("x"))
    empty = F.struct(F.lit(EMPTY).alias("state"), F.expr("CAST(array() AS array<struct<chunk: bigint, state: int>>)").alias("out"))
    run = F.aggregate(
        "x", empty,
        lambda acc, p: F.struct(
            F.get(p["ends"], acc["state"]).alias("state"),
            F.array_append(acc["out"], F.struct(p["chunk"].alias("chunk"), acc["state"].alias("state"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return listed.select("g", F.inline(run))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's letters, its cost and its role after repair (null: it goes), with the roles put in around it."""
    costs, names = Costs(), ["g", "chunk", "at", "audit", "cost", "ahead", "kept", "behind"]
    for (g, chunk), rows in _pieces(batches, ["at", "i", "role", "fault", "assumed", "state", "last"]):
        symbols = [(i, fault) for _, i, _, fault, *_ in rows]
        state, last = rows[0][5], rows[0][6]
        found = list(trace(symbols, costs.along(symbols, tuple(rows[0][4])), state, last))
        behind = found.pop()[0] if last else []
        out = []
        for n, ((at, _, role, fault, *_), (put, letter, to, _)) in enumerate(zip(rows, found)):
            end = behind if n == len(rows) - 1 else []
            cost = INSERT * (len(put) + len(end)) + {"K": 0, "R": REROLE, "D": DELETE}[letter]
            cost += TRUNCATED if fault == CUT and letter != "D" else 0
            kept = None if letter == "D" else role if letter == "K" else ROLE_OF[to]
            out.append((g, chunk, at, "I" * len(put) + letter + "I" * len(end), cost, "".join(put), kept, "".join(end)))
        yield pa.RecordBatch.from_arrays([pa.array(c) if n != "kept" else pa.array(c, pa.string()) for n, c in zip(names, zip(*out))], names)


EDITED = "g string, chunk long, at long, audit string, cost long, ahead string, kept string, behind string"


def edits(rows: DataFrame) -> DataFrame:
    """``ordered`` rows with the cheapest edits: ``audit`` (letters), ``cost``, ``ahead``, ``kept``, ``behind``."""
    slim = rows.select("g", "chunk", "at", "i", "role", "fault")
    pieces = slim.groupBy("g", "chunk").agg(F.count(F.lit(1)).alias("n"))
    spans = pieces.groupBy("g").agg(F.min("chunk").alias("first"), F.max("chunk").alias("final"))
    long = staged(spans.where("first < final"))
    cut = slim.join(long, "g").withColumn("last", F.col("chunk") == F.col("final"))
    vectors, _ = converged(cut, pieces)
    known = cut.join(vectors.select("g", "chunk", "assumed"), ["g", "chunk"])
    ends = _dealt(known.select("g", "chunk", "at", "i", "fault", "assumed", "last")).mapInArrow(_traced, "g string, chunk long, ends array<int>")
    begun = staged(starts(ends).join(vectors.select("g", "chunk", "assumed"), ["g", "chunk"]))
    whole = (
        slim.join(spans.select("g", "final"), "g").join(begun, ["g", "chunk"], "left")
        .withColumn("assumed", F.coalesce("assumed", F.lit(list(scaled(END))).cast("array<int>")))
        .withColumn("state", F.coalesce("state", F.lit(EMPTY))).withColumn("last", F.col("chunk") == F.col("final"))
    )
    columns = ["g", "chunk", "at", "i", "role", "fault", "assumed", "state", "last"]
    return _dealt(whole.select(*columns)).mapInArrow(_edited, EDITED)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(g, at, lines)``: the turns that stand in each row's place after repair, as ``role:text``; none for a deleted row."""
    put = lambda c: F.transform(F.split(c, ""), lambda x: F.when(x == "u", F.lit("user:")).otherwise(F.lit("assistant:")))
    some = lambda c: F.when(F.length(c) > 0, put(c)).otherwise(F.array().cast("array<string>"))
    own = F.when(F.col("kept").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat_ws(":", "kept", "text")))
    joined = rows.select("at", "text").join(found.select("g", "at", "ahead", "kept", "behind"), "at")
    return joined.select("g", "at", F.concat(some("ahead"), own, some("behind")).alias("lines"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per conversation; rows come in order and pass by one batch at a time."""
    here, running, begun = None, None, False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([here]), pa.array([running.hexdigest()])], ["g", "sha"])

    for batch in batches:
        for g, lines in zip(batch.column("g").to_pylist(), batch.column("lines").to_pylist()):
            if g != here:
                if here is not None:
                    yield out()
                here, running, begun = g, hashlib.sha256(), False
            for line in lines:
                running.update((b"\n" if begun else b"") + line.encode())
                begun = True
    if here is not None:
        yield out()


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of ``df`` (these four columns) after repair: ``key``, ``at``, ``role``, ``text``; ``at`` orders a conversation's turns.

    Edits: keep a row (0), give it the other role (1), delete it (2; a must for blank rows and for ones that repeat role and
    text of an earlier row), put in a turn without text (5); a row whose text ends without a full stop or the like costs 5
    unless it goes. Of equally cheap edits the alphabetically least series is taken. A null role or text is one space (so
    the row is blank), a null key a conversation of its own, null turns come first. Rows of one turn are ordered by role
    and text, see ``ordered``. An empty table gives an empty result. Other columns do not matter, whatever their names.
    """
    source = filled(df, key, turn, role, text)
    rows = staged(ordered(source.drop("conv")))
    lines = repaired(rows, edits(rows))
    keys = source.groupBy("g").agg(F.first("conv").alias(key))
    turns = lines.select("g", "at", F.posexplode("lines").alias("n", "line")).join(keys, "g")
    return turns.select(
        quoted(key), F.struct("at", "n").alias("at"), F.substring_index("line", ":", 1).alias(role),
        F.expr("substring(line, instr(line, ':') + 1)").alias(text),
    )


def audit(df: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``df`` (``filled``): faults of ``rows`` (``ordered``), edits, their cost, hash of the repair.

    ``gaps`` counts missing turns between the least and the greatest. ``illegal`` counts neighbours whose roles' initials
    may not follow each other. A conversation without rows has zeros, an empty audit and the hash of an empty text. The
    hash of one conversation is a chain, so its rows pass through one task, in bounded memory; all else is spread.
    """
    found = staged(edits(rows))
    turns = rows.groupBy("g", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    # Neighbours inside a chunk, and across the borders of chunks.
    side = Window.partitionBy("chunk").orderBy("at")
    inside = rows.select("g", F.col("i"), F.lag("i").over(side).alias("j"), F.lag("g").over(side).alias("h")).where("g = h")
    final = rows.groupBy("g", "chunk").agg(F.max_by("i", "at").alias("j"), F.min_by("i", "at").alias("i"))
    across = final.select("g", "chunk", "i").join(final.select("g", (F.col("chunk") + 1).alias("chunk"), "j"), ["g", "chunk"])
    pairs = inside.select("g", "j", "i").unionByName(across.select("g", "j", "i"))
    illegal = pairs.groupBy("g").agg(F.count_if(~F.concat("j", "i").isin("su", "ua", "au")).alias("illegal"))
    faults = rows.groupBy("g").agg(
        *[F.count_if(F.col("fault") == f).alias(n) for f, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))]
    )
    series = found.groupBy("g", "chunk").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "").alias("audit"), F.sum("cost").alias("cost")
    ).groupBy("g").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"), F.sum("cost").alias("cost")
    )
    lines = repaired(rows, found)
    hashes = lines.repartition("g").sortWithinPartitions("g", "at").select("g", "lines").mapInArrow(_hashed, "g string, sha string")
    keys = df.groupBy("g").agg(F.first("conv").alias("conv"))
    whole = keys
    for part in (turns, faults, illegal, series, hashes):
        whole = whole.join(part, "g", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(
        F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
