"""Repair of conversations at the least cost: turns kept, re-roled, deleted or inserted.

A repaired conversation's role initials are none, or an optional s and then
pairs of u and a. Keeping a row costs 0, giving it the role user or assistant
2, deleting it 3 (required for blank and repeated rows), inserting a turn
without text 2; rows that break off cost 1 more unless deleted. Of the cheapest
repairs, the one whose initials (D, I, K, R) come first as text is taken.

**Parallel Viterbi.** Rows are sorted over all tasks and cut into chunks of
consecutive rows, so that a conversation of any length is spread over many. A
chunk goes backward from a vector of costs, one for each state of the pattern.
Only where a conversation goes on in the next chunk that vector is unknown: the
chunk starts from a speculative one, that of a conversation's end. Costs that
differ by a constant lead to the same repair, and after some rows they nearly
always do. Fix-up passes compare each speculative vector with the one that the
next chunk found; where they differ by more than a constant, the chunk runs
again from the right one, beside the old one, until both differ by a constant.
This is repeated until no vector is wrong, at most once for each vector that
there is (a few). With the costs stitched together,
each chunk traces the repair forward, from every state that it may be entered
in; the states then follow from chunk to chunk.

Each row's first fault counts: blank (nothing but blanks), duplicate (role and
text were there before, in any row of the conversation), truncated (the last
character that isn't blank is none of .!?).

Nulls in a role or text become one space. Rows of a conversation are taken by
turn, those without a turn first, and rows of one turn by the MD5 of
"role:text"; rows that are repeated whole are neighbours, and all but one of
them duplicates. Rows without conv_id are one conversation. Texts of any length
are taken whole. A conversation's repaired text is hashed row by row as it
streams through one task, since SHA-256 is sequential. An empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, width

#: States of the pattern are the start, after s, after u, after a; where each role initial leads from each.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The role that a state asks for next and the state then, and the costs of edits.
NEEDS = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Costs to go at a conversation's end: none where it may end, else that of the turns to insert.
END = (0, 4, 2, 0)
FAR = 1 << 40
BLANKS = " \t\n\x0b\f\r"
#: Rows of a chunk.
CHUNK = 1 << 16
#: A row's fault, in bits of its code beside the role's initial.
BLANK, DUPLICATE, TRUNCATED = 4, 8, 16
INITIALS = ["s", "u", "a", ""]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after the damage; copies is 0 for dropped rows, 2 for repeated ones."""
    plain = lambda c: F.coalesce(F.col(c), F.lit(" "))
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(label("conv_id"), F.lit(":"), label("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """Rows as ``damaged`` gives them, all as they are."""
    plain = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", plain("role"), plain("text"), F.lit(1).alias("copies"))


def content(role: str = "role", text: str = "text") -> Column:
    return F.unhex(F.md5(F.concat(F.col(role), F.lit(":"), F.col(text)).cast("binary")))


def ordered(rows: DataFrame) -> DataFrame:
    """(pos, conv_id, turn, content, code): rows without texts in order, ``pos`` rising over all tasks; written."""
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = code + F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    slim = rows.select("conv_id", "turn", content().alias("content"), code.alias("code"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    # Whole repeated rows may go to different tasks by ``spread``; which of them comes first makes no difference.
    slim = slim.withColumn("spread", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "content"]
    parts = slim.repartitionByRange(width(rows.sparkSession), *order, "spread").sortWithinPartitions(*order, "spread")
    return materialize(parts.select(F.monotonically_increasing_id().alias("pos"), *order, "code"), "turns")


def closed(v: tuple) -> tuple:
    """Costs with insertions allowed: from each state it may be cheaper to insert the turn that is asked for."""
    v0, v1, v2, v3 = v
    v2 = min(v2, v3 + INSERT)
    v3 = min(v3, v2 + INSERT)
    return min(v0, v2 + INSERT), min(v1, v2 + INSERT), v2, v3


def before(v: tuple, code: int) -> tuple:
    """Costs before a row, of those behind it."""
    if code & (BLANK | DUPLICATE):
        return closed(tuple(c + DELETE for c in v))
    cut, step = CUT_OFF if code & TRUNCATED else 0, STEP.get(INITIALS[code & 3], {})
    return closed(tuple(min(v[s] + DELETE, v[NEEDS[s][1]] + REROLE + cut, v[step[s]] + cut if s in step else FAR) for s in range(4)))


def parallel(v: tuple, w: tuple) -> bool:
    """Whether two vectors differ by a constant."""
    return len({a - b for a, b in zip(v, w)}) == 1


def backward(codes: list[int], end: tuple) -> list[tuple]:
    """Costs at each row and, last, behind all of them."""
    out = [end]
    for code in reversed(codes):
        out.append(before(out[-1], code))
    return out[::-1]


def rerun(codes: list[int], used: tuple, end: tuple, start: tuple) -> tuple:
    """Costs at the first row from ``end``, given those from ``used``: both run until they differ by a constant."""
    for code in reversed(codes):
        if parallel(used, end):
            return tuple(c + end[0] - used[0] for c in start)
        used, end = before(used, code), before(end, code)
    return end


def trace(codes: list[int], costs: list[tuple], state: int, last: bool) -> tuple[list[str], int]:
    """Initials of the edits at each row, insertions before it included, and the state behind all; the least text of the cheapest.

    ``last``: the conversation ends here, and turns inserted at its end stand with the last row.
    """
    out = []
    for k, code in enumerate(codes):
        edits, step, cut = "", STEP.get(INITIALS[code & 3], {}), CUT_OFF if code & TRUNCATED else 0
        while True:
            here, behind = costs[k][state], costs[k + 1]
            if behind[state] + DELETE == here:
                edits += "D"
            elif costs[k][NEEDS[state][1]] + INSERT == here:
                edits, state = edits + "I", NEEDS[state][1]
                continue
            elif state in step and behind[step[state]] + cut == here:
                edits, state = edits + "K", step[state]
            else:
                edits, state = edits + "R", NEEDS[state][1]
            break
        out.append(edits)
    while last and state not in (0, 3):
        out[-1], state = out[-1] + "I", NEEDS[state][1]
    return out, state


def _stream(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _runs(rows, at: int):
    """Lists of neighbouring rows that agree in field ``at``."""
    run = []
    for row in rows:
        if run and row[at] != run[0][at]:
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def edits(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(pos, code, edit) of ordered rows: the fault found, and the initials of the edits at each row."""
    at = lambda c: F.floor(F.col(c) / chunk).alias("chunk")
    # The first row of each content within a conversation, as a mark beside it: no join by a content that many rows share.
    firsts = turns.groupBy("conv_id", "content").agg(F.min("pos").alias("pos"))
    marks = firsts.select(at("pos"), "pos", F.lit(0).alias("mark"), F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.lit(None).cast("int").alias("code"))
    rows = turns.select(at("pos"), "pos", F.lit(1).alias("mark"), "conv_id", "code").unionByName(marks)
    parts = rows.repartition(width(turns.sparkSession), "chunk").sortWithinPartitions("chunk", "pos", "mark")
    out = pa.schema([("pos", pa.int64()), ("chunk", pa.int64()), ("piece", pa.int64()), ("code", pa.int32()), ("edit", pa.string())])

    def inner(batches):
        # Conversations between a chunk's first and last one lie whole within it.
        for block in _runs(_stream(batches), 0):
            first, found = None, []
            for number, pos, mark, conv, code in block:
                if mark:
                    # A fault that comes before: blank.
                    found.append((pos, conv, code if pos == first or code & BLANK else code & 3 | DUPLICATE))
                else:
                    first = pos
            runs, ready = list(_runs(found, 1)), []
            for k, run in enumerate(runs):
                if k in (0, len(runs) - 1):
                    ready += [(pos, number, run[0][0], code, None) for pos, _, code in run]
                else:
                    codes = [c for _, _, c in run]
                    letters, _ = trace(codes, backward(codes, END), 0, True)
                    ready += [(pos, number, run[0][0], code, edit) for (pos, _, code), edit in zip(run, letters)]
            yield _batch(ready, out)

    found = materialize(parts.mapInArrow(inner, "pos long, chunk long, piece long, code int, edit string"), "edits")
    whole = found.filter("edit is not null").select("pos", "code", "edit")
    return whole.unionByName(_stitched(found.filter("edit is null").drop("edit"), turns))


def _stitched(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """(pos, code, edit) of rows (pos, chunk, piece, code) whose conversation may go beyond their chunk.

    A piece is a conversation's rows within one chunk, two of a chunk at most:
    tables of pieces, and windows over them, are small beside those of rows.
    Costs are those of a vector's least state and more, so that vectors which
    differ by a constant are equal.
    """
    spark = turns.sparkSession
    order = Window.partitionBy("conv_id").orderBy("piece")
    heads = rows.filter(F.col("pos") == F.col("piece")).select("piece").join(turns.select(F.col("pos").alias("piece"), "conv_id"), "piece")
    heads = materialize(heads.withColumns({"first": F.lag("piece").over(order).isNull(), "last": F.lead("piece").over(order).isNull()}), "pieces")

    def each_piece(pieces: DataFrame, work, schema: str) -> DataFrame:
        """Rows that ``work(pos, codes, facts)`` makes of each piece, ``facts`` being the other columns of ``pieces``."""
        facts = [c for c in pieces.columns if c != "piece"]
        arrow = pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in spark.createDataFrame([], schema).schema])
        parts = rows.join(pieces, "piece").select("piece", "pos", "code", *facts).repartition(width(spark), "piece").sortWithinPartitions("piece", "pos")

        def run(batches):
            for piece in _runs(_stream(batches), 0):
                yield _batch(work([r[1] for r in piece], [r[2] for r in piece], dict(zip(facts, piece[0][3:]))), arrow)

        return parts.mapInArrow(run, schema)

    def along(pieces: DataFrame, step, begins: str, ascending: bool, schema: str) -> DataFrame:
        """``step(value, row)`` gives a row and the next value, from piece to piece of each conversation; None where ``begins``."""
        arrow = pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in spark.createDataFrame([], schema).schema])
        parts = pieces.repartition(width(spark), "conv_id").sortWithinPartitions("conv_id", F.col("piece") if ascending else F.col("piece").desc())
        facts = [c for c in pieces.columns if c != "conv_id"]

        def run(batches):
            value = None
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    line, value = step(None if row[begins] else value, row)
                    out.append(line)
                yield _batch(out, arrow)

        return parts.select(*facts).mapInArrow(run, schema)

    def speculate(pos, codes, facts):
        return [(pos[0], END, _least(backward(codes, END)[0]))]

    def fix(pos, codes, facts):
        return [(pos[0], end, _least(rerun(codes, END, tuple(end), tuple(facts["start"])))) for end in facts["ends"]]

    def stitch(value, row):
        end = END if value is None else value
        known = {tuple(r["used"]): tuple(r["start"]) for r in row["runs"]}
        return (row["piece"], end, end in known), known.get(end, known[END])

    vectors = "piece long, used array<long>, start array<long>"
    memo = materialize(each_piece(heads.select("piece"), speculate, vectors), "vectors")
    while True:
        runs = memo.groupBy("piece").agg(F.collect_list(F.struct("used", "start")).alias("runs"))
        ends = materialize(along(heads.join(runs, "piece"), stitch, "last", False, "piece long, used array<long>, known boolean"), "ends")
        # Costs are at most 4 apart, so that there are few different vectors.
        asked = [r["used"] for r in ends.filter("not known").select("used").distinct().collect()]
        if not asked:
            break
        # Every piece of such a conversation, so that a vector which goes through piece after piece takes one pass alone.
        where = heads.join(ends.filter("not known").select("piece"), "piece").select("conv_id").distinct().withColumnRenamed("conv_id", "__conv")
        pieces = heads.join(where, heads["conv_id"].eqNullSafe(where["__conv"]), "left_semi").select("piece").join(runs, "piece")
        wanted = F.filter(F.array(*[F.array(*[F.lit(c).cast("long") for c in v]) for v in asked]), lambda v: ~F.exists("runs", lambda r: r["used"] == v))
        start = F.filter("runs", lambda r: r["used"] == F.array(*[F.lit(c).cast("long") for c in END]))[0]["start"]
        right = each_piece(pieces.select("piece", start.alias("start"), wanted.alias("ends")).filter(F.size("ends") > 0), fix, vectors)
        memo = materialize(memo.unionByName(right), "vectors")

    def exits(pos, codes, facts):
        costs = backward(codes, tuple(facts["used"]))
        return [(pos[0], [trace(codes, costs, s, False)[1] for s in range(4)])]

    def enter(value, row):
        now = 0 if value is None else value
        return (row["piece"], now), row["exits"][now]

    through = each_piece(ends.select("piece", "used"), exits, "piece long, exits array<int>")
    entries = along(heads.join(through, "piece"), enter, "first", True, "piece long, entry int")

    def final(pos, codes, facts):
        letters, _ = trace(codes, backward(codes, tuple(facts["used"])), facts["entry"], facts["last"])
        return list(zip(pos, codes, letters))

    return each_piece(ends.select("piece", "used").join(heads.select("piece", "last"), "piece").join(entries, "piece"), final, "pos long, code int, edit string")


#: Arrow's types of the columns that tasks give out.
ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _least(v: tuple) -> tuple:
    return tuple(c - min(v) for c in v)


class Conversation:
    """Counters, audit and hash of one conversation whose rows come in order."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.cost, self.audit, self.hash, self.lines = conv_id, 0, 0, [], hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.initial = None
        self.waiting: list[str | None] = []

    def row(self, turn, code: int, edit: str) -> None:
        self.blank += bool(code & BLANK)
        self.duplicate += bool(code & DUPLICATE)
        self.truncated += bool(code & TRUNCATED)
        initial = INITIALS[code & 3]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        self.audit.append(edit)
        for letter in edit:
            if letter == "D":
                self.cost += DELETE
                continue
            role, ahead = NEEDS[self.state]
            if letter == "I":
                self.cost += INSERT
                self.waiting.append(role + ":")
            else:
                self.cost += (REROLE if letter == "R" else 0) + (CUT_OFF if code & TRUNCATED else 0)
                # The row's text comes behind its last copy.
                self.waiting.append(None if letter == "K" else role)
                ahead = STEP[initial][self.state] if letter == "K" else ahead
            self.state = ahead

    def text(self, role: str, text: str) -> None:
        for line in self.waiting:
            line = line if line is not None and line.endswith(":") else f"{line or role}:{text}"
            self.hash.update((("\n" if self.lines else "") + line).encode())
            self.lines += 1
        self.waiting = []

    def result(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def repair(conversations: DataFrame, damage: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``damage``: rows are damaged first, as ``damaged`` does.
    """
    rows = damaged(conversations) if damage else undamaged(conversations)
    turns = ordered(rows)
    found = edits(turns, chunk)
    kind = turns.schema["conv_id"].dataType
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    judged = turns.drop("code").join(found, "pos").select("conv_id", "turn", "content", F.lit(0).alias("part"), "pos", "code", "edit", none("role", "string"), none("text", "string"))
    there = F.col("copies") > 0
    only = lambda c: F.when(there, c)
    texts = rows.select(
        "conv_id", only(F.col("turn")).alias("turn"), only(content()).alias("content"), F.when(there, 1).otherwise(2).alias("part"), none("pos", "long"), none("code", "int"), none("edit", "string"),
        only(F.col("role")).alias("role"), only(F.col("text")).alias("text"),
    )
    order = ["conv_id", "turn", "content", "part", "pos"]
    parts = judged.unionByName(texts).repartition(width(conversations.sparkSession), "conv_id").sortWithinPartitions(*order)
    schema = f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv, turn, part, code, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv_id:
                    done += [now.result()] if now else []
                    now = Conversation(conv)
                if part == 0:
                    now.row(turn, code, edit)
                elif part == 1:
                    now.text(role, text)
            if done:
                yield _rows(done, batch.schema.field(0).type)
        if now:
            yield _rows([now.result()], batch.schema.field(0).type)

    return parts.select("conv_id", "turn", "part", "code", "edit", "role", "text").mapInArrow(run, schema)


def _rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return _batch(done, pa.schema([("conv_id", kind), *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())]))
