"""Repair of conversations by the cheapest edits, in parallel along each conversation.

A conversation should read system (or not), then user and assistant in turn, or be empty.
Rows may be kept, given another role or deleted, and empty rows inserted, at a cost each;
blank rows and repetitions must go. The least cost from a row and a state of that grammar
to the end is a vector of four numbers, found row by row from the end: a Viterbi recursion.

Long conversations are cut into chunks that run at once, by rank convergence:

- The rows of all conversations are put in order by ranges and cut into blocks of ``BLOCK``;
  a chunk is what one block holds of one conversation. Nearly all have one.
- A chunk that is not the last of its conversation starts from a speculative vector. After
  that the vectors are passed along the chunks (one row each): where the true one differs
  from the speculative one by a constant only, so do all before it, and the chunk stands.
- Other chunks are fixed up: run again from the vector that reached them until they differ
  from what they had by a constant. Passes repeat until every chunk stands. Where that does
  not settle soon (a long run of one role keeps vectors apart), chunks run from all vectors
  seen in their conversation, which are few, so passes do not grow with its length.
- Edits are traced forward by the stitched vectors, at each step the move least in ASCII of
  those that reach the least cost. A chunk is traced from every state it may be entered in,
  and the one it is entered in picked when exits are known.

Texts take no part in this, only hashes of them; they join the edits at the end.

Cases: missing roles and texts count as one blank. Rows of one conversation are ordered by
turn, missing ones first, and rows of one turn by role and a hash of the text, so that equal
rows stand together. A row that is repeated any number of times is handled once, with a
count. A missing conversation id is one conversation. Of the table only the four columns
are read, so others may have any name. An empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashift.llm.storage import prepared, stored

#: Rows of a block, as a power of two; rows wait in order in numbers given by Spark, whose
#: lower 33 bits count the rows of a partition.
BLOCK = 12
#: Fix-up passes with the vectors that reached a chunk, before all of its conversation.
PATIENCE = 2

BLANK_CHARACTERS = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3

#: States: nothing yet, after system, after user, after assistant.
EXPECTED = ("user", "user", "assistant", "user")
ADVANCE = (2, 2, 3, 2)
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
LEGAL = {"su", "ua", "au"}

Vector = tuple[int, int, int, int]


def closed(costs: list[int]) -> Vector:
    """The vector when rows may be inserted first."""
    after_user = min(costs[2], INSERT + costs[3])
    begin, system, _, assistant = (min(c, INSERT + after_user) for c in costs)
    return begin, system, after_user, assistant


FAR = 1 << 20
#: At the end of a conversation, which is sound before anything and after an assistant.
END = closed([0, FAR, FAR, 0])
SPECULATIVE: Vector = (0, 0, 0, 0)


def moves(initial: str, fault: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, least letter first."""
    yield "D", DELETE, state
    if fault in (SOUND, TRUNCATED):
        extra = UNFINISHED if fault == TRUNCATED else 0
        if (initial, state) in KEEP:
            yield "K", extra, KEEP[initial, state]
        yield "R", REROLE + extra, ADVANCE[state]


def step(after: Vector, initial: str, fault: int) -> Vector:
    """The vector before a row, by that after it."""
    if fault in (BLANK, DUPLICATE):
        return tuple(c + DELETE for c in after)
    return closed([min(c + after[to] for _, c, to in moves(initial, fault, q)) for q in range(4)])


def normal(vector: Vector) -> tuple[Vector, int]:
    """A vector less its least cost, and that."""
    least = min(vector)
    return tuple(c - least for c in vector), least


def parallel(one: Vector, other: Vector) -> bool:
    return normal(one)[0] == normal(other)[0]


@dataclass
class Line:
    """A row of a chunk: its place, initial of its role, fault, and how often it stands there."""

    at: int
    initial: str
    fault: int
    copies: int


def backward(lines: list[Line], end: Vector) -> list[Vector]:
    """Vectors before every line, and ``end`` after the last."""
    out = [end]
    for line in reversed(lines):
        out.append(step(out[-1], line.initial, line.fault))
    return out[::-1]


def fixed_up(lines: list[Line], vectors: list[Vector], end: Vector) -> Vector:
    """The first vector when the last is ``end``: lines run again until they differ from
    the ``vectors`` of an earlier run by a constant only."""
    now = end
    for i in range(len(lines), -1, -1):
        if parallel(now, vectors[i]):
            return tuple(c + now[0] - vectors[i][0] for c in vectors[0])
        if i:
            now = step(now, lines[i - 1].initial, lines[i - 1].fault)
    return now


@dataclass
class Edit:
    """What happens at a line: letters of the audit, cost, roles of the rows that come out,
    which of them has the line's own text (-1: none), and the state after it."""

    letters: str
    cost: int
    made: list[str | None]
    own: int
    state: int


def traced(lines: list[Line], vectors: list[Vector], state: int, last: bool) -> list[Edit]:
    """Edits from a state on. A role of None is the line's own."""
    out = []
    for i, line in enumerate(lines):
        letters, cost, made, own = "", 0, [], -1
        vector, after = vectors[i], vectors[i + 1]
        while True:
            found = {a: (c, to) for a, c, to in moves(line.initial, line.fault, state) if c + after[to] == vector[state]}
            if "D" in found or INSERT + vector[ADVANCE[state]] != vector[state]:
                break
            letters, cost = letters + "I", cost + INSERT
            made.append(EXPECTED[state])
            state = ADVANCE[state]
        letter, (spent, to) = next(iter(found.items()))
        if letter != "D":
            own = len(made)
            made.append(None if letter == "K" else EXPECTED[state])
        again = line.copies - 1
        out.append(Edit(letters + letter + "D" * again, cost + spent + DELETE * again, made, own, to))
        state = to
    while last and vectors[-1][state] > vectors[-1][0]:  # 0 is sound at the end
        out[-1].letters += "I"
        out[-1].cost += INSERT
        out[-1].made.append(EXPECTED[state])
        state = out[-1].state = ADVANCE[state]
    return out


def written(vector: Vector) -> str:
    return " ".join(map(str, vector))


def read(vector: str | None) -> Vector:
    return END if vector is None else tuple(map(int, vector.split()))


def chunks(block: pa.Table) -> Iterator[tuple[dict, list[Line]]]:
    """(row of the first line, lines) of every chunk of a block."""
    rows = sorted(block.to_pylist(), key=lambda r: r["at"])
    for _, group in groupby(rows, key=lambda r: r["no"]):
        group = list(group)
        yield group[0], [Line(r["at"], r["initial"], r["fault"], r["copies"]) for r in group]


def table_of(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, schema.values())], names=list(schema))


LONG, INT, TEXT = pa.int64(), pa.int32(), pa.string()
RUNS = {"no": LONG, "block": LONG, "given": TEXT, "reached": TEXT}
NEEDS = {"no": LONG, "block": LONG, "given": TEXT, "settled": pa.bool_()}
TRACES = {
    "no": LONG, "block": LONG, "entry": INT, "at": LONG, "letters": TEXT, "cost": LONG, "made": pa.list_(TEXT),
    "own": INT, "illegal": LONG, "leave": INT, "head": TEXT, "tail": TEXT,
}
CHOSEN = {"no": LONG, "block": LONG, "chosen": INT, "between": LONG}


def ddl(schema: dict[str, pa.DataType]) -> str:
    names = {LONG: "long", INT: "int", TEXT: "string", pa.bool_(): "boolean", pa.list_(TEXT): "array<string>"}
    return ", ".join(f"{c} {names[t]}" for c, t in schema.items())


def speculated(block: pa.Table) -> pa.Table:
    """First run of the chunks of a block, the last of a conversation from its true end."""
    rows = []
    for head, lines in chunks(block):
        given = END if head["block"] == head["last_block"] else SPECULATIVE
        rows.append((head["no"], head["block"], written(given), written(normal(backward(lines, given)[0])[0])))
    return table_of(RUNS, rows)


def fixed(block: pa.Table) -> pa.Table:
    """Chunks run again from the vectors listed in ``given``."""
    rows = []
    for head, lines in chunks(block):
        vectors = backward(lines, SPECULATIVE)
        for given in head["givens"]:
            first = fixed_up(lines, vectors, read(given))
            rows.append((head["no"], head["block"], given, written(normal(first)[0])))
    return table_of(RUNS, rows)


def stitched(patient: bool):
    """Pass vectors along the chunks of a conversation, from the last: the true one of every
    chunk, or those that chunks have yet to be run from."""

    def run(runs: pa.Table) -> pa.Table:
        known = defaultdict(dict)
        for row in runs.to_pylist():
            known[row["block"]][row["given"]] = row["reached"]
        no, blocks = runs.column("no")[0].as_py(), sorted(known, reverse=True)
        now, settled, need = written(END), [], []
        for block in blocks:
            if now in known[block]:
                settled.append((no, block, now, True))
                now = known[block][now]
            else:
                need.append((no, block, now, False))
                now = known[block][written(SPECULATIVE)]
        if need and not patient:
            seen = {v for block in blocks for v in known[block].values()}
            need = [(no, b, v, False) for b in blocks[1:] for v in sorted(seen - set(known[b]))]
        return table_of(NEEDS, need or settled)

    return run


def edits_of(block: pa.Table) -> pa.Table:
    """Edits of every chunk, from the start or from each state that it may be entered in."""
    rows = []
    for head, lines in chunks(block):
        vectors = backward(lines, read(head["given"]))
        whole = head["first_block"] == head["block"]
        last = head["last_block"] == head["block"]
        initials = [line.initial for line in lines]
        before = [None, *initials[:-1]]
        illegal = [
            (line.copies - 1) * ((2 * line.initial) not in LEGAL) + (b is not None and b + line.initial not in LEGAL)
            for b, line in zip(before, lines)
        ]
        for entry in (0,) if whole else range(4):
            found = traced(lines, vectors, entry, last)
            for i, (line, edit) in enumerate(zip(lines, found)):
                ends = (edit.state, initials[0], initials[-1]) if i == len(lines) - 1 else (None, None, None)
                rows.append(
                    (head["no"], head["block"], entry, line.at, edit.letters, edit.cost, edit.made, edit.own, illegal[i], *ends)
                )
    return table_of(TRACES, rows)


def entered(exits: pa.Table) -> pa.Table:
    """The state that each chunk of a conversation is entered in, and whether the rows on
    both sides of its beginning may not follow each other."""
    by_block = defaultdict(dict)
    for row in exits.to_pylist():
        by_block[row["block"]][row["entry"]] = row
    rows, state, tail = [], 0, None
    for block in sorted(by_block):
        row = by_block[block][state]
        rows.append((row["no"], block, state, int(tail is not None and tail + row["head"] not in LEGAL)))
        state, tail = row["leave"], row["tail"]
    return table_of(CHOSEN, rows)


def stitched_vectors(lines: DataFrame) -> DataFrame:
    """(no, block, given): the true vector after each chunk of conversations with several."""
    several = stored(lines.where("first_block < last_block"), "several")
    runs = stored(several.groupBy("block").applyInArrow(speculated, ddl(RUNS)), "runs")
    tries = 0
    while True:
        vectors = stored(runs.groupBy("no").applyInArrow(stitched(tries < PATIENCE), ddl(NEEDS)), "vectors")
        need = vectors.where("NOT settled").groupBy("no", "block").agg(F.collect_list("given").alias("givens"))
        if need.isEmpty():
            return vectors.select("no", "block", "given")
        again = several.join(need, ["no", "block"]).groupBy("block").applyInArrow(fixed, ddl(RUNS))
        runs = stored(runs.unionByName(again), "runs")
        tries += 1


@dataclass
class Repaired:
    """``rows``: (no, at, place, conv, role, text) in order of no, at, place. ``audits``: a row
    per conversation with gaps, counts of faults, illegal neighbours, cost, and edits as
    letters (Insert, Keep, Rerole, Delete)."""

    rows: DataFrame
    audits: DataFrame


def ordered_lines(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts, with copies, numbered in order by ``at``."""
    solid = F.rtrim(F.col("text"), F.lit(BLANK_CHARACTERS))
    narrow = rows.select(
        "conv",
        "turn",
        "role",
        "d1",
        "d2",
        F.when(solid == "", BLANK).when(F.right(solid, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED).alias("own_fault"),
    )
    key = ["conv", "turn", "role", "d1", "d2"]
    distinct = narrow.groupBy(*key).agg(F.first("own_fault").alias("own_fault"), F.count("*").alias("copies"))
    ranged = distinct.repartitionByRange(*key).sortWithinPartitions(*key)
    return stored(ranged.withColumn("at", F.monotonically_increasing_id()), "ordered")


def faulted(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with faults and the chunks of their conversations, conversations with gaps)."""
    gaps = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    convs = ordered.groupBy("conv").agg(
        F.min("at").alias("no"), F.max("at").alias("end"), F.coalesce(gaps, F.lit(0)).alias("gaps")
    )
    convs = stored(convs, "conversations")
    firsts = ordered.groupBy(F.col("conv").alias("f_conv"), F.col("d1").alias("f1"), F.col("d2").alias("f2")).agg(
        F.min("at").alias("first_at")
    )
    # null-safe, so that a conversation with many rows has an exchange that can be split
    told = ordered.join(
        firsts,
        F.col("conv").eqNullSafe(F.col("f_conv")) & F.col("d1").eqNullSafe(F.col("f1")) & F.col("d2").eqNullSafe(F.col("f2")),
        "left",
    )
    told = told.join(convs.select(F.col("conv").alias("c_conv"), "no", "end"), F.col("conv").eqNullSafe(F.col("c_conv")), "left")
    fault = (
        F.when(F.col("own_fault") == BLANK, BLANK)
        .when(F.col("first_at") < F.col("at"), DUPLICATE)
        .otherwise(F.col("own_fault"))
    )
    block = lambda c: F.shiftright(c, BLOCK)
    lines = told.select(
        "no",
        "at",
        block("at").alias("block"),
        block("no").alias("first_block"),
        block("end").alias("last_block"),
        F.substring("role", 1, 1).alias("initial"),
        fault.alias("fault"),
        F.col("copies").cast("int").alias("copies"),
    )
    return stored(lines, "lines"), convs


def repair_conversations(
    rows: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> Repaired:
    """The cheapest repair of every conversation, of equal ones that with the least audit.

    Writes intermediate tables, one for each pass.
    """
    prepared(rows.sparkSession)
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    named = rows.select(
        F.col(f"`{conv_column}`").alias("conv"),
        F.col(f"`{turn_column}`").alias("turn"),
        said(role_column).alias("role"),
        said(text_column).alias("text"),
    )
    named = named.withColumns(
        {"d1": F.xxhash64("role", "text"), "d2": F.xxhash64(F.lit(1), "role", "text")}
    )
    ordered = ordered_lines(named)
    lines, convs = faulted(ordered)
    vectors = stitched_vectors(lines)
    given = lines.join(vectors, ["no", "block"], "left")
    traces = stored(given.groupBy("block").applyInArrow(edits_of, ddl(TRACES)), "traces")
    exits = traces.where("leave IS NOT NULL").join(vectors.select("no", "block"), ["no", "block"], "left_semi")
    exits = exits.select("no", "block", "entry", "leave", "head", "tail")
    chosen = stored(exits.groupBy("no").applyInArrow(entered, ddl(CHOSEN)), "chosen")
    edits = traces.join(chosen, ["no", "block"], "left").where("entry = coalesce(chosen, 0)")
    edits = edits.drop("chosen", "between", "entry", "leave", "head", "tail")
    return Repaired(repaired_rows(named, ordered, edits, convs), audits(lines, edits, chosen, convs))


def repaired_rows(named: DataFrame, ordered: DataFrame, edits: DataFrame, convs: DataFrame) -> DataFrame:
    """The rows that edits make, with their texts. One row of equal ones lends its text."""
    keys = ["conv", "turn", "d1", "d2"]
    texts = named.groupBy(*keys).agg(F.first("role").alias("own_role"), F.first("text").alias("own_text"))
    texts = texts.withColumnsRenamed({k: f"t_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys]
    made = edits.where(F.size("made") > 0).join(ordered.select("at", *keys), "at")
    whole = made.join(texts, on, "left").select(
        "no", "at", "conv", "own", "own_role", "own_text", F.posexplode("made").alias("place", "made_role")
    )
    return whole.select(
        "no",
        "at",
        "place",
        "conv",
        F.coalesce("made_role", "own_role").alias("role"),
        F.when(F.col("place") == F.col("own"), F.col("own_text")).otherwise(F.lit("")).alias("text"),
    )


def audits(lines: DataFrame, edits: DataFrame, chosen: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation that has rows."""
    faults = lines.groupBy("no").agg(
        F.sum(F.when(F.col("fault") == BLANK, F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(
            F.when(F.col("fault") == DUPLICATE, F.col("copies")).when(F.col("fault") == BLANK, 0).otherwise(F.col("copies") - 1)
        ).alias("duplicate"),
        F.count_if(F.col("fault") == TRUNCATED).alias("truncated"),
    )
    in_order = lambda key, text: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(key, text))), lambda s: s[text]), ""
    )
    # by block first, so that a long conversation gathers one string for each of its blocks
    blocks = edits.groupBy("no", "block").agg(
        in_order("at", "letters").alias("letters"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal")
    )
    whole = blocks.groupBy("no").agg(
        in_order("block", "letters").alias("audit"), F.sum("cost").alias("cost"), F.sum("illegal").alias("within")
    )
    between = chosen.groupBy("no").agg(F.sum("between").alias("between"))
    joined = convs.join(faults, "no").join(whole, "no").join(between, "no", "left")
    illegal = F.col("within") + F.coalesce("between", F.lit(0))
    return joined.select(
        "no", "conv", "gaps", "blank", "duplicate", "truncated", illegal.alias("illegal"), "cost", "audit"
    )


def conversation_digests(rows: DataFrame) -> DataFrame:
    """(no, digest) of the repaired rows, as ``role:text`` joined by line ends. The rows of a
    conversation are streamed through one hash in their order, never held."""
    streamed = rows.select("no", "at", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    streamed = streamed.repartition("no").sortWithinPartitions("no", "at", "place").select("no", "line")

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for no, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if no != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = no, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            yield from table_of({"no": LONG, "digest": TEXT}, done).to_batches()
        if state:
            yield from table_of({"no": LONG, "digest": TEXT}, [(now, state.hexdigest())]).to_batches()

    return streamed.mapInArrow(digests, "no long, digest string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults dealt by a hash of conversation and turn: rows dropped,
    emptied, robbed of their sentence ends, repeated, or given to the user."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(key[0], F.lit(":"), key[1])) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    spoilt = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times: Column = F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))
    return rows.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        spoilt.alias("text"),
        F.explode(times).alias("time"),
    ).drop("time")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """Every conversation of the table, damaged and repaired: its audit and a digest."""
    repaired = repair_conversations(damaged(rows))
    found = repaired.audits.join(conversation_digests(repaired.rows), "no", "left")
    every = rows.select("conv_id").distinct()
    whole = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in figures],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
