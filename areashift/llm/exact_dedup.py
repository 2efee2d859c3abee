"""Exact deduplication by a Grace hash table.

1. *Fold*: every task keeps an open-addressing table of the texts of its own rows and
   hands on each distinct one once, so a group of copies holding a third of all rows
   arrives as one record per task.
2. *Partition*: these records are partitioned by a hash of the text. A task that gets
   more than its memory budget spills them to files by further bits of the hash,
   recursively, until each file fits a table. A file whose records all share one hash
   cannot be divided and is streamed through a table, which holds equal texts once.
3. The tables compare complete contents; hashes only choose the place.

Spill files live inside the task that writes them and go with it: a lost task starts anew
from the shuffled records. The folded records are written to the shared folder once, as
their row numbers must not change between reads.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashift.llm.storage import free_name, free_unread, prepared, stored
from areashift.llm.windows import marked_rows
from areashift.session import scratch_made

#: Bytes of text a task holds in a table before it flushes (fold) or spills (partition).
MEMORY = 48 << 20
#: Files that a spilling task writes at each level of recursion.
FANOUT = 16

FOLDED = "row long, id long, slot long, digest binary, rows long, best long, content binary"


class OpenTable:
    """Open addressing with linear probing over complete byte strings.

    ``find`` gives the entry of a content, adding it when new. ``used`` counts the bytes
    held. Places are a power of two and at most half full.
    """

    def __init__(self) -> None:
        self.places = np.full(1024, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.used = 0

    def find(self, hashed: int, content: bytes) -> tuple[int, bool]:
        mask = len(self.places) - 1
        at = hashed & mask
        while (entry := int(self.places[at])) >= 0:
            if self.hashes[entry] == hashed and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        entry = len(self.contents)
        self.places[at] = entry
        self.hashes.append(hashed)
        self.contents.append(content)
        self.used += len(content)
        if 2 * len(self.contents) > len(self.places):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self.places = np.full(4 * len(self.places), -1, dtype=np.int64)
        mask = len(self.places) - 1
        for entry, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self.places[at] >= 0:
                at = (at + 1) & mask
            self.places[at] = entry


def better(a: tuple, b: tuple) -> tuple:
    """The row that stays, of (id, row): the larger id, no id last, then the smaller row."""
    key = lambda x: (x[0] is not None, x[0] or 0, -x[1])
    return a if key(a) >= key(b) else b


def fold(batches: Iterable[pa.RecordBatch], memory: int = MEMORY) -> Iterator[pa.RecordBatch]:
    """Member rows (row, id, slot, digest) and one record per distinct text of the task
    (slot, digest, rows, best id and row, content)."""
    schema = pa.schema(
        [(n, pa.binary() if k == "binary" else pa.int64()) for n, k in map(str.split, FOLDED.split(", "))]
    )
    base = TaskContext.get().partitionId() << 33
    row = slot = base
    table, digests, groups = OpenTable(), [], []

    def flush():
        nonlocal slot
        for start in range(0, len(groups), 500):
            part = range(start, min(start + 500, len(groups)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([groups[e][2] for e in part], pa.int64()),
                    pa.array([groups[e][1] for e in part], pa.int64()),
                    pa.array([slot + e for e in part], pa.int64()),
                    pa.array([digests[e] for e in part], pa.binary()),
                    pa.array([groups[e][0] for e in part], pa.int64()),
                    pa.array([groups[e][2] for e in part], pa.int64()),
                    pa.array([table.contents[e] for e in part], pa.binary()),
                ],
                schema=schema,
            )
        slot += len(groups)

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows, slots, keys = [], [], []
        for doc, text in zip(ids, texts):
            text = text or b""
            entry, new = table.find(hash(text) & (2**62 - 1), text)
            if new:
                digests.append(hashlib.sha256(text).digest())
                groups.append([0, doc, row])
            group = groups[entry]
            group[0] += 1
            group[1:] = better((group[1], group[2]), (doc, row))
            rows.append(row)
            slots.append(slot + entry)
            keys.append(digests[entry])
            row += 1
        none = [None] * len(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(slots, pa.int64()),
                pa.array(keys, pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.int64()),
                pa.array(none, pa.binary()),
            ],
            schema=schema,
        )
        if table.used > memory:
            yield from flush()
            table, digests, groups = OpenTable(), [], []
    yield from flush()


def hash_at(digest: bytes, level: int) -> int:
    """Independent hash bits per level of recursion: byte ``level`` of a digest of 32."""
    return digest[level % 32]


def grouped(records: Iterable[tuple], level: int, memory: int) -> Iterator[tuple]:
    """(slot, best id, best row, group size) of every record, texts compared in full.

    ``records`` are (slot, digest, rows, id, row, content). They stay in one table while
    they fit; beyond, all go to ``FANOUT`` files by the next bits of the hash, each of
    which is handled alone. After the last bits, or when a file holds a single hash,
    records are streamed through the table.
    """
    table, groups, slots, one = OpenTable(), [], [], True
    files = None
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        first = None
        for record in records:
            if files is not None:
                pickle.dump(record, files[hash_at(record[1], level) % FANOUT])
                continue
            slot, digest, rows, doc, row, content = record
            first = digest if first is None else first
            one = one and digest == first
            entry, new = table.find(int.from_bytes(digest[24:], "little") >> 2, content)
            if new:
                groups.append([0, doc, row, digest])
            group = groups[entry]
            group[0] += rows
            group[1:3] = better((group[1], group[2]), (doc, row))
            slots.append((slot, entry))
            if table.used > memory and not one and level < 24:
                files = [open(f"{folder}/{i}", "wb") for i in range(FANOUT)]  # noqa: SIM115
                # what is in the table goes to the files too, one record per text
                kept = [[] for _ in groups]
                for slot, entry in slots:
                    kept[entry] += slot if isinstance(slot, list) else [slot]
                for entry, (rows, doc, row, digest) in enumerate(groups):
                    out = (kept[entry], digest, rows, doc, row, table.contents[entry])
                    pickle.dump(out, files[hash_at(digest, level) % FANOUT])
                table, groups, slots = OpenTable(), [], []
        if files is None:
            for slot, entry in slots:
                rows, doc, row, _ = groups[entry]
                for each in slot if isinstance(slot, list) else [slot]:
                    yield each, doc, row, rows
            return
        for file in files:
            file.close()
        for i in range(FANOUT):
            with open(f"{folder}/{i}", "rb") as file:
                yield from grouped(spilled(file), level + 1, memory)


def spilled(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def partitioned(
    batches: Iterable[pa.RecordBatch], memory: int = MEMORY
) -> Iterator[pa.RecordBatch]:
    """Group the records of one partition of the hash."""
    records = (
        record for batch in batches for record in zip(*(c.to_pylist() for c in batch.columns))
    )
    names = ["slot", "keep_id", "keep_row", "group_size"]
    out: list[tuple] = []
    for found in grouped(records, 0, memory):
        out.append(found)
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)


def grace_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", memory: int = MEMORY
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A missing text counts as empty. Of equal texts the row with the largest id stays, a
    missing id being the smallest; of rows with the same id and text exactly one stays.
    Other columns are not looked at and may have any name. An empty table gives an empty
    result.
    """
    prepared(docs.sparkSession)
    pairs = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text")
    )
    folded = stored(pairs.mapInArrow(lambda b: fold(b, memory), FOLDED), "folded")
    records = folded.where("content IS NOT NULL").select(
        "slot", "digest", "rows", "id", "best", "content"
    )
    groups = records.repartition(F.xxhash64("digest")).mapInArrow(
        lambda b: partitioned(b, memory),
        "slot long, keep_id long, keep_row long, group_size long",
    )
    members = folded.where("content IS NULL").select("row", "id", "slot", "digest")
    return members.join(groups, "slot").select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of equal texts, all its columns, whatever those are called.

    Only rows whose text a filter of fixed size takes for one that stands several times are
    shuffled to find which of them stays; the others pass through.
    """
    before = scratch_made()
    found = grace_dedup(docs, id_column, text_column).where("group_size > 1 AND kept")
    lowest = F.lit(-(2**63))  # null ids are told apart by text
    marks = found.select(
        F.coalesce(F.col(id_column), lowest).alias("__kept_id"), F.col("text_sha256").alias("__kept_sha")
    )
    marks = stored(marks, "copies")
    free_unread(before, marks)
    sha = F.sha2(F.coalesce(F.col(text_column), F.lit("")).cast("binary"), 256)
    some, others = marked_rows(docs, F.xxhash64(sha), marks.select(F.xxhash64("__kept_sha").alias("digest")))
    own_id, own_sha = free_name(docs, "own_id"), free_name(docs, "own_sha")
    rows = some.withColumns({own_id: F.coalesce(F.col(id_column).cast("long"), lowest), own_sha: sha})
    marks = marks.withColumnsRenamed({c: free_name(docs, c) for c in marks.columns})
    mark_id, mark_sha = marks.columns
    copies = rows.join(marks, (F.col(own_id) == F.col(mark_id)) & (F.col(own_sha) == F.col(mark_sha)), "left_semi")
    # a filter lets some single texts through as well, which no mark names
    shas = marks.select(mark_sha)
    single = rows.join(shas, F.col(own_sha) == F.col(mark_sha), "left_anti")
    once = copies.dropDuplicates([own_id, own_sha])
    return others.unionByName(once.unionByName(single).drop(own_id, own_sha))
