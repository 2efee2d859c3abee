"""Suffix-array deduplication: drop the bytes of long strings that occur again anywhere.

1. Anchored runs (``areashift.llm.windows``) put equal strings of the least length into
   equal classes or under equal anchors. Runs with equal content are settled as a class.
2. The distinct runs under one anchor go to one task, which builds an *enhanced suffix
   array* of them: suffixes sorted by prefix doubling, common prefixes of neighbours, and
   from a stack scan the tree of common-prefix intervals. An interval of at least the
   least length whose occurrences are preceded by different bytes is a maximal repeat; all
   its occurrences belong to it, not only neighbours.
3. An anchor with more distinct runs than a task should hold is split: its windows are
   counted one by one instead, combined on the map side, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashift.llm.storage import stored
from areashift.llm.windows import (
    CLASS,
    Spec,
    class_contents,
    counted_windows,
    cut,
    mask_of,
    repeated_runs,
    run_classes,
    sha256,
    start,
    text_spans,
    whole_spans,
)

LEAST = 400
GRAM = 100
#: Distinct runs of one anchor that one task takes; anchors with more are split.
GROUP = 4000
#: Bytes of runs that share one suffix array.
BUFFER = 1 << 19
#: Bytes a first sorting key holds: 9 bits each, as the end of a run sorts below byte 0.
FIRST = 7


@dataclass
class Repeats:
    """The interval tree: of each group its length, parent (-1 for none), whether it is a
    maximal repeat; and of each occurrence its start and its deepest group. All occurrences
    of a group are its own and those of the groups below."""

    length: np.ndarray
    parent: np.ndarray
    maximal: np.ndarray
    start: np.ndarray
    group: np.ndarray


def suffix_array(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, each cut off at the end of its run, and the ranks by the first
    7, 14, 28, ... bytes.

    ``ends`` has for every place the end of its run. A rank is the place of the first equal
    suffix in the order; 0 is kept for what lies past an end.
    """
    n = len(text)
    place = np.arange(n)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(FIRST):
        at = place + i
        inside = at < ends
        symbol = np.where(inside, text[np.minimum(at, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        key = (key << np.uint64(9)) | symbol
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    ranks, step = [rank], FIRST
    longest = int((ends - place).max()) if n else 0
    while step < longest:
        # only suffixes that are still equal to a neighbour are sorted again
        edge = np.append(new, True)
        tied = np.flatnonzero(~(edge[:-1] & edge[1:]))
        if not len(tied):
            break
        members = order[tied]
        after = members + step
        second = np.where(after < ends[members], rank[np.minimum(after, n - 1)], 0)
        head = rank[members]
        again = np.lexsort((second, head))
        members, second, head = members[again], second[again], head[again]
        order[tied] = members
        fresh = np.ones(len(tied), dtype=bool)
        fresh[1:] = (head[1:] != head[:-1]) | (second[1:] != second[:-1])
        new = new.copy()
        new[tied] = fresh
        rank = rank.copy()
        rank[members] = np.maximum.accumulate(np.where(fresh, tied, 0)) + 1
        ranks.append(rank)
        step *= 2
    return order, ranks


def common_prefixes(
    text: np.ndarray, order: np.ndarray, ranks: list[np.ndarray], ends: np.ndarray, least: int
) -> np.ndarray:
    """Common prefix of every suffix in the order with the one before; 0 may stand for any
    length below ``least``."""
    n = len(order)
    out = np.zeros(n, dtype=np.int64)
    left, right = order[:-1], order[1:]
    near = np.arange(max(n - 1, 0))
    if least >= FIRST:
        level = max(i for i in range(len(ranks)) if FIRST << i <= least)
        near = np.flatnonzero(ranks[level][left] == ranks[level][right])
    a, b = left[near], right[near]
    rest = np.minimum(ends[a] - a, ends[b] - b)
    length = np.zeros(len(near), dtype=np.int64)
    # equal by the first 7 * 2^i bytes: go on behind them, longest steps first
    for i in [len(ranks) - 1, *range(len(ranks) - 1, -1, -1)]:
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        length += np.where((length < rest) & (ranks[i][x] == ranks[i][y]), FIRST << i, 0)
    length = np.minimum(length, rest)
    # the last bytes, fewer than a first key holds
    going = np.ones(len(near), dtype=bool)
    for _ in range(FIRST):
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        going &= (length < rest) & (text[x] == text[y])
        length = length + going
    out[near + 1] = length
    return out


def interval_tree(
    text: np.ndarray, first: np.ndarray, order: np.ndarray, common: np.ndarray, least: int
) -> Repeats:
    """Scan the common prefixes with a stack; ``first`` marks places where a run begins,
    before which nothing is known, so that they count as preceded by a byte of their own."""
    lengths, parents, maximal, starts, groups = [], [], [], [], []
    hot = common >= least
    # a suffix takes part if it shares at least ``least`` bytes with a neighbour
    part = hot.copy()
    part[:-1] |= hot[1:]
    place = np.flatnonzero(part)
    before = np.where(first[order[place]], -1 - order[place], text[order[place] - 1].astype(np.int64))
    own = common[place]
    after = np.zeros(len(place), dtype=np.int64)
    inside = place + 1 < len(common)
    after[inside] = common[place[inside] + 1]
    stack: list[list] = []  # [length, group, byte before, diverse]
    for suffix, left, right, byte in zip(
        order[place].tolist(), own.tolist(), after.tolist(), before.tolist()
    ):
        # leave the intervals that this suffix no longer belongs to
        keep = left if left >= least else 0
        closed = None
        while stack and stack[-1][0] > keep:
            closed = stack.pop()
            maximal[closed[1]] = closed[3]
            if stack and stack[-1][0] >= keep:
                top = stack[-1]
                parents[closed[1]] = top[1]
                top[3] = top[3] or closed[3] or top[2] != closed[2]
                closed = None
        if keep and (not stack or stack[-1][0] < keep):
            # a shorter interval that holds the one just left
            lengths.append(keep)
            parents.append(-1)
            maximal.append(False)
            group = [keep, len(lengths) - 1, byte if closed is None else closed[2], False]
            if closed is not None:
                parents[closed[1]] = group[1]
                group[3] = closed[3]
            stack.append(group)
        if right >= least and (not stack or right > stack[-1][0]):
            lengths.append(right)
            parents.append(-1)
            maximal.append(False)
            stack.append([right, len(lengths) - 1, byte, False])
        if stack:
            top = stack[-1]
            top[3] = top[3] or top[2] != byte
            starts.append(suffix)
            groups.append(top[1])
    while stack:
        closed = stack.pop()
        maximal[closed[1]] = closed[3]
        if stack:
            top = stack[-1]
            parents[closed[1]] = top[1]
            top[3] = top[3] or closed[3] or top[2] != closed[2]
    return Repeats(
        np.array(lengths, dtype=np.int64), np.array(parents, dtype=np.int64),
        np.array(maximal, dtype=bool), np.array(starts, dtype=np.int64), np.array(groups, dtype=np.int64),
    )


def repeats_of(contents: list[bytes], least: int) -> tuple[np.ndarray, Repeats]:
    """(begin of each content in the joined text, maximal repeats of all contents)."""
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(contents), dtype=np.uint8)
    ends = np.repeat(begin + sizes, sizes)
    first = np.zeros(len(text), dtype=bool)
    first[begin[sizes > 0]] = True
    order, ranks = suffix_array(text, ends)
    common = common_prefixes(text, order, ranks, ends, least)
    return begin, interval_tree(text, first, order, common, least)


def covered(repeats: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of occurrences whose deepest group is a maximal repeat.

    They cover all: if a group's occurrences are all preceded by the same byte, the strings
    one byte to the left and one longer are a group too.
    """
    keep = repeats.maximal[repeats.group]
    return repeats.start[keep], repeats.length[repeats.group[keep]]


def grouped_spans(contents: DataFrame, least: int) -> DataFrame:
    """(CLASS columns, spans) from suffix arrays over the runs of whole anchors."""
    schema = "anchor long, before int, windows int, one long, two long, spans array<struct<a:int,b:int>>"
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    names = [c.split()[0] for c in schema.split(", ")]

    def solve(rows: list[dict]) -> pa.RecordBatch:
        begin, repeats = repeats_of([r["content"] for r in rows], least)
        starts, lengths = covered(repeats)
        owner = np.searchsorted(begin, starts, side="right") - 1
        spans: list[list] = [[] for _ in rows]
        for at, row, length in zip((starts - begin[owner]).tolist(), owner.tolist(), lengths.tolist()):
            spans[row].append((at, at + length))
        kept = [(r, merged(s)) for r, s in zip(rows, spans) if s]
        kinds = {"before": pa.int32(), "windows": pa.int32()}
        columns = [pa.array([r[c] for r, _ in kept], kinds.get(c, pa.int64())) for c in CLASS]
        found = pa.array([[{"a": a, "b": b} for a, b in s] for _, s in kept], spans_type)
        return pa.RecordBatch.from_arrays(
            [*(columns[CLASS.index(c)] for c in names[:-1]), found], names
        )

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, used, seen = [], 0, set()
        for batch in batches:
            for row in batch.to_pylist():
                if rows and used > BUFFER and row["anchor"] != rows[-1]["anchor"]:
                    yield solve(rows)
                    rows, used, seen = [], 0, set()
                key = tuple(row[c] for c in CLASS)
                if key not in seen:  # once, also for rows repeated in the input
                    seen.add(key)
                    rows.append(row)
                    used += len(row["content"])
        if rows:
            yield solve(rows)

    return contents.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(apply, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def drop_repeated_bytes(text: bytes, spans: list[dict]) -> dict:
    gone = mask_of(len(text), spans)
    body = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
    return {
        "n_bytes": len(text),
        "n_removed": int(gone.sum()),
        "n_spans": int((edges == 1).sum()),
        "kept_sha256": sha256(body),
        "kept": body,
    }


def suffix_dedup(
    docs: DataFrame,
    least: int = LEAST,
    gram: int = GRAM,
    group: int = GROUP,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    A byte of the text in UTF-8 goes when a string of ``least`` bytes over it also starts
    anywhere else, in the same document (overlaps count) or another. Strings are judged on
    the input and never cross documents. Missing texts are empty; shorter texts keep all;
    rows repeated in the table are copies of each other. ``group`` is the number of distinct
    runs of an anchor that one suffix array takes. Further columns are not looked at.
    """
    spec = Spec(False, least, min(gram, least))
    texts = start(docs, id_column, text_column)
    runs = repeated_runs(texts, spec)
    classes = run_classes(runs)
    # read by two branches: texts are scanned and shuffled for it once
    contents = stored(class_contents(texts, classes.where("kinds > 1"), spec), "contents")
    small = grouped_spans(contents.where(F.col("kinds") <= group), least)
    large = counted_windows(contents.where(F.col("kinds") > group), spec)
    single = classes.where("kinds > 1 AND members = 1").select(*CLASS)
    found = small.select(*CLASS, "spans").unionByName(large.select(*CLASS, "spans"))
    spans = whole_spans(classes, spec).unionByName(found.join(single, CLASS, "left_semi"))
    return cut(
        texts,
        text_spans(runs, spans),
        id_column,
        drop_repeated_bytes,
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
