"""Windows of a text that occur again, without a row for every window.

A text is a sequence of units (bytes, or words as 64-bit hashes). Every window of L units
has an anchor: the leftmost of its grams of k units with the smallest hash. Equal windows
have equal anchors at equal places, and a run of neighbouring windows shares one anchor,
so one row per run (an *anchored run*, about 2 / (L - k + 2) rows per unit) stands for all
its windows: two equal windows always lie in two runs whose anchor grams are equal.

Runs with equal content are one class; a class with several members is repeated as a
whole. Only where an anchor has several classes must single windows be compared, and only
one member of each class takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashift.llm.sketch import flagged, key_flags, merged_sketch, mixed, repeated_flags
from areashift.llm.storage import Kept, free_name, prepared, stored

#: Units handled at once: a longer text goes in pieces that overlap by a window.
PIECE = 1 << 18
BASES = (0x9E3779B97F4A7C55, 0xD1342543DE82EF95)
#: White space that parts words: blank and \t\n\v\f\r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Spec:
    """What a window is: ``words`` or bytes, units in a window and in a gram."""

    words: bool
    length: int
    gram: int


POWERS = Kept()


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse for i below n, modulo 2^64."""
    if (base, n) not in POWERS:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(n, b, dtype=np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        if len(POWERS) > 4:  # sizes of single long texts
            POWERS.clear()
        POWERS[base, n] = both[0], both[1]
    return POWERS[base, n]


class Hashes:
    """Hashes of any stretch of a sequence of units, by prefix sums of a polynomial."""

    def __init__(self, units: np.ndarray, base: int) -> None:
        size = 1 << max(19, int(len(units)).bit_length())  # one table serves most
        self.up, self.down = powers(base, size)
        self.sums = np.zeros(len(units) + 1, dtype=np.uint64)
        np.cumsum(units * self.up[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def grams(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def word_units(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, stop in bytes) of every word."""
    raw = np.frombuffer(data, dtype=np.uint8)
    solid = np.zeros(len(raw) + 2, dtype=np.int8)
    solid[1:-1] = ~SPACE[raw]
    edges = np.diff(solid)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = np.empty(len(starts), dtype=np.uint64)
    # a long text is hashed piece by piece; a word longer than a piece by itself
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + PIECE, side="right")))
        base = int(starts[at])
        units = raw[base : int(stops[to - 1])].astype(np.uint64) + np.uint64(1)
        hashes[at:to] = Hashes(units, BASES[0]).of(starts[at:to] - base, stops[at:to] - base)
        at = to
    return hashes, starts, stops


def pieces(lengths: list[int], window: int, limit: int = PIECE) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to): at most ``limit`` units each, texts in order, a long one
    in parts that overlap by a window less one unit; texts shorter than a window left out."""
    out, used = [], 0
    for text, length in enumerate(lengths):
        start = 0
        while length - start >= window:
            room = limit - used
            if out and room < min(length - start, window + (limit >> 3)):
                yield out
                out, used = [], 0
                continue
            stop = min(length, start + max(room, 2 * window))
            out.append((text, start, stop))
            used += stop - start
            if stop == length:
                break
            start = stop - window + 1
            yield out
            out, used = [], 0
    if out:
        yield out


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` grams the place of its smallest, the leftmost of equals.

    Hashes keep their upper 40 bits and carry their place in the lower 24, so one running
    minimum gives both.
    """
    n = len(grams)
    low = np.uint64((1 << 24) - 1)
    padded = -(-n // width) * width
    keys = np.full(padded, np.uint64(2**64 - 1), dtype=np.uint64)
    keys[:n] = (grams & ~low) | np.arange(n, dtype=np.uint64)
    table = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & low).astype(np.int64)


@dataclass
class Runs:
    """Anchored runs of a piece: text, first window, windows, place of the first window
    before the anchor, anchor hash, and two hashes of the whole stretch."""

    text: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    before: np.ndarray
    anchor: np.ndarray
    one: np.ndarray
    two: np.ndarray


def runs_of(units: list[np.ndarray], spec: Spec, whole: bool = True) -> Iterator[Runs]:
    """Anchored runs of the texts of a batch, each given as its units."""
    length = spec.length
    for part in pieces([len(u) for u in units], length):
        joined = np.concatenate([units[t][a:b] for t, a, b in part]).astype(np.uint64)
        sizes = np.array([b - a for _, a, b in part])
        ends = np.cumsum(sizes)
        hashes = Hashes(joined + np.uint64(1), BASES[0])
        grams = hashes.grams(spec.gram)
        at = anchors(grams, length - spec.gram + 1)
        stop = np.repeat(ends, sizes)[: len(at)]
        place = np.arange(len(at))
        valid = place + length <= stop
        new = valid.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new)
        last_of = valid.copy()
        last_of[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
        last = np.flatnonzero(last_of)
        owner = np.searchsorted(ends, first, side="right")
        anchor = at[first]
        texts = np.array([t for t, _, _ in part])
        shift = np.array([a for _, a, _ in part]) - (ends - sizes)
        second = Hashes(joined + np.uint64(1), BASES[1]) if whole else hashes
        yield Runs(
            texts[owner],
            first + shift[owner],
            last - first + 1,
            anchor - first,
            grams[anchor],
            hashes.of(first, last + length),
            second.of(first, last + length),
        )


def units_of(data: bytes, spec: Spec) -> np.ndarray:
    return word_units(data)[0] if spec.words else np.frombuffer(data, dtype=np.uint8)


def keyed_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, digest, text as bytes); id and digest tell texts apart even where ids are
    missing or repeat."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(text).alias("digest"),
        text.cast("binary").alias("text"),
    )


RUNS = "id long, digest long, first int, windows int, before int, anchor long, one long, two long"
CLASS = ["anchor", "before", "windows", "one", "two"]


def repeated_runs(texts: DataFrame, spec: Spec) -> DataFrame:
    """Anchored runs whose anchor the sketch estimates to occur more than once.

    The estimate of an anchor is never below the count of any window it stands for, so no
    repeated window is lost.
    """
    spark = texts.sparkSession

    def keys_of(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for runs in runs_of([units_of(t, spec) for t in batch.column(0).to_pylist()], spec, False):
                yield runs.anchor

    sketch = merged_sketch(texts.select("text"), keys_of, repeated_flags)
    shared = spark.sparkContext.broadcast(sketch)
    names = [c.split()[0] for c in RUNS.split(", ")]

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        for batch in batches:
            ids, digests, data = batch.columns
            units = [units_of(t, spec) for t in data.to_pylist()]
            for runs in runs_of(units, spec):
                keep = np.flatnonzero(flagged(flags, runs.anchor))
                if not len(keep):
                    continue
                owner = pa.array(runs.text[keep])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(owner),
                        digests.take(owner),
                        *(pa.array(x[keep].astype(np.int32)) for x in (runs.first, runs.windows, runs.before)),
                        *(pa.array(x[keep].view(np.int64)) for x in (runs.anchor, runs.one, runs.two)),
                    ],
                    names,
                )

    return stored(texts.mapInArrow(candidates, RUNS), "runs")


def run_classes(runs: DataFrame) -> DataFrame:
    """Classes of equal runs under anchors that occur more than once: members, the least
    member (id, digest, first), and the number of classes of the anchor."""
    classes = runs.groupBy(*CLASS).agg(
        F.count(F.lit(1)).alias("members"), F.min(F.struct("id", "digest", "first")).alias("least")
    )
    classes = stored(classes, "classes")
    kinds = classes.groupBy(F.col("anchor").alias("__anchor")).agg(F.count(F.lit(1)).alias("kinds"))
    # null-safe, so that either side has an exchange of its own and a hot anchor can be split
    on = F.col("anchor").eqNullSafe(F.col("__anchor"))
    return classes.join(kinds.where("kinds > 1"), on, "left").drop("__anchor")


def texts_of(
    texts: DataFrame, keys: DataFrame, column: str = "digest"
) -> tuple[DataFrame, DataFrame]:
    """(some, others): texts whose ``column`` the column ``digest`` of ``keys`` may name, and
    texts that it does not.

    Only the former need be shuffled to meet what is known of them.
    """
    shared = texts.sparkSession.sparkContext.broadcast(key_flags(keys, "digest"))
    names = [c for c, _ in texts.dtypes]

    def part(named: bool) -> DataFrame:
        def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = names.index(column)
            for batch in batches:
                found = flagged(shared.value, batch.column(at).to_numpy().view(np.uint64))
                if (found if named else ~found).any():
                    yield batch.filter(pa.array(found if named else ~found))

        return texts.mapInArrow(select, texts.schema)

    return part(True), part(False)


def marked_rows(rows: DataFrame, digest: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that the column ``digest`` of ``keys`` may name, and the others, by a digest worked
    out from each; all their columns, whatever those are called."""
    name = free_name(rows, "digest")
    some, others = texts_of(rows.withColumn(name, digest), keys, name)
    return some.drop(name), others.drop(name)


def class_contents(texts: DataFrame, classes: DataFrame, spec: Spec) -> DataFrame:
    """The content of one member of each class: the CLASS columns, kinds, members and
    ``content``, the bytes of the run (for words, their 64-bit hashes in order)."""
    wanted = classes.groupBy("least.id", "least.digest").agg(
        F.collect_list(F.struct(F.col("least.first").alias("first"), *CLASS, "kinds", "members")).alias("wanted")
    )
    wanted = wanted.withColumnsRenamed({"id": "__id", "digest": "__digest"})
    on = F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    some, _ = texts_of(texts, stored(wanted.select(F.col("__digest").alias("digest")), "wanted"))
    one = some.join(wanted, on).select("id", "digest", "text", "wanted")
    # rows that are repeated in the input give each class more than once: the same content
    names = [*CLASS, "kinds", "members", "content"]
    schema = (
        "anchor long, before int, windows int, one long, two long, kinds long, members long, content binary"
    )

    def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                units = units_of(text, spec)
                for start in range(0, len(wanted), 500):
                    part = wanted[start : start + 500]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array([w[c] for w in part]) .cast(pa.int32() if c in ("before", "windows") else pa.int64()) for c in names[:-1]),
                            pa.array(
                                [units[w["first"] : w["first"] + w["windows"] + spec.length - 1].tobytes() for w in part],
                                pa.binary(),
                            ),
                        ],
                        names,
                    )

    return one.mapInArrow(contents, schema)


def counted_windows(contents: DataFrame, spec: Spec) -> DataFrame:
    """Exact groups of single windows: (CLASS columns, spans) of the windows that another
    class holds too.

    A window is told by its anchor, its place before it, and two hashes. Counting them is
    an aggregate combined on the map side, so no group is ever gathered.
    """
    schema = "before int, windows int, anchor long, one long, two long, at int, w1 long, w2 long"
    names = [c.split()[0] for c in schema.split(", ")]
    kind = np.uint64 if spec.words else np.uint8

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows = batch.slice(low, 500)
                units = [np.frombuffer(c, dtype=kind) for c in rows.column("content").to_pylist()]
                n = rows.column("windows").to_numpy()
                begin = np.cumsum([0, *map(len, units[:-1])])
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = begin[row] + at
                joined = np.concatenate(units).astype(np.uint64) + np.uint64(1)
                both = [Hashes(joined, b).of(first, first + spec.length).view(np.int64) for b in BASES]
                owner = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c).take(owner) for c in names[:5]),
                        pa.array(at.astype(np.int32)),
                        *map(pa.array, both),
                    ],
                    names,
                )

    key = ["anchor", "place", "w1", "w2"]
    rows = contents.mapInArrow(windows, schema)
    rows = stored(rows.withColumn("place", F.col("before") - F.col("at")), "windows")
    # a class that came twice, for a row repeated in the input, is one holder all the same
    holder = F.struct("before", "windows", "one", "two")
    again = rows.groupBy(*key).agg(F.min(holder).alias("least"), F.max(holder).alias("most"))
    found = rows.join(again.where("least <> most").select(*key), key, "left_semi")
    spans = F.transform(
        F.array_sort(F.collect_set("at")), lambda a: F.struct(a.alias("a"), (a + spec.length).alias("b"))
    )
    return found.groupBy(*CLASS).agg(spans.alias("spans"))


def whole_spans(classes: DataFrame, spec: Spec) -> DataFrame:
    """(CLASS columns, spans) of the classes with several members: repeated as a whole."""
    whole = F.struct(F.lit(0).alias("a"), (F.col("windows") + spec.length - 1).alias("b"))
    return classes.where("members > 1").select(*CLASS, F.array(whole).alias("spans"))


def text_spans(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans of classes handed to all their members: (id, digest, spans) per text, in units
    of the text, overlapping and in any order. Rows that repeat with id and text have equal
    spans, which are gathered once."""
    class_key = [F.col(c).alias(f"__{c}") for c in CLASS]
    spans = spans.select(*class_key, "spans")
    on = [F.col(c) == F.col(f"__{c}") for c in CLASS]
    placed = runs.join(spans, on).select(
        "id",
        "digest",
        F.transform(
            "spans",
            lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b")),
        ).alias("spans"),
    )
    return placed.groupBy("id", "digest").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def mask_of(n: int, spans: list[dict]) -> np.ndarray:
    """Which of n units some span covers."""
    steps = np.zeros(n + 1, dtype=np.int64)
    for span in spans:
        steps[span["a"]] += 1
        steps[span["b"]] -= 1
    return np.cumsum(steps[:-1]) > 0


def cut(
    texts: DataFrame,
    spans: DataFrame,
    id_column: str,
    cutter: Callable[[bytes, list[dict]], dict],
    schema: str,
) -> DataFrame:
    """Every text with ``cutter(text, spans)`` applied; schema is that of its dictionary."""
    spans = stored(spans, "spans")
    some, others = texts_of(texts, spans)
    spans = spans.withColumnsRenamed({"id": "__id", "digest": "__digest"})
    on = F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    joined = some.join(spans, on, "left").select("id", "text", "spans")
    alone = others.select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    names = [c.split()[0] for c in schema.split(", ")]

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data, spans = batch.columns
            out = [cutter(t, s or []) for t, s in zip(data.to_pylist(), spans.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array([r[n] for r in out]) for n in names)], [id_column, *names]
            )

    return joined.unionAll(alone).mapInArrow(apply, f"`{id_column}` long, {schema}")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def start(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    prepared(docs.sparkSession)
    return keyed_texts(docs, id_column, text_column)
