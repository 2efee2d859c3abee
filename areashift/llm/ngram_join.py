"""Near duplicates by an exact Jaccard join of word n-gram sets.

Sets are compared, not documents: documents with the same set are one *node*. The n-grams
of a set stand in one global order, rare ones first (by a count-min sketch, then by hash;
any order gives the same links). Two sets that link share an n-gram of their prefixes.

1. *Stars*: in the group of nodes under each prefix n-gram, nodes are checked against one
   pivot and joined with it where they link. A few rounds with other pivots settle dense
   groups with a number of checks that grows with their size only.
2. *Nearest*: in a few more rounds each node is checked against those that a prefix tree
   finds for it under other labels, or where these are many the one that it shares most with,
   as the edges of a spanning forest are found. Dense groups that stars left in pieces become
   one. Groups in which no candidate was left out are joined in full, and done.
3. *Prefix trees*: n-gram groups that still hold nodes not known to be connected are
   joined in full. The ordered prefixes of a group are stored in a tree, every node
   traverses it sharing partial overlaps, and subtrees are pruned when the n-grams left
   cannot reach the overlap needed. Large groups are dealt out in blocks: where most nodes
   are connected already, the others meet each block of those; else any two blocks meet.
   What remains is checked on the whole sets.
4. Links, all of them exact, give the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashift.llm.graph import components
from areashift.llm.sketch import cells, fingerprints, flagged, merged_sketch, several_flags
from areashift.llm.storage import free_name, free_unread, prepared, stored
from areashift.llm.windows import BASES, Hashes, keyed_texts, marked_rows, texts_of, word_units
from areashift.session import scratch_made

#: Rounds of stars before the full join; nodes of a group in one block of it.
ROUNDS = 3
BLOCK = 1500
#: Of the pairs checked in a round of stars one in so many must link for another round; up to
#: so many candidates of a node in a group are all checked in a round of nearest ones.
YIELD = 20
FEW = 16
#: Bits of the map of a set by which pairs are ruled out before whole sets are compared.
BITS = 4096
#: N-grams on an edge of a prefix tree: few at the top, where most traversals end.
STRIDES = (4, 16)
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
FOLD = bytes.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``num / den`` over n-grams of ``n`` words."""

    n: int = 4
    num: int = 85
    den: int = 100

    def least_overlap(self, a, b):
        """The smallest overlap at which sets of sizes a and b link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def kept(self, a):
        """The smallest overlap that a set of size a has with any set it links with."""
        return -(-self.num * a // self.den)

    def prefix(self, a):
        """N-grams of the prefix: sets that link share one of them."""
        return a - self.kept(a) + 1

    def sizes_fit(self, a, b):
        """Whether sets of sizes a and b can link at all."""
        return (self.kept(a) <= b) & (self.kept(b) <= a)

    def prefix_overlap(self, a, b, most=None):
        """The n-grams that the prefixes of linking sets of sizes a and b share at least.

        All common n-grams up to the end of the prefix that ends first lie in both prefixes;
        behind it that set has ``kept - 1`` n-grams, which grows with its size, ``most`` at
        most.
        """
        most = np.maximum(a, b) if most is None else most
        return np.maximum(1, self.least_overlap(a, b) - self.kept(most) + 1)


def ngrams(text: bytes, n: int) -> np.ndarray:
    """The distinct word n-grams of a text as sorted hashes, A-Z lower-cased; the whole
    sequence as one if it is shorter; none without words."""
    words = word_units(text.translate(FOLD))[0]
    if not len(words):
        return words
    return np.unique(Hashes(words | np.uint64(1), BASES[1]).grams(min(n, len(words))))


def node_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def nodes_of(texts: DataFrame, how: Similarity) -> tuple[DataFrame, DataFrame]:
    """(members, nodes): (id, digest, n, key) of every document, and of every distinct set
    that is not empty its key, number (node), n, the row of the smallest id (least), the text
    that has it, and the n-grams of its prefix that may occur elsewhere, in order."""

    def keys_of(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            sets = [ngrams(t, how.n) for t in batch.column(0).to_pylist()]
            yield np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)

    counts = merged_sketch(texts.select("text"), keys_of, lambda counts: counts, depth=1)
    shared = texts.sparkSession.sparkContext.broadcast(counts[0])

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            sizes, nodes, prefixes = [], [], []
            for text in batch.column(2).to_pylist():
                grams = ngrams(text, how.n)
                sizes.append(len(grams))
                nodes.append(node_of(grams))
                seen = counts[cells(grams, 0)]
                order = np.lexsort((grams, seen))[: how.prefix(len(grams))] if len(grams) else []
                prefixes.append([int(x) for x in grams[order][seen[order] > 1].view(np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(sizes, pa.int32()),
                    pa.array(nodes, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())),
                ],
                ["id", "digest", "n", "key", "prefix"],
            )

    rows = stored(
        texts.mapInArrow(described, "id long, digest long, n int, key binary, prefix array<long>"), "sets"
    )
    one, several = sets_of_several(rows.where("n > 0"))
    place = F.struct(F.col("id").isNull().alias("missing"), "id", "digest")
    met = several.groupBy("key").agg(F.min(place).alias("least"), F.min(F.struct("id", "digest", "n", "prefix")).alias("own"))
    nodes = met.select("key", "least", "own.*").unionByName(one.select("key", place.alias("least"), "id", "digest", "n", "prefix"))
    nodes = nodes.withColumnRenamed("id", "own_id").withColumn("node", F.monotonically_increasing_id())
    return stored(rows.select("id", "digest", "n", "key"), "members"), stored(nodes, "nodes")


def sets_of_several(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key no other row has, and the others with a few that a filter takes for
    such: only those need be shuffled to find the rows of a set."""

    def numbers(keys: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(keys.to_pylist()), dtype=np.uint64)[::2]

    def keys_of(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield numbers(batch.column(0))

    shared = rows.sparkSession.sparkContext.broadcast(several_flags(rows.select("key"), keys_of))
    at = rows.columns.index("key")

    def part(several: bool) -> DataFrame:
        def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = flagged(shared.value, fingerprints(numbers(batch.column(at))))
                yield batch.filter(pa.array(found if several else ~found))

        return rows.mapInArrow(select, rows.schema)

    return part(False), part(True)


def shared_grams(nodes: DataFrame) -> DataFrame:
    """(node, n, grams): of every node the n-grams of its prefix that are in several by their
    fingerprints, in order; nodes without any are left out."""

    def keys_of(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield batch.column(0).flatten().to_numpy().view(np.uint64)

    flags = several_flags(nodes.select("prefix"), keys_of)
    shared = nodes.sparkSession.sparkContext.broadcast(flags)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            grams = lists.flatten().to_numpy()
            found = flagged(shared.value, fingerprints(grams.view(np.uint64)))
            row = lists.value_parent_indices().to_numpy()[found]
            size = np.bincount(row, minlength=batch.num_rows)
            offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            kept = pa.ListArray.from_arrays(offsets, pa.array(grams[found]))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], ["node", "n", "grams"])
            yield out.filter(pa.array(size > 0))

    columns = nodes.select("node", "n", "prefix")
    return stored(columns.mapInArrow(keep, "node long, n int, grams array<long>"), "prefixes")


def contents_of(texts: DataFrame, nodes: DataFrame, how: Similarity) -> DataFrame:
    """(node, grams, bits): the whole sets of the given nodes, as sorted 64-bit hashes and as
    bitmaps of ``BITS`` bits, once also where the row of a node is repeated in the table."""
    wanted = nodes.select(F.col("own_id").alias("__id"), F.col("digest").alias("__digest"), "node")
    on = F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(t, how.n) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x.tobytes() for x in found], pa.binary()),
                    pa.array([bitmap(x).tobytes() for x in found], pa.binary()),
                ],
                ["node", "grams", "bits"],
            )

    some, _ = texts_of(texts, wanted.select(F.col("__digest").alias("digest")))
    found = some.join(wanted, on).select("node", "text").mapInArrow(
        sets, "node long, grams binary, bits binary"
    )
    grams = stored(found, "grams")
    again = grams.groupBy(F.col("node").alias("__node")).agg(F.count(F.lit(1)).alias("rows"))
    again = stored(again.where("rows > 1").select("__node"), "again")
    if again.isEmpty():
        return grams
    on = F.col("node") == F.col("__node")
    one = grams.join(again, on, "left_semi").dropDuplicates(["node"])
    return stored(grams.join(again, on, "left_anti").unionByName(one), "grams")


def bitmap(grams: np.ndarray) -> np.ndarray:
    """A bit for every n-gram, several of which may share one."""
    bits = np.zeros(BITS, dtype=bool)
    bits[(grams >> np.uint64(40)) % np.uint64(BITS)] = True
    return np.packbits(bits).view(np.uint64)


def may_overlap(bits: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, how: Similarity) -> np.ndarray:
    """Whether sets may overlap enough: a bit that only one of them has is an n-gram of it at
    least that the other lacks."""
    need = how.least_overlap(size, sizes)
    ours = np.bitwise_count(bits & ~others).sum(axis=1)
    theirs = np.bitwise_count(others & ~bits).sum(axis=1)
    return (size - ours.astype(np.int64) >= need) & (sizes - theirs.astype(np.int64) >= need)


def linked(pairs: DataFrame, grams: DataFrame, how: Similarity) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough. Only sets that a filter of fixed
    size takes for one of a pair are shuffled."""
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("u").alias("digest")).unionByName(pairs.select(F.col("v").alias("digest")))
    grams, _ = texts_of(grams.select("node", "grams"), ends, "node")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                need = how.least_overlap(len(x), len(y))
                enough = min(len(x), len(y)) >= need
                keep.append(enough and len(np.intersect1d(x, y, assume_unique=True)) >= need)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = grams.select(F.col("node").alias("u1"), F.col("grams").alias("a"))
    two = grams.select(F.col("node").alias("v1"), F.col("grams").alias("b"))
    both = pairs.join(one, F.col("u") == F.col("u1")).join(two, F.col("v") == F.col("v1"))
    return stored(both.select("u", "v", "a", "b").mapInArrow(check, "u long, v long"), "links")


def opened(postings: DataFrame, round_: int) -> DataFrame:
    """The postings (gram, node, n, rest, label) under n-grams that hold several labels,
    with the number of nodes (size) and a pivot with its label.

    The pivot of an n-gram is its least node by a hash that differs by round. What comes
    of a group is combined on the map side, whatever its size; null-safe keys give either
    side of the join an exchange of its own, so that a hot n-gram can be split.
    """
    place = F.xxhash64(F.lit(round_), "node")
    groups = postings.groupBy(F.col("gram").alias("__gram")).agg(
        F.min("label").alias("__least"), F.max("label").alias("__most"), F.count(F.lit(1)).alias("size"),
        F.min(F.struct(place.alias("place"), "node", "label")).alias("first"),
    )
    groups = groups.where("__least <> __most").select(
        "__gram", "size", F.col("first.node").alias("pivot"), F.col("first.label").alias("pivot_label")
    )
    rows = postings.select("gram", "node", "n", "rest", "label")
    joined = rows.join(groups, F.col("gram").eqNullSafe(F.col("__gram"))).drop("__gram")
    return stored(joined, "postings")


def star_pairs(postings: DataFrame) -> DataFrame:
    """Each node with the pivot, under another label, that it shares most n-grams with."""
    near = postings.where("label <> pivot_label")
    counted = near.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("shared"))
    best = counted.groupBy("node").agg(F.max(F.struct("shared", "pivot")).alias("best"))
    return best.select(F.col("node").alias("u"), F.col("best.pivot").alias("v"))


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links were found: every label hangs on the smallest one it is linked
    with, and takes over the label of that. Equal labels are connected; connected nodes may
    keep several, which the components of all links settle in the end."""
    to = labels.withColumnsRenamed({"node": "v", "label": "lv"})
    edges = links.join(labels.withColumnsRenamed({"node": "u", "label": "lu"}), "u").join(to, "v")
    both = edges.select("lu", "lv").unionByName(edges.select(F.col("lv").alias("lu"), F.col("lu").alias("lv")))
    hung = both.groupBy("lu").agg(F.least(F.min("lv"), F.col("lu")).alias("up"))
    hung = stored(hung, "hung")
    once = labels.join(hung, F.col("label") == F.col("lu"), "left")
    once = once.select("node", F.coalesce("up", "label").alias("label"))
    twice = once.join(hung, F.col("label") == F.col("lu"), "left")
    return stored(twice.select("node", F.coalesce("up", "label").alias("label")), "labels")


def with_labels(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings under new labels."""
    new = labels.withColumnsRenamed({"node": "__node", "label": "__label"})
    joined = postings.select("gram", "node", "n", "rest").join(new, F.col("node") == F.col("__node"))
    return joined.select("gram", "node", "n", "rest", F.col("__label").alias("label"))


class PrefixTree:
    """Ordered prefixes of a group of nodes as a tree whose edges hold several n-grams.

    Of every level: parent in the level above, n-grams of the edge (as numbers local to the
    group, -1 beyond an end), n-grams that the subtree has left behind it at most, smallest
    and largest set in the subtree, and which prefixes end there.
    """

    def __init__(self, prefixes: list[np.ndarray], sizes: np.ndarray) -> None:
        self.sizes = sizes
        lengths = np.array([len(p) for p in prefixes])
        longest = int(lengths.max(initial=0))
        table = np.full((len(prefixes), longest + max(STRIDES)), -1, dtype=np.int64)
        for i, p in enumerate(prefixes):
            table[i, : len(p)] = p
        self.levels = []
        above = np.zeros(len(prefixes), dtype=np.int64)  # tree node of each prefix, one level up
        depth, stride = 0, STRIDES[0]
        while depth < longest:
            rows = np.flatnonzero(lengths > depth)
            edges = np.column_stack([above[rows], table[rows, depth : depth + stride]])
            # equal edges of one parent are one node
            order = np.lexsort(edges.T[::-1])
            new = np.append(True, (edges[order[1:]] != edges[order[:-1]]).any(axis=1))
            at = np.empty(len(rows), dtype=np.int64)
            at[order] = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            found = edges[order[first]]
            left = np.maximum.reduceat(np.maximum(0, lengths[rows] - depth - stride)[order], first)
            low = np.minimum.reduceat(sizes[rows][order], first)
            high = np.maximum.reduceat(sizes[rows][order], first)
            ends = lengths[rows] <= depth + stride
            self.levels.append((found[:, 0], found[:, 1:], left, low, high, rows[ends], at[ends]))
            above = np.zeros(len(prefixes), dtype=np.int64)
            above[rows] = at
            depth, stride = depth + stride, STRIDES[1]

    def traverse(self, prefix: np.ndarray, size: int, first: int, vocabulary: int, how: Similarity) -> np.ndarray:
        """Members whose prefix shares enough n-grams with this one and ``first`` before any
        other. Overlaps are carried down from the parent; a subtree is left when the
        n-grams that remain in it cannot make up for what is missing."""
        holds = np.zeros(vocabulary + 1, dtype=bool)  # the last stands for -1
        holds[prefix] = True
        out = []
        overlap, alive = np.zeros(1, dtype=np.int64), np.ones(1, dtype=bool)
        for parent, grams, left, low, high, ended, at in self.levels:
            here = np.flatnonzero(alive[parent])
            if not len(here):
                break
            hits = holds[grams[here]]
            shared = overlap[parent[here]]
            now = shared + hits.sum(axis=1)
            need = how.prefix_overlap(size, low[here], np.maximum(size, high[here]))
            going = now + np.minimum(left[here], len(prefix) - now) >= need
            begins = np.flatnonzero(going & (shared == 0) & (now > 0))
            going[begins] = grams[here[begins], hits[begins].argmax(axis=1)] == first
            alive, overlap = np.zeros(len(parent), dtype=bool), np.zeros(len(parent), dtype=np.int64)
            alive[here], overlap[here] = going, now
            done = np.flatnonzero(alive[at])
            if len(done):
                sizes = self.sizes[ended[done]]
                enough = overlap[at[done]] >= how.prefix_overlap(size, sizes)
                out.append(ended[done[enough & how.sizes_fit(size, sizes)]])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def least_needed(n: np.ndarray, most: np.ndarray, several: np.ndarray, how: Similarity) -> np.ndarray:
    """For sets of each size in a group the n-grams that they must be able to share there to
    link with any other of it; beyond all that can be shared where no size fits. ``most`` is
    what a set of each size can share at most, ``several`` whether there are sets of that
    size under several labels."""
    out = np.full(len(n), np.iinfo(np.int64).max)
    for at in range(0, len(n), 256):
        x = np.arange(at, min(at + 256, len(n)))
        a, b = n[x, None], n[None, :]
        need = how.prefix_overlap(a, b)
        may = how.sizes_fit(a, b) & (need <= most[None, :])
        may[np.arange(len(x)), x] &= several[x]
        out[x] = np.where(may, need, out[x, None]).min(axis=1)
    return out


def by_group(rows: DataFrame, solve, schema: str, least: int = 2) -> DataFrame:
    """``solve`` applied to the rows of each (gram, low, high), as tuples, in one task; it
    returns tuples of the schema. Groups of fewer rows than ``least`` are left out."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*found), fields)]
        return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:3] != group[0][:3]:
                    if len(group) >= least:
                        found += solve(group)
                    group = []
                    if len(found) > 10_000:
                        yield batch_of(found)
                        found = []
                group.append(row)
        if len(group) >= max(1, least):
            found += solve(group)
        if found:
            yield batch_of(found)

    near = rows.repartition("gram", "low", "high").sortWithinPartitions("gram", "low", "high")
    return near.mapInArrow(apply, schema)


ROW = ["gram", "low", "high", "node", "n", "label", "own", "most"]


def with_most(postings: DataFrame) -> DataFrame:
    """Postings with ``most``, the n-grams that a pair can share from this one on: those that
    the prefix has left, and those that are under any open group."""
    shared = postings.groupBy(F.col("node").alias("__node")).agg(F.count(F.lit(1)).alias("shared"))
    rows = postings.join(shared, F.col("node") == F.col("__node")).drop("__node")
    return rows.withColumn("most", F.least("shared", "rest"))


def dealt(postings: DataFrame, block: int) -> DataFrame:
    """Postings with ``most`` and the groups (low, high) of their n-gram that they belong to.

    Rows under the label of the pivot need no pairs with each other. Where the others are few
    enough for a block, they go to every part of those (``own`` -1, the part as low and
    high), so the rows dealt grow with the group and not with its square. Else any two
    blocks meet.
    """
    odd = F.col("label") != F.col("pivot_label")
    few = postings.groupBy(F.col("gram").alias("__gram")).agg(F.count_if(odd).alias("odd"))
    rows = with_most(postings).join(few, F.col("gram").eqNullSafe(F.col("__gram"))).drop("__gram")
    parts = F.ceil(F.col("size") / block).cast("int")
    star = F.col("odd") <= block
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    rows = rows.withColumn("own", F.when(star & odd & (parts > 1), F.lit(-1)).otherwise(F.col("part")))
    alone = star & (F.col("own") >= 0)
    met = F.when(alone, F.array("part")).otherwise(F.sequence(F.lit(0), parts - 1))
    rows = rows.withColumn("other", F.explode(met))
    pair = ~star
    return rows.withColumns(
        {
            "low": F.when(pair, F.least("own", "other")).otherwise(F.col("other")),
            "high": F.when(pair, F.greatest("own", "other")).otherwise(F.col("other")),
        }
    )


def feasible_rows(postings: DataFrame, how: Similarity) -> DataFrame:
    """The postings that have a partner under their n-gram with which their node may link.

    That depends on sizes, so the sizes under an n-gram are compared, not its nodes: they are
    counted on the map side, and meet in bands, as sets that link lie in the same band or in
    neighbouring ones.
    """
    rows = with_most(postings)
    sizes = rows.groupBy("gram", "n").agg(
        F.max("most").alias("most"), (F.min("label") != F.max("label")).alias("several")
    )
    # bands a little wider than the ratio of sizes that link, for what logarithms round
    band = F.floor(F.log(F.col("n").cast("double")) / (float(np.log(how.den / how.num)) + 1e-6)).cast("int")
    dealt_sizes = sizes.withColumn("low", F.explode(F.array(band, band - 1))).withColumn("high", F.col("low"))

    def fits(a: tuple, b: tuple) -> int | None:
        """What a set of the size of ``a`` needs to link with one of the size of ``b``."""
        least = -(-how.num * (a[3] + b[3]) // (how.num + how.den))
        kept = -(-how.num * max(a[3], b[3]) // how.den)
        need = max(1, least - kept + 1)
        return need if kept <= min(a[3], b[3]) and need <= b[4] else None

    def solve(group: list[tuple]) -> list[tuple]:
        if len(group) < 4:  # most groups: no arrays for so little
            out = []
            for i, a in enumerate(group):
                needs = [fits(a, b) for j, b in enumerate(group) if i != j or a[5]]
                need = min((x for x in needs if x is not None), default=None)
                if need is not None and need <= a[4]:
                    out.append((a[0], a[3], need))
            return out
        n, most, several = (np.array([r[i] for r in group]) for i in (3, 4, 5))
        need = least_needed(n, most, several, how)
        return [(r[0], r[3], int(x)) for r, x in zip(group, need) if x <= r[4]]

    needs = by_group(
        dealt_sizes.select("gram", "low", "high", "n", "most", "several"), solve, "gram long, n int, need long", 1
    )
    needs = needs.groupBy(F.col("gram").alias("__gram"), F.col("n").alias("__n")).agg(F.min("need").alias("need"))
    # null-safe, so that a hot n-gram has an exchange that can be split
    on = F.col("gram").eqNullSafe(F.col("__gram")) & F.col("n").eqNullSafe(F.col("__n"))
    kept = rows.join(needs, on).where("most >= need")
    return stored(kept.select("gram", "node", "n", "rest", "label"), "feasible")


def tree_pairs(
    postings: DataFrame,
    prefixes: DataFrame,
    grams: DataFrame,
    how: Similarity,
    block: int = BLOCK,
    nearest: bool = False,
) -> DataFrame:
    """Pairs (u, v) of nodes with different labels whose prefixes, and bitmaps, overlap
    enough, each from the group of the first n-gram that they share. With ``nearest`` (u, v,
    shared, gram): the pairs of a node u that has few in a group, shared being -1; else that
    whose bitmaps overlap most, and by how much."""
    lists = prefixes.select(F.col("node").alias("__node"), F.col("grams").alias("prefix"))
    maps = grams.select(F.col("node").alias("__map"), "bits")
    kept = dealt(postings, block).join(lists, F.col("node") == F.col("__node"))
    kept = kept.join(maps, F.col("node") == F.col("__map")).select(*ROW, "prefix", "bits")

    def pairs(group: list[tuple]) -> list[tuple]:
        gram, low, high = group[0][:3]
        known: dict[int, int] = {}
        local = [np.array([known.setdefault(g, len(known)) for g in r[8]], dtype=np.int64) for r in group]
        sizes = np.array([r[4] for r in group])
        labels = np.array([r[5] for r in group])
        bits = np.frombuffer(b"".join(r[9] for r in group), dtype=np.uint64).reshape(len(group), -1)
        odd = np.array([r[6] < 0 for r in group])
        # rows sent to every part probe; with each other in the first part only
        star = bool(odd.any())
        named = np.flatnonzero(odd | True if low == high else np.array([r[6] == high for r in group]))
        if star and low > 0:
            named = np.flatnonzero(~odd)
        if not len(named):
            return []
        probes = range(len(group)) if low == high else np.flatnonzero(np.array([r[6] == low for r in group]))
        if star:
            probes = np.flatnonzero(odd)
        tree = PrefixTree([local[i] for i in named], sizes[named])
        out = []
        for i in probes:
            near = named[tree.traverse(local[i], int(sizes[i]), known[gram], len(known), how)]
            near = near[may_overlap(bits[i], int(sizes[i]), bits[near], sizes[near], how)]
            if nearest:
                near = near[labels[near] != labels[i]]
                if len(near) <= FEW:
                    out += [(group[i][3], group[j][3], -1, gram) for j in near]
                else:
                    shared = np.bitwise_count(bits[i] & bits[near]).sum(axis=1)
                    best = near[shared.argmax()]
                    out.append((group[i][3], group[best][3], int(shared.max()), gram))
                continue
            for j in near:
                twice = low == high and not (star and not odd[j]) and i >= j
                if group[i][5] != group[j][5] and not twice:
                    out.append((group[i][3], group[j][3]))
        return out

    return by_group(kept, pairs, "u long, v long, shared int, gram long" if nearest else "u long, v long")


def nearest_pairs(found: DataFrame) -> DataFrame:
    """Of what ``tree_pairs`` found nearest to each node all pairs once, and of the nodes with
    more candidates than that the best one."""
    few = found.where("shared < 0").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    best = found.where("shared >= 0").groupBy("u").agg(F.max(F.struct("shared", "v")).alias("best"))
    return few.distinct().unionByName(best.select("u", F.col("best.v").alias("v")))


def near_duplicates(
    docs: DataFrame,
    how: Similarity = Similarity(),
    rounds: int = ROUNDS,
    block: int = BLOCK,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when the Jaccard similarity of their n-gram sets is at least that of
    ``how``; ``component_id`` is the smallest id reachable. A missing or empty text has
    no n-grams and links with nothing, not even its like. Rows with equal sets link,
    repeated rows among them; a missing id is never the smallest unless all are missing.
    Further columns are not looked at.
    """
    found = grouped_rows(docs, how, rounds, block, id_column, text_column)
    component = F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_column), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")
    )


def grouped_rows(
    docs: DataFrame, how: Similarity, rounds: int, block: int, id_column: str, text_column: str
) -> DataFrame:
    """(id, digest, n, first) of every document; first is the row (id, digest) of its group
    with the smallest id, missing without n-grams. Groups are told apart by their nodes."""
    prepared(docs.sparkSession)
    before = scratch_made()
    texts = keyed_texts(docs, id_column, text_column)
    members, nodes = nodes_of(texts, how)
    free_unread(before, members, nodes)
    prefixes = shared_grams(nodes)
    nodes = stored(nodes.drop("prefix"), "nodes")
    free_unread(before, members, nodes, prefixes)
    postings = prefixes.select("node", "n", F.size("grams").alias("all"), F.posexplode("grams").alias("at", "gram"))
    rest = (F.col("all") - F.col("at")).cast("long")
    postings = postings.select("gram", "node", "n", rest.alias("rest"), F.col("node").alias("label"))
    postings = opened(feasible_rows(opened(postings, 0), how), 0)
    free_unread(before, members, nodes, prefixes, postings)
    near = nodes.join(postings.select("node").distinct(), "node", "left_semi")
    grams = contents_of(texts, near, how)

    labels = near.select("node", F.col("node").alias("label"))
    found = []
    for round_ in range(1, rounds + 1):
        if postings.isEmpty():
            break
        pairs = stored(star_pairs(postings), "pairs")
        found.append(linked(pairs, grams, how))
        links = found[-1].count()
        if not links:
            break
        labels = relabelled(labels, found[-1])
        postings = opened(with_labels(postings, labels), round_)
        if links * YIELD < pairs.count():
            break
    whole = False
    for round_ in range(rounds + 1, 2 * rounds + 1):
        whole = whole or postings.isEmpty()
        if whole:
            break
        near = stored(tree_pairs(postings, prefixes, grams, how, block, nearest=True), "near")
        cut = near.where("shared >= 0").select(F.col("gram").alias("__gram")).distinct()
        whole = cut.isEmpty()
        found.append(linked(stored(nearest_pairs(near), "pairs"), grams, how))
        if whole:
            break
        # pairs that were left out are under n-grams where a node had too many
        postings = postings.join(cut, F.col("gram").eqNullSafe(F.col("__gram")), "left_semi")
        if found[-1].isEmpty():
            break
        labels = relabelled(labels, found[-1])
        postings = opened(with_labels(postings, labels), round_)
    if not whole:
        found.append(linked(stored(tree_pairs(postings, prefixes, grams, how, block), "pairs"), grams, how))
    links = docs.sparkSession.createDataFrame([], "u long, v long")
    for more in found:
        links = links.unionByName(more)
    links = components(links)
    free_unread(before, members, nodes, links)
    roots = links.withColumnsRenamed({"u": "__node", "root": "__root"})
    named = nodes.select("key", "node", "least")
    named = named.join(roots, F.col("node") == F.col("__node"), "left")
    named = named.withColumn("label", F.coalesce("__root", "node"))
    smallest = named.groupBy(F.col("label").alias("of")).agg(F.min("least").alias("first"))
    of_node = named.join(smallest, F.col("label") == F.col("of")).select(F.col("key").alias("__key"), "first")
    joined = members.join(of_node, F.col("key") == F.col("__key"), "left")
    return joined.select("id", "digest", "n", "first")


def drop_near_copies(docs: DataFrame, how: Similarity, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group, that with the smallest id, all columns.

    Rows are told apart by id and text, as ids may be missing or repeat; of rows with both
    equal one stays. Documents without n-grams all stay.
    """
    before = scratch_made()
    found = grouped_rows(docs, how, ROUNDS, BLOCK, id_column, text_column)
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    marked = found.where("n > 0").groupBy("id", "digest")
    marked = marked.agg(F.max(first).alias("first"), F.count(F.lit(1)).alias("rows"))
    # what is neither left out nor repeated needs no mark, and is not shuffled
    marked = stored(marked.where("NOT first OR rows > 1"), "marked")
    free_unread(before, marked)
    key = F.col(id_column).cast("long")
    digest = F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    some, others = marked_rows(docs, digest, marked)
    own = {n: free_name(docs, f"own_{n}") for n in ("id", "digest")}
    rows = some.withColumns({own["id"]: key, own["digest"]: digest})
    marked = marked.withColumnsRenamed({c: free_name(docs, f"mark_{c}") for c in marked.columns})
    mark_id, mark_digest, is_first, _ = marked.columns
    match = F.col(own["id"]).eqNullSafe(F.col(mark_id)) & (F.col(own["digest"]) == F.col(mark_digest))
    once = rows.join(marked.where(F.col(is_first)), match, "left_semi").dropDuplicates(list(own.values()))
    unmarked = rows.join(marked, match, "left_anti")
    return others.unionByName(once.unionByName(unmarked).drop(*own.values()))
