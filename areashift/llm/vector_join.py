"""Near duplicates of embeddings by an exact pigeonhole join over blocks of coordinates.

For unit vectors, a cosine of t or more is a squared distance of 2 - 2t or less. A rotation
keeps distances, so rotated vectors may be split into blocks of coordinates, each with a
share of that budget in proportion to its share of the variance: two vectors that keep
within the whole budget keep within the share of one block at least. Pairs within the share
of some block are candidates, and only those are compared in full, in double precision. No
pair is missed, and none is linked that is not verified.

How it is spread:

- Equal vectors become one node with a count, so copies are never paired.
- The rotation puts most variance first. Nodes are cut into strips along that first
  coordinate, at quantiles of a bounded sample, and a strip with more than a tile's worth
  into pieces by hash. Pieces whose ranges lie within the whole distance of each other meet
  in one task each, so a task holds two pieces at most, whatever is dense or repeats.
- Within a task vectors lie in chunks with a box around each block of coordinates. Two
  chunks range-join in those blocks only whose boxes are near enough.
- A task returns a count for each linked node and a forest of its links, never pairs.

Vectors spread evenly over all directions leave boxes and strips little to prune: every
piece meets every other, and a node is sent once for each of them.

Cases: a vector that is missing, empty, zero, or holds a missing or non-finite component
links with nothing and is its own component, also beside an equal one. Vectors of different
lengths never link. Rows with equal vectors are linked with each other, also under one id;
rows with a missing id count as vectors, but a component is named by the smallest id there
is, and by none where all are missing. ``kept`` compares id and component null-safe. Only id
and vector are read of the table, so other columns may have any name. An empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashift.llm.graph import components
from areashift.llm.storage import prepared, sent, stored

#: Vectors compared at once within a tile.
CHUNK = 512
#: Added to budgets of blocks, whose distances are in single precision.
SLACK = 2e-5
#: Rotations are fitted for so many lengths, the most frequent, up to so many coordinates;
#: others keep their coordinates, which is a rotation as well.
LENGTHS, WIDEST = 8, 1024


@dataclass(frozen=True)
class Cosine:
    """Link from ``threshold`` on; ``block`` coordinates in a block, ``piece`` vectors on a
    side of a tile, fewer where they are long, and ``sample`` vectors to fit a rotation."""

    threshold: float = 0.9
    block: int = 16
    piece: int = 8192
    sample: int = 20_000

    @property
    def budget(self) -> float:
        return 2.0 - 2.0 * self.threshold

    def rows(self, length: int) -> int:
        return int(min(self.piece, max(256, (1 << 20) // length)))


@dataclass
class Axes:
    """For vectors of one length: the rotation, or None for none, where strips begin along
    the first coordinate, and (from, to, budget) of every block."""

    rotation: np.ndarray | None
    bounds: np.ndarray
    blocks: list[tuple[int, int, float]]


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, by the largest component first, so that no square
    overflows or vanishes."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def rotated(vectors: np.ndarray, axes: Axes) -> np.ndarray:
    return vectors if axes.rotation is None else vectors @ axes.rotation


def axes_of(length: int, sample: np.ndarray, count: int, join: Cosine, fit: bool) -> Axes:
    """Axes fitted on sampled unit vectors of a length that ``count`` vectors have."""
    rotation, variance = None, np.ones(length)
    if len(sample) > 1:
        variance = sample.var(axis=0)
        if fit and length <= WIDEST:
            values, vectors = np.linalg.eigh(np.cov(sample.T).reshape(length, length))
            rotation, variance = vectors[:, ::-1], np.maximum(values[::-1], 0.0)
    if not variance.sum() > 0:
        variance = np.ones(length)
    edges = [*range(0, length, join.block), length]
    spans = list(zip(edges, edges[1:]))
    blocks = [(a, b, join.budget * float(variance[a:b].sum() / variance.sum())) for a, b in spans]
    strips = -(-count // join.rows(length))
    bounds = np.array([])
    if strips > 1 and len(sample):
        first = sample @ rotation[:, 0] if rotation is not None else sample[:, 0]
        bounds = np.unique(np.quantile(first, np.arange(1, strips) / strips))
    return Axes(rotation, bounds, blocks)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column, all of one length, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fitted(vectors: DataFrame, join: Cosine) -> dict[int, Axes]:
    """Axes by length, from a sample by hash that the driver holds: at most ``join.sample``
    vectors, and 2^22 components."""
    counts = {r["length"]: r["n"] for r in vectors.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    total, components_ = sum(counts.values()), sum(k * n for k, n in counts.items())
    rows = max(1, min(join.sample, (1 << 22) * total // components_))
    share = F.shiftrightunsigned("k2", 24) < int(2**40 * min(1.0, rows / total))
    picked = vectors.where(share).dropDuplicates(["k1", "k2"]).limit(rows).select("length", "vector").toArrow()
    lengths = picked.column("length").to_numpy()
    frequent = sorted(counts, key=counts.get, reverse=True)[:LENGTHS]
    found = {}
    for length, n in counts.items():
        mine = picked.filter(pa.array(lengths == length)).column("vector")
        sample = units(matrix(mine)) if len(mine) else np.empty((0, length))
        found[length] = axes_of(length, sample, n, join, length in frequent)
    return found


def usable(vector: Column) -> Column:
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~wrong & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Sets of places that links join."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, places: np.ndarray) -> np.ndarray:
        while True:
            above = self.parent[places]
            if (above == places).all():
                return places
            places = above

    def join(self, a: int, b: int) -> None:
        a, b = int(self.roots(np.array([a]))[0]), int(self.roots(np.array([b]))[0])
        self.parent[max(a, b)] = min(a, b)

    def link(self, rows: np.ndarray, columns: np.ndarray, links: np.ndarray) -> None:
        """Join rows and columns of a matrix of links, by a link for each row at a time."""
        while True:
            apart = links & (self.roots(rows)[:, None] != self.roots(columns)[None, :])
            hit = np.flatnonzero(apart.any(axis=1))
            if not len(hit):
                return
            for i, j in zip(rows[hit], columns[apart[hit].argmax(axis=1)]):
                self.join(i, j)


class Side:
    """Vectors of a piece in chunks: rotated blocks ready to multiply, and their boxes."""

    def __init__(self, vectors: np.ndarray, axes: Axes, at: np.ndarray) -> None:
        turned = rotated(vectors, axes)
        order = np.argsort(turned[:, 0], kind="stable")
        self.at, self.vectors = at[order], vectors[order]
        turned = turned[order].astype(np.float32)
        self.starts = np.arange(0, len(order), CHUNK)
        self.low = np.minimum.reduceat(turned, self.starts, axis=0)
        self.high = np.maximum.reduceat(turned, self.starts, axis=0)
        # (a, -|a|^2/2, 1) . (b, 1, -|b|^2/2) is -|a - b|^2 / 2
        self.left, self.right = [], []
        one = np.ones((len(order), 1), dtype=np.float32)
        for a, b, _ in axes.blocks:
            part = turned[:, a:b]
            half = -0.5 * (part * part).sum(axis=1, keepdims=True)
            self.left.append(np.hstack([part, half, one]))
            self.right.append(np.hstack([part, one, half]).T.copy())

    def chunk(self, i: int) -> slice:
        return slice(self.starts[i], self.starts[i] + CHUNK)


def candidates(a: Side, i: int, b: Side, j: int, near: list[int], axes: Axes) -> np.ndarray | None:
    """Which pairs of two chunks keep within the budget of some near block."""
    found = None
    for k in near:
        distance = a.left[k][a.chunk(i)] @ b.right[k][:, b.chunk(j)]
        least = -0.5 * (axes.blocks[k][2] + SLACK)
        if distance.max() >= least:
            within = distance >= least
            found = within if found is None else found | within
    return found


def verified(a: np.ndarray, b: np.ndarray, candidate: np.ndarray, threshold: float) -> np.ndarray:
    """Candidates whose cosine reaches the threshold. Products of matrices differ in the last
    bits by their shape, so close ones are summed pair by pair."""
    cosine = a @ b.T
    close = np.argwhere(candidate & (np.abs(cosine - threshold) < 1e-12))
    for r, c in close:
        cosine[r, c] = np.sum(a[r] * b[c])
    return candidate & (cosine >= threshold)


def tile_links(
    a: Side, b: Side, axes: Axes, join: Cosine, copies: np.ndarray
) -> tuple[np.ndarray, Forest]:
    """(rows linked with each place, forest of links) of two sides, or of one with itself."""
    links, forest = np.zeros(len(copies)), Forest(len(copies))
    starts = [x for x, _, _ in axes.blocks]
    budgets = np.array([y for _, _, y in axes.blocks]) + SLACK
    for i in range(len(a.starts)):
        gap = np.maximum(0, np.maximum(b.low - a.high[i], a.low[i] - b.high))
        near = np.add.reduceat(gap * gap, starts, axis=1) <= budgets
        for j in range(i if a is b else 0, len(b.starts)):
            found = candidates(a, i, b, j, np.flatnonzero(near[j]).tolist(), axes)
            if found is None:
                continue
            if a is b and i == j:
                found = np.triu(found, 1)
            rows, columns = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
            if not len(rows):
                continue
            r, c = rows + a.starts[i], columns + b.starts[j]
            linked = verified(a.vectors[r], b.vectors[c], found[np.ix_(rows, columns)], join.threshold)
            if linked.any():
                r, c = a.at[r], b.at[c]
                weight = linked.astype(np.float64)
                links[r] += weight @ copies[c]
                links[c] += copies[r] @ weight
                forest.link(r, c, linked)
    return links, forest


LINKS = "node long, root long, links long"


def tile_join(found: Callable[[], dict[int, Axes]], join: Cosine) -> Callable[[pa.Table], pa.Table]:
    """The task of a tile: nodes of one piece or two, to the linked ones with a root each."""

    def run(tile: pa.Table) -> pa.Table:
        vectors = units(matrix(tile.column("vector")))
        axes = found()[vectors.shape[1]]
        piece = tile.column("piece").to_numpy()
        first, last = piece.min(), piece.max()
        a = Side(vectors[piece == first], axes, np.flatnonzero(piece == first))
        both = tile.column("a")[0] != tile.column("b")[0]
        b = Side(vectors[piece == last], axes, np.flatnonzero(piece == last)) if first != last else a
        node = tile.column("node").to_numpy()
        if both and first == last:  # the other piece turned out empty
            at = np.array([], dtype=np.int64)
            return pa.table([pa.array(at)] * 3, names=["node", "root", "links"])
        links, forest = tile_links(a, b, axes, join, tile.column("copies").to_numpy().astype(np.float64))
        at = np.flatnonzero(links > 0)
        columns = [node[at], node[forest.roots(at)], links[at].astype(np.int64)]
        return pa.table([pa.array(c) for c in columns], names=["node", "root", "links"])

    return run


def pieces_of(strips: list, join: Cosine) -> list[tuple[int, int, int, int, int, int]]:
    """(length, strip, first piece, pieces, least and last piece in reach) of every strip.

    Pieces are numbered along the strips, so that what a strip can reach is an interval.
    """
    reach = float(np.sqrt(join.budget)) + SLACK
    out, base = [], 0
    for length in sorted({s["length"] for s in strips}):
        mine = sorted((s for s in strips if s["length"] == length), key=lambda s: s["strip"])
        parts = np.array([-(-s["n"] // join.rows(length)) for s in mine])
        begin = base + np.concatenate([[0], np.cumsum(parts)])
        low, high = np.array([s["low"] for s in mine]), np.array([s["high"] for s in mine])
        least = np.searchsorted(high, low - reach, side="left")
        most = np.searchsorted(low, high + reach, side="right") - 1
        for i, s in enumerate(mine):
            row = (length, s["strip"], begin[i], parts[i], begin[least[i]], begin[most[i] + 1] - 1)
            out.append(tuple(int(x) for x in row))
        base = int(begin[-1])
    return out


def near_vectors(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    join: Cosine = Cosine(),
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: other rows linked directly, smallest
    id in reach, and whether that is the row's own. Intermediate tables are written."""
    spark = prepared(rows.sparkSession)
    kind = dict(rows.dtypes)[vector_column]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    all_rows = rows.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast(kind).alias("vector")
    ).withColumn("usable", usable(F.col("vector")))
    vectors = all_rows.where("usable").select(
        "id",
        "vector",
        F.size("vector").alias("length"),
        F.xxhash64("vector").alias("k1"),
        F.xxhash64(F.lit(1), "vector").alias("k2"),
    )
    axes = sent(spark, fitted(vectors, join))
    nodes = stored(placed_nodes(vectors, axes), "nodes")
    strips = nodes.groupBy("length", "strip").agg(
        F.count("*").alias("n"), F.min("first").alias("low"), F.max("first").alias("high")
    )
    plan = pieces_of(strips.collect(), join)
    found = stored(tiles(nodes, plan).applyInArrow(tile_join(axes, join), LINKS), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = nodes.select(F.col("node").alias("u"), "least").join(reached, "u")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select(F.col("u").alias("node"), "component")
    settled = (
        nodes.select("node", "k1", "k2", "copies", "least")
        .join(links, "node", "left")
        .join(named.withColumn("in_one", F.lit(True)), "node", "left")
        .select(
            F.col("k1").alias("n1"),
            F.col("k2").alias("n2"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.when(F.col("in_one"), F.col("component")).otherwise(F.col("least")).alias("component_id"),
        )
    )
    # null-safe, so that a vector with many copies has an exchange that can be split
    on = F.col("k1").eqNullSafe(F.col("n1")) & F.col("k2").eqNullSafe(F.col("n2"))
    linked = vectors.select("id", "k1", "k2").join(settled, on, "left").select("id", "n_links", "component_id")
    alone = all_rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).select(
        F.col("id").alias(id_column),
        "n_links",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def placed_nodes(vectors: DataFrame, axes: Callable[[], dict[int, Axes]]) -> DataFrame:
    """A numbered row for each distinct vector, with copies, smallest id, first coordinate
    and strip."""
    distinct = vectors.groupBy("k1", "k2").agg(
        F.first("vector").alias("vector"),
        F.first("length").alias("length"),
        F.count("*").alias("copies"),
        F.min("id").alias("least"),
    )

    def place(batches):
        for batch in filter(len, batches):
            lengths = batch.column("length").to_numpy()
            first, strip = np.zeros(len(batch)), np.zeros(len(batch), dtype=np.int32)
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                own = axes()[length]
                rows = units(matrix(batch.column("vector").take(pa.array(mine))))
                first[mine] = rows[:, 0] if own.rotation is None else rows @ own.rotation[:, 0]
                strip[mine] = np.searchsorted(own.bounds, first[mine], side="right")
            names = [*batch.schema.names, "first", "strip"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(strip)], names)

    schema = ", ".join(f"{c} {t}" for c, t in distinct.dtypes) + ", first double, strip int"
    return distinct.mapInArrow(place, schema).withColumn("node", F.monotonically_increasing_id())


def tiles(nodes: DataFrame, plan: list[tuple[int, int, int, int, int, int]]):
    """Nodes grouped by the pairs of pieces that they take part in."""
    spark = nodes.sparkSession
    names = "length int, strip int, base long, parts long, lowest long, highest long"
    table = spark.createDataFrame(plan, names)
    piece = F.col("base") + F.pmod(F.xxhash64("node"), F.col("parts"))
    met = F.explode(F.sequence("lowest", "highest")).alias("met")
    dealt = (
        nodes.join(table, ["length", "strip"])
        .select("node", "copies", "vector", piece.alias("piece"), "lowest", "highest")
        .select("node", "copies", "vector", "piece", met)
        .select("node", "copies", "vector", "piece", F.least("piece", "met").alias("a"), F.greatest("piece", "met").alias("b"))
    )
    # a tile is much work for few bytes, so partitions are not left to be merged by size
    meetings = sum(parts * (most - least + 1) for *_, parts, least, most in plan)
    return dealt.repartition(int(min(20_000, max(1, 2 * meetings))), "a", "b").groupBy("a", "b")


VECTORS_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(u, v) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE u = e.vec_id) AS n_links,
       min(r.v) AS component_id, e.vec_id = min(r.v) AS kept
FROM embeddings e JOIN reach r ON r.u = e.vec_id GROUP BY e.vec_id
"""
