"""Near duplicates of vectors against all pairs."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import TESTDATA

from areashift.llm import vector_join
from areashift.llm.vector_join import Cosine, near_vectors, pieces_of

SCHEMA = "vec_id long, embedding array<double>, label int, node long, piece int, k1 string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "k", "c") for i, v in rows], SCHEMA).repartition(3)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows, threshold=0.9):
    """(id, n_links, component, kept) of every row, by all pairs."""
    n = len(rows)
    unit = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float) / max(map(abs, v))) / max(map(abs, v)) if good(v) else None for _, v in rows]
    group, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            if unit[i] is None or unit[j] is None or len(unit[i]) != len(unit[j]):
                continue
            if float(unit[i] @ unit[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if group[j] == group[i] and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((key, links[i], least, key == least))
    return sorted(out, key=str)


def run(spark, rows, join=Cosine()):
    got = near_vectors(frame(spark, rows), join=join)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=str)


def clustered(n, length, spread, seed=3):
    """Vectors around few centres, at distances on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, length))
    rows = centres[rng.integers(0, 5, n)] + spread * rng.normal(size=(n, length))
    return [(int(i), list(map(float, r))) for i, r in enumerate(rows)]


AWKWARD = [
    (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]),
    (7, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1e200, 2e200]), (10, [1e-320, 2e-320]), (11, [-1.0, -2.0]),
    (12, [1.0, 2.0, 0.0]), (13, [5.0]), (14, [0.001]), (15, [-5.0]), (None, [2.0, 1.0]), (None, [2.0, 1.0]),
    (None, None), (16, [0.0, 0.0]), (17, [0.0, 0.0, 0.0, 1.0]), (-3, [0.0, -0.0, 0.0, 2.0]),
]


def test_awkward_rows(spark):
    assert run(spark, AWKWARD) == brute(AWKWARD)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]


@pytest.mark.parametrize("length, spread", [(3, 0.3), (24, 0.28), (40, 0.3)])
@pytest.mark.parametrize("join", [Cosine(), Cosine(block=4, piece=1), Cosine(0.97, 7)])
def test_all_pairs(spark, monkeypatch, length, spread, join):
    monkeypatch.setattr(vector_join, "CHUNK", 16)
    monkeypatch.setattr(Cosine, "rows", lambda self, n: 64 if self.piece == 1 else 8192)
    rows = clustered(400, length, spread)
    want = brute(rows, join.threshold)
    assert any(r[1] for r in want) and any(not r[3] for r in want)
    assert run(spark, rows, join) == want


def test_one_group_and_many_copies(spark, monkeypatch):
    """A third of the rows are copies of one vector, a third differ a little from it."""
    monkeypatch.setattr(Cosine, "rows", lambda self, n: 50)
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, list(map(float, base))) for i in range(200)]
    rows += [(1000 + i, list(map(float, base + 0.02 * rng.normal(size=8)))) for i in range(200)]
    rows += [(2000 + i, list(map(float, rng.normal(size=8)))) for i in range(200)]
    assert run(spark, rows) == brute(rows)


def test_a_chain_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(Cosine, "rows", lambda self, n: 4)
    angles = np.arange(30) * 0.4
    rows = [(int(100 - i), [float(np.cos(a)), float(np.sin(a)), 0.0]) for i, a in enumerate(angles[:8])]
    got = run(spark, rows)
    assert got == brute(rows) and {r[2] for r in got} == {93}


def test_at_the_threshold(spark):
    """Cosines of exactly 0.6 and just below."""
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, 4.000001])]
    got = {r[0]: r[1] for r in run(spark, rows, Cosine(0.6))}
    assert got == {1: 1, 2: 2, 3: 1}


def test_pieces_in_reach():
    strip = lambda s, n, low, high: {"length": 64, "strip": s, "n": n, "low": low, "high": high}
    plan = pieces_of([strip(0, 9000, -1.0, -0.5), strip(1, 100, -0.4, 0.0), strip(3, 100, 0.3, 0.9)], Cosine())
    assert plan == [(64, 0, 0, 2, 0, 2), (64, 1, 2, 1, 0, 3), (64, 3, 3, 1, 2, 3)]


def test_whole_table_against_all_pairs(spark):
    """The group of near copies in it is found whole."""
    path = TESTDATA / "check_s" / "embeddings.parquet"
    if not path.exists():
        pytest.skip("needs the test tables")
    data = pq.read_table(path)
    x = np.array(data["embedding"].to_pylist())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(x[a : a + 1000] @ x.T >= 0.9).sum(axis=1) - 1 for a in range(0, len(x), 1000)])
    got = near_vectors(spark.read.parquet(str(path))).toPandas().set_index("vec_id").n_links
    assert want.sum() > 0 and (got[data["vec_id"].to_numpy()].to_numpy() == want).all()
