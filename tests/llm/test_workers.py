"""What is sent to workers, and rows that repeat there."""

import pickle
import subprocess
import sys
from collections import Counter

import pytest
from llm_cases import brute_bytes, brute_windows, frame, words
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from areashift.llm import windows
from areashift.llm.conversation_repair import damaged_and_repaired
from areashift.llm.decontaminate import drop_leaks
from areashift.llm.exact_dedup import drop_copies
from areashift.llm.fill_middle import fill_in_middle, with_restored
from areashift.llm.ngram_join import Similarity, drop_near_copies, near_duplicates
from areashift.llm.substring_dedup import substring_dedup
from areashift.llm.suffix_dedup import suffix_dedup
from areashift.llm.toxicity import score_toxicity, train
from areashift.llm.vector_join import near_vectors

LOAD = """
import pickle, sys, numpy, pyarrow, pandas, pyspark.core.broadcast
pyspark.core.broadcast._from_id = lambda number: None
sys.path = [p for p in sys.path if "repo" not in p]
for size in iter(lambda: sys.stdin.buffer.read(8), b""):
    pickle.loads(sys.stdin.buffer.read(int.from_bytes(size, "big")))
"""


def talk(spark):
    return spark.createDataFrame([(1, i, "user", f"{i}.") for i in range(9)], "conv_id long, turn long, role string, text string")


def toxic(spark):
    docs = frame(spark, [(i, f"{'bad' if i % 2 else 'good'} word {i}") for i in range(60)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    return score_toxicity(docs, train(docs, labels))


ITEMS = [(1, f"{words('q', 20)}. {words('a', 6)}")]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


OPERATORS = {
    "2": lambda s: drop_leaks(frame(s), items(s)),
    "4": lambda s: near_duplicates(frame(s)),
    "5": lambda s: substring_dedup(frame(s)),
    "8": toxic,
    "9": lambda s: suffix_dedup(frame(s)),
    "11": lambda s: with_restored(fill_in_middle(frame(s))),
    "12": lambda s: near_vectors(s.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "vec_id long, embedding array<float>")),
    "13": lambda s: damaged_and_repaired(talk(s)),
}


@pytest.mark.parametrize("number", sorted(OPERATORS, key=int))
def test_functions_load_without_the_package(spark, monkeypatch, tmp_path, number):
    """Executors have numpy, pandas and pyarrow, but not this library."""
    sent = []

    def noted(plain):
        def call(self, function, *args, **kwargs):
            sent.append(cloudpickle.dumps(function))
            return plain(self, function, *args, **kwargs)

        return call

    monkeypatch.setattr(DataFrame, "mapInArrow", noted(DataFrame.mapInArrow))
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", noted(PandasGroupedOpsMixin.applyInArrow))
    from pyspark.core.context import SparkContext

    plain = SparkContext.broadcast
    # values of broadcasts are pickled plainly, so their classes go by name
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, v: sent.append(pickle.dumps(v)) or plain(self, v))
    OPERATORS[number](spark)
    assert sent
    data = b"".join(len(s).to_bytes(8, "big") + s for s in sent)
    done = subprocess.run([sys.executable, "-c", LOAD], input=data, capture_output=True, cwd=tmp_path, env={"PATH": "/usr/bin"})
    assert not done.returncode, done.stderr.decode()[-2000:]


@pytest.mark.parametrize("key", [5, None])
def test_rows_repeated_under_one_id(spark, key):
    rows = [(key, f"{words('a', 60)} {words('b', 30)}")] * 40 + [(7, f"{words('c', 20)} {words('b', 30)}"), (8, "z")]
    got = substring_dedup(frame(spark, rows), 12, 4).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == brute_windows(rows, 12)
    got = suffix_dedup(frame(spark, rows), 50, 9).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == brute_bytes(rows, 50)


def test_spans_of_repeated_rows_are_gathered_once(spark):
    """A text's list of spans does not grow with the rows that repeat it."""
    schema = "id long, digest long, first int, windows int, before int, anchor long, one long, two long"
    runs = [(None, 1, at, 3, 2, at, 5, 6) for at in range(4)]
    spans = [(at, 2, 3, 5, 6, [(0, 9)]) for at in range(4)]
    spans = spark.createDataFrame(spans, "anchor long, before int, windows int, one long, two long, spans array<struct<a:int,b:int>>")
    for times in (1, 50):
        (row,) = windows.text_spans(spark.createDataFrame(runs * times, schema), spans).select(F.size("spans")).collect()
        assert row[0] == 4


CLASHING = [
    "__dedup_id", "__dedup_kept", "__dedup_sha", "__dedup_kept_sha", "__leak_id", "__leak_digest", "__kept_id", "__kept_sha",
    "own_id", "own_sha", "own_digest", "mark_id", "mark_digest", "mark_first", "digest", "_digest", "first", "rows", "ID", "node",
]


def test_stages_keep_columns_of_any_name(spark):
    near = f"{words('w', 100)}"
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (None, ""), (4, near), (5, near + " more"),
            (6, f"x {ITEMS[0][1]} y"), (7, "g h i j k l"), (7, "g h i j k l"), (7, "other text under one id")]
    docs = spark.createDataFrame([(i, t, *[f"{c}{n}" for c in CLASHING]) for n, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    docs = docs.repartition(4)
    stages = {
        "copies": (drop_copies(docs), [2, 3, 4, 5, 6, 7, 7]),
        "near copies": (drop_near_copies(docs, Similarity(n=5, num=80, den=100)), [1, 3, 4, 6, 7, 7]),
        "leaks": (drop_leaks(docs, items(spark)), [1, 2, 3, 4, 5, 7, 7, 7]),
    }
    whole = {tuple(r) for r in docs.collect()}
    for name, (left, want) in stages.items():
        assert left.columns == docs.columns, name
        got = left.collect()
        assert sorted(r.doc_id for r in got if r.doc_id is not None) == want, name
        assert {tuple(r) for r in got} <= whole and len({tuple(r) for r in got}) == len(got), name
