"""Every query of the package over whole tables at sf0.01, against SQL or a plain version."""

import math
from collections import Counter

import duckdb
import pytest
from llm_cases import brute_bytes, brute_components, brute_pii, brute_windows, sha

import corpus_pipeline
from areashift.llm import queries as corpus
from areashift.llm.html_extract import main_text
from areashift.llm.pii import KINDS
from areashift.llm.storage import stored
from conftest import TESTDATA

SF = TESTDATA / "sf0.01"
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def run(spark, name, *columns):
    found = corpus.queries()[name](spark, str(SF))
    return Counter(tuple(r[c] for c in columns) for r in found.collect())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in corpus.queries()) == list(range(1, 14))
    assert set(corpus.oracle_sql()) <= set(corpus.queries())


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    cursor = duck.execute(corpus.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = Counter(cursor.fetchall())
    assert sum(want.values()) > 0
    assert set(corpus.queries()[name](spark, str(SF)).columns) == set(columns)
    assert run(spark, name, *columns) == want


def test_personal_data(spark, texts):
    want = Counter()
    for i, t in texts:
        spans = brute_pii(t)
        kinds = Counter(k for *_, k in spans)
        want[(i, *(kinds[k] for k in KINDS), sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))] += 1
    assert run(spark, "op3_personal_data", "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256") == want


def test_ngram_join(spark, texts):
    got = run(spark, "op4_ngram_join", "doc_id", "n_shingles", "component_id")
    assert got == brute_components(texts, 4, 85, 100)


def test_substring_dedup(spark, texts):
    got = run(spark, "op5_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_windows(texts, 35)


def test_suffix_dedup(spark, texts):
    got = run(spark, "op9_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_bytes(texts, 400)


def test_toxicity_on_rows_held_out(spark, duck, texts):
    marks = dict(duck.execute("SELECT doc_id, toxic FROM labels").fetchall())
    found = corpus.queries()["op8_toxicity"](spark, str(SF)).collect()
    assert len(found) == len(texts)
    held = [(r["score"], marks[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in marks]
    ones, zeros = [s for s, t in held if t], [s for s, t in held if not t]
    ranked = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert ranked > 0.8  # some 50 labelled rows of class 1 to learn from at this size
    assert all(math.isfinite(r["score"]) for r in found)


def test_html_extract(spark, duck):
    found = {r["page_id"]: r for r in corpus.queries()["op7_html_extract"](spark, str(SF)).collect()}
    rows = duck.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert len(found) == len(rows)
    for page, url, html in rows:
        r = found[page]
        assert (r["url"], r["n_chars"]) == (url, len(r["text"]))
        assert r["text"] == main_text(html, None)  # these articles hold no template


def test_pipeline_stages_take_effect(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        docs = stored(stage(spark, docs, str(SF)), "stage")
        kept[name] = (before, [r["doc_id"] for r in docs.select("doc_id").collect()])
        if name != "mixing":
            assert docs.columns == columns
    flagged = {r["doc_id"] for r in corpus.queries()["op8_toxicity"](spark, str(SF)).collect() if r["predicted"]}
    before, after = kept["toxicity"]
    assert set(after) == set(before) - flagged
    before, after = kept["exact_dedup"]
    least = {}
    for i, t in before.items():
        least[t] = max(i, least.get(t, i))
    assert sorted(after) == sorted(least.values())
    before, after = kept["ngram_join"]
    roots = brute_components(list(before.items()), 5, 80, 100)
    assert sorted(after) == sorted(i for i, n, root in roots if n == 0 or i == root)
    before, after = kept["decontamination"]
    leaks = duck.execute(f"SELECT DISTINCT doc_id FROM ({corpus.oracle_sql()['op2_decontaminate']})").fetchall()
    assert set(after) == set(before) - {i for (i,) in leaks}
    before, after = kept["mixing"]
    assert set(after) <= set(before) and len(after) == len(set(after))
    assert all(r["taken"] > 0 for r in docs.collect())
