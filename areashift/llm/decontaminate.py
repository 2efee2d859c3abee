"""Benchmark decontamination: BM25 with block-max WAND, then question and answer overlap.

Test items form an inverted index with postings in blocks of items and the largest weight
of a term in each block. Every training passage is a query: blocks whose largest weights
cannot reach the threshold are skipped whole, in the others a pivot moves over the cursors
of the passage's terms. All items at or above the threshold are retrieved, no top-k.

Weights are divided by the threshold of their item, which is what the item's score keeps
at least when as many of its n-grams are missing as verification allows. So retrieval
loses no item that verification would accept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashift.llm.storage import prepared, sent

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
NGRAM = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
#: Items of a block, and items of an index that is sent to every task at most.
BLOCK = 4
SHARD = 20_000
SLACK = 1e-9


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def ngrams(words: list[str]) -> set[tuple]:
    """N-grams of the words, all of them as one if there are fewer."""
    if not words:
        return set()
    n = min(NGRAM, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words of all sentences but the last, and of the last. An item of one sentence
    has its last quarter of words as answer."""
    sentences = [w for w in map(words_of, SENTENCE.split(text or "")) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def share(part: set[tuple], grams: set) -> float:
    """The share of an item's n-grams that a passage has; 1 for none."""
    return sum(g in grams for g in part) / len(part) if part else 1.0


@dataclass
class Index:
    """Inverted index: per term (by number) a slice of its blocks, and per block the largest
    weight and a slice of postings by item. Items are numbered in the order given."""

    items: list[int]
    parts: list[tuple[set, set]]
    terms: dict[str, int]
    post_item: np.ndarray
    post_weight: np.ndarray
    block_at: np.ndarray
    block_of: np.ndarray
    block_most: np.ndarray
    block_post: np.ndarray

    @property
    def blocks(self) -> int:
        return -(-len(self.items) // BLOCK)


def lost_words(words: list[str], overlap: float) -> int:
    """Words that may be missing from a passage that still has enough n-grams: each missing
    n-gram uncovers one word at most."""
    n = len(ngrams(words))
    return n - math.ceil(overlap * n - SLACK)


def build_index(items: list[tuple[int, str]], overlap: float = OVERLAP) -> Index:
    """Index of (id, text) items. Items without words are left out."""
    split = [(i, *question_and_answer(t)) for i, t in items]
    split = [(i, q, a) for i, q, a in split if q or a]
    counts = [Counter(q + a) for _, q, a in split]
    mean = sum(sum(c.values()) for c in counts) / max(1, len(counts))
    seen = Counter(w for c in counts for w in c)
    terms = {w: k for k, w in enumerate(sorted(seen))}
    rows = []
    for k, (count, (_, q, a)) in enumerate(zip(counts, split)):
        length = sum(count.values())
        weight = {
            w: math.log(1 + (len(counts) - seen[w] + 0.5) / (seen[w] + 0.5))
            * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean))
            for w, n in count.items()
        }
        lost = lost_words(q, overlap) + lost_words(a, overlap)
        threshold = sum(sorted(weight.values())[: max(1, len(weight) - lost)])
        rows += [(terms[w], k, x / threshold) for w, x in weight.items()]
    rows.sort()
    term = np.array([r[0] for r in rows], dtype=np.int64)
    item = np.array([r[1] for r in rows], dtype=np.int64)
    weight = np.array([r[2] for r in rows], dtype=np.float64)
    key = term * (len(split) + 1) + item // BLOCK
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    most = np.maximum.reduceat(weight, first) if len(key) else weight
    bounds = np.arange(len(terms) + 1)
    return Index(
        [i for i, _, _ in split],
        [(ngrams(q), ngrams(a)) for _, q, a in split],
        terms,
        item,
        weight,
        np.searchsorted(term[first], bounds),
        item[first] // BLOCK,
        most,
        np.append(first, len(term)),
    )


def slices(starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Places of the concatenated slices of the given terms."""
    low, size = starts[terms], starts[terms + 1] - starts[terms]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)


def retrieve(index: Index, words: set[str]) -> list[tuple[int, float]]:
    """(item number, score as a multiple of its threshold) of all items that reach it."""
    terms = np.array(sorted(index.terms[w] for w in words & index.terms.keys()), dtype=np.int64)
    if not len(terms):
        return []
    at = slices(index.block_at, terms)
    blocks = index.block_of[at]
    bound = np.bincount(blocks, weights=index.block_most[at], minlength=index.blocks)
    reached = np.flatnonzero(bound >= 1 - SLACK)
    if not len(reached):
        return []
    at = at[np.argsort(blocks, kind="stable")]
    ends = np.cumsum(np.bincount(blocks, minlength=index.blocks))
    found = []
    for block in reached.tolist():
        found += wand(index, at[ends[block - 1] if block else 0 : ends[block]])
    return found


def wand(index: Index, lists: np.ndarray) -> list[tuple[int, float]]:
    """Weak AND over the given terms' postings in one block: the pivot is the first item at
    which the largest weights of the cursors up to it reach the threshold; items before it
    are skipped."""
    low, high = index.block_post[lists].tolist(), index.block_post[lists + 1].tolist()
    start, stop = min(low), max(high)
    item = index.post_item[start:stop].tolist() if stop - start < 4096 else index.post_item
    weight = index.post_weight[start:stop].tolist() if stop - start < 4096 else index.post_weight
    shift = start if stop - start < 4096 else 0
    # cursors: item under it, place, end, largest weight
    cursors = [
        [item[a - shift], a - shift, b - shift, most]
        for a, b, most in zip(low, high, index.block_most[lists].tolist())
    ]
    found = []
    while cursors:
        cursors.sort()
        total, pivot = 0.0, None
        for c in cursors:
            total += c[3]
            if total >= 1 - SLACK:
                pivot = c[0]
                break
        if pivot is None:
            break
        score, full = 0.0, cursors[0][0] == pivot
        alive = []
        for c in cursors:
            if full and c[0] == pivot:
                score += weight[c[1]]
                c[1] += 1
            else:
                while c[1] < c[2] and item[c[1]] < pivot:
                    c[1] += 1
            if c[1] < c[2]:
                c[0] = item[c[1]]
                alive.append(c)
        if full and score >= 1 - SLACK:
            found.append((int(pivot), float(score)))
        cursors = alive
    return found


def leaks_of(index: Index, text: str | None, overlap: float = OVERLAP) -> list[tuple[int, float, float, float]]:
    """(item id, score, question overlap, answer overlap) of the items that a passage holds."""
    words = words_of(text)
    found = retrieve(index, set(words))
    if not found:
        return []
    grams = {n: set(zip(*(words[i:] for i in range(n)))) for n in {len(g) for k, _ in found for p in index.parts[k] for g in p}}
    out = []
    for k, score in found:
        shares = [share(p, grams[len(next(iter(p)))]) if p else 1.0 for p in index.parts[k]]
        if min(shares) >= overlap - SLACK:
            out.append((index.items[k], score, *shares))
    return out


def shards_of(benchmark: DataFrame, id_column: str, text_column: str, size: int) -> Iterator[list]:
    """Items in lists of bounded length, however many there are."""
    items = benchmark.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("id IS NOT NULL")
    n = max(1, -(-items.count() // size))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).distinct()
        yield sorted((r["id"], r["text"] or "") for r in part.collect())


LEAKS = "item_id long, score double, question_overlap double, answer_overlap double"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    overlap: float = OVERLAP,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    shard: int = SHARD,
) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score (as a multiple of
    the item's threshold), question_overlap, answer_overlap.

    An item is held when the document has at least ``overlap`` of the n-grams of its
    question and of its answer. An item without words is held by nothing; missing and
    empty documents hold nothing; repeated rows of either table give repeated rows, but
    equal items count once. A benchmark beyond ``shard`` items is taken in several
    passes, each with the term statistics of its own part.
    """
    leaks = leaking_rows(docs, benchmark, overlap, id_column, text_column, item_column, shard)
    return leaks.select(F.col("__leak_id").alias(id_column), *(c.split()[0] for c in LEAKS.split(", ")))


def digest_of(text_column: str) -> Column:
    """Tells texts apart where ids are missing or repeat."""
    return F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))


def leaking_rows(
    docs: DataFrame, benchmark: DataFrame, overlap: float, id_column: str, text_column: str, item_column: str, shard: int
) -> DataFrame:
    """``find_leaks`` with the id as __leak_id and the digest of the text as __leak_digest."""
    spark = prepared(docs.sparkSession)
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), digest_of(text_column).alias("digest"), F.col(text_column).cast("string").alias("text")
    )
    names = ["__leak_id", "__leak_digest", *(c.split()[0] for c in LEAKS.split(", "))]
    out = None
    for items in shards_of(benchmark, item_column, text_column, shard):
        shared = sent(spark, build_index(items, overlap))

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared()
            for batch in batches:
                found = [
                    (doc, digest, *leak)
                    for doc, digest, text in zip(*(c.to_pylist() for c in batch.columns))
                    for leak in leaks_of(index, text, overlap)
                ]
                if found:
                    columns = [pa.array(c, pa.int64() if i < 3 else pa.float64()) for i, c in enumerate(zip(*found))]
                    yield pa.RecordBatch.from_arrays(columns, names)

        leaks = rows.mapInArrow(search, f"__leak_id long, __leak_digest long, {LEAKS}")
        out = leaks if out is None else out.unionByName(leaks)
    return out


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id"
) -> DataFrame:
    """The documents that hold no item, all columns, whatever those are called.

    Rows are filtered where they are, once for each shard of items: each goes or stays by its
    own text, with or without an id. ``id_column`` is not looked at.
    """
    spark = prepared(docs.sparkSession)
    for items in shards_of(benchmark, item_column, text_column, SHARD):
        shared = sent(spark, build_index(items, OVERLAP))

        def clean(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared()
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
                held = [next(iter(leaks_of(index, t, OVERLAP)), None) is not None for t in texts]
                yield batch.filter(pa.array([not h for h in held], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


#: The pairs by counting n-grams, without an index.
LEAKS_SQL = r"""
WITH parts AS (
  SELECT item_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
           lambda s: regexp_extract_all(lower(s), '[\p{L}\p{N}]+')), lambda w: len(w) > 0) AS sentences
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)
), split AS (
  SELECT item_id,
    CASE WHEN len(sentences) > 1 THEN flatten(sentences[:-2])
         ELSE sentences[1][:len(sentences[1]) - len(sentences[1]) // 4] END AS question,
    CASE WHEN len(sentences) > 1 THEN sentences[-1]
         ELSE sentences[1][len(sentences[1]) - len(sentences[1]) // 4 + 1:] END AS answer
  FROM parts WHERE len(sentences) > 0
), both_parts AS (
  SELECT item_id, 'q' AS part, question AS words FROM split UNION ALL SELECT item_id, 'a', answer FROM split
), grams AS (
  SELECT DISTINCT item_id, part, n, words[i:i + n - 1] AS gram
  FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i
        FROM (SELECT *, least(5, len(words)) AS n FROM both_parts WHERE len(words) > 0))
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents
), doc_grams AS (
  SELECT DISTINCT r, doc_id, n, words[i:i + n - 1] AS gram
  FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM grams) sizes WHERE len(words) >= n)
), totals AS (SELECT item_id, part, count(*) AS total FROM grams GROUP BY ALL
), hits AS (
  SELECT r, doc_id, item_id, part, count(*) AS hit FROM grams JOIN doc_grams USING (n, gram) GROUP BY ALL
), shares AS (
  SELECT r, doc_id, item_id, max(CASE WHEN part = 'q' THEN hit / total END) AS q, max(CASE WHEN part = 'a' THEN hit / total END) AS a
  FROM hits JOIN totals USING (item_id, part) GROUP BY ALL
), has_parts AS (SELECT item_id, bool_or(part = 'q') AS has_q, bool_or(part = 'a') AS has_a FROM totals GROUP BY ALL)
SELECT doc_id, item_id, CASE WHEN has_q THEN q ELSE 1.0 END AS question_overlap, CASE WHEN has_a THEN a ELSE 1.0 END AS answer_overlap
FROM shares JOIN has_parts USING (item_id)
WHERE CASE WHEN has_q THEN coalesce(q, 0) ELSE 1 END >= 0.8 - 1e-9 AND CASE WHEN has_a THEN coalesce(a, 0) ELSE 1 END >= 0.8 - 1e-9
"""
