"""Fill-in-the-middle training examples, made column by column with ``pyarrow.compute``.

A text is cut into lines; two cuts between lines, chosen by a hash of the id, part it into
prefix, middle and suffix, which are put in another order between three markers. All texts
of an Arrow batch go through the same steps at once: lines as list arrays, flattened with
the index of their text, numbered within it, filtered by part, built into lists again and
joined. Spark hands out the batches, and nothing is shuffled.

Cases:

- A missing text is an empty one; an empty text has no lines and stays plain.
- A text that holds a marker stays plain, as it could not be restored.
- A missing id is hashed as an empty one. Rows with equal ids and texts give equal rows,
  one for each.
- A text is handled whole. A batch holds what the session allows (``storage.ARROW``), or
  one text longer than that.
- Of the table only id and text are read, so other columns may have any name.
- An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashift.llm.storage import prepared

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Rates:
    """Which texts are rearranged, and how many of those suffix first, in percent; ``seed``
    goes into the hash of an id."""

    rearranged: int = 100
    suffix_first: int = 50
    seed: str = "7:"


def draws(key: Column, seed: str) -> list[Column]:
    """Four numbers below 2^32 from the hash of a key."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lines with their line ends, text of each line, lines of each text)."""
    split = pc.split_pattern(texts, "\n")
    units, owner = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    last = np.append(owner[1:] != owner[:-1], [True] * bool(len(owner)))
    ends = pc.if_else(pa.array(last), "", "\n").cast(units.type)
    units = pc.binary_join_element_wise(units, ends, pa.scalar("", units.type))
    # what follows the last line end is a line unless it is empty
    real = pc.greater(pc.binary_length(units), 0)
    owner = owner[real.to_numpy(zero_copy_only=False)]
    return units.filter(real), owner, np.bincount(owner, minlength=len(texts))


def joined(units: pa.Array, owner: np.ndarray, chosen: np.ndarray, n: int) -> pa.Array:
    """For each of n texts its chosen units as one string."""
    counts = np.bincount(owner[chosen], minlength=n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, units.filter(pa.array(chosen)))
    return pc.binary_join(lists, "")


def glued(*pieces: pa.Array | str) -> pa.Array:
    kind = next(p.type for p in pieces if isinstance(p, pa.Array))
    whole = [p if isinstance(p, pa.Array) else pa.scalar(p, kind) for p in pieces]
    return pc.binary_join_element_wise(*whole, pa.scalar("", kind))


def rearranged(batch: pa.RecordBatch, rates: Rates) -> list[pa.Array]:
    """(lines, form, prefix and middle in code points, output) of a batch of (id, text, h1..h4)."""
    texts = batch.column(1)
    h1, h2, h3, h4 = (batch.column(i).to_numpy() for i in range(2, 6))
    units, owner, n = lines_of(texts)
    starts = np.cumsum(n) - n
    ordinal = np.arange(len(owner)) - starts[owner]
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    role = (ordinal >= low[owner]).astype(np.int8) + (ordinal >= high[owner])
    prefix, middle, suffix = (joined(units, owner, role == r, len(texts)) for r in range(3))

    plain = np.asarray(n == 0) | (h3 % 100 >= rates.rearranged)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain |= pc.match_substring(texts, marker).to_numpy(zero_copy_only=False)
    first = pa.array(h4 % 100 < rates.suffix_first)
    plain = pa.array(plain)
    output = pc.if_else(
        plain,
        texts,
        pc.if_else(
            first,
            glued(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle),
            glued(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle),
        ),
    )
    form = pc.if_else(plain, "plain", pc.if_else(first, "spm", "psm"))
    gap = pa.scalar(None, pa.int64())
    lengths = [pc.if_else(plain, gap, pc.utf8_length(p).cast(pa.int64())) for p in (prefix, middle)]
    return [pa.array(n.astype(np.int64)), form, *lengths, output]


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rates: Rates = Rates()
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    ``n`` is the number of lines, ``form`` one of plain, psm (prefix, suffix, middle) and
    spm (suffix, prefix, middle); the two lengths are in code points and missing if plain.
    """
    prepared(docs.sparkSession)
    key = F.col(f"`{id_column}`")
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    drawn = [h.alias(f"h{i}") for i, h in enumerate(draws(key, rates.seed))]
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = docs.select(key.alias("id"), text.alias("text"), *drawn)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *rearranged(batch, rates)], names)

    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(apply, schema).withColumnRenamed("id", id_column)


def restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that outputs of the given forms were made of.

    The text holds no marker, and a marker cannot begin in it and end in the next one, so
    the first place of each marker is where it was put.
    """
    parted = pc.not_equal(forms, "plain")
    first = pc.equal(forms.filter(parted), "spm")
    rows = outputs.filter(parted)
    after = pc.utf8_slice_codeunits(rows, len(PREFIX))
    head, rest = halves(after, pc.if_else(first, PREFIX, SUFFIX))
    second, middle = halves(rest, pa.repeat(MIDDLE, len(rest)))
    prefix, suffix = pc.if_else(first, second, head), pc.if_else(first, head, second)
    whole = glued(prefix, middle, suffix)
    return pc.replace_with_mask(outputs, parted, whole)


def halves(rows: pa.Array, markers: pa.Array) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first occurrence of each row's marker."""
    before, after = rows, rows
    for marker in pc.unique(markers).to_pylist():
        mine = pc.equal(markers, marker)
        parts = pc.list_flatten(pc.split_pattern(rows.filter(mine), marker, max_splits=1))
        place = np.arange(len(parts)) % 2 == 0
        before = pc.replace_with_mask(before, mine, parts.filter(pa.array(place)))
        after = pc.replace_with_mask(after, mine, parts.filter(pa.array(~place)))
    return before, after


def with_restored(rows: DataFrame, name: str = "restored") -> DataFrame:
    """Rows of ``fill_in_middle`` with the text rebuilt from output and form alone."""
    at, form = rows.columns.index("output"), rows.columns.index("form")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            text = restored(batch.column(at), batch.column(form))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, name])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    return rows.mapInArrow(apply, f"{schema}, `{name}` string")


MIDDLE_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbers AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[25:32])::BIGINT AS h4
  FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM numbers
), parts AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
         array_to_string(u[b + 1:n], '') AS s
  FROM cuts
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                        ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
