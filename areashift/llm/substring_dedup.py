"""Substring deduplication: drop the words of windows that occur again anywhere.

Count-min prefilter: every partition sketches its windows through the anchors that stand
for them, the merged sketch overestimates how often each occurs, and a second pass groups
exactly, and only, the windows estimated to be repeated (``areashift.llm.windows``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from areashift.llm.windows import (
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
    word_units,
)

WINDOW = 35
GRAM = 12


def drop_repeated_words(text: bytes, spans: list[dict]) -> dict:
    _, starts, stops = word_units(text)
    gone = mask_of(len(starts), spans)
    kept = np.flatnonzero(~gone)
    body = b" ".join([text[a:b] for a, b in zip(starts[kept].tolist(), stops[kept].tolist())])
    return {
        "n_words": len(starts),
        "n_removed": int(gone.sum()),
        "kept_sha256": sha256(body),
        "kept": body.decode("utf-8", "replace"),
    }


def substring_dedup(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept.

    A word goes when some window of ``window`` words over it occurs again, in the same or
    another document; windows are judged on the input. Texts shorter than a window, empty
    or missing keep all words. Rows repeated in the table are copies of each other like
    any others. Further columns are not looked at.
    """
    spec = Spec(True, window, min(gram, window))
    texts = start(docs, id_column, text_column)
    runs = repeated_runs(texts, spec)
    classes = run_classes(runs)
    mixed = classes.where("kinds > 1 AND members = 1")
    rivals = classes.where("kinds > 1")
    contents = class_contents(texts, rivals, spec)
    single = counted_windows(contents, spec).join(
        mixed.select("anchor", "before", "windows", "one", "two"),
        ["anchor", "before", "windows", "one", "two"],
        "left_semi",
    )
    spans = whole_spans(classes, spec).unionByName(single)
    return cut(
        texts,
        text_spans(runs, spans),
        id_column,
        drop_repeated_words,
        "n_words long, n_removed long, kept_sha256 string, kept string",
    )
