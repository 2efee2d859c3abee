"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and of its beginnings. Filters of several
widths run over the words of the whole text; the largest answer of each filter goes into a
logistic output. The model is fitted on all labelled rows outside fold 0: these are dealt
into shards of some million words, in every epoch each shard improves the model of the
epoch before, and the mean of what they found is the next one. Thresholds are calibrated
by language on the labelled rows that shards leave out, where the language of a text is
guessed from its own words, and are moved into the score, so that 0.5 is the threshold in
every language.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areashift.llm.storage import prepared, sent, stored
from areashift.llm.windows import BASES, Hashes
from areashift.session import free_scratch, scratch_made

#: Words of the rows that go into one shard, about; a shard is cut at twice as many.
SHARD_WORDS = 1 << 22
#: Every so many of the labelled rows, by hash of the id, calibrate thresholds instead.
CALIBRATE = 5
#: Thresholds lie between steps of the logit of one part in so many; counts are of all rows.
GRID = 1 << 10
#: Rows of a class that a language needs for a threshold of its own.
ENOUGH = 10
#: Folds of crc32(id); rows of fold 0 are never learned from.
FOLDS = 5

BUCKETS = 1 << 16
SIZE = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
BEGINNINGS = (4, 5)
EPOCHS = 6
BATCH = 64
#: Words convolved at once.
PIECE = 1 << 16
#: Embeddings that are averaged together.
BLOCK = 1 << 10

WORDLIKE = np.zeros(256, dtype=bool)
WORDLIKE[0x80:] = True
for _low, _high in (b"09", b"az"):
    WORDLIKE[_low : _high + 1] = True


def hashed_words(text: str | None) -> np.ndarray:
    """(words, 1 + beginnings) buckets of a text, lower-cased; empty for none."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), dtype=np.uint8)
    solid = np.zeros(len(raw) + 2, dtype=np.int8)
    solid[1:-1] = WORDLIKE[raw]
    edges = np.diff(solid)
    start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = Hashes(raw.astype(np.uint64) + np.uint64(1), BASES[0])
    ends = [stop, *(np.minimum(stop, start + n) for n in BEGINNINGS)]
    salted = [hashes.of(start, end) + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64) for i, end in enumerate(ends)]
    return np.stack([(h >> np.uint64(20)) % np.uint64(BUCKETS) for h in salted], axis=1).astype(np.int32)


@dataclass
class Model:
    """Embeddings, filters per width as (taps, SIZE, FILTERS), output weights, language
    profiles (buckets, languages) and a threshold (in logits) for each language."""

    embeddings: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    offset: float
    profiles: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.float64))

    def embed(self, words: np.ndarray) -> np.ndarray:
        return self.embeddings[words].sum(axis=1)

    def answers(self, embedded: np.ndarray) -> list[np.ndarray]:
        """Per width the filters' answers at every place; the text is followed by nothing."""
        out = []
        padded = np.vstack([embedded, np.zeros((max(WIDTHS), SIZE), dtype=embedded.dtype)])
        for filters, bias in zip(self.filters, self.biases):
            n = max(1, len(embedded))
            out.append(sum(padded[j : j + n] @ filters[j] for j in range(len(filters))) + bias)
        return out

    def pooled(self, words: np.ndarray) -> np.ndarray:
        """The largest answer of each filter over the whole text, piece by piece."""
        best = None
        for at in range(0, max(1, len(words)), PIECE):
            # a piece sees the first words of the next one
            part = self.embed(words[at : at + PIECE + max(WIDTHS) - 1])
            whole = np.concatenate([a[:PIECE].max(axis=0) for a in self.answers(part)])
            best = whole if best is None else np.maximum(best, whole)
        return best

    def winners(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(widths, FILTERS) each: the largest answers over the whole text and their places."""
        best, places = np.full((len(WIDTHS), FILTERS), -np.inf), np.zeros((len(WIDTHS), FILTERS), dtype=np.int64)
        for at in range(0, max(1, len(words)), PIECE):
            part = self.embed(words[at : at + PIECE + max(WIDTHS) - 1])
            answers = [a[:PIECE] for a in self.answers(part)]
            top = np.stack([a.max(axis=0) for a in answers])
            where = at + np.stack([a.argmax(axis=0) for a in answers])
            better = top > best
            best, places = np.where(better, top, best), np.where(better, where, places)
        return best, places

    def logit(self, words: np.ndarray) -> float:
        return float(np.tanh(self.pooled(words)) @ self.output + self.offset)

    def language(self, words: np.ndarray) -> int:
        if not len(words) or self.profiles.shape[1] < 2:
            return 0
        return int(np.argmax(self.profiles[words[:, 0]].sum(axis=0)))

    def score(self, words: np.ndarray) -> float:
        return float(sigmoid(self.logit(words) - self.thresholds[self.language(words)]))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def log_odds(seen: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How much likelier a bucket is in texts of label 1, as a smoothed log ratio, of the
    texts of each label that hold it and of all of them."""
    seen, totals = seen + 0.5, totals[:, None] + 1.0
    ratio = np.log(seen[1] / totals[1]) - np.log(seen[0] / totals[0])
    ratio[(seen.sum(axis=0) <= 3)] = 0
    return np.clip(ratio, -3, 3)


def language_profiles(seen: np.ndarray) -> np.ndarray:
    """Log probabilities of word buckets in each language, of how often it has them."""
    seen = seen + 0.1
    return np.log(seen / seen.sum(axis=0)).astype(np.float32)


def count_words(found: dict, words: np.ndarray, label: int, language: str) -> None:
    """Add a text to counts by (what, name): texts of its label that hold a bucket, and
    words of its language in a bucket."""
    for key, buckets in ((("label", str(label)), np.unique(words)), (("language", language), words[:, 0])):
        if key not in found:
            found[key] = np.zeros(BUCKETS, dtype=np.int64)
        np.add.at(found[key], buckets, 1)


@dataclass
class Learner:
    """A model, the weight of each label, and sums of squared gradients for AdaGrad."""

    model: Model
    weights: np.ndarray
    squares: list[np.ndarray]
    square_e: np.ndarray
    square_o: np.ndarray

    def small(self) -> np.ndarray:
        """All but the embeddings, as one array."""
        m = self.model
        return np.concatenate([np.ravel(x).astype(np.float64) for x in (*m.filters, *m.biases, m.output, m.offset, *self.squares, self.square_o)])

    def set_small(self, flat: np.ndarray) -> None:
        m, at = self.model, 0
        for x in (*m.filters, *m.biases, m.output, None, *self.squares, self.square_o):
            n = 1 if x is None else x.size
            if x is None:
                m.offset = float(flat[at])
            else:
                x[...] = flat[at : at + n].reshape(x.shape)
            at += n

    def epoch(self, number: int, texts: list[np.ndarray], labels: np.ndarray, seed: Iterable[int] = ()) -> None:
        """One pass over rows in shuffled batches, the same for the same rows."""
        draw = np.random.default_rng([7, number, *seed])
        rate = 0.1 / (1 + number)
        for at in np.array_split(draw.permutation(len(texts)), max(1, len(texts) // BATCH)):
            step(self.model, [texts[i] for i in at], labels[at], self.weights[labels[at]], rate, self.squares, self.square_e, self.square_o)


def begin(found: dict, totals: np.ndarray) -> tuple[Model, Learner | None]:
    """The model to start from, of counts as ``count_words`` has them and of the texts of
    each label, and its learner; None where there are not both labels to learn from.

    The first embedding dimension starts from log odds, the rest from small random
    numbers; only the places that won the pooling are changed.
    """
    draw = np.random.default_rng(7)
    none = np.zeros(BUCKETS, dtype=np.int64)
    seen = np.stack([found.get(("label", str(label)), none) for label in (0, 1)])
    names = sorted(name for what, name in found if what == "language")
    spoken = np.stack([found["language", n] for n in names] or [none], axis=1)
    embeddings = draw.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
    embeddings[:, 0] = log_odds(seen, totals) / 3 if totals.sum() else 0
    filters = [draw.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for bank in filters:
        bank[:, 0, : FILTERS // 2] = np.abs(bank[:, 0, : FILTERS // 2]) + 0.3
    biases = [np.full(FILTERS, -0.5, dtype=np.float32) for _ in WIDTHS]
    output = draw.normal(0, 0.3, FILTERS * len(WIDTHS))
    model = Model(embeddings, filters, biases, output, 0.0, language_profiles(spoken))
    if not totals.all():
        share = float(totals[1] / totals.sum()) if totals.sum() else 0.0
        model.output[:] = 0
        model.offset = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return model, None
    squares = [np.full_like(x, 1e-6) for x in (*model.filters, *model.biases)]
    weights = 0.5 * totals.sum() / totals
    return model, Learner(model, weights, squares, np.full_like(model.embeddings, 1e-4), np.full(len(model.output) + 1, 1e-6))


def fit(texts: list[np.ndarray], labels: np.ndarray, languages: list[str], epochs: int = EPOCHS) -> Model:
    """Train on rows at hand, as one shard."""
    found: dict = {}
    for words, label, language in zip(texts, labels, languages):
        count_words(found, words, int(label), language)
    model, learner = begin(found, np.array([(labels == 0).sum(), (labels == 1).sum()]))
    for number in range(epochs if learner else 0):
        learner.epoch(number, texts, labels)
    return model


def step(model, texts, labels, weight, rate, squares, square_e, square_o) -> None:
    """One batch of gradient descent."""
    pooled, places = zip(*[model.winners(words) for words in texts])
    hidden = np.tanh(np.array([p.ravel() for p in pooled]))
    error = (sigmoid(hidden @ model.output + model.offset) - labels) * weight / len(texts)
    down = (error[:, None] * model.output) * (1 - hidden**2)
    grad_o = np.append(hidden.T @ error, error.sum())
    square_o += grad_o**2
    change = rate * grad_o / np.sqrt(square_o)
    rows, grads = [], []
    for k, width in enumerate(WIDTHS):
        part = down[:, k * FILTERS : (k + 1) * FILTERS]
        grad_f = np.zeros_like(model.filters[k])
        for i, words in enumerate(texts):
            at = places[i][k]
            for j in range(width):
                inside = at + j < len(words)
                buckets = words[(at + j)[inside]]
                near = np.zeros((FILTERS, SIZE), dtype=np.float32)
                near[inside] = model.embed(buckets)
                grad_f[j] += near.T * part[i]
                back = (model.filters[k][j] * part[i]).T[inside]
                rows.append(buckets.ravel())
                grads.append(np.repeat(back, buckets.shape[1], axis=0))
        for x, g, s in ((model.filters[k], grad_f, squares[k]), (model.biases[k], part.sum(axis=0), squares[len(WIDTHS) + k])):
            s += g**2
            x -= (rate * g / np.sqrt(s)).astype(x.dtype)
    model.output -= change[:-1]
    model.offset -= float(change[-1])
    rows, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    total = np.zeros((len(rows), SIZE), dtype=np.float32)
    np.add.at(total, inverse, np.concatenate(grads).astype(np.float32))
    square_e[rows] += total**2
    model.embeddings[rows] -= rate * total / np.sqrt(square_e[rows])


def best_threshold(low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """The middle of the widest gap between steps, of least and largest logit and with rows of
    label 1 and 0, with the fewest errors."""
    order = np.argsort(low, kind="stable")
    low, high, ones, zeros = low[order], high[order], ones[order], zeros[order]
    wrong = np.concatenate([[0], np.cumsum(ones)]) + zeros.sum() - np.concatenate([[0], np.cumsum(zeros)])
    starts, stops = np.concatenate([[low[0] - 2], high]), np.concatenate([low, [high[-1] + 2]])
    at = int(np.argmax(np.where(wrong == wrong.min(), stops - starts, -1)))
    return float((starts[at] + stops[at]) / 2)


def calibrate(model: Model, steps: pa.Table) -> None:
    """Set a threshold for each guessed language; a language with few rows of a class takes
    that of all. ``steps``: language, low, high, ones, zeros."""
    n = model.profiles.shape[1]
    model.thresholds = np.zeros(n)
    language, low, high, ones, zeros = (steps[c].to_numpy() for c in ("language", "low", "high", "ones", "zeros"))
    if not ones.sum() or not zeros.sum():
        return
    # steps of several languages that overlap are one step
    same, at = np.unique(np.floor(low * GRID), return_inverse=True)
    least, most = np.full(len(same), np.inf), np.full(len(same), -np.inf)
    np.minimum.at(least, at, low)
    np.maximum.at(most, at, high)
    both = [np.bincount(at, x) for x in (ones, zeros)]
    model.thresholds[:] = best_threshold(least, most, *both)
    for k in range(n):
        own = language == k
        if min(ones[own].sum(), zeros[own].sum()) >= ENOUGH:
            model.thresholds[k] = best_threshold(low[own], high[own], ones[own], zeros[own])


def fold_of(id_column: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def unpacked(words: bytes) -> np.ndarray:
    return np.frombuffer(words, dtype=np.uint16).reshape(-1, 1 + len(BEGINNINGS))


def hashed_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (first column) as hashed words; further columns stay."""
    for batch in batches:
        words = [hashed_words(t).astype(np.uint16) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array([len(w) for w in words], pa.int64()), pa.array([w.tobytes() for w in words], pa.binary())],
            [*batch.schema.names[1:], "n", "words"],
        )


def word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of ``count_words`` over the rows of a task."""

    def rows(found: dict) -> Iterator[pa.RecordBatch]:
        for (what, name), counts in found.items():
            (at,) = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([what] * len(at), pa.string()), pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])],
                ["what", "name", "bucket", "n"],
            )

    found: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            count_words(found, unpacked(row["words"]), row["label"], row["language"])
            if len(found) > 64:  # bounds a task's memory
                yield from rows(found)
                found = {}
    yield from rows(found)


def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard, or per part of one with too many words, of rows in their order."""
    key, part, total, labels, sizes, words = None, 0, 0, [], [], []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"shard": key, "part": part, "labels": bytes(labels), "sizes": np.array(sizes, dtype=np.int64).tobytes(), "words": b"".join(words)}],
            pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("labels", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())]),
        )

    for batch in batches:
        for r in batch.to_pylist():
            if labels and (total >= 2 * SHARD_WORDS or r["shard"] != key):
                yield row()
                part = part + 1 if r["shard"] == key else 0
                total, labels, sizes, words = 0, [], [], []
            key = r["shard"]
            total += r["n"]
            labels.append(r["label"])
            sizes.append(r["n"])
            words.append(r["words"])
    if labels:
        yield row()


def improve(learner: Learner, number: int, shard: dict) -> Iterator[dict]:
    """An epoch over a shard: rows of block, rows of the shard, buckets and their values. Block
    -1 is all but the embeddings; of these and their squares go those that were changed."""
    own = copy.deepcopy(learner)
    labels = np.frombuffer(shard["labels"], dtype=np.int8).astype(np.int64)
    ends = np.cumsum(np.frombuffer(shard["sizes"], dtype=np.int64))
    texts = np.split(unpacked(shard["words"]), ends[:-1])
    own.epoch(number, texts, labels, (shard["shard"], shard["part"]))
    place = {"shard": shard["shard"], "part": shard["part"], "weight": float(len(labels))}
    yield {"block": -1, **place, "buckets": b"", "values": own.small().tobytes()}
    (changed,) = np.nonzero((own.square_e != learner.square_e).any(axis=1))
    for at in np.split(changed, np.flatnonzero(np.diff(changed // BLOCK)) + 1):
        if len(at):
            values = np.concatenate([own.model.embeddings[at], own.square_e[at]], axis=1).astype(np.float32)
            yield {"block": int(at[0]) // BLOCK, **place, "buckets": at.astype(np.int32).tobytes(), "values": values.tobytes()}


IMPROVED = "block int, shard long, part int, weight double, buckets binary, values binary"


def averaged(table: pa.Table) -> pa.Table:
    """The mean of a block over the shards that changed a bucket, by their rows. Shards are
    added in one order, so that results do not depend on how they were dealt."""
    table = table.sort_by([("shard", "ascending"), ("part", "ascending")])
    block, rows = table["block"][0].as_py(), zip(*(table[c].to_pylist() for c in ("weight", "buckets", "values")))
    if block < 0:
        found = [(w, np.frombuffer(v)) for w, _, v in rows]
        mean = sum(w * v for w, v in found) / sum(w for w, _ in found)
        buckets, values = b"", mean.tobytes()
    else:
        total, weight = np.zeros((BLOCK, 2 * SIZE)), np.zeros(BLOCK)
        for w, b, v in rows:
            at = np.frombuffer(b, dtype=np.int32) - block * BLOCK
            total[at] += w * np.frombuffer(v, dtype=np.float32).reshape(-1, 2 * SIZE)
            weight[at] += w
        (at,) = np.nonzero(weight)
        buckets = (at + block * BLOCK).astype(np.int32).tobytes()
        values = (total[at] / weight[at, None]).astype(np.float32).tobytes()
    return pa.table({"block": pa.array([block], pa.int32()), "buckets": [buckets], "values": [values]})


def next_epoch(spark: SparkSession, learner: Learner, number: int, dealt: DataFrame) -> None:
    """Let every shard improve the learner, which takes the mean. An action."""
    shared = sent(spark, learner)  # its size is fixed

    def improved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = shared()
        names = [c.split()[0] for c in IMPROVED.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
        for batch in batches:
            for shard in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(improve(learner, number, shard)), pa.schema(list(zip(names, kinds))))

    means = dealt.mapInArrow(improved, IMPROVED).groupBy("block").applyInArrow(averaged, "block int, buckets binary, values binary")
    for r in means.collect():  # the model, whatever the rows
        if r["block"] < 0:
            learner.set_small(np.frombuffer(r["values"]))
        else:
            at, values = np.frombuffer(r["buckets"], dtype=np.int32), np.frombuffer(r["values"], dtype=np.float32).reshape(-1, 2 * SIZE)
            learner.model.embeddings[at], learner.square_e[at] = values[:, :SIZE], values[:, SIZE:]


def logit_steps(spark: SparkSession, model: Model, held: DataFrame) -> pa.Table:
    """Rows of each label by guessed language and step of the logit, of all rows. An action."""
    shared = sent(spark, model)

    def logits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            texts = [unpacked(w) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.language(t) for t in texts], pa.int32()), pa.array([model.logit(t) for t in texts], pa.float64())],
                ["label", "language", "logit"],
            )

    found = held.select("label", "words").mapInArrow(logits, "label int, language int, logit double")
    return found.groupBy("language", F.floor(F.col("logit") * GRID).alias("step")).agg(
        F.min("logit").alias("low"), F.max("logit").alias("high"),
        F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros"),
    ).toArrow()


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    label_column: str = "toxic",
) -> Model:
    """Fit on the whole texts of all labelled rows that are not of fold 0. An action.

    One in ``CALIBRATE`` of them calibrates instead. The driver gets only counts and
    parameters of the model, whose size does not depend on the rows.
    """
    spark = prepared(docs.sparkSession)
    before = set(scratch_made())
    usable = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (fold_of(F.col("id")) != 0))
        .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other").drop("other")
    )
    texts = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.coalesce(F.col(language_column).cast("string"), F.lit("")).alias("language")
    ).where(F.col("id").isNotNull() & (fold_of(F.col("id")) != 0))
    # merged at any size: the ids grow with the rows
    marked = texts.join(usable.hint("merge"), "id").select(
        "text", F.xxhash64("id", "text").alias("place"), (F.pmod(F.xxhash64("id"), F.lit(CALIBRATE)) == 0).alias("held"),
        F.col("label").cast("int").alias("label"), "language",
    )
    rows = stored(marked.mapInArrow(hashed_rows, "place long, held boolean, label int, language string, n long, words binary"), "hashed")

    learned, held = rows.where("NOT held"), rows.where("held")
    sizes = {r["label"]: r for r in learned.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    totals = np.array([sizes[k]["rows"] if k in sizes else 0 for k in (0, 1)])
    counts = learned.select("label", "language", "words").mapInArrow(word_counts, "what string, name string, bucket int, n long")
    counts = counts.groupBy("what", "name", "bucket").agg(F.sum("n").alias("n")).toArrow()
    found: dict = {}
    for key in counts.group_by(["what", "name"]).aggregate([("bucket", "list"), ("n", "list")]).to_pylist():
        found[key["what"], key["name"]] = own = np.zeros(BUCKETS, dtype=np.int64)
        own[key["bucket_list"]] = key["n_list"]

    model, learner = begin(found, totals)
    if learner:
        profiles, model.profiles = model.profiles, model.profiles[:0]  # shards need none
        n = -(-sum(r["n"] for r in sizes.values()) // SHARD_WORDS) or 1
        dealt = learned.select(F.pmod("place", F.lit(n)).alias("shard"), "place", "label", "n", "words")
        dealt = dealt.repartition("shard").sortWithinPartitions("shard", "place")
        dealt = stored(dealt.select("shard", "label", "n", "words").mapInArrow(shards, "shard long, part int, labels binary, sizes binary, words binary"), "shards")
        for number in range(EPOCHS):
            next_epoch(spark, learner, number, dealt)
        model.profiles = profiles
        calibrate(model, logit_steps(spark, model, held))
    else:
        model.thresholds = np.zeros(model.profiles.shape[1])
    free_scratch(spark, [p for p in scratch_made() if p not in before])
    return model


def score_toxicity(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Whole texts are scored; an empty or missing text gets the score of no words. Rows
    repeated in the table get a row each. A missing id belongs to the fold of ''.
    """
    prepared(docs.sparkSession)
    shared = sent(docs.sparkSession, model)  # its size is fixed

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            found = [model.score(hashed_words(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(x >= 0.5) for x in found], pa.int32())],
                [id_column, "held_out", "score", "predicted"],
            )

    return docs.select(
        F.col(id_column).cast("long").alias("id"), (fold_of(F.col(id_column)) == 0).alias("held"), F.col(text_column).cast("string").alias("text")
    ).mapInArrow(scores, f"`{id_column}` long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The documents scored below 0.5, all their columns, in one pass over the rows."""
    prepared(docs.sparkSession)
    shared = sent(docs.sparkSession, model)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
            yield batch.filter(pa.array([model.score(hashed_words(t)) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
