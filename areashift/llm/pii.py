"""Personal data: candidate spans chosen by gradient-boosted trees.

DataFrame operations only, in the JVM throughout. *Generators* are patterns: the strict
ones, whose valid matches (the base) are always reported, and loose ones of high recall that
propose further, overlapping spans. *Trees* learn from all strict matches, valid ones
against those that fail their check, by features of format and context, with no feature
that names the pattern. *Thresholds* are calibrated for each kind on matches held out, at
the precision asked for. A loose span at or above the threshold of its kind that overlaps
no base span is reported too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areashift.llm.storage import prepared, stored

KINDS = ("email", "ip", "card", "phone")
#: Characters of context kept on either side of a span.
CONTEXT = 24
#: Every so many of the strict matches, by hash of the match, calibrate instead.
HELD_OUT = 4
PRECISION = 0.98
ROUNDS = 8


@dataclass(frozen=True)
class Generator:
    """A pattern for a kind, and a cheap condition that every match implies.

    Quantifiers are possessive, and a match starts at the start of its run of characters
    or where the last match ended, which finds the same matches in time linear in the text.
    """

    kind: str
    pattern: str
    needs: str
    strict: bool = True


LOCAL = "A-Za-z0-9._%+-"
GENERATORS = (
    Generator("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Generator("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}"),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    # loose
    Generator(
        "email",
        rf"(?<![{LOCAL}])[{LOCAL}]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++"
        r"(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[A-Za-z0-9-]++)++",
        r"(?i)[\[(]at[\])]",
        False,
    ),
    Generator("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":[0-9A-Fa-f]{1,4}:", False),
    Generator("card", r"(?<![0-9._/-])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9._/-])", r"[0-9]{4}[._/][0-9]{4}", False),
    Generator("phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[.-][0-9]{4}", False),
)

#: Words near a span that tell what it is, lower case.
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|server|host|address|login|adresse",
    "card": "card|visa|credit|pay|karte|tarjeta|carte|iban|account",
    "phone": "tel|phone|call|mobile|fax|ruf|llam|appel",
}


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(
        parts,
        lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
    )
    return (F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0) & (F.length(digits) > 0)


def largest_part(text: Column) -> Column:
    """The largest number between dots, as a double: parts may have any length."""
    parts = F.transform(F.split(text, r"\."), lambda p: F.coalesce(p.try_cast("double"), F.lit(-1.0)))
    return F.array_max(parts)


def valid(kind: Column, span: Column) -> Column:
    """The check that a strict match must pass."""
    n = F.length(digits_of(span))
    return (
        F.when(kind == "ip", largest_part(span) <= 255)
        .when(kind == "card", n.between(14, 19) & luhn(digits_of(span)))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(True)
    )


def matches(text: Column, generator: Generator) -> Column:
    """(found, between): the matches, and of the texts around them, one more than matches,
    length and both ends. Their lengths give the places of the matches."""
    pattern = F.lit(generator.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.transform(
        F.split(text, generator.pattern, -1),
        lambda part: F.struct(
            F.length(part).alias("gap"),
            F.right(part, F.lit(CONTEXT)).alias("left"),
            F.substring(part, 1, CONTEXT).alias("right"),
        ),
    )
    return F.when(text.rlike(generator.needs), F.struct(found.alias("found"), between.alias("between")))


def candidates(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every document with a row number, and the matches of every generator
    with start and end in code points, checks and context."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    found = docs.select(
        F.col(id_column).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        *[matches(text, g).alias(f"g{i}") for i, g in enumerate(GENERATORS)],
    )
    found = stored(found, "matches")
    each = F.array(
        *[
            F.struct(
                F.lit(i).alias("generator"), F.lit(g.kind).alias("kind"), F.lit(g.strict).alias("strict"),
                F.col(f"g{i}.found").alias("found"), F.col(f"g{i}.between").alias("between"),
            )
            for i, g in enumerate(GENERATORS)
        ]
    )
    some = F.greatest(*[F.size(F.coalesce(F.col(f"g{i}.found"), F.array())) for i in range(len(GENERATORS))])
    by_generator = found.where(some > 0).select("row", F.explode(each).alias("g")).select("row", "g.*")
    spans = by_generator.where(F.size("found") > 0).select(
        "row", "generator", "kind", "strict", "between", F.posexplode("found").alias("nth", "span")
    )
    at = F.element_at("between", F.col("nth") + 1)
    spans = spans.select(
        "row", "generator", "kind", "strict", "nth", "span",
        at["gap"].alias("gap"), at["left"].alias("left"),
        F.element_at("between", F.col("nth") + 2)["right"].alias("right"),
    )
    upto = Window.partitionBy("row", "generator").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("span")).over(upto)
    spans = spans.withColumn("end", end).withColumn("start", F.col("end") - F.length("span"))
    return found.select("id", "row"), spans.drop("gap", "nth").withColumn(
        "valid", F.col("strict") & valid(F.col("kind"), F.col("span"))
    )


FEATURES = ("digits", "length", "letters", "groups", "luhn", "largest", "cue", "any_cue", "left_glued", "right_glued", "lead")


def with_features(spans: DataFrame) -> DataFrame:
    """Format and context of a span as numbers."""
    span, digits = F.col("span"), digits_of(F.col("span"))
    around = F.lower(F.concat("left", F.lit(" "), "right"))
    cue = F.coalesce(
        *[F.when(F.col("kind") == k, around.rlike(f"\\b(?:{words})")) for k, words in CUES.items()]
    )
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return spans.withColumns(
        {
            "digits": number(F.length(digits)),
            "length": number(F.length(span)),
            "letters": number(F.length(F.regexp_replace(span, "[^A-Za-z]", ""))),
            "groups": number(F.size(F.split(span, "[^0-9A-Za-z]+"))),
            "luhn": number(luhn(digits)),
            "largest": F.when(F.col("kind") == "ip", F.least(F.coalesce(largest_part(span), F.lit(-1.0)), F.lit(1e6))).otherwise(-1.0),
            "cue": number(cue),
            "any_cue": number(around.rlike("\\b(?:" + "|".join(CUES.values()) + ")")),
            "left_glued": number(F.col("left").rlike(r"[\p{L}\p{N}_./=#-]$")),
            "right_glued": number(F.col("right").rlike(r"^[\p{L}\p{N}_/=#-]")),
            "lead": number(F.substring(digits, 1, 1).try_cast("int")),
        }
    )


def scored(spans: DataFrame, precision: float, rounds: int) -> DataFrame | None:
    """Loose spans with score and threshold; None where there is nothing to learn from."""
    featured = VectorAssembler(
        inputCols=[*FEATURES, *[f"is_{k}" for k in KINDS]], outputCol="features"
    ).transform(
        with_features(spans).withColumns({f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS})
    )
    place = F.xxhash64("kind", "span", "left", "right")
    labelled = featured.where("strict").select(
        F.col("valid").cast("double").alias("label"), "features", "kind", place.alias("place")
    )
    labelled = stored(labelled, "labelled").withColumn("held", F.pmod("place", F.lit(HELD_OUT)) == 0)
    classes = labelled.where("NOT held").select("label").distinct().count()
    if classes < 2:
        return None
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=3, seed=1, minInstancesPerNode=5
    ).fit(labelled.where("NOT held"))
    score = vector_to_array("probability")[1]
    tried = trees.transform(labelled.where("held")).select("kind", "label", (F.floor(100 * score) / 100).alias("score"))
    upward = Window.partitionBy("kind").orderBy(F.desc("score"))
    kept = tried.groupBy("kind", "score").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    share = F.sum("good").over(upward) / F.sum("n").over(upward)
    limits = (
        kept.withColumn("share", share).where(F.col("share") >= precision)
        .groupBy("kind").agg(F.min("score").alias("limit"))
    )
    loose = trees.transform(featured.where("NOT strict")).select("row", "kind", "start", "end", score.alias("score"))
    floor = F.greatest(F.col("limit"), F.lit(0.5))
    return loose.join(limits.withColumnRenamed("kind", "of"), F.col("kind") == F.col("of")).where(
        F.col("score") >= floor
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind in the fixed order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(
            ":", F.element_at(names, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string")
        ),
    )
    return F.coalesce(F.concat_ws(",", text), F.lit(""))


def find_personal_data(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    precision: float = PRECISION,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and hash are those of the base; ``spans`` lists base and added ones. Places are
    code points of the whole text, ends exclusive. A missing or empty text has none (the
    hash of an empty list is that of ''). Rows repeated in the table each get their own
    row. Further columns are not looked at.
    """
    prepared(docs.sparkSession)
    rows, spans = candidates(docs, id_column, text_column)
    spans = stored(spans, "spans")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    columns = ["row", "kind", "start", "end"]
    base = spans.where("valid").select(*columns, F.lit(True).alias("base"))
    added = scored(spans, precision, rounds)
    every = base
    if added is not None:
        inside = (
            (F.col("a.row") == F.col("b.row"))
            & (F.col("a.start") < F.col("b.end"))
            & (F.col("b.start") < F.col("a.end"))
        )
        added = added.alias("a").join(base.alias("b"), inside, "left_anti").select(*columns)
        every = base.unionByName(added.distinct().withColumn("base", F.lit(False)))
    place = F.struct("start", order.alias("order"), "end")
    per_row = every.groupBy(F.col("row").alias("__row")).agg(
        *[
            F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS
        ],
        F.collect_list(F.when(F.col("base"), place)).alias("base"),
        F.collect_list(place).alias("every"),
    )
    joined = rows.join(per_row, F.col("row") == F.col("__row"), "left")
    return joined.select(
        F.col("id").alias(id_column),
        *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("every")).alias("spans"),
    )
