"""Questions: where they begin on a page, their marks, their options and their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Patterns and maps down to DIGITS are fixed values.
START = r"(?iU)^\s*[\(\[]?\s*Q?\.?\s*(\d+)\s*[.\)\]:\s]"
PREFIX = START + r"\s*"
OPTION = r"(?U)^[\(\[]?\s*([AaBbCcDd]|[1-4]|[iI][iI][iI][iI]|[iI][iI][iI]|[iI][iI]|[iI][vV]|[iI])\s*[\)\].\s]\s*"
MARKS = r"(?iU)[\[\(]?\s*(\d+(?:\.\d+)?)\s*[Mm]ark"
INTEGER = r"(?iU)\b(integer|numerical|value of|answer is (an? )?integer|find the value)\b"
ASSERTION = r"(?iU)\b(assertion|reason|statement[- ]?(i|ii|1|2)|both.*statement)\b"
MULTI = r"(?iU)\b(one or more|correct option[s]?|may be correct|all.*correct|more than one)\b"
ROMAN = {"i": "a", "ii": "b", "iii": "c", "iv": "d"}
DIGITS = {"1": "a", "2": "b", "3": "c", "4": "d"}
LOOKED_AT, GAP = 3, 80


def question_number(texts: Column) -> Column:
    """The number that one of the first three texts begins with; null if none does, or beyond 64 bits."""
    found = F.filter(F.transform(F.slice(texts, F.lit(1), F.lit(LOOKED_AT)), lambda t: F.regexp_extract(t, START, 1)), lambda d: d != "")
    return F.get(found, F.lit(0)).try_cast("bigint")


def segment(regions: DataFrame) -> DataFrame:
    """Adds number and group_no to regions (page_id, reading_order, y1, y2, texts); 0 is what stands before any question.

    texts are a region's text blocks; null or empty ones drop the region, but its lower edge still counts for the gap.
    """
    order = Window.partitionBy("page_id").orderBy("reading_order")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = regions.withColumn("above", F.lag("y2").over(order)).where(F.size("texts") > 0).withColumn("number", question_number(F.col("texts")))
    started = F.coalesce(F.count("number").over(before), F.lit(0)) > 0
    breaks = seen.withColumn("opens", F.col("number").isNotNull() | (started & F.coalesce(F.col("y1") - F.col("above") > GAP, F.lit(False))))
    return breaks.withColumn("group_no", F.sum(F.col("opens").cast("long")).over(upto)).drop("above", "opens")


def strip_prefix(text: Column) -> Column:
    """The text without the question number it begins with; empty if that was all."""
    return F.when(text.rlike(PREFIX), strip(F.regexp_replace(text, PREFIX, ""))).otherwise(text)


def marks(text: Column) -> Column:
    return F.regexp_extract(text, MARKS, 1).try_cast("double")


def option_letter(text: Column) -> Column:
    """The option a text opens, a to d (iiii stays as it is); null if it opens none."""
    raw = F.lower(F.regexp_extract(strip(text), OPTION, 1))
    letters = F.create_map(*(F.lit(x) for pair in (ROMAN | DIGITS).items() for x in pair))
    return F.when(raw != "", F.coalesce(letters[raw], raw))


def question_type(text: Column, n_options: Column) -> Column:
    """The type by clues and options; unknown for a question without blocks (null text)."""
    return (
        F.when(text.isNull(), "unknown")
        .when(n_options >= 3, F.when(text.rlike(MULTI), "mcq_multi").otherwise("mcq_single"))
        .when(text.rlike(ASSERTION), "assertion_reason")
        .when(text.rlike(INTEGER), "integer")
        .when(n_options > 0, "mcq_single")
        .otherwise("subjective")
    )


def split_options(blocks: DataFrame) -> DataFrame:
    """(question_id, pos, option, value, opens) of blocks (question_id, pos, type, value); option is null before the first marker.

    A marker's remainder is a text of the option it opens; without one the marker's row has no value.
    """
    order = Window.partitionBy("question_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.withColumn("letter", F.when(F.col("type") == "text", option_letter(F.col("value"))))
    rest = strip(F.regexp_replace(strip(F.col("value")), OPTION, ""))
    return marked.select(
        "question_id", "pos", "type", F.last("letter", ignorenulls=True).over(order).alias("option"),
        F.when(F.col("letter").isNull(), F.col("value")).otherwise(F.nullif(rest, F.lit(""))).alias("value"), F.col("letter").isNotNull().alias("opens"),
    )


def parse_questions(blocks: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(question_id, number, marks, type, content, options) of blocks (question_id, pos, type, value).

    questions: (question_id) of all questions, if some have no blocks; their type is unknown.
    """
    order = Window.partitionBy("question_id").orderBy("pos")
    texts = F.sum((F.col("type") == "text").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = blocks.withColumn("lead", (F.col("type") == "text") & (texts == 1))
    number = F.when(F.col("lead"), F.regexp_extract("value", PREFIX, 1).try_cast("bigint"))
    bare = ranked.withColumn("number", number).withColumn("value", F.when(F.col("lead"), strip_prefix(F.col("value"))).otherwise(F.col("value")))
    kept = bare.where(~(F.col("lead") & F.col("number").isNotNull() & (F.col("value") == "")))
    numbers = bare.groupBy("question_id").agg(F.max("number").alias("number"), F.lit(True).alias("asked"))
    if questions is not None:
        numbers = questions.select("question_id").distinct().join(numbers, "question_id", "left")
    full = kept.where("type = 'text'").groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), " ").alias("full_text"))
    pieces = split_options(kept.select("question_id", "pos", "type", "value"))
    item = F.struct("pos", "value")
    grouped = pieces.groupBy("question_id", "option").agg(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), item))).alias("items"))
    values = F.transform("items", lambda x: x["value"])
    options = grouped.where("option IS NOT NULL").groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("option", values.alias("v"))))).alias("options"))
    content = grouped.where("option IS NULL").select("question_id", values.alias("content"))
    whole = numbers.join(full, "question_id", "left").join(content, "question_id", "left").join(options, "question_id", "left")
    count = F.coalesce(F.size(F.map_keys("options")), F.lit(0))
    text = F.when(F.col("asked"), F.coalesce("full_text", F.lit("")))
    return whole.select(
        "question_id", "number", marks(text).alias("marks"), question_type(text, count).alias("type"),
        F.coalesce("content", F.array().cast("array<string>")).alias("content"), "options",
    )
