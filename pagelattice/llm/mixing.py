"""Mixing sources to target weights with a low-discrepancy schedule.

A schedule of slots is drawn from the van der Corput sequence: slot k stands at the bit-reversed fraction of k, which
the cumulative slots due to the sources map to a source. The r-th slot of a source takes the r-th of the source's blocks,
which cut its shuffled documents into runs of equally many words; after the last block the source begins again, at most
MOST_EPOCHS times. The words of a block are chosen for each source by its target, so that a small source beside large
ones has slots enough too; a source whose target is short of FEW blocks of the least size has blocks of one word, and as
many slots as words in its target. Ranks and running sums are two-level (sums of chunks, then rows within a chunk), so a source that
holds a third of all rows is still worked on by many tasks.

Nulls and oddities: a null text has no words and is taken 0 times; documents without a source are one source, last in
order; a repeated row is another document; documents with equal shuffling keys are ordered by doc_id and size; a very long
text is a document of many blocks, whose words are counted whole; an empty table gives an empty table. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Words in a block: at most so many, and few enough that the schedule has about LEAST_SLOTS slots.
BLOCK_WORDS = 4096
LEAST_SLOTS = 50_000
#: The least such block, slots a source has unless its blocks are already that small, and fewest slots it may have then.
SMALL_BLOCK, SOURCE_SLOTS, FEW = 16, 4096, 128
#: Bits of a slot number that are reversed, and cells in which cumulative weights are looked up.
BITS = 48
CELLS = 4096


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, h): words of each document and its place in the shuffle."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(shared.WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id").alias("h"),
    )


def targets(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, sid, source_size, target) of rows (source, size): one row a source.

    The caps are met in the order of cap over weight: the first source whose cap lies above its share of what the
    capped ones before it leave over isn't capped, nor is any after it.
    """
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*(F.lit(float(w)) for w in weights))
    listed = per.withColumn("sid", F.row_number().over(by_name).cast("long") - 1).withColumn(
        "weight", F.get(ws, (F.col("sid") % len(weights)).cast("int"))
    )
    listed = listed.withColumn("most", MOST_EPOCHS * F.col("source_size").cast("double"))
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    every = Window.partitionBy(F.lit(0))
    filled = (
        listed.withColumn("pool", share * F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("pool") - F.col("capped")) / F.col("left"))
        .withColumn("open", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "sid", "level"))).over(every))
    )
    return filled.select(
        "source", "sid", "source_size", F.coalesce(F.least("most", F.col("open.level") * F.col("weight")), F.col("most")).alias("target")
    )


def _chunk_rows(n: int) -> int:
    return max(500, math.isqrt(max(n, 1)))


def with_blocks(sources: DataFrame, block_words: int) -> DataFrame:
    """targets() with the words of a source's block, at most block_words, its blocks and the slots due to it."""
    fine = F.greatest(F.lit(min(SMALL_BLOCK, block_words)), F.floor(F.col("target") / SOURCE_SLOTS))
    block = F.when(F.col("target") < FEW * SMALL_BLOCK, 1).otherwise(F.least(F.lit(block_words), fine)).cast("long")
    return sources.withColumn("block_words", block).withColumns(
        {"blocks": F.ceil(F.col("source_size") / F.col("block_words")), "due": F.col("target") / F.col("block_words")}
    )


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(sid, block, times): how often the slots take each block, of with_blocks()."""
    whole = Window.orderBy("sid")
    bounds = (
        sources.withColumn("all", F.sum("due").over(Window.partitionBy(F.lit(0))))
        .withColumn("hi", F.sum("due").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
        .where("due > 0")
        .select("sid", ((F.col("hi") - F.col("due")) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi"), "blocks")
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    )
    chunk = _chunk_rows(slots)
    points = sources.sparkSession.range(slots).select(
        F.col("id").alias("k"),
        (F.conv(F.reverse(F.lpad(F.bin("id"), BITS, "0")), 2, 10).cast("double") / float(1 << BITS)).alias("u"),
    )
    drawn = (
        points.withColumn("cell", F.floor(F.col("u") * CELLS))
        .join(bounds, "cell")
        .where("u >= lo AND u < hi")
        .select("k", "sid", "blocks", F.floor(F.col("k") / chunk).alias("chunk"))
    )
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n")).select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = drawn.withColumn("i", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("k")) - 1).join(base, ["sid", "chunk"])
    # the schedule gives a source its slots but for a few; where a slot is one word, they are made up to the target
    words = sources.where("block_words = 1").select("sid", "blocks", F.round("due").cast("long").alias("most"))
    drawn_words = ranked.groupBy("sid").agg(F.count("*").alias("n"))
    missing = (
        words.join(drawn_words, "sid", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .where("n < most")
        .select("sid", "blocks", "most", F.explode(F.sequence(F.col("n"), F.col("most") - 1)).alias("rank"))
    )
    kept = ranked.join(F.broadcast(words.select("sid", "most")), "sid", "left").select("sid", "blocks", "most", (F.col("base") + F.col("i")).alias("rank"))
    return (
        kept.unionByName(missing)
        .where(F.col("rank") < F.coalesce("most", MOST_EPOCHS * F.col("blocks")))
        .groupBy("sid", (F.col("rank") % F.col("blocks")).alias("block"))
        .agg(F.count("*").alias("times"))
    )


def mix(docs: DataFrame, block_words: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of rows (doc_id, source, text)."""
    rows = shared.cut(sized(docs, seed), "sizes")
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    pool = math.ceil(SHARE * facts["words"])
    block_words = block_words or max(SMALL_BLOCK, min(BLOCK_WORDS, pool // LEAST_SLOTS))
    sources = shared.cut(with_blocks(targets(rows), block_words), "sources")
    slots = math.ceil(round(sources.agg(F.sum("due")).first()[0] or 0, 6))
    buckets = max(1, facts["n"] // _chunk_rows(facts["n"]))
    own = rows.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    own = own.withColumn("b", F.least(F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * buckets), F.lit(buckets - 1)))
    before = Window.partitionBy("sid").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("sid", "b").agg(F.sum("size").alias("n")).select("sid", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        own.where("size > 0")
        .withColumn("run", F.sum("size").over(inside))
        .join(base, ["sid", "b"])
        .withColumn("start", F.col("base") + F.col("run") - F.col("size"))
        .select("doc_id", "source", "size", "source_size", "target", "sid", "start", "block_words")
    )
    block = F.explode(F.sequence(F.floor(F.col("start") / F.col("block_words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words"))))
    parts = placed.withColumn("block", block).withColumn(
        "words",
        F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words")) - F.greatest("start", F.col("block") * F.col("block_words")),
    )
    taken = (
        parts.join(schedule(sources, slots), ["sid", "block"], "left")
        .groupBy("sid", "start", "doc_id", "source", "size", "source_size", "target")
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        .drop("sid", "start")
    )
    return taken.unionByName(own.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents mixed; each row's words, its source's words and target, and the words the mix takes of it."""
    return mix(shared.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, to the nearest whole number of times; the rest go.

    Rows with one id and source are taken equally often. The columns stay as they are, whatever their names.
    """
    doc_id, source, n, copy = (shared.private(c, docs) for c in ("mix_id", "mix_source", "mix_times", "mix_copy"))
    times = mix(docs).groupBy("doc_id", "source").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken")).where("size > 0")
    times = times.select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), F.round(F.col("taken") / F.col("size")).cast("int").alias(n)).where(F.col(n) > 0)
    return (
        docs.join(times, docs["doc_id"].eqNullSafe(times[doc_id]) & docs["source"].eqNullSafe(times[source]))
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
        .select(*docs.columns)
    )
