"""Page saves as a stream: state by page, right for any order of arrival and any split into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import figure_urls
from ..operators.mutations import PAGE_DEFAULTS, PAGE_KEY, PAGE_LISTS, states

#: Columns of a page that saves may state, and what the stream emits for each page that a batch touches.
FIELDS = ("status", "ocr_blocks", "structured_content", "structure_status")
SAVE = "document_id long, page_number int, seq long, fields array<string>, " + ", ".join(f"{c} string" for c in FIELDS)
PAGE = "document_id long, page_number int, " + ", ".join(f"{c} string" for c in FIELDS) + ", dropped array<string>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state is kept on disk; a batch writes its changes and not all files of a store, and doesn't count the rows in it.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def saves(change: DataFrame, order: str) -> DataFrame:
    """A change of pages (see upsert_pages) as rows of the stream."""
    stated = F.filter(F.array(*(F.when(states(change, c), c) for c in FIELDS)), lambda c: c.isNotNull())
    column = lambda c: (F.col(c) if c in change.columns else F.lit(None)).cast("string").alias(c)
    return change.select(*(F.col(k).cast(t).alias(k) for k, t in zip(PAGE_KEY, ("long", "int"), strict=True)), F.col(order).cast("long").alias("seq"), stated.alias("fields"), *map(column, FIELDS))


def snapshot(pages: DataFrame) -> DataFrame:
    """Pages as they are before all saves, as rows of the stream."""
    return saves(pages.withColumn("no_seq", F.lit(None).cast("long")), "no_seq")


def _dropped(base: Column, stated: Column) -> Column:
    """The figures that saves of blocks (seq, blocks, whole) dropped, in order: of the blocks right before each, from the snapshot's on."""
    turns = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("seq"), base["ocr_blocks"].alias("blocks"), F.lit(True).alias("whole"))), F.sort_array(stated))
    figures = F.transform(turns, lambda t: F.struct(figure_urls(t["blocks"]).alias("urls"), t["whole"].alias("whole")))
    lost = lambda now, before: F.when(now["whole"], F.array().cast("array<string>")).otherwise(F.array_except(before["urls"], now["urls"]))
    pairs = F.zip_with(F.slice(figures, F.lit(2), F.size(figures)), F.slice(figures, F.lit(1), F.size(figures) - 1), lost)
    return F.sort_array(F.array_distinct(F.flatten(pairs)))


def folded(rows: DataFrame) -> DataFrame:
    """The stream of touched pages (document_id, page_number, FIELDS, dropped) of a stream of saves() and snapshot() rows; whole keys only.

    The state of a page is an aggregate: its row in the snapshot (the greatest, if there are several), the last statement of each field by number, then
    value, and the different saves of blocks. So a late save only replaces fields that no later one states and takes its place among the
    saves of blocks, and a save that comes twice counts once. It grows with a page's saves of blocks.
    """
    says = lambda c: F.coalesce(F.array_contains("fields", F.lit(c)), F.lit(False))
    save, blocks = F.col("seq").isNotNull(), F.struct("seq", F.col("ocr_blocks").alias("blocks"), says("structured_content").alias("whole"))
    held = rows.where("document_id IS NOT NULL AND page_number IS NOT NULL").groupBy(*PAGE_KEY).agg(
        F.max(F.when(~save, F.struct(*FIELDS))).alias("base"),
        *(F.max(F.when(save & says(c), F.struct("seq", F.col(c).alias("value")))).alias(f"last_{c}") for c in FIELDS),
        F.collect_set(F.when(save & says("ocr_blocks"), blocks)).alias("stated"),
    )
    at = lambda c: F.col(f"last_{c}")["seq"]
    stale = at("ocr_blocks").isNotNull() & (at("structured_content").isNull() | (at("structured_content") < at("ocr_blocks")))
    first = lambda c: F.when(F.col("base").isNotNull(), F.col("base")[c]).otherwise(F.lit("[]" if c in PAGE_LISTS else PAGE_DEFAULTS.get(c)))
    value = {c: F.when(at(c).isNotNull(), F.col(f"last_{c}")["value"]).otherwise(first(c)) for c in FIELDS}
    value |= {"structured_content": F.when(~stale, value["structured_content"]), "structure_status": F.when(stale, "none").otherwise(value["structure_status"])}
    return held.select(*PAGE_KEY, *(value[c].cast("string").alias(c) for c in FIELDS), _dropped(F.col("base"), F.col("stated")).alias("dropped"))


def fold_files(spark: SparkSession, source: str, target: str, checkpoint: str, files_in_batch: int = 1) -> None:
    """Folds the Parquet files of a folder batch by batch and writes touched pages with their batch's number; goes on where it ended before."""
    own = spark.newSession()  # the state store is a setting of the session
    for k, v in (STATE | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        own.conf.set(k, v)
    rows = own.readStream.schema(SAVE).option("maxFilesPerTrigger", files_in_batch).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")  # a batch that runs again replaces itself

    folded(rows).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_emitted(spark: SparkSession, target: str) -> DataFrame:
    """Each page as the newest batch that touched it left it."""
    rows = spark.read.schema(PAGE + ", batch long").parquet(target)
    fields = [c for c in rows.columns if c not in (*PAGE_KEY, "batch")]
    return rows.groupBy(*PAGE_KEY).agg(F.max_by(F.struct(*fields), "batch").alias("page")).select(*PAGE_KEY, "page.*")
