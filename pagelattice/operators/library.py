"""Document library: listing, filters, folders and tags, storage and activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import isoformat, strip

#: Extensions of image files; fixed values.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tiff", "tif", "bmp", "webp", "gif")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STORAGE_LIMIT = 100 * 1024**3


def file_type(filename: Column) -> Column:
    """pdf, image or other, by what stands after the last point."""
    ext = F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1))).otherwise("")
    return F.when(ext == "pdf", "pdf").when(ext.isin(*IMAGE_EXTENSIONS), "image").otherwise("other")


def search(docs: DataFrame, tags: DataFrame | None = None, *, deleted: bool = False, folder: str | None = None, starred: bool | None = None, tag: str | None = None, text: str | None = None, ids: str | None = None) -> DataFrame:
    """Documents under the filters that are given; a filter left out isn't part of the plan.

    text is matched anywhere in the filename, letters A to Z in either case; ids is a list with commas.
    """
    out = docs.where(F.col("deleted_at").isNotNull() if deleted else F.col("deleted_at").isNull())
    if folder:
        out = out.where(F.col("folder_id") == folder)
    if starred:
        out = out.where("is_starred")
    if tag is not None and tags is not None:
        out = out.join(tags.where(F.col("tag") == tag).select(F.col("document_id").alias("id")), "id", "left_semi")
    if text and text.strip():
        out = out.where(F.contains(F.translate("filename", UPPER, LOWER), F.translate(F.lit(text.strip()), UPPER, LOWER)))
    if ids is not None and (wanted := [i.strip() for i in ids.split(",") if i.strip()]):
        out = out.where(F.col("id").cast("string").isin(wanted))
    return out


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(
        F.count_if(F.col("status") == "layout-detected").alias("pages_layout_done"), F.count_if(F.col("status") == "ocr-complete").alias("pages_ocr_done")
    )


def listing(docs: DataFrame, pages: DataFrame, tags: DataFrame) -> DataFrame:
    """A row a document with its tags and page counts; both sides are aggregated before they are joined."""
    tag_lists = tags.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))
    return (
        docs.join(page_counts(pages).withColumnRenamed("document_id", "id"), "id", "left")
        .join(tag_lists.withColumnRenamed("document_id", "id"), "id", "left")
        .select(
            "id", "filename", "status", "page_count", "folder_id", "is_starred", "file_size", file_type(F.col("filename")).alias("file_type"),
            F.coalesce("tags", F.lit("")).alias("tags"),
            F.coalesce("pages_layout_done", F.lit(0)).alias("pages_layout_done"), F.coalesce("pages_ocr_done", F.lit(0)).alias("pages_ocr_done"),
        )
    )


def media_url(path: Column, base: str) -> Column:
    """The absolute URL of a stored file; null without one."""
    return F.when(path != "", F.concat(F.lit(base.rstrip("/") + "/media/"), path))


def rows(docs: DataFrame, pages: DataFrame, links: DataFrame, base: str) -> DataFrame:
    """A document as a list shows it, 16 fields; docs: thumbnail and pdf_file besides, links: (document_id, tag_id)."""
    tags = links.groupBy("document_id").agg(F.array_sort(F.collect_set(F.col("tag_id").cast("string"))).alias("tag_ids"))
    joined = docs.join(page_counts(pages).withColumnRenamed("document_id", "id"), "id", "left").join(tags.withColumnRenamed("document_id", "id"), "id", "left")
    return joined.select(
        F.col("id").cast("string").alias("id"), "filename", "page_count", "status",
        media_url(F.col("thumbnail"), base).alias("thumbnail_url"), media_url(F.col("pdf_file"), base).alias("pdf_url"),
        isoformat(F.col("created_at")).alias("created_at"), isoformat(F.col("updated_at")).alias("updated_at"),
        "is_starred", F.col("folder_id").cast("string").alias("folder_id"), F.coalesce("tag_ids", F.array().cast("array<string>")).alias("tag_ids"),
        "file_size", "file_type", isoformat(F.col("deleted_at")).alias("deleted_at"),
        F.coalesce("pages_layout_done", F.lit(0)).alias("pages_layout_done"), F.coalesce("pages_ocr_done", F.lit(0)).alias("pages_ocr_done"),
    )


def detail(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """A row a document with its pages as an array of (page_number, status), in order."""
    own = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "status"))).alias("pages"))
    return docs.join(own.withColumnRenamed("document_id", "id"), "id", "left").withColumn(
        "pages", F.coalesce("pages", F.array().cast("array<struct<page_number:int,status:string>>"))
    )


def page_detail(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, page_number, status) for each page asked for; one that isn't there is idle."""
    return wanted.join(pages, ["document_id", "page_number"], "left").withColumn("status", F.coalesce("status", F.lit("idle")))


#: JSON texts that count as nothing; fixed values.
NOTHING = ("", "null", "[]", "{}", '""', "0", "0.0", "false")


def or_empty(c: Column) -> Column:
    """A JSON list, or an empty one for null and for what counts as nothing."""
    return F.when(c.isNull() | strip(c).isin(*NOTHING), "[]").otherwise(c)


def page_payload(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """A page as it is shown, for each (document_id, page_number) asked for: lists are never null. A page that isn't there is idle, has no
    blocks, and nothing else of it is known."""
    lists = ("layout_blocks", "ocr_blocks", "placed_images")
    there = pages.select("document_id", "page_number", *("session_id", "image_w", "image_h", "status"), *(or_empty(F.col(c)).alias(c) for c in lists))
    out = wanted.select("document_id", "page_number").join(there.withColumn("there", F.lit(True)), ["document_id", "page_number"], "left")
    absent = F.col("there").isNull()
    return out.withColumns({"layout_blocks": F.when(absent, "[]").otherwise(F.col("layout_blocks")), "status": F.when(absent, "idle").otherwise(F.col("status"))}).drop("there")


def folder_counts(folders: DataFrame, docs: DataFrame) -> DataFrame:
    """Live documents of each folder; a folder without any counts 0."""
    live = docs.where("deleted_at IS NULL").groupBy("folder_id").agg(F.count("id").alias("n"))
    return folders.join(live, folders["id"] == live["folder_id"], "left").select(folders["id"], "name", "parent_id", F.coalesce("n", F.lit(0)).alias("document_count"))


def tag_counts(tags: DataFrame, docs: DataFrame) -> DataFrame:
    """Live documents of each tag; a tag without any counts 0."""
    live = docs.where("deleted_at IS NULL").select(F.col("id").alias("live_id"))
    return tags.join(live, tags["document_id"] == live["live_id"], "left").groupBy("tag").agg(F.count("live_id").alias("document_count"))


def storage_summary(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: live documents, their bytes, and their pages with text."""
    live = docs.where("deleted_at IS NULL")
    total = live.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("used_bytes"))
    read = pages.where("status = 'ocr-complete'").join(live.select(F.col("id").alias("document_id")), "document_id", "left_semi").agg(F.count("*").alias("ocr_pages"))
    both = total.unionByName(read, allowMissingColumns=True)  # one row each, made one
    return both.agg(*(F.max(c).alias(c) for c in ("file_count", "used_bytes", "ocr_pages"))).withColumn("limit_bytes", F.lit(STORAGE_LIMIT))


def storage_by_type(docs: DataFrame) -> DataFrame:
    """Live documents by file type with their share in whole percent, halves to even."""
    counts = docs.where("deleted_at IS NULL").groupBy(file_type(F.col("filename")).alias("file_type")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over three rows at most
    return counts.select("file_type", "n", F.bround(F.col("n") / total * 100).cast("int").alias("percent"))


def status_rollup(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, old_status, new_status, completed): the documents' status by their pages; without progress it stays."""
    done = pages.groupBy("document_id").agg(
        F.count_if(F.col("status") == "ocr-complete").alias("read"), F.count_if(F.col("status").isin("layout-detected", "ocr-complete")).alias("seen")
    )
    joined = docs.join(done, docs["id"] == done["document_id"], "left")
    read, seen = F.coalesce("read", F.lit(0)), F.coalesce("seen", F.lit(0))
    new = F.when((F.col("page_count") > 0) & (read == F.col("page_count")), "complete").when(seen > 0, "partial").otherwise(F.col("status"))
    return joined.select("id", F.col("status").alias("old_status"), new.alias("new_status")).withColumn(
        "completed", (F.col("old_status") != "complete") & (F.col("new_status") == "complete")
    )


def recent_activity(activity: DataFrame, limit: int = 10) -> DataFrame:
    """The latest rows, at most 50; a report of the newest, so its limit is its meaning."""
    return activity.orderBy(F.desc("created_at"), F.desc("id")).limit(min(limit, 50))


def last_page(pages: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """The number the next page of each document gets; of docs (id), if given, also of those without pages: 1."""
    known = pages.groupBy("document_id").agg((F.coalesce(F.max("page_number"), F.lit(0)) + 1).alias("next_page"))
    if docs is None:
        return known
    return docs.select(F.col("id").alias("document_id")).join(known, "document_id", "left").withColumn("next_page", F.coalesce("next_page", F.lit(1)))


def ordered(df: DataFrame, entity: str) -> DataFrame:
    """An entity's rows in its default order, with ties settled by id."""
    keys = {"folder": ["name", "id"], "tag": ["name", "id"], "document": [F.desc("created_at"), "id"], "page": ["page_number", "id"], "activity": [F.desc("created_at"), "id"]}
    return df.orderBy(*keys[entity])


def duplicate_names(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """Names that can't be given to a tag since one has it."""
    return wanted.join(tags.select("name").distinct(), "name", "left_semi")


def with_usable_session(pages: DataFrame) -> DataFrame:
    return pages.where("session_id IS NOT NULL AND session_id <> ''")
