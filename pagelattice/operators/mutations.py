"""Changes as functions of state and change: each returns the new state as a plan, and writes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import figure_urls, strip
from .folders import under
from .library import file_type, status_rollup


def append(state: DataFrame, rows: DataFrame) -> DataFrame:
    return state.unionByName(rows, allowMissingColumns=True)


def states(change: DataFrame, column: str) -> Column:
    """Whether a row of a change states a column: one that its array `fields` names; without one, one that isn't null."""
    if column not in change.columns:
        return F.lit(False)
    return F.coalesce(F.array_contains("fields", F.lit(column)), F.lit(False)) if "fields" in change.columns else F.col(column).isNotNull()


def latest_fields(change: DataFrame, key: list[str], columns: list[str], order: str | None = None) -> DataFrame:
    """key, at_<c> and new_<c> for each of columns that change has: the last value stated for it, wrapped in a struct, and its place.

    A row states the columns that its array `fields` names, nulls among them; without one, those that aren't null. Rows of
    a key are ordered by the column `order`, then by value. A field that no row states has a null struct.
    """
    rank = F.col(order) if order else F.lit(0)
    aggs = []
    for c in (c for c in columns if c in change.columns):
        there = states(change, c)
        at = F.when(there, F.struct(rank.alias("rank"), F.col(c).cast("string").alias("tie")))
        aggs += [F.max_by(F.struct(F.col(c).alias("value")), at).alias(f"new_{c}"), F.max(F.when(there, rank)).alias(f"at_{c}")]
    return change.groupBy(*key).agg(*aggs) if aggs else change.select(*key).distinct()


def _with_latest(c: str, latest: DataFrame) -> Column:
    return F.when(F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}")["value"]).otherwise(F.col(c)).alias(c) if f"new_{c}" in latest.columns else F.col(c)


def update(state: DataFrame, change: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of state with the last value that change states for each column; see latest_fields. Rows with other keys are left out."""
    latest = latest_fields(change, [key], [c for c in state.columns if c != key], order)
    return state.join(latest, key, "left").select(*(_with_latest(c, latest) for c in state.columns))


def soft_delete(docs: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    marked = docs.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    when = F.when(F.col("hit") & F.col("deleted_at").isNull(), F.lit(at).cast(docs.schema["deleted_at"].dataType))
    return marked.withColumn("deleted_at", when.otherwise(F.col("deleted_at"))).select(*docs.columns)


def restore(docs: DataFrame, ids: DataFrame) -> DataFrame:
    marked = docs.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return marked.withColumn("deleted_at", F.when(F.col("hit").isNull(), F.col("deleted_at"))).select(*docs.columns)


def hard_delete(docs: DataFrame, pages: DataFrame, activity: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and their pages without ids; activities stay and lose the document."""
    gone = ids.select("id").distinct()
    kept_pages = pages.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti").select(*pages.columns)
    marked = activity.join(gone.select(F.col("id").alias("document_id"), F.lit(True).alias("hit")), "document_id", "left")
    loose = marked.withColumn("document_id", F.when(F.col("hit").isNull(), F.col("document_id"))).select(*activity.columns)
    return docs.join(gone, "id", "left_anti").select(*docs.columns), kept_pages, loose


PAGE_KEY = ["document_id", "page_number"]
#: What a new page has where nothing is stated; fixed values. Lists are empty.
PAGE_DEFAULTS = {"session_id": "", "image_w": 0, "image_h": 0, "status": "idle", "structure_status": "none"}
PAGE_LISTS = ("layout_blocks", "ocr_blocks", "placed_images")


def _default(pages: DataFrame, c: str) -> Column:
    kind = pages.schema[c].dataType
    if c in PAGE_LISTS:
        return F.lit("[]") if isinstance(kind, T.StringType) else F.array().cast(kind)
    return F.lit(PAGE_DEFAULTS.get(c)).cast(kind)


def upsert_pages(pages: DataFrame, change: DataFrame, order: str | None = None) -> DataFrame:
    """Pages with the last value that change states for each column, and a page for each new (document_id, page_number).

    What change doesn't state stays as it is, and is its default in a new page: idle, without structure, lists empty; see latest_fields. A page
    whose blocks are stated after the last statement of its structure loses its structure.
    """
    fields = [c for c in pages.columns if c not in PAGE_KEY]
    latest = latest_fields(change.where("document_id IS NOT NULL AND page_number IS NOT NULL"), PAGE_KEY, fields, order)
    merged = pages.withColumn("there", F.lit(True)).join(latest, PAGE_KEY, "full_outer")
    merged = merged.withColumns({c: F.when(F.col("there"), F.col(c)).otherwise(_default(pages, c)) for c in fields})
    out = merged.select(*(F.col(c) if c in PAGE_KEY else _with_latest(c, latest) for c in pages.columns), *(F.col(c) for c in ("at_ocr_blocks", "at_structured_content") if c in latest.columns))
    if "at_ocr_blocks" in out.columns and "structured_content" in pages.columns:
        stale = F.col("at_ocr_blocks").isNotNull()
        if "at_structured_content" in out.columns:
            stale &= F.col("at_structured_content").isNull() | (F.col("at_structured_content") < F.col("at_ocr_blocks"))
        out = out.withColumn("structured_content", F.when(~stale, F.col("structured_content")))
        if "structure_status" in pages.columns:
            out = out.withColumn("structure_status", F.when(stale, "none").otherwise(F.col("structure_status")))
    return out.select(*pages.columns)


def dropped_figures(pages: DataFrame, change: DataFrame, order: str | None = None) -> DataFrame:
    """(document_id, page_number, url): figures that a save of blocks no longer refers to, of the page's blocks right before it.

    Saves are taken in their order, after what pages have; a save that states the structure too drops nothing.
    """
    rank = F.col(order) if order else F.lit(0)
    empty = F.lit(None).cast("string")
    saved = change.where(states(change, "ocr_blocks")).select(*PAGE_KEY, rank.alias("rank"), F.col("ocr_blocks").cast("string").alias("blocks"), states(change, "structured_content").alias("whole"))
    old = pages.join(saved.select(*PAGE_KEY).distinct(), PAGE_KEY, "left_semi").select(*PAGE_KEY, F.lit(None).cast(saved.schema["rank"].dataType).alias("rank"), F.col("ocr_blocks").cast("string").alias("blocks"), F.lit(True).alias("whole"))
    turn = Window.partitionBy(*PAGE_KEY).orderBy(F.col("rank").asc_nulls_first(), "blocks")
    pairs = old.unionByName(saved).withColumn("before", F.coalesce(F.lag("blocks").over(turn), empty)).where("NOT whole")
    return pairs.select(*PAGE_KEY, F.explode(F.array_except(figure_urls(F.col("before")), figure_urls(F.col("blocks")))).alias("url")).distinct()


def invalidate_structure(pages: DataFrame) -> DataFrame:
    """Clears the structure of pages whose blocks changed without a new structure.

    pages: new_blocks, new_structure (null: not part of the change), structured_content, structure_status.
    """
    stale = F.col("new_blocks").isNotNull() & F.col("new_structure").isNull()
    return pages.withColumns(
        {
            "structured_content": F.when(~stale, F.coalesce("new_structure", "structured_content")),
            "structure_status": F.when(stale, "none").otherwise(F.col("structure_status")),
        }
    )


def save_pages(docs: DataFrame, pages: DataFrame, change: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New pages, documents with their status rolled up, and an activity for each one that is now complete.

    Pages are saved as upsert_pages says; changes of documents that aren't there are left out.
    """
    known = change.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(*change.columns)
    merged = upsert_pages(pages, known, order)
    rolled = status_rollup(docs, merged)
    new_docs = docs.join(rolled.select("id", "new_status"), "id").withColumn("status", F.col("new_status")).select(*docs.columns)
    done = rolled.where("completed").select(F.col("id").alias("document_id"), F.lit("ocr_completed").alias("action"))
    return merged, new_docs, done


def delete_page(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages without gone (document_id, page_number), numbered on without gaps.

    A document's only page stays; if all its pages are named, the one with the highest number does.
    """
    document = Window.partitionBy("document_id")
    marked = pages.join(gone.select(*PAGE_KEY).distinct().withColumn("hit", F.lit(True)), PAGE_KEY, "left")
    marked = marked.withColumns({"left": F.count_if(F.col("hit").isNull()).over(document), "last": F.max("page_number").over(document)})
    return renumber(marked.where("hit IS NULL OR left = 0 AND page_number = last").select(*pages.columns))


def delete_pages(docs: DataFrame, pages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their new page counts, and pages: of blank documents alone, pages can be deleted."""
    blank = docs.where("file_type = 'blank'").select(F.col("id").alias("document_id"))
    kept = delete_page(pages, gone.join(blank, "document_id", "left_semi"))
    touched = gone.join(blank, "document_id", "left_semi").select("document_id").distinct()
    counts = kept.join(touched, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").cast("int").alias("new_count"))
    counted = docs.join(counts.withColumnRenamed("document_id", "id"), "id", "left").withColumn("page_count", F.coalesce("new_count", "page_count"))
    return counted.select(*docs.columns), kept


def renumber(pages: DataFrame) -> DataFrame:
    """Pages numbered from 1 in their order."""
    order = Window.partitionBy("document_id").orderBy("page_number", *(c for c in ("id", "status") if c in pages.columns))
    return pages.withColumn("page_number", F.row_number().over(order)).select(*pages.columns)


def toggle_star(docs: DataFrame, ids: DataFrame) -> DataFrame:
    marked = docs.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return marked.withColumn("is_starred", F.when(F.col("hit"), ~F.col("is_starred")).otherwise(F.col("is_starred"))).select(*docs.columns)


def replace_tags(tags: DataFrame, change: DataFrame) -> DataFrame:
    """Links with those of the changed documents replaced; a change row with a null tag only clears."""
    kept = tags.join(change.select("document_id").distinct(), "document_id", "left_anti").select(*tags.columns)
    return kept.unionByName(change.where("tag IS NOT NULL").select(*tags.columns).distinct())


def delete_folders(folders: DataFrame, docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders without ids and what lies under them, however deep; documents in them go to the root."""
    gone = under(folders, ids)
    marked = docs.join(gone.select(F.col("id").alias("folder_id"), F.lit(True).alias("hit")), "folder_id", "left")
    loose = marked.withColumn("folder_id", F.when(F.col("hit").isNull(), F.col("folder_id"))).select(*docs.columns)
    return folders.join(gone, "id", "left_anti").select(*folders.columns), loose


def _known(folders: DataFrame, column: str) -> DataFrame:
    return folders.select(F.col("id").alias(column), F.lit(True).alias("known")).distinct()


def create_documents(docs: DataFrame, pages: DataFrame, activity: DataFrame, folders: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, pages and activities with those of new (id, filename, file_type, page_count, file_size, folder_id, created_at).

    A row of type blank has one idle page, no bytes and the name Untitled if it has none; the type of others follows from
    their filename. A folder that isn't there is left out. Null ids and ids that are there already add nothing; of rows that repeat an
    id the least counts.
    """
    fields = [c for c in new.columns if c != "id"]
    fresh = new.where("id IS NOT NULL").join(docs.select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.min(F.struct(*fields)).alias("r")).select("id", "r.*")
    blank = F.coalesce(F.col("file_type") == "blank", F.lit(False))
    made = fresh.join(_known(folders, "folder_id"), "folder_id", "left").select(
        "id", F.when(blank, F.coalesce(F.nullif("filename", F.lit("")), F.lit("Untitled"))).otherwise(F.col("filename")).alias("filename"),
        F.lit("uploaded").alias("status"), F.when(blank, 1).otherwise(F.coalesce("page_count", F.lit(0))).alias("page_count"),
        F.when(blank, 0).otherwise(F.coalesce("file_size", F.lit(0))).alias("file_size"), F.when(blank, "blank").otherwise(file_type(F.col("filename"))).alias("file_type"),
        F.when(F.col("known"), F.col("folder_id")).alias("folder_id"), F.lit(False).alias("is_starred"), "created_at",
    )
    page = made.where("file_type = 'blank'").select(F.col("id").alias("document_id"), F.lit(1).alias("page_number"), F.lit("idle").alias("status"))
    said = made.select(F.col("id").alias("document_id"), F.lit("uploaded").alias("action"), "created_at")
    return append(docs, made.select(*(c for c in made.columns if c in docs.columns))), append(pages, page), append(activity, said)


def move(docs: DataFrame, change: DataFrame, folders: DataFrame) -> DataFrame:
    """Documents in the folders that change (id, folder_id) names, null being the root.

    A move to a folder that isn't there is left out; of several moves of a document the one to the greatest folder id counts, to the root last.
    """
    wanted = change.select("id", F.col("folder_id").alias("to")).join(_known(folders, "to"), "to", "left").where("known OR to IS NULL")
    moves = wanted.groupBy("id").agg(F.max("to").alias("to"), F.lit(True).alias("hit"))
    return docs.join(moves, "id", "left").withColumn("folder_id", F.when(F.col("hit"), F.col("to")).otherwise(F.col("folder_id"))).select(*docs.columns)


def create_folders(folders: DataFrame, new: DataFrame) -> DataFrame:
    """Folders with new ones (id, name, parent_id), names stripped.

    Rows without a name or an id, with an id that is there or with a parent that isn't add nothing; of rows that share an id the least
    name counts, then the least parent.
    """
    named = new.withColumn("name", strip(F.col("name"))).where("name <> '' AND id IS NOT NULL").join(_known(folders, "parent_id"), "parent_id", "left")
    fresh = named.where("known OR parent_id IS NULL").join(folders.select("id").distinct(), "id", "left_anti")
    first = fresh.groupBy("id").agg(F.min(F.struct("name", "parent_id")).alias("r"))
    return append(folders, first.select("id", "r.name", "r.parent_id"))


def save_folders(folders: DataFrame, change: DataFrame, order: str | None = None) -> DataFrame:
    """Folders with the names and parents that change states (see latest_fields); rows with a parent that isn't there are left out."""
    parents = change.join(_known(folders, "parent_id"), "parent_id", "left").where("known OR parent_id IS NULL").select(*change.columns)
    return update(folders, parents.withColumn("name", strip(F.col("name"))), "id", order)


def create_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Tags with new ones (id, name, color), names stripped, gray if no colour is given.

    Rows without a name or an id, or with one that a tag has, add nothing; of rows that share an id the least name counts, then of rows that
    share a name the least id.
    """
    named = new.withColumn("name", strip(F.col("name"))).where("name <> '' AND id IS NOT NULL")
    fresh = named.join(tags.select("name").distinct(), "name", "left_anti").join(tags.select("id").distinct(), "id", "left_anti")
    one = fresh.groupBy("id").agg(F.min(F.struct("name", "color")).alias("r")).select("id", "r.name", "r.color")
    first = one.groupBy("name").agg(F.min(F.struct("id", "color")).alias("r"))
    return append(tags, first.select("r.id", "name", F.coalesce("r.color", F.lit("gray")).alias("color")))


def save_tags(tags: DataFrame, change: DataFrame, order: str | None = None) -> DataFrame:
    """Tags with the names and colours that change states (see latest_fields), names stripped.

    A blank name is left out, and so is one that another tag has or would get: names stay unique.
    """
    named = change.withColumn("name", F.nullif(strip(F.col("name")), F.lit(""))) if "name" in change.columns else change
    if "fields" in named.columns and "name" in named.columns:
        named = named.withColumn("fields", F.when(F.col("name").isNull(), F.array_remove("fields", "name")).otherwise(F.col("fields")))
    after = update(tags, named, "id", order).select("id", F.col("name").alias("after"), "color")
    both = tags.select("id", "name").join(after, "id")
    # a name is free for a tag if no other has it now or after the change
    wanted = both.where("after <> name").select("id", "after")
    held = both.select(F.col("id").alias("other"), F.explode(F.array_distinct(F.array("name", "after"))).alias("after"))
    taken = wanted.join(held, "after").where("id <> other").select("id").distinct().withColumn("taken", F.lit(True))
    out = both.join(taken, "id", "left").withColumn("name", F.when(F.col("taken"), F.col("name")).otherwise(F.col("after")))
    return out.select(*tags.columns)


def delete_tags(tags: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags and links (document_id, tag_id) without the tags of ids."""
    gone = ids.select("id").distinct()
    return tags.join(gone, "id", "left_anti").select(*tags.columns), links.join(gone.withColumnRenamed("id", "tag_id"), "tag_id", "left_anti").select(*links.columns)
