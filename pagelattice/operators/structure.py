"""Recognised blocks to a structured document: sections, merged inline content, repaired references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INLINE = "array<struct<type:string,value:string,display:boolean>>"


def inline(blocks: Column) -> Column:
    """Text and formula blocks; a text joins the text before it with a space, across blocks that are left out."""

    def add(done: Column, b: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.lit("text").alias("type"), F.concat(last["value"], F.lit(" "), b["value"]).alias("value"), F.lit(None).cast("boolean").alias("display"))))
        text = F.array(F.struct(F.lit("text").alias("type"), b["value"].alias("value"), F.lit(None).cast("boolean").alias("display")))
        formula = F.array(F.struct(F.lit("latex").alias("type"), b["value"].alias("value"), F.coalesce(b["display"], F.lit(False)).alias("display")))
        joins = (b["type"] == "text") & (F.size(done) > 0) & (last["type"] == "text")
        return F.when(joins, merged).when(b["type"] == "text", F.concat(done, text)).when(b["type"] == "latex", F.concat(done, formula)).otherwise(done)

    return F.aggregate(blocks, F.array().cast(INLINE), lambda done, b: add(done, b).cast(INLINE))


def first_of(blocks: Column, kind: str) -> Column:
    """The first block of a kind, or null."""
    return F.get(F.filter(blocks, lambda b: b["type"] == kind), F.lit(0))


def leading_text(blocks: Column) -> Column:
    return F.coalesce(first_of(blocks, "text")["value"], F.lit(""))


def failed(error: Column, blocks: Column) -> Column:
    return F.coalesce(error != "", F.lit(False)) & (F.coalesce(F.size(blocks), F.lit(0)) <= 0)


def sections(blocks: DataFrame) -> DataFrame:
    """Adds node_type and section_id to blocks (page_id, block_id, reading_order, label, error, blocks).

    A title opens a section that later nodes of the page belong to; one that could not be read and is empty is an error
    and opens none. Blocks without a reading order come first, ties stand in the order of block_id.
    """
    bad = failed(F.col("error"), F.col("blocks"))
    kind = (
        F.when(bad, "error").when(F.col("label") == "figure", "image").when(F.col("label") == "table", "table").when(F.col("label") == "title", "section").otherwise("paragraph")
    )
    order = Window.partitionBy("page_id").orderBy(F.coalesce("reading_order", F.lit(0)), "block_id")
    typed = blocks.withColumn("node_type", kind)
    opened = F.last(F.when(F.col("node_type") == "section", F.col("block_id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return typed.withColumn("position", F.row_number().over(order) - 1).withColumn("section_id", F.when(F.col("node_type") == "section", F.lit(None)).otherwise(opened))


def node_id(page: Column, block: Column) -> Column:
    """An id that stays the same when a page is parsed again."""
    return F.substring(F.sha2(F.concat_ws("/", page.cast("string"), block.cast("string")), 256), 1, 32)


def structured(blocks: DataFrame) -> DataFrame:
    """(page_id, structured_content): each page's document as JSON, sections with their children."""
    b = F.col("blocks")
    image, table, latex = first_of(b, "image"), first_of(b, "table"), first_of(b, "latex")
    formula = F.array(F.struct(F.lit("latex").alias("type"), F.coalesce(latex["value"], F.lit("")).alias("value"), F.lit(True).alias("display"))).cast(INLINE)
    t = F.col("node_type")
    node = F.struct(
        node_id(F.col("page_id"), F.col("block_id")).alias("id"), t.alias("type"), F.array(F.col("block_id").cast("string")).alias("source_block_ids"),
        F.when(t == "paragraph", F.when(F.col("label") == "isolate_formula", formula).otherwise(inline(b))).alias("content"),
        F.when(t == "image", F.coalesce(image["url"], F.lit(""))).alias("url"), F.when(t == "image", F.coalesce(image["alt"], F.lit(""))).alias("alt"),
        F.when(t == "image", F.coalesce(image["width"], F.lit(0))).alias("width"), F.when(t == "image", F.coalesce(image["height"], F.lit(0))).alias("height"),
        F.when(t == "table", F.coalesce(table["rows"], F.lit(0))).alias("rows"), F.when(t == "table", F.coalesce(table["cols"], F.lit(0))).alias("cols"),
        F.when(t == "table", F.coalesce(table["cells"], F.array().cast("array<array<array<struct<type:string,value:string,display:boolean,url:string,alt:string,width:int,height:int,smiles:string>>>>"))).alias("cells"),
        F.when(t == "error", F.col("label")).alias("label"), F.when(t == "error", F.col("error")).alias("message"),
    )
    placed = sections(blocks).select("page_id", "position", "block_id", "section_id", "node_type", node.alias("node"), F.when(t == "section", inline(b)).alias("heading"))
    children = (
        placed.where("section_id IS NOT NULL").groupBy("page_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("position", "node"))).alias("c")).select("page_id", F.col("section_id").alias("block_id"), F.transform("c", lambda x: x["node"]).alias("children"))
    )
    top = placed.where("section_id IS NULL").join(children, ["page_id", "block_id"], "left")
    empty = F.slice(F.array("node"), F.lit(1), F.lit(0))
    whole = F.struct("position", F.struct("node.*", "heading", F.when(F.col("node_type") == "section", F.coalesce("children", empty)).alias("children")).alias("n"))
    pages = top.groupBy("page_id").agg(F.array_sort(F.collect_list(whole)).alias("t"))
    return pages.select("page_id", F.to_json(F.struct(F.lit(1).alias("version"), F.transform("t", lambda x: x["n"]).alias("nodes"))).alias("structured_content"))


def repair_table_sources(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """The k-th table node without a source gets the k-th table block that no node names.

    nodes: page_id, position, type, source_block_id (null: none). blocks: page_id, block_id, reading_order, label.
    """
    used = nodes.where("source_block_id IS NOT NULL").select("page_id", F.col("source_block_id").alias("block_id")).distinct()
    free = blocks.where("label = 'table' AND block_id IS NOT NULL").join(used, ["page_id", "block_id"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy(F.coalesce("reading_order", F.lit(0)), "block_id")))
    open_nodes = nodes.where("type = 'table' AND source_block_id IS NULL").withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("position")))
    matched = open_nodes.join(free.select("page_id", "k", "block_id"), ["page_id", "k"]).select("page_id", "position", "block_id")
    return nodes.join(matched, ["page_id", "position"], "left").select("page_id", "position", "type", F.coalesce("source_block_id", "block_id").alias("source_block_id"))


def not_parsed(pages: DataFrame) -> DataFrame:
    """Pages that have blocks and no stored structure: what a parse has yet to do."""
    return pages.where("structured_content IS NULL AND ocr_blocks IS NOT NULL")
