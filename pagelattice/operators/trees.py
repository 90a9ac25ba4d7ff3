"""Structured documents of any depth as tables of nodes: walked from the top, patched by id, put together from the leaves.

A document's JSON is a variant; a level's nodes are a table, their children the next one, written below the shared folder, so the plan
doesn't grow with the depth. No document is walked by one function call, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import store


def _kept(df: DataFrame) -> DataFrame:
    path = store.run_folder(df.sparkSession, "level")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _items(v: Column, key: str) -> Column:
    """The elements of an array under a key of a variant; null if there is none."""
    return F.try_variant_get(v, f"$.{key}", "array<variant>")


def levels(docs: DataFrame) -> list[DataFrame]:
    """For each depth the nodes (doc_id, path, node) of documents (doc_id, content), path being the places from the top down.

    content is JSON; what can't be read as JSON, and null, has no nodes. doc_id tells the rows apart.
    """
    top = docs.select("doc_id", F.posexplode(_items(F.try_parse_json("content"), "nodes")).alias("at", "node"))
    now = _kept(top.select("doc_id", F.array("at").alias("path"), "node"))
    out = []
    while not now.isEmpty():
        out.append(now)
        below = now.select("doc_id", "path", F.posexplode(_items(F.col("node"), "children")).alias("at", "node"))
        now = _kept(below.select("doc_id", F.concat("path", F.array("at")).alias("path"), "node"))
    return out


def walk(docs: DataFrame) -> DataFrame:
    """(doc_id, path, depth, id, type): every node; ordered by doc_id and path each one stands before its children."""
    field = lambda name: F.try_variant_get("node", f"$.{name}", "string").alias(name)
    parts = [n.select("doc_id", "path", (F.size("path") - 1).alias("depth"), field("id"), field("type")) for n in levels(docs)]
    if not parts:
        return docs.where("false").select("doc_id", F.array(F.lit(0)).alias("path"), F.lit(0).alias("depth"), F.lit("").alias("id"), F.lit("").alias("type"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _member(key: Column, text: Column) -> Column:
    return F.concat(F.to_json(key.cast("variant")), F.lit(":"), text)


def _object(fields: Column, key: str, inner: Column) -> Column:
    """The JSON of an object's fields, and behind them an array under a key unless that is null."""
    members = F.transform(F.map_entries(fields), lambda e: _member(e["key"], F.to_json(e["value"])))
    return F.concat(F.lit("{"), F.array_join(F.concat(members, F.when(inner.isNull(), F.array().cast("array<string>")).otherwise(F.array(_member(F.lit(key), F.concat(F.lit("["), inner, F.lit("]")))))), ","), F.lit("}"))


def _fields(v: Column, without: str, dropped: Column) -> Column:
    """The fields of an object but one that is put together anew; null if v is none."""
    return F.map_filter(v.try_cast("map<string, variant>"), lambda k, _: (k != without) | ~dropped)


def _joined(below: DataFrame) -> DataFrame:
    """(doc_id, path, inner) of children (doc_id, path, json): their JSON in order, under their parent's path."""
    place = F.struct(F.element_at("path", -1).alias("at"), "json")
    grouped = below.groupBy("doc_id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.array_sort(F.collect_list(place)).alias("c"))
    return grouped.select("doc_id", "path", F.array_join(F.transform("c", lambda c: c["json"]), ",").alias("inner"))


def with_s3_urls(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Documents with s3_url set on the image nodes that patches (doc_id, id, s3_url) name, at any depth.

    A document without such a node stays as it is, byte for byte; in another the keys of each object are sorted, s3_url and then children last. Of several URLs for one
    node the least counts.
    """
    wanted = patches.where("id IS NOT NULL AND s3_url IS NOT NULL").groupBy("doc_id", "id").agg(F.min("s3_url").alias("s3_url"))
    found = levels(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"))
    image = F.try_variant_get("node", "$.type", "string") == "image"
    marked = [n.withColumn("id", F.try_variant_get("node", "$.id", "string")).join(wanted, ["doc_id", "id"], "left").withColumn("s3_url", F.when(image, F.col("s3_url"))) for n in found]
    if not marked:
        return docs
    hits = marked[0].where("s3_url IS NOT NULL").select("doc_id")
    for m in marked[1:]:
        hits = hits.unionByName(m.where("s3_url IS NOT NULL").select("doc_id"))
    hits = _kept(hits.distinct())
    below = None
    for level in reversed(marked):
        own = level.join(hits, "doc_id", "left_semi")
        own = own.join(_joined(below), ["doc_id", "path"], "left") if below is not None else own.withColumn("inner", F.lit(None).cast("string"))
        inner = F.coalesce("inner", F.when(_items(F.col("node"), "children").isNotNull(), ""))
        patched = _fields(F.col("node"), "children", inner.isNotNull())
        patched = F.when(F.col("s3_url").isNull(), patched).otherwise(F.map_concat(F.map_filter(patched, lambda k, _: k != "s3_url"), F.create_map(F.lit("s3_url"), F.col("s3_url").cast("variant"))))
        below = _kept(own.select("doc_id", "path", F.coalesce(_object(patched, "children", inner), F.to_json("node")).alias("json")))
    tops = _joined(below).select("doc_id", "inner")
    rows = docs.join(tops, "doc_id", "left")
    whole = _object(_fields(F.try_parse_json("content"), "nodes", F.col("inner").isNotNull()), "nodes", F.col("inner"))
    return rows.withColumn("content", F.when(F.col("inner").isNull(), F.col("content")).otherwise(whole)).select(*docs.columns)
