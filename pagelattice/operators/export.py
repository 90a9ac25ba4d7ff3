"""Rendering: column trees, HTML, Markdown, annotation lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html, fixed6, strip

#: Training classes, group colours; fixed values.
CLASSES = {"title": 0, "plain_text": 1, "figure": 2, "table": 3, "isolate_formula": 4}
COLOURS = {"plain_text": "#4f8ef7", "title": "#a78bfa", "isolate_formula": "#f59e0b", "table": "#22c55e", "figure": "#f43f5e"}


def _lookup(c: Column, table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]


def class_of(label: Column) -> Column:
    """The training class of a label; null for labels that aren't trained on."""
    return _lookup(label, CLASSES)


def column_tree(blocks: DataFrame) -> DataFrame:
    """(page_id, column_idx, x1, y1, x2, y2, groups): each column's box and its blocks in reading order.

    blocks: page_id, column_idx, reading_order, block_id, label, x1, y1, x2, y2, blocks.
    """
    item = F.struct("reading_order", "block_id", "label", "blocks")
    return blocks.groupBy("page_id", "column_idx").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sort_array(F.collect_list(item)).alias("groups")
    )


def page_tree(columns: DataFrame) -> DataFrame:
    """(page_id, columns): a page's columns from left to right."""
    return columns.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("column_idx", "groups"))).alias("columns"))


def _simple_html(b: Column, base: str) -> Column:
    t, value = b["type"], escape_html(b["value"])
    url = F.when(b["url"].startswith("http"), b["url"]).otherwise(F.concat(F.lit(base.rstrip("/")), b["url"]))
    return (
        F.when(t == "text", F.concat(F.lit("<span>"), value, F.lit("</span> ")))
        .when((t == "latex") & F.coalesce(b["display"], F.lit(False)), F.concat(F.lit('<div class="b-latex-display">$$'), value, F.lit("$$</div>")))
        .when(t == "latex", F.concat(F.lit('<span class="b-latex-inline">$'), value, F.lit("$</span>")))
        .when(t == "image", F.concat(F.lit('<img src="'), url, F.lit('" alt="'), escape_html(b["alt"]), F.lit('" style="max-width:100%;display:block;margin:6px 0"/>')))
        .otherwise("")
    )


def block_html(b: Column, base: str = "/") -> Column:
    def row(cells: Column, i: Column) -> Column:
        tag = F.when(i == 0, "th").otherwise("td")
        inner = lambda cell: F.array_join(F.transform(cell, lambda x: _simple_html(x, base)), "")
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<"), tag, F.lit(">"), inner(c), F.lit("</"), tag, F.lit(">"))), ""), F.lit("</tr>"))

    rows = F.array_join(F.transform(F.coalesce(b["cells"], F.slice(b["cells"], 1, 0)), row), "")
    table = F.concat(F.lit('<table style="border-collapse:collapse;width:100%">'), F.coalesce(rows, F.lit("")), F.lit("</table>"))
    return F.when(b["type"] == "table", table).otherwise(_simple_html(b, base))


def group_html(g: Column, base: str = "/") -> Column:
    tag = F.when(g["label"] == "title", "h2").otherwise("div")
    colour = F.coalesce(_lookup(g["label"], COLOURS), F.lit("#888"))
    inner = F.array_join(F.transform(g["blocks"], lambda b: block_html(b, base)), "")
    return F.concat(
        F.lit("<"), tag, F.lit(' class="content-group" data-label="'), g["label"], F.lit('" style="border-left:3px solid '), colour,
        F.lit(';padding:8px 12px;margin:6px 0">'), inner, F.lit("</"), tag, F.lit(">"),
    )


def page_html_body(columns: Column, base: str = "/") -> Column:
    """What stands in the body: two columns or more are a grid."""
    style = F.when(F.size(columns) >= 2, "display:grid;grid-template-columns:1fr 1fr;gap:16px;").otherwise("")
    inside = F.transform(columns, lambda c: F.concat(F.lit('<div class="column">'), F.array_join(F.transform(c["groups"], lambda g: group_html(g, base)), ""), F.lit("</div>")))
    return F.concat(F.lit('<div style="'), style, F.lit('">'), F.array_join(inside, ""), F.lit("</div>"))


#: The page around the body: formulas are rendered in the browser; fixed values.
HEAD = """<!DOCTYPE html>
<html lang="en">
<head>
<meta charset="UTF-8"/>
<meta name="viewport" content="width=device-width,initial-scale=1"/>
<title>Extracted Document</title>
<link rel="stylesheet" href="https://cdn.jsdelivr.net/npm/katex@0.16.10/dist/katex.min.css"/>
<script defer src="https://cdn.jsdelivr.net/npm/katex@0.16.10/dist/katex.min.js"></script>
<script defer src="https://cdn.jsdelivr.net/npm/katex@0.16.10/dist/contrib/auto-render.min.js"
  onload="renderMathInElement(document.body,{delimiters:[
    {left:'$$',right:'$$',display:true},
    {left:'$',right:'$',display:false}
  ]})"></script>
<style>
  body{font-family:-apple-system,BlinkMacSystemFont,"Segoe UI",sans-serif;
        max-width:960px;margin:0 auto;padding:24px;line-height:1.6;}
  .column{min-width:0;}
  h2.content-group{font-size:1.1em;}
  .b-latex-display{overflow-x:auto;padding:8px 0;text-align:center;}
  table td,table th{border:1px solid #ddd;padding:5px 8px;}
  table tr:first-child th{background:#f5f5f5;}
</style>
</head>
<body>
"""


def page_html(columns: Column, base: str = "/") -> Column:
    return F.concat(F.lit(HEAD), page_html_body(columns, base), F.lit("\n</body>\n</html>"))


def _simple_md(b: Column) -> Column:
    t = b["type"]
    return (
        F.when(t == "text", b["value"])
        .when((t == "latex") & F.coalesce(b["display"], F.lit(False)), F.concat(F.lit("\n$$\n"), b["value"], F.lit("\n$$\n")))
        .when(t == "latex", F.concat(F.lit("$"), b["value"], F.lit("$")))
        .when(t == "image", F.concat(F.lit("!["), F.coalesce(F.nullif(b["alt"], F.lit("")), F.lit("image")), F.lit("]("), b["url"], F.lit(")")))
        .otherwise("")
    )


def block_md(b: Column) -> Column:
    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.array_join(F.transform(c, _simple_md), " ")), " | "), F.lit(" |"))

    def row(cells: Column, i: Column) -> Column:
        rule = F.concat(F.lit("\n| "), F.array_join(F.transform(cells, lambda _: F.lit("---")), " | "), F.lit(" |"))
        return F.when(i == 0, F.concat(line(cells), rule)).otherwise(line(cells))

    return F.when(b["type"] == "table", F.coalesce(F.array_join(F.transform(b["cells"], row), "\n"), F.lit(""))).otherwise(_simple_md(b))


def group_md(g: Column) -> Column:
    text = strip(F.array_join(F.filter(F.transform(g["blocks"], block_md), lambda p: p != ""), " "))
    return F.when(g["label"] == "title", F.concat(F.lit("\n## "), text, F.lit("\n"))).otherwise(F.concat(F.lit("\n"), text, F.lit("\n")))


def page_md(columns: Column) -> Column:
    """GitHub-flavoured Markdown; columns are named by a comment where there are several."""

    def column(c: Column) -> Column:
        groups = F.transform(c["groups"], group_md)
        return F.when(F.size(columns) > 1, F.concat(F.array(F.concat(F.lit("\n<!-- column "), c["column_idx"].cast("string"), F.lit(" -->\n"))), groups)).otherwise(groups)

    return F.concat(strip(F.array_join(F.flatten(F.transform(columns, column)), "\n")), F.lit("\n"))


def yolo_lines(blocks: DataFrame, image_w: int, image_h: int) -> DataFrame:
    """(page_id, det_idx, line): class, centre and size as shares of the image, for labels that are trained on."""
    w, h = F.lit(float(image_w)), F.lit(float(image_h))
    numbers = [(F.col("x1") + F.col("x2")) / 2 / w, (F.col("y1") + F.col("y2")) / 2 / h, (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h]
    return (
        blocks.withColumn("class_id", class_of(F.col("label")))
        .where("class_id IS NOT NULL")
        .select("page_id", "det_idx", F.concat_ws(" ", F.col("class_id").cast("string"), *(fixed6(x) for x in numbers)).alias("line"))
    )


def stem(document_id: Column, page_number: Column) -> Column:
    return F.concat(document_id.cast("string"), F.lit("_p"), page_number.cast("string"))
