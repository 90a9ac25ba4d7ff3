"""Table geometry and text: dividers, grids, cell types, annotation rectangles, pipe tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, normalize_cell, round_exact, split_row, strip
from .scan import scanned

CELL_PADDING, CELL_LEAST, TYPING_LEAST = 4, 32, 128
#: Annotation categories; fixed values.
CATEGORIES = {1: "table column header", 2: "table row", 3: "table column", 4: "table"}


def dividers(lines: DataFrame) -> DataFrame:
    """Adds (table_id, axis, i, divider): the middle between each row's or column's end and the next one's begin, as a share.

    lines: table_id, axis, lo, hi, dim, and idx by which equal begins go. A single line gives none.
    """
    order = Window.partitionBy("table_id", "axis").orderBy("lo", "idx" if "idx" in lines.columns else "hi")
    following = lines.withColumn("i", F.row_number().over(order) - 1).withColumn("next", F.lead("lo").over(order)).where("next IS NOT NULL")
    return following.select("table_id", "axis", "i", round_exact((F.col("hi") + F.col("next")) / 2.0 / F.col("dim"), 4).alias("divider"))


def boundaries(shares: Column, dim: Column) -> Column:
    """0, the dividers in pixels (halves to even) and the whole size."""
    return F.concat(F.array(F.lit(0)), F.transform(shares, lambda d: F.bround(d * dim).cast("int")), F.array(dim.cast("int")))


def even_dividers(n: Column) -> Column:
    """i / n for i from 1 to n - 1."""
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: i / n)).otherwise(F.array().cast("array<double>"))


def cell_types(n_rows: Column, n_cols: Column, header_rows: Column) -> Column:
    """The grid of initial types: header rows first."""
    row = lambda r: F.array_repeat(F.when(r <= header_rows, "header").otherwise("data"), n_cols)
    return F.transform(F.sequence(F.lit(1), n_rows), row)


def cell_type_at(types: Column, r: Column, c: Column) -> Column:
    return F.coalesce(F.get(F.get(types, r), c), F.lit("plain_text"))


def validity(present: Column, finalized: Column, n_rows: Column, n_cols: Column) -> Column:
    """Why a table can't be read, or null."""
    return (
        F.when(~F.coalesce(present, F.lit(False)), "table structure is missing")
        .when(~F.coalesce(finalized, F.lit(False)), "table structure is not finalized")
        .when((n_rows == 0) | (n_cols == 0), "table structure has no rows or columns")
    )


def grid(tables: DataFrame) -> DataFrame:
    """A row a cell with its padded, clamped crop and its scale; tables: table_id, rb, cb (boundaries), types, crop_w, crop_h."""
    cells = tables.select("*", F.posexplode(F.slice("rb", F.lit(1), F.size("rb") - 1)).alias("r", "top")).select("*", F.posexplode(F.slice("cb", F.lit(1), F.size("cb") - 1)).alias("c", "left"))
    placed = cells.select(
        "table_id", "r", "c", cell_type_at(F.col("types"), F.col("r"), F.col("c")).alias("cell_type"),
        F.greatest(F.lit(0), F.col("left") - CELL_PADDING).alias("x1"), F.greatest(F.lit(0), F.col("top") - CELL_PADDING).alias("y1"),
        F.least("crop_w", F.get("cb", F.col("c") + 1) + CELL_PADDING).alias("x2"), F.least("crop_h", F.get("rb", F.col("r") + 1) + CELL_PADDING).alias("y2"),
    )
    return placed.where("x2 > x1 AND y2 > y1").withColumn("scale", upscale(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), CELL_LEAST))


def upscale(w: Column, h: Column, least: int) -> Column:
    """By how much a crop grows so that neither side is under `least`."""
    return F.when((w < least) | (h < least), F.greatest(F.lit(least) / F.greatest(w, F.lit(1)), F.lit(least) / F.greatest(h, F.lit(1)), F.lit(1.0))).otherwise(1.0)


def regroup(cells: DataFrame) -> DataFrame:
    """(table_id, rows, cols, cells) of cells (table_id, r, c, content): the nested grid."""
    rows = cells.groupBy("table_id", "r").agg(F.array_sort(F.collect_list(F.struct("c", "content"))).alias("row"))
    whole = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("r", "row"))).alias("g"))
    nested = F.transform("g", lambda r: F.transform(r["row"], lambda c: c["content"]))
    return whole.select("table_id", F.size("g").alias("rows"), F.array_max(F.transform("g", lambda r: F.size(r["row"]))).alias("cols"), nested.alias("cells"))


def surest(candidates: DataFrame) -> DataFrame:
    """(cell_id, label) of candidates (cell_id, idx, label, confidence): the most confident, the first among equals."""
    return candidates.groupBy("cell_id").agg(F.max_by("label", F.struct("confidence", (-F.col("idx")).alias("o"))).alias("label"))


def annotations(tables: DataFrame) -> DataFrame:
    """Rectangles of edited tables (table_id, rb, cb, header_rows, crop_w, crop_h) with running image and annotation ids.

    Rows come first, then columns, then the table; ids follow table_id, and no task sees all rows (see scan).
    """
    kinds = F.concat(
        F.transform(F.sequence(F.lit(0), F.size("rb") - 2), lambda i: F.struct(
            F.when(i < F.col("header_rows"), 1).otherwise(2).alias("category_id"), F.lit(0).alias("x"), F.get("rb", i).alias("y"),
            F.col("crop_w").alias("w"), (F.get("rb", i + 1) - F.get("rb", i)).alias("h"))),
        F.transform(F.sequence(F.lit(0), F.size("cb") - 2), lambda j: F.struct(
            F.lit(3).alias("category_id"), F.get("cb", j).alias("x"), F.lit(0).alias("y"), (F.get("cb", j + 1) - F.get("cb", j)).alias("w"), F.col("crop_h").alias("h"))),
        F.array(F.struct(F.lit(4).alias("category_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("crop_w").alias("w"), F.col("crop_h").alias("h"))),
    )
    placed = scanned(tables.select("table_id", kinds.alias("a")), ["table_id"], {"before": F.size("a")})
    return placed.select(F.col("rank").alias("image_id"), "before", F.posexplode("a").alias("i", "a")).select(
        "image_id", (F.col("before") + F.col("i") + 1).alias("annotation_id"), "a.category_id", "a.x", "a.y", "a.w", "a.h", (F.col("a.w") * F.col("a.h")).alias("area"))


#: Labels of detected parts of a table, and the score above which they count; fixed values.
ROW, COLUMN, COLUMN_HEADER, PART_SCORE = "table row", "table column", "table column header", 0.7


def structure(crops: DataFrame, parts: DataFrame) -> DataFrame:
    """(table_id, row_dividers, col_dividers, header_rows, cell_types, source) of each crop (table_id, w, h).

    parts: table_id, idx (order of detection), label, score, x1, y1, x2, y2 as detected. Rows go by their top and columns by their left edge, equal ones as
    detected; dividers are the middles between one's end and the next one's begin. header_rows counts the boxes of the header, as
    their detection does. A crop without parts is one cell.
    """
    sure = parts.where(F.col("score") > PART_SCORE)
    row = F.col("label") == ROW
    lines = sure.where(row | (F.col("label") == COLUMN)).join(crops.select("table_id", "w", "h"), "table_id").select(
        "table_id", F.when(row, "row").otherwise("col").alias("axis"), "idx", F.when(row, F.col("y1")).otherwise(F.col("x1")).alias("lo"),
        F.when(row, F.col("y2")).otherwise(F.col("x2")).alias("hi"), F.when(row, F.col("h")).otherwise(F.col("w")).alias("dim"))
    split = lambda axis: F.transform(F.array_sort(F.collect_list(F.when(F.col("axis") == axis, F.struct("i", "divider")))), lambda d: d["divider"])
    divided = dividers(lines).groupBy("table_id").agg(split("row").alias("rows"), split("col").alias("cols"))
    headers = sure.where(F.col("label") == COLUMN_HEADER).groupBy("table_id").agg(F.count("*").cast("int").alias("n"))
    none = F.array().cast("array<double>")
    out = crops.select("table_id").join(divided, "table_id", "left").join(headers, "table_id", "left")
    out = out.select("table_id", F.coalesce("rows", none).alias("row_dividers"), F.coalesce("cols", none).alias("col_dividers"), F.coalesce("n", F.lit(0)).alias("header_rows"))
    return out.withColumns({"cell_types": cell_types(F.size("row_dividers") + 1, F.size("col_dividers") + 1, F.col("header_rows")), "source": F.lit("tatr")})


def tsv(lines: Column) -> Column:
    """Lines of a pipe table as tab-separated rows, without separators and blank lines."""
    rows = F.filter(F.transform(lines, strip), lambda x: ~x.rlike(r"^[-| ]*$"))
    cells = F.filter(F.transform(rows, split_row), lambda r: F.size(r) > 0)
    return F.array_join(F.transform(cells, lambda r: F.array_join(F.transform(r, normalize_cell), "\t")), "\n")


def _upper(c: Column) -> Column:
    """Some letter is upper case, and none lower or title case."""
    return c.rlike(r"\p{IsUppercase}") & ~c.rlike(r"[\p{IsLowercase}\p{Lt}]")


def format_table(lines: Column) -> Column:
    """A pipe table of lines with equal columns and one separator; empty without cells, null for null.

    A first row of short or upper-case cells gets the separator below it. Other rows of dashes, or of empty cells, go; the
    separator follows the first row if none of them went.
    """
    rows = F.filter(F.transform(F.filter(F.transform(lines, strip), lambda x: x != ""), split_row), lambda r: F.size(r) > 0)
    return bound(F.transform(rows, lambda r: F.transform(r, normalize_cell)), _ruled)


def _show(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _ruled(rows: Column) -> Column:
    """The table of rows of clean cells; see format_table."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    wide = bound(width, lambda n: F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), n - F.size(r)))))
    heading = lambda first: F.forall(first, lambda c: F.length(c) <= 15) | F.forall(first, lambda c: (F.length(c) <= 1) | _upper(c))
    dashes = lambda r: F.forall(r, lambda c: c.rlike(r"\A-*\z"))
    below = lambda r: _show(F.transform(r, lambda c: F.lit("---")))

    def laid_out(w: Column) -> Column:
        first, others = F.slice(w, 1, 1), F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))
        plain = F.transform(F.filter(w, lambda r: ~dashes(r)), _show)
        rest = F.transform(F.filter(others, lambda r: ~dashes(r)), _show)
        separator = F.transform(first, below)
        headed = F.concat(F.transform(first, _show), separator, rest)
        unheaded = bound(plain, lambda p: F.when(F.size(p) < F.size(w), p).otherwise(F.concat(F.slice(p, 1, 1), separator, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))))))
        return F.array_join(F.when(F.forall(first, heading), headed).otherwise(unheaded), "\n")

    return F.when(F.size(rows) > 0, bound(wide, laid_out)).otherwise(F.when(rows.isNotNull(), ""))


def profile_angle(profiles: DataFrame) -> DataFrame:
    """(crop_id, angle) of profiles (crop_id, angle, row_sum): the angle whose row sums vary most, the first among equals."""
    spread = profiles.groupBy("crop_id", "angle").agg(F.var_pop("row_sum").alias("v"))
    return spread.groupBy("crop_id").agg(F.max_by("angle", F.struct("v", (-F.col("angle")).alias("o"))).alias("angle"))


#: Sides below which a crop isn't turned, and the angles tried; fixed values.
DESKEW_LEAST, SKEW_RANGE, SKEW_STEP = 60, 10.0, 0.5


def skew_angles() -> Column:
    """The angles tried, from the least."""
    steps = int(2 * SKEW_RANGE / SKEW_STEP)
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i * F.lit(SKEW_STEP) - F.lit(SKEW_RANGE))


def deskew_angle(crops: DataFrame, profiles: DataFrame) -> DataFrame:
    """(crop_id, angle) of each crop (crop_id, w, h): see profile_angle; 0 for one that is too small or has no profile.

    Of the profiles those at the angles of skew_angles count.
    """
    tall = crops.where((F.col("w") >= DESKEW_LEAST) & (F.col("h") >= DESKEW_LEAST)).select("crop_id")
    best = profile_angle(profiles.where(F.array_contains(skew_angles(), F.col("angle").cast("double"))).join(tall, "crop_id", "left_semi"))
    return crops.select("crop_id").join(best, "crop_id", "left").withColumn("angle", F.coalesce("angle", F.lit(0.0)))
