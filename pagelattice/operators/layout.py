"""Layout post-processing: detections to de-duplicated, column-split blocks in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Detector classes by id; captions and footnotes are folded into the kind they are read as; fixed values.
LABELS = {
    0: "title", 1: "plain_text", 2: "abandon", 3: "figure", 4: "plain_text",
    5: "table", 6: "title", 7: "plain_text", 8: "isolate_formula", 9: "plain_text",
}
LEAST_CONFIDENCE, MOST_CONTAINED = 0.35, 0.80
#: Share of the page's width left of which, and right of which, a block's middle counts to a side; where columns part.
LEFT, RIGHT, SPLIT = 0.38, 0.62, 0.5


def label_of(class_id: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(known[class_id], F.lit("plain_text"))


def detections(boxes: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Boxes (page_id, det_idx, class_id, confidence, x1, y1, x2, y2) that are sure enough, of use, and on the page."""
    w, h = F.lit(float(page_w)), F.lit(float(page_h))
    return (
        boxes.where(F.col("confidence") >= LEAST_CONFIDENCE)
        .withColumn("label", label_of(F.col("class_id")))
        .where("label <> 'abandon'")
        .withColumns({"fx1": F.greatest(F.lit(0.0), "x1"), "fx2": F.least(w, "x2"), "fy1": F.greatest(F.lit(0.0), "y1"), "fy2": F.least(h, "y2")})
        .where("fx2 > fx1 AND fy2 > fy1")
        .select(
            "page_id", "det_idx", "label", "confidence", ((F.col("fx1") + F.col("fx2")) / 2).alias("x_mid"),
            *(F.col(f"f{c}").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")),
        )
    )


def dedup(blocks: DataFrame) -> DataFrame:
    """Drops a block that contains more than 80 % of another of its label that is not dropped yet, in order of det_idx.

    Whether a block goes depends on those dropped before it, so each page's few blocks are folded over in order.
    """
    own = [c for c in blocks.columns if c != "page_id"]
    first = ["det_idx", *(c for c in own if c != "det_idx")]
    pages = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*first))).alias("b"))

    def area(x: Column) -> Column:
        return (x["x2"] - x["x1"]).cast("double") * (x["y2"] - x["y1"])

    def contains(a: Column, x: Column) -> Column:
        iw = F.least(a["x2"], x["x2"]) - F.greatest(a["x1"], x["x1"])
        ih = F.least(a["y2"], x["y2"]) - F.greatest(a["y1"], x["y1"])
        return (a["label"] == x["label"]) & (area(a) > 0) & (area(x) > 0) & (iw > 0) & (ih > 0) & (iw.cast("double") * ih / area(x) > MOST_CONTAINED)

    def step(gone: Column, a: Column) -> Column:
        hit = F.exists("b", lambda x: (x["det_idx"] != a["det_idx"]) & ~F.array_contains(gone, x["det_idx"]) & contains(a, x))
        return F.when(hit, F.concat(gone, F.array(a["det_idx"]))).otherwise(gone)

    idx = blocks.schema["det_idx"].dataType.simpleString()
    gone = F.aggregate("b", F.array().cast(f"array<{idx}>"), step)
    kept = pages.withColumn("gone", gone).select("page_id", F.explode(F.filter("b", lambda a: ~F.array_contains(F.col("gone"), a["det_idx"]))).alias("k"))
    return kept.select("page_id", *(F.col(f"k.{c}") for c in own))


def column_profile(blocks: DataFrame, page_w: int) -> DataFrame:
    """(page_id, n, n_left, n_right, n_mid, boundary): boundary is null for a page in one column."""
    counts = blocks.groupBy("page_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("x_mid") < LEFT * page_w).alias("n_left"),
        F.count_if(F.col("x_mid") > RIGHT * page_w).alias("n_right"),
    )
    return _with_boundary(counts.withColumn("n_mid", F.col("n") - F.col("n_left") - F.col("n_right")), page_w)


def _with_boundary(counts: DataFrame, page_w: int) -> DataFrame:
    side = F.greatest(F.lit(2.0), 0.25 * F.col("n"))
    two = (F.col("n") >= 4) & (F.col("n_left") >= side) & (F.col("n_right") >= side) & (F.col("n_mid") <= F.greatest(F.lit(1.0), 0.15 * F.col("n")))
    return counts.withColumn("boundary", F.when(two, F.lit(SPLIT * page_w)))


def reading_order(blocks: DataFrame, page_w: int) -> DataFrame:
    """Adds column_idx and reading_order; the counts are windows over the page, so one shuffle serves both."""
    page = Window.partitionBy("page_id")
    counted = blocks.withColumns(
        {
            "n": F.count("*").over(page),
            "n_left": F.count_if(F.col("x_mid") < LEFT * page_w).over(page),
            "n_right": F.count_if(F.col("x_mid") > RIGHT * page_w).over(page),
        }
    ).withColumn("n_mid", F.col("n") - F.col("n_left") - F.col("n_right"))
    placed = _with_boundary(counted, page_w).withColumn(
        "column_idx", F.when(F.col("boundary").isNull() | (F.col("x_mid") < F.col("boundary")), 0).otherwise(1)
    )
    order = page.orderBy("column_idx", "y1", "det_idx")
    return placed.withColumn("reading_order", F.row_number().over(order) - 1).select(
        "page_id", "det_idx", "label", "x1", "y1", "x2", "y2", "column_idx", "reading_order", F.bround("confidence", 3).alias("confidence")
    )


def expand(blocks: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Adds ex1 to ey2: the box widened by 2 % of its shorter side, 4 pixels at least, within the page; tables stay."""
    by = F.when(F.col("label") == "table", 0).otherwise(
        F.greatest(F.lit(4), (F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * 0.02).cast("int"))
    )
    wide = blocks.withColumn("by", by)
    return wide.select(
        *blocks.columns,
        F.when(F.col("label") != "table", F.greatest(F.lit(0), F.col("x1") - F.col("by"))).otherwise(F.col("x1")).alias("ex1"),
        F.when(F.col("label") != "table", F.greatest(F.lit(0), F.col("y1") - F.col("by"))).otherwise(F.col("y1")).alias("ey1"),
        F.when(F.col("label") != "table", F.least(F.lit(page_w), F.col("x2") + F.col("by"))).otherwise(F.col("x2")).alias("ex2"),
        F.when(F.col("label") != "table", F.least(F.lit(page_h), F.col("y2") + F.col("by"))).otherwise(F.col("y2")).alias("ey2"),
    )


def erase_rects(blocks: DataFrame) -> DataFrame:
    """Adds rects: erase_regions (fractions of the box) as rectangles within the crop that begins at (ex1, ey1)."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def rect(r: Column) -> Column:
        at = lambda origin, size, f, crop: (F.col(origin) + f * size).cast("int") - F.col(crop)
        return F.array(at("x1", w, r[0], "ex1"), at("y1", h, r[1], "ey1"), at("x1", w, r[2], "ex1"), at("y1", h, r[3], "ey1"))

    return blocks.withColumn("rects", F.transform("erase_regions", rect))


def crop_geometry(blocks: DataFrame) -> DataFrame:
    """Adds pad, padded_w, padded_h and scale: the white margin by label, and the enlargement of crops under 80 pixels."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    least = F.least(w, h)
    share = lambda most, f: F.greatest(F.lit(most), (least * f).cast("int"))
    pad = (
        F.when(F.col("label") == "isolate_formula", share(16, 0.15))
        .when(F.col("label").isin("plain_text", "title"), share(12, 0.08))
        .when(F.col("label") == "figure", share(1, 0.05))
        .otherwise(share(15, 0.10))
    )
    padded = blocks.withColumn("pad", pad).withColumns({"padded_w": w + 2 * F.col("pad"), "padded_h": h + 2 * F.col("pad")})
    scale = F.when(F.col("padded_h") < 80, F.least(F.lit(3.0), F.greatest(F.lit(2.0), 80.0 / F.col("padded_h")))).otherwise(1.0)
    return padded.withColumn("scale", scale)


def with_corners(boxes: DataFrame) -> DataFrame:
    """Boxes whose array bbox has four values, as x1, y1, x2, y2; all others, null ones too, are left out."""
    corners = {c: F.get("bbox", F.lit(i)) for i, c in enumerate(("x1", "y1", "x2", "y2"))}
    return boxes.where(F.size("bbox") == 4).withColumns(corners)


def top_left(position: Column, width: Column, height: Column) -> Column:
    """(top, left) of a polygon of alternating x and y; the centre of a crop of this size without a whole polygon."""
    xs, ys = F.filter(position, lambda _, i: i % 2 == 0), F.filter(position, lambda _, i: i % 2 == 1)
    whole = (F.size(position) > 0) & (F.size(position) % 2 == 0) & ~F.exists(position, lambda v: v.isNull())
    corner = F.struct(F.array_min(ys).cast("double").alias("top"), F.array_min(xs).cast("double").alias("left"))
    return F.when(whole, corner).otherwise(F.struct((height / 2).cast("double").alias("top"), (width / 2).cast("double").alias("left")))


def handler(label: Column) -> Column:
    """Which reader a region goes to."""
    return (
        F.when(label == "table", "table").when(label == "title", "text_only").when(label == "isolate_formula", "formula").when(label == "figure", "figure").otherwise("text_formula")
    )
