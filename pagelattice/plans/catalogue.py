"""Registered queries of the library and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import models
from ..functions import latex, text
from ..operators import artifacts, export, folders, layout, library, mutations, questions, structure, tables, trees
from ..sources import archives, cleanup, plugins, sinks, store
from ..sources.versioned import SPAN, PageTable
from ..sources.views import PAGE_H, PAGE_W, view, with_views
from ..streaming import batch as streams
from ..streaming import pages as page_stream
from ..streaming import sessions as session_stream

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Registers a function (get) -> DataFrame, where get(view) reads a view of the run's folder."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str, build=build) -> DataFrame:
            return build(lambda v: view(spark, sf_dir, v))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


# --- layout -----------------------------------------------------------------------------------------------------------

LABEL_SQL = "CASE class_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in layout.LABELS.items()) + " ELSE 'plain_text' END"
DETECTED = f"""{with_views("boxes")},
clamped AS (
  SELECT page_id, det_idx, {LABEL_SQL} AS label, confidence,
         greatest(0.0, x1) AS fx1, greatest(0.0, y1) AS fy1, least({float(PAGE_W)}, x2) AS fx2, least({float(PAGE_H)}, y2) AS fy2
  FROM boxes WHERE confidence >= {layout.LEAST_CONFIDENCE}),
detected AS (
  SELECT page_id, det_idx, label, confidence, CAST((fx1 + fx2) / 2 AS DOUBLE) AS x_mid,
         CAST(trunc(fx1) AS INT) AS x1, CAST(trunc(fy1) AS INT) AS y1, CAST(trunc(fx2) AS INT) AS x2, CAST(trunc(fy2) AS INT) AS y2
  FROM clamped WHERE label <> 'abandon' AND fx2 > fx1 AND fy2 > fy1)"""
# the fold over a page's blocks, in order, with the indexes dropped so far
# per block, the blocks it contains; then the fold in order, with the indexes dropped so far
DEDUPED = f"""{DETECTED},
pairs AS (
  SELECT a.page_id, a.det_idx AS i, list(x.det_idx) AS inside FROM detected a JOIN detected x
    ON a.page_id = x.page_id AND a.det_idx <> x.det_idx AND a.label = x.label
    AND (a.x2 - a.x1) * (a.y2 - a.y1) > 0 AND (x.x2 - x.x1) * (x.y2 - x.y1) > 0
    AND least(a.x2, x.x2) > greatest(a.x1, x.x1) AND least(a.y2, x.y2) > greatest(a.y1, x.y1)
    AND CAST(least(a.x2, x.x2) - greatest(a.x1, x.x1) AS DOUBLE) * (least(a.y2, x.y2) - greatest(a.y1, x.y1)) / ((x.x2 - x.x1) * (x.y2 - x.y1)) > {layout.MOST_CONTAINED}
  GROUP BY a.page_id, a.det_idx),
folded AS (
  SELECT page_id, list_reduce(list({{'i': i, 'inside': inside, 'gone': CAST([] AS BIGINT[])}} ORDER BY i), lambda acc, p: {{
      'i': p.i, 'inside': p.inside,
      'gone': CASE WHEN len(list_filter(p.inside, lambda x: NOT list_contains(acc.gone, x))) > 0 THEN list_append(acc.gone, p.i) ELSE acc.gone END
    }}, {{'i': CAST(-1 AS BIGINT), 'inside': CAST([] AS BIGINT[]), 'gone': CAST([] AS BIGINT[])}}).gone AS gone
  FROM pairs GROUP BY page_id),
deduped AS (
  SELECT d.* FROM detected d LEFT JOIN folded f USING (page_id) WHERE f.gone IS NULL OR NOT list_contains(f.gone, d.det_idx))"""
SIDES = f"""count(*) FILTER (x_mid < {layout.LEFT * PAGE_W}) {{over}} AS n_left, count(*) FILTER (x_mid > {layout.RIGHT * PAGE_W}) {{over}} AS n_right"""
BOUNDARY = f"""CASE WHEN n >= 4 AND n_left >= greatest(2, 0.25 * n) AND n_right >= greatest(2, 0.25 * n) AND n - n_left - n_right <= greatest(1, 0.15 * n)
  THEN {layout.SPLIT * PAGE_W} END"""
OVER_PAGE = "OVER (PARTITION BY page_id)"
ORDERED = f"""{DEDUPED},
counted AS (SELECT *, count(*) {OVER_PAGE} AS n, {SIDES.format(over=OVER_PAGE)} FROM deduped),
placed AS (SELECT *, CASE WHEN {BOUNDARY} IS NULL OR x_mid < {BOUNDARY} THEN 0 ELSE 1 END AS column_idx FROM counted),
ordered AS (
  SELECT page_id, det_idx, label, x1, y1, x2, y2, column_idx,
         row_number() OVER (PARTITION BY page_id ORDER BY column_idx, y1, det_idx) - 1 AS reading_order, round_even(confidence, 3) AS confidence
  FROM placed)"""


def detected(get) -> DataFrame:
    return layout.detections(get("boxes"), PAGE_W, PAGE_H)


def ordered(get) -> DataFrame:
    return layout.reading_order(layout.dedup(detected(get)), PAGE_W)


query("layout_reading_order", f"{ORDERED} SELECT * FROM ordered")(ordered)
query("layout_detections", f"{DETECTED} SELECT * FROM detected")(detected)
query("layout_dedup", f"{DEDUPED} SELECT * FROM deduped")(lambda get: layout.dedup(detected(get)))
query("layout_column_profile", f"""{DEDUPED}, c AS (SELECT page_id, count(*) AS n, {SIDES.format(over="")} FROM deduped GROUP BY page_id)
SELECT page_id, n, n_left, n_right, n - n_left - n_right AS n_mid, {BOUNDARY} AS boundary FROM c""")(lambda get: layout.column_profile(layout.dedup(detected(get)), PAGE_W))

EXPANDED = f"""{DETECTED}, e AS (SELECT *, CASE WHEN label = 'table' THEN 0 ELSE greatest(4, CAST(trunc(least(x2 - x1, y2 - y1) * 0.02) AS INT)) END AS k FROM detected),
expanded AS (SELECT page_id, det_idx, label, confidence, x_mid, x1, y1, x2, y2,
  CASE WHEN label = 'table' THEN x1 ELSE greatest(0, x1 - k) END AS ex1, CASE WHEN label = 'table' THEN y1 ELSE greatest(0, y1 - k) END AS ey1,
  CASE WHEN label = 'table' THEN x2 ELSE least({PAGE_W}, x2 + k) END AS ex2, CASE WHEN label = 'table' THEN y2 ELSE least({PAGE_H}, y2 + k) END AS ey2 FROM e)"""
query("bbox_expand_clamp", f"{EXPANDED} SELECT * FROM expanded")(lambda get: layout.expand(detected(get), PAGE_W, PAGE_H))


@query("erase_region_rects", f"""{EXPANDED} SELECT page_id, det_idx,
  CAST(trunc(x1 + (det_idx + 1) * 0.05 * (x2 - x1)) AS INT) - ex1 AS px1, CAST(trunc(y1 + 0.125 * (y2 - y1)) AS INT) - ey1 AS py1,
  CAST(trunc(x1 + (det_idx + 2) * 0.05 * (x2 - x1)) AS INT) - ex1 AS px2, CAST(trunc(y1 + 0.5 * (y2 - y1)) AS INT) - ey1 AS py2 FROM expanded""")
def _erase(get):
    at = lambda k: (F.col("det_idx") + k) * F.lit(0.05)
    boxes = layout.expand(detected(get), PAGE_W, PAGE_H).withColumn("erase_regions", F.array(F.array(at(1), F.lit(0.125), at(2), F.lit(0.5))))
    r = layout.erase_rects(boxes)
    return r.select("page_id", "det_idx", F.explode("rects").alias("q")).select("page_id", "det_idx", *(F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("px1", "py1", "px2", "py2"))))


@query("crop_padding", f"""{DETECTED}, m AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h, least(x2 - x1, y2 - y1) AS s FROM detected),
p AS (SELECT *, CASE label WHEN 'isolate_formula' THEN greatest(16, CAST(trunc(s * 0.15) AS INT)) WHEN 'plain_text' THEN greatest(12, CAST(trunc(s * 0.08) AS INT))
  WHEN 'title' THEN greatest(12, CAST(trunc(s * 0.08) AS INT)) WHEN 'figure' THEN greatest(1, CAST(trunc(s * 0.05) AS INT)) ELSE greatest(15, CAST(trunc(s * 0.10) AS INT)) END AS pad FROM m)
SELECT page_id, det_idx, pad, w + 2 * pad AS padded_w, h + 2 * pad AS padded_h,
  CAST(CASE WHEN h + 2 * pad < 80 THEN least(3.0, greatest(2.0, 80.0 / (h + 2 * pad))) ELSE 1 END AS DOUBLE) AS scale,
  CASE label WHEN 'table' THEN 'table' WHEN 'title' THEN 'text_only' WHEN 'isolate_formula' THEN 'formula' WHEN 'figure' THEN 'figure' ELSE 'text_formula' END AS handler FROM p""")
def _crop(get):
    return layout.crop_geometry(detected(get)).select("page_id", "det_idx", "pad", "padded_w", "padded_h", "scale", layout.handler(F.col("label")).alias("handler"))


CLASS_SQL = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in export.CLASSES.items()) + " END"
query("yolo_lines", f"""{DETECTED} SELECT page_id, det_idx, printf('%d %.6f %.6f %.6f %.6f', {CLASS_SQL},
  (x1 + x2) / 2.0 / {PAGE_W}, (y1 + y2) / 2.0 / {PAGE_H}, (x2 - x1) / CAST({PAGE_W} AS DOUBLE), (y2 - y1) / CAST({PAGE_H} AS DOUBLE)) AS line
FROM (SELECT page_id, det_idx, label, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM detected) WHERE {CLASS_SQL} IS NOT NULL""")(
    lambda get: export.yolo_lines(detected(get), PAGE_W, PAGE_H)
)

# --- library ----------------------------------------------------------------------------------------------------------

FT = """CASE WHEN filename NOT LIKE '%.%' THEN 'other' WHEN lower(string_split(filename, '.')[-1]) = 'pdf' THEN 'pdf'
 WHEN lower(string_split(filename, '.')[-1]) IN ('jpg', 'jpeg', 'png', 'tiff', 'tif', 'bmp', 'webp', 'gif') THEN 'image' ELSE 'other' END"""

query("doc_list", f"""{with_views("docs", "doc_pages", "doc_tags")},
p AS (SELECT document_id, count(*) FILTER (status = 'layout-detected') AS l, count(*) FILTER (status = 'ocr-complete') AS o FROM doc_pages GROUP BY 1),
t AS (SELECT document_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM doc_tags GROUP BY 1)
SELECT id, filename, status, page_count, folder_id, is_starred, file_size, {FT} AS file_type, coalesce(tags, '') AS tags, coalesce(l, 0) AS pages_layout_done, coalesce(o, 0) AS pages_ocr_done
FROM docs LEFT JOIN p ON p.document_id = id LEFT JOIN t ON t.document_id = id WHERE deleted_at IS NULL""")(
    lambda get: library.listing(library.search(get("docs")), get("doc_pages"), get("doc_tags"))
)
query("doc_search", f"""{with_views("docs")} SELECT id, filename, folder_id, file_size FROM docs
WHERE deleted_at IS NULL AND folder_id = 'n7' AND is_starred AND contains(lower(filename), 'doc_')""")(
    lambda get: library.search(get("docs"), folder="n7", starred=True, text=" DOC_ ").select("id", "filename", "folder_id", "file_size")
)
DEEP = f"""{with_views("tables").replace("WITH ", "WITH RECURSIVE ", 1)},
deep AS (SELECT table_id AS id, CASE WHEN table_id % 700 = 1 THEN NULL WHEN table_id % 700 = 350 AND table_id % 1400 < 700 THEN table_id + 9 ELSE table_id - 1 END AS parent_id FROM tables)"""


def _deep(get) -> DataFrame:
    """A folder a part: chains of up to 700, and in every second one a cycle of ten half-way down."""
    t = F.col("table_id")
    parent = F.when(t % 700 == 1, None).when((t % 700 == 350) & (t % 1400 < 700), t + 9).otherwise(t - 1)
    return get("tables").select(t.alias("id"), parent.alias("parent_id"))


query("folder_places", f"""{DEEP}, r(id, root, depth) AS (SELECT id, id, 0 FROM deep WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM deep)
  UNION ALL SELECT d.id, r.root, r.depth + 1 FROM r JOIN deep d ON d.parent_id = r.id),
c(own, up) AS (SELECT id, parent_id FROM deep WHERE id NOT IN (SELECT id FROM r) UNION SELECT c.own, d.parent_id FROM c JOIN deep d ON d.id = c.up)
SELECT id, root, depth, id IN (SELECT own FROM c WHERE own = up) AS in_cycle FROM deep LEFT JOIN r USING (id)""")(lambda get: folders.placed(_deep(get)))
query("folders_under", f"""{DEEP}, u(id) AS (SELECT id FROM deep WHERE id % 700 IN (100, 355) UNION SELECT d.id FROM u JOIN deep d ON d.parent_id = u.id) SELECT id FROM u""")(
    lambda get: folders.under(_deep(get), _deep(get).where("id % 700 IN (100, 355)").select("id"))
)
query("tag_save", f"""{with_views("folders")} SELECT id, CASE WHEN id LIKE 'n%' AND length(id) = 2 THEN 'T ' || id ELSE name END AS name, CASE WHEN id LIKE '%1' THEN 'blue' ELSE 'red' END AS color
FROM (SELECT min(id) AS id, name FROM folders GROUP BY name)""")(
    lambda get: mutations.save_tags(
        get("folders").groupBy("name").agg(F.min("id").alias("id")).select("id", "name", F.lit("red").alias("color")),
        get("folders").select(
            "id", F.when(F.col("id").like("n%") & (F.length("id") == 2), F.concat(F.lit(" T "), "id")).when(F.col("id").like("r%"), F.lit("EGYPT")).otherwise(" ").alias("name"), F.when(F.col("id").like("%1"), "blue").alias("color")
        ),
    )
)
query("doc_trash", f"{with_views('docs')} SELECT id, filename, deleted_at FROM docs WHERE deleted_at IS NOT NULL AND CAST(id AS STRING) IN ('10', '20', '30', '70', '170')")(
    lambda get: library.search(get("docs"), deleted=True, ids=" 10, 20,30,,70, 170").select("id", "filename", "deleted_at")
)
query("doc_by_tag", f"""{with_views("docs", "doc_tags")} SELECT id, filename FROM docs WHERE deleted_at IS NULL
AND id IN (SELECT document_id FROM doc_tags WHERE tag = (SELECT min(tag) FROM doc_tags))""")(
    lambda get: library.search(get("docs")).join(
        get("doc_tags").join(F.broadcast(get("doc_tags").agg(F.min("tag").alias("tag"))), "tag").select(F.col("document_id").alias("id")), "id", "left_semi"
    ).select("id", "filename")
)
query("doc_detail", f"""{with_views("docs", "doc_pages")}, p AS (SELECT document_id, string_agg(page_number || ':' || status, ',' ORDER BY page_number) AS s FROM doc_pages GROUP BY 1)
SELECT id, filename, coalesce(s, '') AS pages FROM docs LEFT JOIN p ON document_id = id""")(
    lambda get: library.detail(get("docs"), get("doc_pages")).select("id", "filename", F.array_join(F.transform("pages", lambda p: F.concat(p["page_number"].cast("string"), F.lit(":"), p["status"])), ",").alias("pages"))
)
query("page_detail", f"""{with_views("docs", "doc_pages")} SELECT d.id AS document_id, CAST(n AS INT) AS page_number, coalesce(p.status, 'idle') AS status
FROM docs d, LATERAL (SELECT unnest(range(1, d.page_count + 1)) AS n) LEFT JOIN doc_pages p ON p.document_id = d.id AND p.page_number = n""")(
    lambda get: library.page_detail(get("docs").select(F.col("id").alias("document_id"), F.explode(F.sequence(F.lit(1), "page_count")).alias("page_number")), get("doc_pages"))
)


def _payload_pages(get) -> DataFrame:
    """Stored pages whose lists are null, empty in several ways, or not, and whose sizes may be 0."""
    k = ((F.col("document_id") + F.col("page_number")) % 6).cast("int")
    some = lambda *texts: F.element_at(F.array(*(F.lit(t) for t in texts)), k + 1)
    return get("doc_pages").withColumns({
        "session_id": some("", "s", None, "s", "s", ""), "image_w": F.when(k != 3, k * 100), "image_h": F.lit(0),
        "layout_blocks": some(None, "[]", "{}", '[{"id":"a"}]', "", "null"), "ocr_blocks": some("[1]", None, "[]", "0", '""', " [] "), "placed_images": some("[]", "[2]", "false", None, "[0]", "[]"),
    })


query("page_payload", f"""{with_views("docs", "doc_pages")}, w AS (SELECT id AS document_id, unnest(range(1, page_count + 1)) AS page_number FROM docs),
p AS (SELECT *, (document_id + page_number) % 6 AS k, true AS there FROM doc_pages)
SELECT w.document_id, w.page_number, CASE WHEN there THEN ['', 's', NULL, 's', 's', ''][k + 1] END AS session_id, CASE WHEN k <> 3 THEN k * 100 END AS image_w, CASE WHEN there THEN 0 END AS image_h,
  coalesce(status, 'idle') AS status, CASE WHEN k = 3 THEN '[{{"id":"a"}}]' ELSE '[]' END AS layout_blocks, CASE WHEN k = 0 THEN '[1]' WHEN there THEN '[]' END AS ocr_blocks,
  CASE k WHEN 1 THEN '[2]' WHEN 4 THEN '[0]' ELSE CASE WHEN there THEN '[]' END END AS placed_images
FROM w LEFT JOIN p ON p.document_id = w.document_id AND p.page_number = w.page_number""")(
    lambda get: library.page_payload(get("docs").select(F.col("id").alias("document_id"), F.explode(F.sequence(F.lit(1), "page_count")).alias("page_number")), _payload_pages(get))
)
query("folder_counts", f"""{with_views("folders", "docs")} SELECT f.id, f.name, f.parent_id, count(d.id) FILTER (d.deleted_at IS NULL) AS document_count
FROM folders f LEFT JOIN docs d ON d.folder_id = f.id GROUP BY ALL""")(lambda get: library.folder_counts(get("folders"), get("docs")))
query("tag_counts", f"""{with_views("doc_tags", "docs")} SELECT tag, count(d.id) FILTER (d.deleted_at IS NULL) AS document_count
FROM doc_tags t LEFT JOIN docs d ON d.id = t.document_id GROUP BY tag""")(lambda get: library.tag_counts(get("doc_tags"), get("docs")))
query("folder_subtree", f"""{with_views("folders").replace("WITH ", "WITH RECURSIVE ", 1)}, tree(root, id, level) AS (SELECT id, id, 0 FROM folders UNION ALL
SELECT t.root, f.id, t.level + 1 FROM tree t JOIN folders f ON f.parent_id = t.id) SELECT * FROM tree""")(lambda get: folders.tree(get("folders")))
query("storage_summary", f"""{with_views("docs", "doc_pages")} SELECT count(*) AS file_count, coalesce(CAST(sum(file_size) AS BIGINT), 0) AS used_bytes,
(SELECT count(*) FROM doc_pages p JOIN docs d ON d.id = p.document_id WHERE d.deleted_at IS NULL AND p.status = 'ocr-complete') AS ocr_pages, {library.STORAGE_LIMIT} AS limit_bytes
FROM docs WHERE deleted_at IS NULL""")(lambda get: library.storage_summary(get("docs"), get("doc_pages")))
query("storage_by_type", f"""{with_views("docs")}, c AS (SELECT {FT} AS file_type, count(*) AS n FROM docs WHERE deleted_at IS NULL GROUP BY 1)
SELECT file_type, n, CAST(round_even(n * 100.0 / (SELECT sum(n) FROM c), 0) AS INT) AS percent FROM c""")(lambda get: library.storage_by_type(get("docs")))
ROLLED = f"""{with_views("docs", "doc_pages")}, p AS (SELECT document_id, count(*) FILTER (status = 'ocr-complete') AS o, count(*) FILTER (status IN ('ocr-complete', 'layout-detected')) AS l FROM doc_pages GROUP BY 1),
r AS (SELECT id, status AS old_status, CASE WHEN page_count > 0 AND coalesce(o, 0) = page_count THEN 'complete' WHEN coalesce(l, 0) > 0 THEN 'partial' ELSE status END AS new_status FROM docs LEFT JOIN p ON document_id = id)"""
query("doc_status_rollup", f"{ROLLED} SELECT *, old_status <> 'complete' AND new_status = 'complete' AS completed FROM r")(lambda get: library.status_rollup(get("docs"), get("doc_pages")))
query("recent_activity", f"{with_views('activity')} SELECT * FROM activity ORDER BY created_at DESC, id DESC LIMIT 50")(lambda get: library.recent_activity(get("activity"), 60))
query("next_page_number", f"{with_views('doc_pages')} SELECT document_id, max(page_number) + 1 AS next_page FROM doc_pages GROUP BY 1")(lambda get: library.last_page(get("doc_pages")))

# --- artifacts --------------------------------------------------------------------------------------------------------

CUTOFF = "2024-01-20"
LIVE = "live AS (SELECT DISTINCT concat('s', CAST(document_id AS STRING)) AS session_id FROM doc_pages)"
ORPHANS = f"""{with_views("artifacts", "doc_pages")}, {LIVE},
o AS (SELECT *, string_split(stem, '_block_')[1] AS session_id FROM artifacts)"""


def _sessions(get) -> DataFrame:
    return get("doc_pages").select(F.concat(F.lit("s"), F.col("document_id").cast("string")).alias("session_id"))


query("orphan_artifacts", f"{ORPHANS} SELECT session_id, dir, stem, size, mtime FROM o WHERE session_id NOT IN (SELECT session_id FROM live)")(
    lambda get: artifacts.orphans(get("artifacts"), _sessions(get))
)
query("freed_bytes", f"""{ORPHANS}, k AS (SELECT * FROM o WHERE session_id NOT IN (SELECT session_id FROM live) AND mtime <= TIMESTAMP '{CUTOFF}')
SELECT dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM k GROUP BY ROLLUP (dir)""")(lambda get: artifacts.freed(artifacts.orphans(get("artifacts"), _sessions(get), CUTOFF)))


#: Files that lie on disk at once, since a file system has so many and no more; files in a folder; tasks that write them.
FILES_AT_ONCE, FILES_IN_FOLDER, FILE_TASKS = 1 << 20, 4096, 64
ARTIFACT_DIRS = ("debug_cache", "training_images", "tatr_crops")


def _waves(session: Column, waves: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(waves)).alias("wave")


def _artifact_files(get) -> Iterator[tuple[int, int, DataFrame, str]]:
    """The artifacts as files of 0 to 4 bytes, in waves of about FILES_AT_ONCE: a wave's number, how many there are, a listing of its files where
    they lie, and their folder. All files of a session are of one wave; a wave's files are deleted before the next is written."""
    files = get("artifacts")
    spark, n = files.sparkSession, files.count()
    waves, spread = max(1, -(-n // FILES_AT_ONCE)), max(1, -(-min(n, FILES_AT_ONCE) // FILES_IN_FOLDER))
    below = F.concat_ws("/", "dir", F.pmod(F.xxhash64("stem"), F.lit(spread)))
    content = F.encode(F.repeat(F.lit("x"), (F.col("size") % 5).cast("int")), "UTF-8")
    placed = files.select(_waves(artifacts.session_of(F.col("stem")), waves), below.alias("below"), F.concat(below, F.lit("/"), "stem", F.lit(".jpg")).alias("name"), content.alias("content"))
    run = store.run_folder(spark, "artifacts")
    for wave in range(waves):
        root = f"{run}/{wave}"
        named = placed.where(F.col("wave") == wave).repartition(min(FILE_TASKS, spread * len(ARTIFACT_DIRS)), "below")
        if sinks.write_files(named, root).where("error IS NOT NULL").count():
            raise OSError(f"{root} can't be written")
        yield wave, waves, plugins.files(spark, root, pattern="*.jpg", nested="true"), root
        made = spark.range(spread).select(F.explode(F.array(*map(F.lit, ARTIFACT_DIRS))).alias("dir"), "id")
        cleanup.drop(made.select(F.concat_ws("/", "dir", "id").alias("path")).repartition(FILE_TASKS), root)


def _listed_files(get) -> DataFrame:
    """The listings of all waves, as a written table."""
    spark = get("artifacts").sparkSession
    out = store.run_folder(spark, "listed")
    for wave, _, listed, _ in _artifact_files(get):
        kind = listed.schema
        listed.write.parquet(f"{out}/wave={wave}")
    return spark.read.schema(kind).parquet(out)


def _cleaned(get) -> DataFrame:
    """What a cleanup of the files frees, by a dry run and then in fact, and how many files are left."""
    spark = get("artifacts").sparkSession
    live, out, no = store.run_folder(spark, "live"), store.run_folder(spark, "cleaned"), F.lit(0).cast("long")
    for wave, waves, listed, root in _artifact_files(get):
        if wave == 0:
            _sessions(get).distinct().select("session_id", _waves(F.col("session_id"), waves)).write.partitionBy("wave").parquet(live)
        own = spark.read.schema("session_id string, wave int").parquet(live).where(F.col("wave") == wave)
        dry = cleanup.clean(listed, own, root, f"{root}-dry", dry_run=True).select("dir", no.alias("files"), no.alias("bytes"), F.col("files").alias("would"), no.alias("left"))
        freed = cleanup.clean(listed, own, root, f"{root}-journal").select("dir", "files", "bytes", no.alias("would"), no.alias("left"))
        left = listed.rollup("dir").agg(F.count("*").alias("left")).select("dir", no.alias("files"), no.alias("bytes"), no.alias("would"), "left")
        dry.unionByName(freed).unionByName(left).write.parquet(f"{out}/wave={wave}")
    kind = "dir string, files long, bytes long, would long, left long"
    none = spark.createDataFrame([(None, 0, 0, 0, 0)], kind)  # of no files there is a total too
    return spark.read.schema(kind).parquet(out).drop("wave").unionByName(none).groupBy("dir").agg(*(F.sum(c).alias(c) for c in ("files", "bytes", "would", "left")))


query("artifact_files", f"{ORPHANS} SELECT session_id, dir, stem, size % 5 AS size FROM o WHERE session_id NOT IN (SELECT session_id FROM live)")(
    lambda get: artifacts.orphans(_listed_files(get), _sessions(get)).select("session_id", "dir", "stem", "size")
)
query("artifact_cleanup", f"""{ORPHANS}, k AS (SELECT dir, size % 5 AS size, session_id NOT IN (SELECT session_id FROM live) AS gone FROM o)
SELECT dir, count(*) FILTER (gone) AS files, CAST(coalesce(sum(size) FILTER (gone), 0) AS BIGINT) AS bytes, count(*) FILTER (gone) AS would, count(*) FILTER (NOT gone) AS left FROM k GROUP BY ROLLUP (dir)""")(_cleaned)
query("crop_files_present", f"""{with_views("artifacts", "doc_pages")}, b AS (SELECT document_id, page_number, 's' || CAST(document_id AS STRING) || '_block_' || CAST(page_number AS STRING) AS stem FROM doc_pages)
SELECT stem, document_id, page_number FROM b WHERE stem IN (SELECT stem FROM artifacts)""")(
    lambda get: artifacts.existing(
        get("doc_pages").select("document_id", "page_number", F.concat(F.lit("s"), F.col("document_id").cast("string")).alias("session_id"), F.col("page_number").alias("block_id")), get("artifacts")
    ).select("stem", "document_id", "page_number")
)
FIG = "regexp_extract_all({c}, '/media/figures/[^\\s\"''<>]+')"
query("orphan_figures", f"""{with_views("figures")} SELECT document_id, page_number, unnest(list_filter(list_distinct({FIG.format(c="old_blocks")}),
lambda u: NOT list_contains(coalesce({FIG.format(c="new_blocks")}, []), u))) AS url FROM figures""")(lambda get: artifacts.orphan_figures(get("figures")))
query("figure_s3_urls", f"""{with_views("figures")} SELECT DISTINCT u AS url, 'https://bucket.s3.eu-west-1.amazonaws.com/' || regexp_replace(u, '^/media/', '') AS s3_url
FROM (SELECT unnest({FIG.format(c="old_blocks")}) AS u FROM figures)""")(
    lambda get: get("figures").select(F.explode(text.figure_urls(F.col("old_blocks"))).alias("url")).distinct().withColumn("s3_url", text.s3_url(F.col("url"), "bucket", "eu-west-1"))
)
query("delete_manifest", f"""{with_views("docs", "figures")}, d AS (SELECT id, filename FROM docs), f AS (SELECT f.* FROM figures f JOIN d ON d.id = f.document_id)
SELECT DISTINCT document_id, p AS path FROM (
  SELECT document_id, unnest(['debug_cache/s' || document_id || '.jpg', 'training_images/s' || document_id || '.jpg', 'tatr_crops/s' || document_id || '_block_*.jpg']) AS p FROM f
  UNION ALL SELECT document_id, regexp_replace(unnest({FIG.format(c="old_blocks")}), '^/media/', 'media/') FROM f
  UNION ALL SELECT id, 'pdfs/' || filename FROM d)""")(
    lambda get: artifacts.delete_manifest(
        get("docs").select("id", F.concat(F.lit("pdfs/"), F.col("filename")).alias("pdf_file"), F.lit(None).cast("string").alias("thumbnail")),
        get("figures").select("document_id", F.concat(F.lit("s"), F.col("document_id").cast("string")).alias("session_id"), F.col("old_blocks").alias("blocks")),
        True,
    )
)

# --- structure and questions ------------------------------------------------------------------------------------------

BLOCK_OF = "struct<type:string,value:string,display:boolean,url:string,alt:string,width:int,height:int,rows:int,cols:int,cells:array<array<array<struct<type:string,value:string,display:boolean,url:string,alt:string,width:int,height:int,smiles:string>>>>>"


def _blocks(get) -> DataFrame:
    """Regions as recognised blocks: words are text elements, every seventh region failed."""
    words = F.filter(F.split("value", " "), lambda w: w != "")
    inner = F.transform(words, lambda w, i: F.struct(F.when(i % 5 == 3, "latex").when(i % 11 == 7, "image").otherwise("text").alias("type"), w.alias("value"), (i % 2 == 1).alias("display")))
    made = F.transform(inner, lambda b: F.named_struct(*_named(b)).cast(BLOCK_OF))
    bad = (F.col("page_id") + F.col("reading_order")) % 7 == 5
    return get("regions").select(
        "page_id", F.col("reading_order").cast("string").alias("block_id"), "reading_order", "column_idx", "label", "y1", "y2",
        F.when(bad, "unreadable").alias("error"), F.when(bad, F.slice(made, 1, 0)).otherwise(made).alias("blocks"),
    )


def _named(b):
    empty = "array<array<array<struct<type:string,value:string,display:boolean,url:string,alt:string,width:int,height:int,smiles:string>>>>"
    fields = {"type": b["type"], "value": b["value"], "display": b["display"], "url": F.concat(F.lit("/media/figures/"), b["value"]), "alt": F.lit("")}
    for f in ("width", "height", "rows", "cols"):
        fields[f] = F.lit(0)
    fields["cells"] = F.lit(None).cast(empty)
    return [x for k, v in fields.items() for x in (F.lit(k), v)]


query("section_assignment", f"""{with_views("regions")}, t AS (SELECT *, CASE WHEN (page_id + reading_order) % 7 = 5 THEN 'error' WHEN label = 'title' THEN 'section' ELSE 'paragraph' END AS node_type FROM regions)
SELECT page_id, CAST(reading_order AS STRING) AS block_id, node_type, row_number() OVER w - 1 AS position,
  CASE WHEN node_type <> 'section' THEN last_value(CASE WHEN node_type = 'section' THEN CAST(reading_order AS STRING) END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) END AS section_id
FROM t WINDOW w AS (PARTITION BY page_id ORDER BY reading_order)""")(lambda get: structure.sections(_blocks(get)).select("page_id", "block_id", "node_type", "position", "section_id"))

ELEMENTS = f"""{with_views("regions")}, e AS (
  SELECT page_id, reading_order, unnest(range(0, len(w))) AS i, unnest(w) AS value FROM
  (SELECT page_id, reading_order, list_filter(string_split(value, ' '), lambda x: x <> '') AS w FROM regions WHERE (page_id + reading_order) % 7 <> 5)),
k AS (SELECT *, CASE WHEN i % 5 = 3 THEN 'latex' WHEN i % 11 = 7 THEN 'image' ELSE 'text' END AS type, i % 2 = 1 AS display FROM e)"""
query("inline_merge", f"""{ELEMENTS}, m AS (SELECT *, sum(CASE WHEN type = 'latex' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, reading_order ORDER BY i) AS g FROM k WHERE type <> 'image'),
r AS (SELECT page_id, reading_order, g, type, min(i) AS i, string_agg(value, ' ' ORDER BY i) AS value FROM m GROUP BY ALL)
SELECT page_id, CAST(reading_order AS STRING) AS block_id, row_number() OVER (PARTITION BY page_id, reading_order ORDER BY i) - 1 AS pos, type, value FROM r""")(
    lambda get: _blocks(get).select("page_id", "block_id", F.posexplode(structure.inline(F.col("blocks"))).alias("pos", "b")).select("page_id", "block_id", "pos", "b.type", "b.value")
)
query("structured_content")(lambda get: structure.structured(_blocks(get)))



def _trees(get) -> DataFrame:
    """Documents of up to seven nested sections, each with a paragraph, and an image at the bottom."""
    section = lambda i: F.concat(F.lit('{"id":"s'), i.cast("string"), F.lit('","type":"section","children":[{"id":"p'), i.cast("string"), F.lit('","type":"paragraph","value":"'), F.md5("text"), F.lit('"},'))
    depth = (F.col("doc_id") % 8).cast("int")
    opened = F.when(depth > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(depth - 1, F.lit(0))), section), "")).otherwise("")
    return get("texts").select("doc_id", F.concat(F.lit('{"nodes":['), opened, F.lit('{"id":"img","type":"image"}'), F.repeat(F.lit("]}"), depth), F.lit('],"version":1}')).alias("content"))


query("node_walk", """WITH d AS (SELECT doc_id, doc_id % 8 AS d FROM documents), k AS (SELECT doc_id, d, unnest(range(0, d)) AS k FROM d)
SELECT doc_id, '0' || repeat('/1', d) AS path, d AS depth, 'img' AS id, 'image' AS type FROM d UNION ALL SELECT doc_id, '0' || repeat('/1', k), k, 's' || k, 'section' FROM k
UNION ALL SELECT doc_id, '0' || repeat('/1', k) || '/0', k + 1, 'p' || k, 'paragraph' FROM k""")(
    lambda get: trees.walk(_trees(get)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))
)
query("node_patch", """WITH d AS (SELECT doc_id, md5(text) AS h, doc_id % 8 AS d, doc_id % 3 = 0 AS hit FROM documents)
SELECT doc_id, CASE WHEN hit THEN '{"version":1,"nodes":[' ELSE '{"nodes":[' END || array_to_string(list_transform(range(0, d), lambda k: '{"id":"s' || k || '","type":"section","children":[{"id":"p' || k || '","type":"paragraph","value":"' || h || '"},'), '')
  || '{"id":"img","type":"image"' || CASE WHEN hit THEN ',"s3_url":"s3/' || doc_id || '"' ELSE '' END || '}' || repeat(']}', d) || CASE WHEN hit THEN ']}' ELSE '],"version":1}' END AS content FROM d""")(
    lambda get: trees.with_s3_urls(_trees(get), get("texts").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "img").otherwise("p0").alias("id"), F.concat(F.lit("s3/"), F.col("doc_id").cast("string")).alias("s3_url")))
)
query("repair_table_sources", f"""{with_views("regions")}, n AS (SELECT page_id, reading_order AS position, CASE WHEN reading_order % 2 = 0 THEN 'table' ELSE 'paragraph' END AS type,
  CASE WHEN reading_order % 4 = 0 THEN NULL ELSE 'b' || CAST(reading_order AS STRING) END AS src FROM regions),
b AS (SELECT page_id, 'b' || CAST(reading_order AS STRING) AS block_id, reading_order FROM regions WHERE reading_order % 2 = 0 AND page_id % 3 > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY reading_order) AS k FROM b WHERE (page_id, block_id) NOT IN (SELECT (page_id, src) FROM n WHERE src IS NOT NULL)),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position) AS k FROM n WHERE type = 'table' AND src IS NULL)
SELECT n.page_id, n.position, n.type, coalesce(n.src, f.block_id) AS source_block_id FROM n LEFT JOIN o USING (page_id, position) LEFT JOIN f ON f.page_id = o.page_id AND f.k = o.k""")(
    lambda get: structure.repair_table_sources(
        get("regions").select("page_id", F.col("reading_order").alias("position"), F.when(F.col("reading_order") % 2 == 0, "table").otherwise("paragraph").alias("type"),
                              F.when(F.col("reading_order") % 4 != 0, F.concat(F.lit("b"), F.col("reading_order").cast("string"))).alias("source_block_id")),
        get("regions").where("reading_order % 2 = 0 AND page_id % 3 > 0").select("page_id", F.concat(F.lit("b"), F.col("reading_order").cast("string")).alias("block_id"), "reading_order", F.lit("table").alias("label")),
    )
)

Q_SQL = r"(?i)^[ \t\n\r\f]*[\(\[]?[ \t\n\r\f]*Q?\.?[ \t\n\r\f]*([0-9]+)[ \t\n\r\f]*[.\)\]: \t\n\r\f]"


def _texts(get) -> DataFrame:
    empty = (F.col("page_id") + F.col("reading_order")) % 9 == 4
    return get("regions").withColumn("texts", F.when(empty, F.array().cast("array<string>")).otherwise(F.array("value")))


query("question_segments", f"""{with_views("regions")}, l AS (SELECT *, lag(y2) OVER (PARTITION BY page_id ORDER BY reading_order) AS above FROM regions),
s AS (SELECT *, try_cast(nullif(regexp_extract(value, '{Q_SQL}', 1), '') AS BIGINT) AS number FROM l WHERE (page_id + reading_order) % 9 <> 4),
t AS (SELECT *, count(number) OVER (PARTITION BY page_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS started FROM s),
b AS (SELECT *, number IS NOT NULL OR (coalesce(started, false) AND coalesce(y1 - above > {questions.GAP}, false)) AS opens FROM t)
SELECT page_id, reading_order, number, CAST(sum(CAST(opens AS INT)) OVER (PARTITION BY page_id ORDER BY reading_order) AS BIGINT) AS group_no FROM b""")(
    lambda get: questions.segment(_texts(get)).select("page_id", "reading_order", "number", "group_no")
)
query("question_prefix", f"""{with_views("regions")} SELECT page_id, reading_order, CASE WHEN regexp_matches(value, '{Q_SQL}') THEN trim(regexp_replace(value, '{Q_SQL}[ \\t\\n\\r\\f]*', ''), E' \\t\\n\\r\\f') ELSE value END AS value FROM regions""")(
    lambda get: get("regions").select("page_id", "reading_order", questions.strip_prefix(F.col("value")).alias("value"))
)
CLUES = "CASE reading_order % 6 WHEN 0 THEN 'Assertion: ' WHEN 1 THEN 'find the value of x [2 Marks] ' WHEN 2 THEN 'one or more (2.5marks) ' WHEN 3 THEN '3 M ' ELSE '' END"
B = r"\b"
MARKS_SQL = "try_cast(nullif(regexp_extract(v, '(?i)[\\[\\(]?[ \\t\\n]*([0-9]+(?:\\.[0-9]+)?)[ \\t\\n]*mark', 1), '') AS DOUBLE)"
TYPE_SQL = f"""CASE WHEN n >= 3 THEN CASE WHEN regexp_matches(v, '(?i){B}(one or more|correct option[s]?|may be correct|all.*correct|more than one){B}') THEN 'mcq_multi' ELSE 'mcq_single' END
       WHEN regexp_matches(v, '(?i){B}(assertion|reason|statement[- ]?(i|ii|1|2)|both.*statement){B}') THEN 'assertion_reason'
       WHEN regexp_matches(v, '(?i){B}(integer|numerical|value of|answer is (an? )?integer|find the value){B}') THEN 'integer'
       WHEN n > 0 THEN 'mcq_single' ELSE 'subjective' END"""
query("question_type", f"""{with_views("regions")}, t AS (SELECT page_id, reading_order, concat({CLUES}, value) AS v, page_id % 5 AS n FROM regions)
SELECT page_id, reading_order, {MARKS_SQL} AS marks, {TYPE_SQL} AS type FROM t""")(
    lambda get: get("regions").select(
        "page_id", "reading_order", F.concat(F.expr(CLUES), "value").alias("v"), (F.col("page_id") % 5).alias("n")
    ).select("page_id", "reading_order", questions.marks(F.col("v")).alias("marks"), questions.question_type(F.col("v"), F.col("n")).alias("type"))
)
OPT_SQL = r"^[\(\[]?[ \t\n\r\f]*([AaBbCcDd]|[1-4]|[iI][iI][iI][iI]|[iI][iI][iI]|[iI][iI]|[iI][vV]|[iI])[ \t\n\r\f]*[\)\]. \t\n\r\f][ \t\n\r\f]*"
query("option_split", f"""{with_views("regions")}, s AS (SELECT page_id, reading_order, value, trim(value, E' \\t\\n\\r\\f') AS v FROM regions),
m AS (SELECT *, nullif(lower(regexp_extract(v, '{OPT_SQL}', 1)), '') AS raw FROM s),
o AS (SELECT *, coalesce(map {{'i': 'a', 'ii': 'b', 'iii': 'c', 'iv': 'd', '1': 'a', '2': 'b', '3': 'c', '4': 'd'}}[raw], raw) AS letter FROM m)
SELECT page_id AS question_id, reading_order AS pos, last_value(letter IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY reading_order) AS option,
  CASE WHEN letter IS NULL THEN value ELSE nullif(trim(regexp_replace(v, '{OPT_SQL}', ''), E' \\t\\n\\r\\f'), '') END AS value, letter IS NOT NULL AS opens FROM o""")(
    lambda get: questions.split_options(get("regions").select(F.col("page_id").alias("question_id"), F.col("reading_order").alias("pos"), F.lit("text").alias("type"), "value")).drop("type")
)
query("parse_questions")(lambda get: questions.parse_questions(get("regions").select(F.col("page_id").alias("question_id"), F.col("reading_order").alias("pos"), F.lit("text").alias("type"), "value")))



def _asked(get) -> DataFrame:
    """Each page as a question; some of its regions open an option, some hold marks."""
    texts = get("regions").select(F.col("page_id").alias("question_id"), F.col("reading_order").alias("pos"), F.lit("text").alias("type"), "value")
    marked = F.when(F.col("pos") % 7 == 3, F.concat(F.lit("("), F.substring(F.lit("abcd"), (F.col("pos") % 4 + 1).cast("int"), F.lit(1)), F.lit(") "), "value")).otherwise(F.col("value"))
    return texts.withColumn("value", F.when(F.col("pos") % 11 == 5, F.concat(F.lit("one or more [3 marks] "), marked)).otherwise(marked))


query("parsed_questions", f"""{with_views("regions")},
a AS (SELECT page_id AS question_id, reading_order AS pos, CASE WHEN reading_order % 7 = 3 THEN '(' || substr('abcd', CAST(reading_order % 4 + 1 AS INT), 1) || ') ' || value ELSE value END AS o FROM regions),
q AS (SELECT question_id, pos, CASE WHEN pos % 11 = 5 THEN 'one or more [3 marks] ' || o ELSE o END AS value, row_number() OVER (PARTITION BY question_id ORDER BY pos) = 1 AS lead FROM a),
b AS (SELECT question_id, pos, lead, CASE WHEN lead THEN try_cast(nullif(regexp_extract(value, '{Q_SQL}', 1), '') AS BIGINT) END AS number,
  CASE WHEN lead AND regexp_matches(value, '{Q_SQL}') THEN trim(regexp_replace(value, '{Q_SQL}[ \\t\\n\\r\\f]*', ''), E' \\t\\n\\r\\f') ELSE value END AS value FROM q),
k AS (SELECT *, trim(value, E' \\t\\n\\r\\f') AS t FROM b WHERE NOT (lead AND number IS NOT NULL AND value = '')),
m AS (SELECT *, nullif(lower(regexp_extract(t, '{OPT_SQL}', 1)), '') AS raw FROM k),
l AS (SELECT *, coalesce(map {{'i': 'a', 'ii': 'b', 'iii': 'c', 'iv': 'd', '1': 'a', '2': 'b', '3': 'c', '4': 'd'}}[raw], raw) AS letter FROM m),
p AS (SELECT question_id, pos, last_value(letter IGNORE NULLS) OVER (PARTITION BY question_id ORDER BY pos) AS option,
  CASE WHEN letter IS NULL THEN value ELSE nullif(trim(regexp_replace(t, '{OPT_SQL}', ''), E' \\t\\n\\r\\f'), '') END AS value FROM l),
g AS (SELECT question_id, option, coalesce(string_agg(value, ' / ' ORDER BY pos), '') AS text FROM p GROUP BY ALL),
o AS (SELECT question_id, string_agg(option || ': ' || text, ' | ' ORDER BY option) AS options, count(*) AS n FROM g WHERE option IS NOT NULL GROUP BY 1),
f AS (SELECT question_id, string_agg(value, ' ' ORDER BY pos) AS v FROM k GROUP BY 1),
w AS (SELECT i.question_id, i.number, coalesce(f.v, '') AS v, coalesce(o.n, 0) AS n, coalesce(c.text, '') AS content, o.options
  FROM (SELECT question_id, max(number) AS number FROM b GROUP BY 1) i LEFT JOIN f USING (question_id) LEFT JOIN o USING (question_id) LEFT JOIN (SELECT * FROM g WHERE option IS NULL) c ON c.question_id = i.question_id)
SELECT question_id, number, {MARKS_SQL} AS marks, {TYPE_SQL} AS type, content, options FROM w""")(
    lambda get: questions.parse_questions(_asked(get)).withColumns({
        "content": F.array_join("content", " / "),
        "options": F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], " / "))), " | "),
    })
)
query("question_unknown", f"""{with_views("regions")}, c AS (SELECT DISTINCT page_id, -1 - page_id AS blank FROM regions)
SELECT question_id, question_id < 0 AS is_unknown FROM (SELECT page_id AS question_id FROM c UNION ALL SELECT blank FROM c)""")(
    lambda get: questions.parse_questions(
        get("regions").select(F.col("page_id").alias("question_id"), F.col("reading_order").alias("pos"), F.lit("text").alias("type"), "value"),
        get("regions").select(F.explode(F.array("page_id", -1 - F.col("page_id"))).alias("question_id")),
    ).select("question_id", (F.col("type") == "unknown").alias("is_unknown"))
)

# --- tables -----------------------------------------------------------------------------------------------------------


def _tables(get) -> DataFrame:
    t = get("tables")
    shares = lambda n: tables.even_dividers(F.col(n))
    return t.select("*", tables.boundaries(shares("n_rows"), F.col("crop_h")).alias("rb"), tables.boundaries(shares("n_cols"), F.col("crop_w")).alias("cb"),
                    tables.cell_types(F.col("n_rows"), F.col("n_cols"), F.col("header_rows")).alias("types"))


BOUNDS = f"""{with_views("tables")}, g AS (SELECT *,
  list_concat(list_transform(range(0, n_rows), lambda i: CAST(round_even(CAST(i AS DOUBLE) / n_rows * crop_h, 0) AS INT)), [crop_h]) AS rb,
  list_concat(list_transform(range(0, n_cols), lambda i: CAST(round_even(CAST(i AS DOUBLE) / n_cols * crop_w, 0) AS INT)), [crop_w]) AS cb FROM tables)"""
query("table_grid", f"""{BOUNDS}, r AS (SELECT *, unnest(range(0, n_rows)) AS r FROM g), c AS (SELECT *, unnest(range(0, n_cols)) AS c FROM r),
p AS (SELECT table_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CASE WHEN r < header_rows THEN 'header' ELSE 'data' END AS cell_type,
  greatest(0, cb[c + 1] - 4) AS x1, greatest(0, rb[r + 1] - 4) AS y1, least(crop_w, cb[c + 2] + 4) AS x2, least(crop_h, rb[r + 2] + 4) AS y2 FROM c)
SELECT *, CAST(CASE WHEN x2 - x1 < 32 OR y2 - y1 < 32 THEN greatest(CAST(32 AS DOUBLE) / greatest(x2 - x1, 1), CAST(32 AS DOUBLE) / greatest(y2 - y1, 1), 1) ELSE 1 END AS DOUBLE) AS scale FROM p WHERE x2 > x1 AND y2 > y1""")(
    lambda get: tables.grid(_tables(get))
)
query("header_types", f"""{with_views("tables")} SELECT table_id, string_agg(CASE WHEN r < header_rows THEN 'header' ELSE 'data' END, ',' ORDER BY r) AS first_column
FROM (SELECT *, unnest(range(0, n_rows)) AS r FROM tables) GROUP BY table_id""")(lambda get: _tables(get).select("table_id", F.array_join(F.transform("types", lambda r: F.get(r, F.lit(0))), ",").alias("first_column")))
query("table_dividers", f"""{with_views("tables")}, l AS (SELECT table_id, unnest(range(0, n_rows)) AS k, n_rows, crop_h FROM tables),
e AS (SELECT table_id, crop_h, k * crop_h / CAST(n_rows AS DOUBLE) + 1 AS lo, (k + 1) * crop_h / CAST(n_rows AS DOUBLE) - 1 AS hi FROM l),
d AS (SELECT *, row_number() OVER w - 1 AS i, lead(lo) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY table_id ORDER BY lo))
SELECT table_id, i, CAST(printf('%.4f', (hi + nxt) / 2 / crop_h) AS DOUBLE) AS divider FROM d WHERE nxt IS NOT NULL""")(
    lambda get: tables.dividers(
        get("tables").select("table_id", F.lit("row").alias("axis"), "n_rows", "crop_h", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("k")).select(
            "table_id", "axis", (F.col("k") * F.col("crop_h") / F.col("n_rows") + 1).alias("lo"), ((F.col("k") + 1) * F.col("crop_h") / F.col("n_rows") - 1).alias("hi"), F.col("crop_h").alias("dim"))
    ).select("table_id", "i", "divider")
)
query("coco_annotations", f"""{BOUNDS}, e AS (SELECT *, row_number() OVER (ORDER BY table_id) AS image_id FROM g WHERE source = 'edited'),
a AS (
  SELECT image_id, 1 AS k, i, CASE WHEN i < header_rows THEN 1 ELSE 2 END AS category_id, 0 AS x, rb[i + 1] AS y, crop_w AS w, rb[i + 2] - rb[i + 1] AS h FROM (SELECT *, unnest(range(0, n_rows)) AS i FROM e)
  UNION ALL SELECT image_id, 2, i, 3, cb[i + 1], 0, cb[i + 2] - cb[i + 1], crop_h FROM (SELECT *, unnest(range(0, n_cols)) AS i FROM e)
  UNION ALL SELECT image_id, 3, 0, 4, 0, 0, crop_w, crop_h FROM e)
SELECT image_id, row_number() OVER (ORDER BY image_id, k, i) AS annotation_id, category_id, x, y, w, h, w * h AS area FROM a""")(
    lambda get: tables.annotations(_tables(get).where("source = 'edited'"))
)


def _bundled(pieces: DataFrame) -> DataFrame:
    folder = store.run_folder(pieces.sparkSession, "bundles")
    return archives.read(archives.write(pieces, folder), folder)


#: Pages and tables of a bundle in these queries, so that there are several.
IN_BUNDLE = 200
ABOUT_SQL = "'path: .\ntrain: images\nval: images\nnc: 5\nnames: [\"title\", \"plain_text\", \"figure\", \"table\", \"isolate_formula\"]\n'"
query("yolo_bundles", f"""WITH lines AS ({ORACLES["yolo_lines"]}),
p AS (SELECT page_id, string_agg(line, chr(10) ORDER BY det_idx) || chr(10) AS t FROM lines GROUP BY 1), b AS (SELECT *, (row_number() OVER (ORDER BY page_id) - 1) // {IN_BUNDLE} AS bundle FROM p)
SELECT bundle, 'labels/' || page_id || '.txt' AS name, t AS content FROM b
UNION ALL SELECT DISTINCT bundle, 'data.yaml', {ABOUT_SQL} FROM b UNION ALL SELECT DISTINCT bundle, 'README.md', 'Labels: class, centre and size as shares of the image.' || chr(10) FROM b""")(
    lambda get: _bundled(
        archives.label_pieces(export.yolo_lines(detected(get), PAGE_W, PAGE_H).select(F.col("page_id").alias("page"), F.col("page_id").cast("string").alias("stem"), F.col("det_idx").alias("idx"), "line"), pages_in_bundle=IN_BUNDLE)
    ).withColumn("content", F.decode("content", "UTF-8"))
)
BOX = "array<struct<id:long,image_id:long,category_id:int,bbox:array<long>,area:long,iscrowd:int>>"
query("coco_bundles", f"""SELECT (image_id - 1) // {IN_BUNDLE} AS bundle, image_id, annotation_id, category_id, x, y, w, h, area, image_id || '.jpg' AS file_name,
max(CASE WHEN category_id = 4 THEN w END) OVER (PARTITION BY image_id) AS width, max(CASE WHEN category_id = 4 THEN h END) OVER (PARTITION BY image_id) AS height FROM ({ORACLES["coco_annotations"]})""")(
    lambda get: _annotated(_bundled(archives.annotation_pieces(tables.annotations(_tables(get).where("source = 'edited'")), IN_BUNDLE, 32)))
)


def _annotated(files: DataFrame) -> DataFrame:
    """Boxes and the images they are of, out of annotations.json."""
    whole = files.select("bundle", F.from_json(F.decode("content", "UTF-8"), f"images array<struct<id:long,file_name:string,width:long,height:long>>, annotations {BOX}").alias("j"))
    images = whole.select("bundle", F.explode("j.images").alias("i")).select("bundle", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    boxes = whole.select("bundle", F.explode("j.annotations").alias("a")).select("bundle", F.col("a.id").alias("annotation_id"), "a.image_id", "a.category_id", *(F.col("a.bbox")[k].alias(c) for k, c in enumerate("xywh")), "a.area")
    return boxes.join(images, ["bundle", "image_id"])


query("cell_argmax", f"""{with_views("boxes")} SELECT page_id AS cell_id, arg_max(class_id, (confidence, -det_idx)) AS label FROM boxes GROUP BY page_id""")(
    lambda get: tables.surest(get("boxes").select(F.col("page_id").alias("cell_id"), F.col("det_idx").alias("idx"), F.col("class_id").alias("label"), "confidence"))
)
query("table_regroup", f"""{BOUNDS} SELECT table_id, n_rows AS rows, n_cols AS cols FROM g""")(
    lambda get: tables.regroup(tables.grid(_tables(get)).select("table_id", "r", "c", F.col("cell_type").alias("content"))).select("table_id", "rows", "cols")
)


def _pipes(get) -> DataFrame:
    """Regions as pipe tables: a heading, sometimes a rule, and all further words in rows of three."""
    w = F.split("value", " ")
    at = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    row = lambda i: F.concat(F.lit("| "), at(i), F.lit(" |  "), at(i + 1), F.lit("\\|x | "), at(i + 2), F.lit(" |"))
    rule = F.when(F.col("page_id") % 2 == 0, F.lit("|---|---|---|")).otherwise(F.lit("  "))
    rows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(2), F.floor((F.size(w) - 1) / 3).cast("int"))), lambda k: row(k * 3))
    return get("regions").select("page_id", "reading_order", F.concat(F.array(row(F.lit(0)), rule), rows).alias("lines"))


WS = "E' \\t\\n\\r\\f'"
_AT = lambda i: f"coalesce(w[{i} + 1], '')"
_ROW = lambda i: f"'| ' || {_AT(i)} || ' |  ' || {_AT(f'{i} + 1')} || '\\|x | ' || {_AT(f'{i} + 2')} || ' |'"
PIPES = f"""{with_views("regions")}, v AS (SELECT page_id, reading_order, string_split(value, ' ') AS w FROM regions),
l AS (SELECT page_id, reading_order, list_concat([{_ROW(0)}, CASE WHEN page_id % 2 = 0 THEN '|---|---|---|' ELSE '  ' END],
  list_transform(range(1, greatest(2, (len(w) - 1) // 3) + 1), lambda k: {_ROW("k * 3")})) AS lines FROM v),
s AS (SELECT page_id, reading_order, list_filter(list_transform(lines, lambda x: trim(x, {WS})), lambda x: x <> '') AS lines FROM l),
f AS (SELECT page_id, reading_order, lines, list_transform(lines, lambda x: list_transform(string_split(x, '|'), lambda c: trim(c, {WS}))) AS parts FROM s),
c AS (SELECT page_id, reading_order, lines, list_transform(parts, lambda p: p[CASE WHEN p[1] = '' THEN 2 ELSE 1 END : CASE WHEN p[-1] = '' THEN len(p) - 1 ELSE len(p) END]) AS parts FROM f),
r AS (SELECT page_id, reading_order, lines, list_transform(parts, lambda p: list_transform(p, lambda c:
  trim(regexp_replace(replace(regexp_replace(regexp_replace(c, '^[ \\t\\n\\r\\f\\v]*\\|[ \\t\\n\\r\\f\\v]*', ''), '[ \\t\\n\\r\\f\\v]*\\|[ \\t\\n\\r\\f\\v]*$', ''), '\\|', '|'), '[ \\t\\f\\v]+', ' ', 'g'), {WS}))) AS rows FROM c)"""
query("format_table", f"""{PIPES}, n AS (SELECT page_id, reading_order, list_filter(rows, lambda x: len(x) > 0) AS rows FROM r),
w AS (SELECT page_id, reading_order, rows, list_max(list_transform(rows, lambda x: len(x))) AS width FROM n),
p AS (SELECT page_id, reading_order, width, list_transform(rows, lambda x: list_concat(x, list_transform(range(0, width - len(x)), lambda i: ''))) AS rows FROM w),
h AS (SELECT *, len(list_filter(rows[1], lambda c: length(c) > 15)) = 0
  OR len(list_filter(rows[1], lambda c: length(c) > 1 AND (regexp_matches(c, '\\p{{Ll}}|\\p{{Lt}}') OR NOT regexp_matches(c, '\\p{{Lu}}')))) = 0 AS heading FROM p),
g AS (SELECT *, list_filter(range(1, len(rows) + 1), lambda i: (i = 1 AND heading) OR len(list_filter(rows[i], lambda c: NOT regexp_matches(c, '^-*$'))) > 0) AS kept FROM h),
o AS (SELECT *, list_transform(kept, lambda i: '| ' || array_to_string(rows[i], ' | ') || ' |') AS shown FROM g)
SELECT page_id, reading_order, CASE WHEN len(shown) = 0 THEN '' ELSE array_to_string(list_concat(shown[1:1], CASE WHEN heading OR len(kept) = len(rows)
  THEN ['| ' || array_to_string(list_transform(range(0, width), lambda i: '---'), ' | ') || ' |'] ELSE [] END, shown[2:]), chr(10)) END AS markdown FROM o""")(
    lambda get: _pipes(get).select("page_id", "reading_order", tables.format_table(F.col("lines")).alias("markdown"))
)
query("table_tsv", f"""{PIPES}, k AS (SELECT page_id, reading_order, list_filter(range(1, len(lines) + 1), lambda i: NOT regexp_matches(lines[i], '^[-| ]*$') AND len(rows[i]) > 0) AS kept, rows FROM r)
SELECT page_id, reading_order, array_to_string(list_transform(kept, lambda i: array_to_string(rows[i], chr(9))), chr(10)) AS tsv FROM k""")(
    lambda get: _pipes(get).select("page_id", "reading_order", tables.tsv(F.col("lines")).alias("tsv"))
)
query("cell_normalize", f"""{with_views("regions")}, c AS (SELECT page_id, reading_order, concat(' | ', value, '\\|  x | ') AS v FROM regions)
SELECT page_id, reading_order, trim(regexp_replace(replace(regexp_replace(regexp_replace(v, '^[ \\t\\n\\r\\f]*\\|[ \\t\\n\\r\\f]*', ''), '[ \\t\\n\\r\\f]*\\|[ \\t\\n\\r\\f]*$', ''), '\\|', '|'), '[ \\t\\f]+', ' ', 'g'), E' \\t\\n\\r\\f') AS cell FROM c""")(
    lambda get: get("regions").select("page_id", "reading_order", text.normalize_cell(F.concat(F.lit(" | "), F.col("value"), F.lit("\\|  x | "))).alias("cell"))
)

# --- export -----------------------------------------------------------------------------------------------------------


def _columns(get) -> DataFrame:
    box = _blocks(get).where("error IS NULL").withColumns({"x1": F.col("column_idx") * 1000, "x2": F.col("column_idx") * 1000 + 900})
    return export.column_tree(box)


query("column_tree_bbox", f"""{with_views("regions")} SELECT page_id, column_idx, min(column_idx * 1000) AS x1, min(y1) AS y1, max(column_idx * 1000 + 900) AS x2, max(y2) AS y2,
  string_agg(CAST(reading_order AS STRING), ',' ORDER BY reading_order) AS block_ids FROM regions WHERE (page_id + reading_order) % 7 <> 5 GROUP BY ALL""")(
    lambda get: _columns(get).select("page_id", "column_idx", "x1", "y1", "x2", "y2", F.array_join(F.transform("groups", lambda g: g["block_id"]), ",").alias("block_ids"))
)
MD = f"""{ELEMENTS}, r AS (SELECT k.*, label, column_idx FROM k JOIN (SELECT page_id, reading_order, label, column_idx FROM regions) USING (page_id, reading_order)),
b AS (SELECT page_id, reading_order, label, column_idx, string_agg(CASE WHEN type = 'latex' AND display THEN chr(10) || '$$' || chr(10) || value || chr(10) || '$$' || chr(10)
   WHEN type = 'latex' THEN '$' || value || '$' WHEN type = 'image' THEN '![image](/media/figures/' || value || ')' ELSE value END, ' ' ORDER BY i) AS t FROM r GROUP BY ALL),
g AS (SELECT *, CASE WHEN label = 'title' THEN chr(10) || '## ' || trim(t, E' \\t\\n') || chr(10) ELSE chr(10) || trim(t, E' \\t\\n') || chr(10) END AS m FROM b),
c AS (SELECT page_id, column_idx, string_agg(m, chr(10) ORDER BY reading_order) AS m, count(*) OVER (PARTITION BY page_id) AS n FROM g GROUP BY page_id, column_idx)
SELECT page_id, trim(string_agg(CASE WHEN n > 1 THEN chr(10) || '<!-- column ' || CAST(column_idx AS STRING) || ' -->' || chr(10) || chr(10) ELSE '' END || m, chr(10) ORDER BY column_idx), E' \\t\\n') || chr(10) AS markdown FROM c GROUP BY page_id"""
query("export_markdown", MD)(lambda get: export.page_tree(_columns(get)).select("page_id", export.page_md(F.col("columns")).alias("markdown")))
ESC = "replace(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
COLOUR_SQL = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in export.COLOURS.items()) + " ELSE '#888' END"
HTML = f"""{ELEMENTS}, r AS (SELECT k.*, label, column_idx FROM k JOIN (SELECT page_id, reading_order, label, column_idx FROM regions) USING (page_id, reading_order)),
b AS (SELECT page_id, reading_order, label, column_idx, string_agg(CASE WHEN type = 'latex' AND display THEN '<div class="b-latex-display">$$' || {ESC} || '$$</div>'
   WHEN type = 'latex' THEN '<span class="b-latex-inline">$' || {ESC} || '$</span>' WHEN type = 'image' THEN '<img src="/media/figures/' || value || '" alt="" style="max-width:100%;display:block;margin:6px 0"/>'
   ELSE '<span>' || {ESC} || '</span> ' END, '' ORDER BY i) AS t FROM r GROUP BY ALL),
g AS (SELECT *, CASE WHEN label = 'title' THEN 'h2' ELSE 'div' END AS tag FROM b),
h AS (SELECT *, '<' || tag || ' class="content-group" data-label="' || label || '" style="border-left:3px solid ' || {COLOUR_SQL} || ';padding:8px 12px;margin:6px 0">' || t || '</' || tag || '>' AS x FROM g),
c AS (SELECT page_id, column_idx, '<div class="column">' || string_agg(x, '' ORDER BY reading_order) || '</div>' AS x, count(*) OVER (PARTITION BY page_id) AS n FROM h GROUP BY page_id, column_idx)
SELECT page_id, '<div style="' || CASE WHEN max(n) >= 2 THEN 'display:grid;grid-template-columns:1fr 1fr;gap:16px;' ELSE '' END || '">' || string_agg(x, '' ORDER BY column_idx) || '</div>' AS html FROM c GROUP BY page_id"""
query("export_html", HTML)(lambda get: export.page_tree(_columns(get)).select("page_id", export.page_html_body(F.col("columns")).alias("html")))

# --- formulas ---------------------------------------------------------------------------------------------------------

SYMBOLS = latex.FIRST_SYMBOLS | {k: "\\" + v for k, v in latex.BINARY.items()} | latex.SECOND_SYMBOLS


def _symbols_sql() -> str:
    out = "expr"
    for k, v in SYMBOLS.items():
        out = f"replace({out}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return out


query("latex_symbols", f"{with_views('formulas')} SELECT id, {_symbols_sql()} AS expr FROM formulas")(lambda get: get("formulas").select("id", latex.symbols(F.col("expr"), SYMBOLS).alias("expr")))
query("clean_latex")(lambda get: get("formulas").select("id", latex.clean_latex("expr").alias("expr")))
query("mathrm_plain", f"""{with_views("formulas")}, m AS (SELECT id, CASE id % 4 WHEN 0 THEN '\\mathrm{{o f}} \\mathrm{{the }}' WHEN 1 THEN '\\mathrm{{x}}+1' WHEN 2 THEN ' \\mathrm{{a}}' ELSE expr END AS e FROM formulas)
SELECT id, CASE id % 4 WHEN 0 THEN 'o f the' WHEN 2 THEN 'a' END AS plain FROM m""")(
    lambda get: get("formulas").select("id", F.when(F.col("id") % 4 == 0, r"\mathrm{o f} \mathrm{the }").when(F.col("id") % 4 == 1, r"\mathrm{x}+1").when(F.col("id") % 4 == 2, r" \mathrm{a}").otherwise(F.col("expr")).alias("e")).select("id", latex.roman_text(F.col("e")).alias("plain"))
)

# --- mutations --------------------------------------------------------------------------------------------------------


def _change(get) -> DataFrame:
    return get("doc_pages").where("document_id % 3 = 0").select("document_id", (F.col("page_number") + 1).alias("page_number"), F.lit("ocr-complete").alias("status")).distinct()


UPSERTED = f"""{with_views("docs", "doc_pages")}, ch AS (SELECT DISTINCT document_id, page_number + 1 AS page_number, 'ocr-complete' AS status FROM doc_pages WHERE document_id % 3 = 0),
up AS (SELECT coalesce(c.document_id, p.document_id) AS document_id, coalesce(c.page_number, p.page_number) AS page_number, coalesce(c.status, p.status) AS status
  FROM doc_pages p FULL JOIN ch c ON c.document_id = p.document_id AND c.page_number = p.page_number)"""
query("page_upsert", f"{UPSERTED} SELECT * FROM up")(lambda get: mutations.upsert_pages(get("doc_pages"), _change(get)))
query("page_save_status", f"""{UPSERTED}, p AS (SELECT document_id, count(*) FILTER (status = 'ocr-complete') AS o, count(*) FILTER (status IN ('ocr-complete', 'layout-detected')) AS l FROM up GROUP BY 1)
SELECT id, CASE WHEN page_count > 0 AND coalesce(o, 0) = page_count THEN 'complete' WHEN coalesce(l, 0) > 0 THEN 'partial' ELSE status END AS status FROM docs LEFT JOIN p ON document_id = id""")(
    lambda get: mutations.save_pages(get("docs"), get("doc_pages"), _change(get))[1].select("id", "status")
)
query("page_renumber", f"""{with_views("doc_pages")}, k AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM doc_pages)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, status) AS page_number, status FROM k WHERE page_number <> 2 OR n <= 1""")(
    lambda get: mutations.delete_page(get("doc_pages"), get("doc_pages").where("page_number = 2"))
)
query("next_page_of_each", f"""{with_views('docs', 'doc_pages')} SELECT id AS document_id, coalesce(m, 0) + 1 AS next_page
FROM docs LEFT JOIN (SELECT document_id, max(page_number) AS m FROM doc_pages GROUP BY 1) ON document_id = id""")(lambda get: library.last_page(get("doc_pages"), get("docs")))


def _stored_pages(get) -> DataFrame:
    return get("doc_pages").select("document_id", "page_number", "status", F.concat(F.lit("b"), F.col("page_number").cast("string")).alias("ocr_blocks"), F.lit("s").alias("structured_content"), F.lit("edited").alias("structure_status"))


def _partial_change(get) -> DataFrame:
    """Two changes in turn to some pages, each of some fields, and new pages 99."""
    k, text = F.col("document_id") + F.col("page_number"), F.lit(None).cast("string")
    pages = get("doc_pages").select("document_id", "page_number")
    first = pages.where(k % 3 == 0).select("document_id", "page_number", F.lit(1).alias("seq"), F.lit("ocr-complete").alias("status"), F.lit("first").alias("ocr_blocks"), F.lit("t").alias("structured_content"))
    second = pages.where(k % 5 == 0).select("document_id", "page_number", F.lit(2).alias("seq"), text.alias("status"), F.lit("second").alias("ocr_blocks"), text.alias("structured_content"))
    new = get("docs").where("id % 50 = 0").select(F.col("id").alias("document_id"), F.lit(99).alias("page_number"), F.lit(1).alias("seq"), F.lit("layout-detected").alias("status"), text.alias("ocr_blocks"), text.alias("structured_content"))
    return first.unionByName(second).unionByName(new)


PARTIAL = f"""{with_views('docs', 'doc_pages')}, k AS (SELECT *, (document_id + page_number) % 3 = 0 AS a, (document_id + page_number) % 5 = 0 AS b FROM doc_pages),
saved AS (SELECT document_id, page_number, CASE WHEN a THEN 'ocr-complete' ELSE status END AS status,
  CASE WHEN b THEN 'second' WHEN a THEN 'first' ELSE 'b' || CAST(page_number AS STRING) END AS ocr_blocks,
  CASE WHEN b THEN NULL WHEN a THEN 't' ELSE 's' END AS structured_content, CASE WHEN b THEN 'none' ELSE 'edited' END AS structure_status FROM k
  UNION ALL SELECT id, 99, 'layout-detected', '[]', NULL, 'none' FROM docs WHERE id % 50 = 0)"""
query("page_partial_save", f"{PARTIAL} SELECT * FROM saved")(lambda get: mutations.save_pages(get("docs"), _stored_pages(get), _partial_change(get), "seq")[0])


def _page_table(get) -> PageTable:
    spark = get("docs").sparkSession
    return PageTable(spark, store.run_folder(spark, "pages"))


def _saved_table(get) -> DataFrame:
    """The same changes as two saves to a versioned table."""
    table = _page_table(get)
    table.create(_stored_pages(get))
    table.log(_partial_change(get).where("seq = 1"))
    table.save(_partial_change(get).where("seq = 2"))
    return table.read()


def _few_saved(get) -> DataFrame:
    """Versions before and after a save of the newest hundredth of the documents, and how many pages a reader of each finds changed."""
    table = _page_table(get)
    table.create(_stored_pages(get))
    before = table.read()
    newest = get("docs").agg((F.max("id") - F.max("id") / 100).alias("least"))
    few = get("doc_pages").join(F.broadcast(newest), F.col("document_id") > F.col("least"))  # of one row
    table.save(few.select("document_id", "page_number", F.lit("saved").alias("ocr_blocks")))
    seen = [(v, df.where("ocr_blocks = 'saved'").count()) for v, df in ((1, before), (2, table.read()))]
    return table.history().join(table.spark.createDataFrame(seen, "version long, changed long"), "version")


query("page_table_save", f"{PARTIAL} SELECT * FROM saved")(_saved_table)
query("page_table_versions", f"""{with_views('docs', 'doc_pages')}, f AS (SELECT max(id) - max(id) / 100 AS least FROM docs),
p AS (SELECT document_id // {SPAN} AS b, document_id > least AS hit FROM doc_pages, f),
n AS (SELECT count(DISTINCT b) AS buckets, count(DISTINCT b) FILTER (hit) AS rewritten, count(*) FILTER (hit) AS changed FROM p)
SELECT 1 AS version, buckets, buckets AS rewritten, 0 AS changed FROM n UNION ALL SELECT 2, buckets, rewritten, changed FROM n""")(_few_saved)


def _figure_saves(get) -> tuple[DataFrame, DataFrame]:
    """Pages with figures, and up to three saves of each: new blocks, blocks with their structure, the first blocks again."""
    f = get("figures").groupBy("document_id", "page_number").agg(F.min("old_blocks").alias("ocr_blocks"), F.max("new_blocks").alias("new_blocks"))
    pages = f.select("document_id", "page_number", F.lit("layout-detected").alias("status"), "ocr_blocks", F.lit("s").alias("structured_content"), F.lit("edited").alias("structure_status"))
    save = lambda seq, blocks, where, **more: f.where(where).select("document_id", "page_number", F.lit(seq).alias("seq"), blocks.alias("ocr_blocks"), *(F.lit(more.get(c)).cast("string").alias(c) for c in ("status", "structured_content")))
    k = F.col("document_id") + F.col("page_number")
    first = save(1, F.col("new_blocks"), F.col("new_blocks").isNotNull(), status="ocr-complete")
    second = save(2, F.lit("[]"), k % 3 == 0, structured_content="t")
    third = save(3, F.col("ocr_blocks"), k % 2 == 0)
    status = save(4, F.lit(None).cast("string"), k % 5 == 0, status="idle")
    return pages, first.unionByName(second).unionByName(third).unionByName(status)


SAVES = f"""{with_views("figures")}, p AS (SELECT document_id, page_number, min(old_blocks) AS b0, max(new_blocks) AS b1, (document_id + page_number) % 3 = 0 AS two, (document_id + page_number) % 2 = 0 AS three,
  (document_id + page_number) % 5 = 0 AS four FROM figures GROUP BY ALL),
c AS (SELECT document_id, page_number, 0 AS seq, b0 AS b, true AS whole FROM p UNION ALL SELECT document_id, page_number, 1, b1, false FROM p WHERE b1 IS NOT NULL
  UNION ALL SELECT document_id, page_number, 2, '[]', true FROM p WHERE two UNION ALL SELECT document_id, page_number, 3, b0, false FROM p WHERE three),
l AS (SELECT *, lag(b) OVER (PARTITION BY document_id, page_number ORDER BY seq) AS before FROM c),
u AS (SELECT document_id, page_number, b, unnest(regexp_extract_all(before, '/media/figures/[^\\s"''<>]+')) AS url FROM l WHERE NOT whole),
dropped AS (SELECT DISTINCT document_id, page_number, url FROM u WHERE NOT contains(b, url || '"'))"""
query("page_dropped_figures", f"{SAVES} SELECT * FROM dropped")(lambda get: mutations.dropped_figures(*_figure_saves(get), "seq"))


def _streamed(get) -> DataFrame:
    """The figure saves as a stream: half of them arrive late, behind the pages themselves, in batches of their own."""
    pages, change = _figure_saves(get)
    spark = pages.sparkSession
    root = store.run_folder(spark, "saves")
    arrives = F.when(F.col("seq").isNull(), 1).otherwise(F.pmod(F.col("seq") + F.col("document_id"), F.lit(2)) * 2)
    rows = page_stream.snapshot(pages).unionByName(page_stream.saves(change, "seq")).withColumn("arrives", arrives)
    for turn in range(3):
        rows.where(F.col("arrives") == turn).drop("arrives").write.mode("append").parquet(f"{root}/in")
        page_stream.fold_files(spark, f"{root}/in", f"{root}/out", f"{root}/state", files_in_batch=1000)
    return page_stream.last_emitted(spark, f"{root}/out").withColumn("dropped", F.array_join("dropped", "|"))


query("page_save_stream", f"""{SAVES}, d AS (SELECT document_id, page_number, string_agg(url, '|' ORDER BY url) AS dropped FROM dropped GROUP BY ALL)
SELECT p.document_id, p.page_number, CASE WHEN four THEN 'idle' WHEN b1 IS NOT NULL THEN 'ocr-complete' ELSE 'layout-detected' END AS status,
  CASE WHEN three THEN b0 WHEN two THEN '[]' WHEN b1 IS NOT NULL THEN b1 ELSE b0 END AS ocr_blocks,
  CASE WHEN three THEN NULL WHEN two THEN 't' WHEN b1 IS NOT NULL THEN NULL ELSE 's' END AS structured_content,
  CASE WHEN three OR (b1 IS NOT NULL AND NOT two) THEN 'none' ELSE 'edited' END AS structure_status, coalesce(dropped, '') AS dropped
FROM p LEFT JOIN d USING (document_id, page_number)""")(_streamed)
query("page_delete_blank", f"""{with_views('docs', 'doc_pages')}, k AS (SELECT p.*, id % 3 = 0 AND (id % 2 = 0 OR page_number = 1) AS hit, max(page_number) OVER (PARTITION BY document_id) AS last,
  sum(CASE WHEN id % 3 = 0 AND (id % 2 = 0 OR page_number = 1) THEN 0 ELSE 1 END) OVER (PARTITION BY document_id) AS others FROM doc_pages p JOIN docs ON id = document_id)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, status) AS page_number, status FROM k WHERE NOT hit OR (others = 0 AND page_number = last)""")(
    lambda get: mutations.delete_pages(
        get("docs").withColumn("file_type", F.when(F.col("id") % 3 == 0, "blank").otherwise("pdf")), get("doc_pages"), get("doc_pages").where("document_id % 2 = 0 OR page_number = 1")
    )[1]
)
query("invalidate_structure", f"""{with_views("doc_pages")} SELECT document_id, page_number, CASE WHEN document_id % 2 = 0 THEN NULL ELSE 'old' END AS structured_content,
CASE WHEN document_id % 2 = 0 THEN 'none' ELSE 'edited' END AS structure_status FROM doc_pages""")(
    lambda get: mutations.invalidate_structure(
        get("doc_pages").select("document_id", "page_number", F.when(F.col("document_id") % 2 == 0, "[]").alias("new_blocks"), F.lit(None).cast("string").alias("new_structure"), F.lit("old").alias("structured_content"), F.lit("edited").alias("structure_status"))
    ).select("document_id", "page_number", "structured_content", "structure_status")
)
query("soft_delete", f"""{with_views("docs")} SELECT id, CASE WHEN id % 6 = 0 AND deleted_at IS NULL THEN TIMESTAMP '2024-06-01' WHEN id % 20 = 0 AND id % 6 <> 0 THEN NULL ELSE deleted_at END AS deleted_at FROM docs""")(
    lambda get: mutations.restore(mutations.soft_delete(get("docs"), get("docs").where("id % 6 = 0"), "2024-06-01"), get("docs").where("id % 20 = 0 AND id % 6 <> 0")).select("id", "deleted_at")
)
query("hard_delete_activity", f"{with_views('docs', 'activity')} SELECT id, CASE WHEN document_id IN (SELECT id FROM docs WHERE id % 4 = 0) THEN NULL ELSE document_id END AS document_id, action FROM activity")(
    lambda get: mutations.hard_delete(get("docs"), get("doc_pages"), get("activity"), get("docs").where("id % 4 = 0"))[2].select("id", "document_id", "action")
)
query("replace_tags", f"""{with_views("doc_tags")} SELECT document_id, tag FROM doc_tags WHERE document_id % 8 <> 0
UNION ALL SELECT DISTINCT document_id, 'kept' FROM doc_tags WHERE document_id % 16 = 0""")(
    lambda get: mutations.replace_tags(get("doc_tags"), get("doc_tags").where("document_id % 8 = 0").select("document_id", F.when(F.col("document_id") % 16 == 0, "kept").alias("tag")))
)
query("delete_folders", f"""{with_views("docs", "folders")}, gone AS (SELECT id FROM folders WHERE id = 'r1' OR parent_id = 'r1')
SELECT id, CASE WHEN folder_id IN (SELECT id FROM gone) THEN NULL ELSE folder_id END AS folder_id FROM docs""")(
    lambda get: mutations.delete_folders(get("folders"), get("docs"), get("folders").where("id = 'r1'"))[1].select("id", "folder_id")
)
query("toggle_star", f"{with_views('docs')} SELECT id, CASE WHEN id % 3 = 0 THEN NOT is_starred ELSE is_starred END AS is_starred FROM docs")(lambda get: mutations.toggle_star(get("docs"), get("docs").where("id % 3 = 0")).select("id", "is_starred"))
query("update_documents", f"{with_views('docs')} SELECT id, CASE WHEN id % 7 = 0 THEN 'renamed' ELSE filename END AS filename, status FROM docs")(
    lambda get: mutations.update(get("docs"), get("docs").where("id % 7 = 0").select("id", F.lit("renamed").alias("filename"), F.lit(None).cast("string").alias("status"))).select("id", "filename", "status")
)

# --- state ------------------------------------------------------------------------------------------------------------

query("session_lru", f"""{with_views("sessions")}, l AS (SELECT session_id, max(ts) AS ts FROM sessions GROUP BY 1)
SELECT session_id, ts FROM l ORDER BY ts DESC, session_id DESC LIMIT {streams.KEPT}""")(lambda get: streams.newest_sessions(get("sessions")))
NDJSON = f"""{ELEMENTS}, x AS (SELECT page_id, reading_order, '[' || string_agg('{{"type":"' || type || '","value":' || to_json(value) || ',"display":' || CAST(display AS STRING) || ',"url":' || to_json('/media/figures/' || value) || ',"alt":"","width":0,"height":0,"rows":0,"cols":0}}', ',' ORDER BY i) || ']' AS blocks FROM k GROUP BY ALL),
lines AS (SELECT r.page_id, row_number() OVER (PARTITION BY r.page_id ORDER BY r.reading_order) - 1 AS seq, r.label, CAST(r.reading_order AS STRING) AS block_id,
  CASE WHEN (r.page_id + r.reading_order) % 7 = 5 OR value IS NOT NULL THEN coalesce(blocks, '[]') END AS blocks, (r.page_id + r.reading_order) % 7 = 5 AS bad FROM regions r LEFT JOIN x USING (page_id, reading_order)),
json AS (SELECT page_id, seq, '{{"block_id":"' || block_id || '","label":"' || label || '"' || coalesce(',"blocks":' || blocks, '') || CASE WHEN bad THEN ',"error":"unreadable"' ELSE '' END || '}}' AS line FROM lines)"""


def _lines(get) -> DataFrame:
    return streams.ndjson(_blocks(get).select("page_id", "block_id", "reading_order", "label", "blocks", "error"))


def _sunk(get) -> DataFrame:
    """The lines as a stream into the NDJSON sink, in three batches, and read back in the order of the files."""
    lines = _lines(get).withColumn("line", F.concat(F.lit('{"page_id":'), F.col("page_id").cast("string"), F.lit(","), F.substring("line", 2, F.length("line"))))
    spark = plugins.register(lines.sparkSession)
    root = store.run_folder(spark, "ndjson")
    for turn in range(3):
        lines.where(F.pmod("page_id", F.lit(3)) == turn).write.mode("append").parquet(f"{root}/in")
        plugins.write_lines(spark.readStream.schema(lines.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/state").awaitTermination()
    found = spark.read.format("page_ndjson").option("path", f"{root}/out").load().withColumn("page_id", F.get_json_object("line", "$.page_id").cast("long"))
    place = Window.partitionBy("page_id").orderBy("batch", "at")  # a page's lines are in one file
    return found.select("page_id", (F.row_number().over(place) - 1).alias("seq"), "line")


query("ocr_ndjson_stream", f"{NDJSON} SELECT page_id, seq, line FROM json")(_lines)
query("ocr_ndjson_sink", f"""{NDJSON} SELECT page_id, seq, '{{"page_id":' || CAST(page_id AS STRING) || ',' || substr(line, 2) AS line FROM json""")(_sunk)



def _streamed_sessions(get) -> DataFrame:
    """The sessions as a stream of three batches, later ones first."""
    s = get("sessions")
    root = store.run_folder(s.sparkSession, "sessions")
    for turn in range(3):
        s.where(F.pmod(F.col("event_id").cast("long"), F.lit(3)) == 2 - turn).select("session_id", F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(f"{root}/in")
        session_stream.fold_files(s.sparkSession, f"{root}/in", f"{root}/out", f"{root}/state", files_in_batch=1000)
    return session_stream.merged(s.sparkSession, f"{root}/out").select("session_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


query("session_lru_stream", ORACLES["session_lru"])(_streamed_sessions)
PARTS = f"""{with_views("boxes")}, p AS (SELECT page_id AS table_id, det_idx AS idx, CASE class_id % 5 WHEN 0 THEN 'table row' WHEN 1 THEN 'table column' WHEN 2 THEN 'table row' WHEN 3 THEN 'table column header' ELSE 'table' END AS label,
  confidence AS score, x1, y1, x2, y2 FROM boxes WHERE confidence > 0.7),
l AS (SELECT table_id, 'row' AS axis, idx, y1 AS lo, y2 AS hi, {PAGE_H} AS dim FROM p WHERE label = 'table row' UNION ALL SELECT table_id, 'col', idx, x1, x2, {PAGE_W} FROM p WHERE label = 'table column'),
d AS (SELECT *, lead(lo) OVER w AS nxt, row_number() OVER w AS i FROM l WINDOW w AS (PARTITION BY table_id, axis ORDER BY lo, idx)),
s AS (SELECT table_id, string_agg(printf('%.4f', (hi + nxt) / 2.0 / dim), ',' ORDER BY i) FILTER (axis = 'row') AS r, string_agg(printf('%.4f', (hi + nxt) / 2.0 / dim), ',' ORDER BY i) FILTER (axis = 'col') AS c,
  count(*) FILTER (axis = 'row') AS nr, count(*) FILTER (axis = 'col') AS nc FROM d WHERE nxt IS NOT NULL GROUP BY table_id),
h AS (SELECT table_id, count(*) AS n FROM p WHERE label = 'table column header' GROUP BY table_id), t AS (SELECT DISTINCT page_id AS table_id FROM boxes)
SELECT table_id, coalesce(r, '') AS row_dividers, coalesce(c, '') AS col_dividers, coalesce(n, 0) AS header_rows, coalesce(nr, 0) + 1 AS n_rows, coalesce(nc, 0) + 1 AS n_cols, least(coalesce(n, 0), coalesce(nr, 0) + 1) AS typed
FROM t LEFT JOIN s USING (table_id) LEFT JOIN h USING (table_id)"""


@query("table_structure", PARTS)
def _table_structure(get):
    kinds = F.element_at(F.array(*map(F.lit, (tables.ROW, tables.COLUMN, tables.ROW, tables.COLUMN_HEADER, "table"))), F.col("class_id") % 5 + 1)
    parts = get("boxes").select(F.col("page_id").alias("table_id"), F.col("det_idx").alias("idx"), kinds.alias("label"), F.col("confidence").alias("score"), *("x1", "y1", "x2", "y2"))
    crops = get("boxes").select(F.col("page_id").alias("table_id"), F.lit(PAGE_W).alias("w"), F.lit(PAGE_H).alias("h")).distinct()
    shown = lambda c: F.array_join(F.transform(c, lambda d: F.format_string("%.4f", d)), ",").alias(c)
    typed = F.size(F.filter("cell_types", lambda row: row[0] == "header"))
    return tables.structure(crops, parts).select("table_id", shown("row_dividers"), shown("col_dividers"), "header_rows", F.size("cell_types").alias("n_rows"), F.size(F.get("cell_types", F.lit(0))).alias("n_cols"), typed.alias("typed"))


# --- rows, creation and geometry --------------------------------------------------------------------------------------

ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({c}) % 1000000 = 0 THEN '' ELSE strftime({c}, '.%f') END || '+00:00'"


@query("doc_rows", f"""{with_views("docs", "doc_pages", "doc_tags")}, d AS (SELECT *, created_at + to_microseconds(id * 1001000) AS updated_at FROM docs),
p AS (SELECT document_id, count(*) FILTER (status = 'layout-detected') AS l, count(*) FILTER (status = 'ocr-complete') AS o FROM doc_pages GROUP BY 1),
t AS (SELECT document_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM doc_tags GROUP BY 1)
SELECT CAST(id AS STRING) AS id, filename, page_count, status, CASE WHEN id % 3 = 0 THEN 'https://host/media/t/' || CAST(id AS STRING) || '.jpg' END AS thumbnail_url,
  CASE WHEN id % 4 <> 3 THEN 'https://host/media/pdfs/' || filename END AS pdf_url, {ISO.format(c="created_at")} AS created_at, {ISO.format(c="updated_at")} AS updated_at,
  is_starred, folder_id, coalesce(tags, '') AS tag_ids, file_size, {FT} AS file_type, {ISO.format(c="deleted_at")} AS deleted_at, coalesce(l, 0) AS pages_layout_done, coalesce(o, 0) AS pages_ocr_done
FROM d LEFT JOIN p ON p.document_id = id LEFT JOIN t ON t.document_id = id""")
def _doc_rows(get):
    docs = get("docs").withColumns({
        "thumbnail": F.when(F.col("id") % 3 == 0, F.concat(F.lit("t/"), F.col("id").cast("string"), F.lit(".jpg"))), "pdf_file": F.when(F.col("id") % 4 != 3, F.concat(F.lit("pdfs/"), "filename")).otherwise(""),
        "updated_at": F.timestamp_add("MILLISECOND", F.col("id") * 1001, F.col("created_at")), "file_type": library.file_type(F.col("filename")),
    })
    links = get("doc_tags").withColumnRenamed("tag", "tag_id")
    return library.rows(docs, get("doc_pages"), links, "https://host/").withColumn("tag_ids", F.array_join("tag_ids", "|"))


query("doc_tag_search", f"""{with_views("docs", "doc_tags")} SELECT id, filename FROM docs WHERE deleted_at IS NULL AND id IN (SELECT document_id FROM doc_tags WHERE tag = 'PROMO')""")(
    lambda get: library.search(get("docs"), get("doc_tags"), tag="PROMO").select("id", "filename")
)
query("usable_sessions", f"""{with_views("doc_pages")} SELECT document_id, page_number FROM doc_pages WHERE (document_id + page_number) % 3 = 2""")(
    lambda get: library.with_usable_session(
        get("doc_pages").withColumn("session_id", F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("s")), ((F.col("document_id") + F.col("page_number")) % 3 + 1).cast("int")))
    ).select("document_id", "page_number")
)


def _new_documents(get) -> DataFrame:
    """A new document for each that is there, blank for even ids, and rows that repeat ids."""
    d = get("docs")
    new = d.select(
        (-1 - F.col("id")).alias("id"), F.when(F.col("id") % 4 != 0, F.col("filename")).alias("filename"), F.when(F.col("id") % 2 == 0, "blank").alias("file_type"), "page_count", "file_size",
        F.when(F.col("id") % 3 == 0, "n1").when(F.col("id") % 3 == 1, "nowhere").alias("folder_id"), "created_at",
    )
    return new.unionByName(new).unionByName(d.select("id", "filename", F.lit("blank").alias("file_type"), "page_count", "file_size", "folder_id", "created_at"))


@query("document_create", f"""{with_views("docs")}, c AS (SELECT id, filename, status, page_count, file_size, folder_id, NULL AS first_status FROM docs UNION ALL
SELECT -1 - id, CASE WHEN id % 4 = 0 THEN 'Untitled' ELSE filename END, 'uploaded', CASE WHEN id % 2 = 0 THEN 1 ELSE page_count END, CASE WHEN id % 2 = 0 THEN 0 ELSE file_size END,
  CASE WHEN id % 3 = 0 THEN 'n1' END, CASE WHEN id % 2 = 0 THEN 'idle' END FROM docs) SELECT *, CASE WHEN id < 0 THEN 'uploaded' END AS action FROM c""")
def _document_create(get):
    docs, pages, acts = mutations.create_documents(get("docs"), get("doc_pages").where("page_number < 0"), get("activity").where("document_id < 0"), get("folders"), _new_documents(get))
    first = pages.where("page_number = 1").select(F.col("document_id").alias("id"), F.col("status").alias("first_status"))
    said = acts.select(F.col("document_id").alias("id"), "action")
    return docs.select("id", "filename", "status", "page_count", "file_size", "folder_id").join(first, "id", "left").join(said, "id", "left")


query("doc_move", f"""{with_views("docs")} SELECT id, CASE id % 4 WHEN 0 THEN 'n3' WHEN 2 THEN NULL ELSE folder_id END AS folder_id FROM docs""")(
    lambda get: mutations.move(
        get("docs"), get("docs").where("id % 4 < 3").select("id", F.when(F.col("id") % 4 == 0, "n3").when(F.col("id") % 4 == 1, "nowhere").alias("folder_id")), get("folders")
    ).select("id", "folder_id")
)
query("folder_create", f"""{with_views("folders")} SELECT id, name, parent_id FROM folders UNION ALL SELECT 'x' || id, 'new ' || name, id FROM folders WHERE parent_id IS NULL""")(
    lambda get: mutations.create_folders(
        get("folders"),
        get("folders").select(
            F.concat(F.lit("x"), "id").alias("id"), F.when(F.col("id") == "n2", "  ").otherwise(F.concat(F.lit(" new "), "name", F.lit(" "))).alias("name"), F.when(F.col("parent_id").isNull(), F.col("id")).otherwise("nowhere").alias("parent_id")
        ),
    )
)
query("folder_save", f"""{with_views("folders")} SELECT id, CASE WHEN parent_id = 'r1' THEN 'renamed' ELSE name END AS name, CASE WHEN parent_id = 'r1' THEN 'r2' ELSE parent_id END AS parent_id FROM folders""")(
    lambda get: mutations.save_folders(
        get("folders"), get("folders").where("parent_id IS NOT NULL").select("id", F.lit(" renamed ").alias("name"), F.when(F.col("parent_id") == "r1", "r2").otherwise("nowhere").alias("parent_id"))
    )
)
query("tag_create", f"""{with_views("folders")}, t AS (SELECT id, name, 'red' AS color FROM folders WHERE parent_id IS NULL)
SELECT * FROM t UNION ALL SELECT min(id), name, 'gray' FROM folders WHERE name NOT IN (SELECT name FROM t) GROUP BY name""")(
    lambda get: mutations.create_tags(
        get("folders").where("parent_id IS NULL").select("id", "name", F.lit("red").alias("color")), get("folders").select("id", F.concat(F.lit(" "), "name").alias("name"), F.lit(None).cast("string").alias("color"))
    )
)
query("bbox_corners", f"""{with_views("boxes")} SELECT page_id, det_idx, x1, y1, x2, y2 FROM boxes WHERE det_idx % 3 = 0""")(
    lambda get: layout.with_corners(
        get("boxes").select("page_id", "det_idx", F.when(F.col("det_idx") % 3 == 0, F.array("x1", "y1", "x2", "y2")).when(F.col("det_idx") % 3 == 1, F.array("x1", "y1", "x2")).alias("bbox"))
    ).drop("bbox")
)


def _element(*fields) -> DataFrame:
    return F.array_sort(F.collect_list(F.struct("det_idx", *fields)))


query("cell_element_order", f"""{with_views("boxes")}, e AS (SELECT page_id, det_idx, CASE WHEN det_idx % 4 = 3 THEN {PAGE_H / 2} ELSE least(y1, y2) END AS t, CASE WHEN det_idx % 4 = 3 THEN {PAGE_W / 2} ELSE least(x1, x2) END AS l FROM boxes)
SELECT page_id, det_idx, row_number() OVER (PARTITION BY page_id ORDER BY t, l, det_idx) - 1 AS pos FROM e""")(
    lambda get: get("boxes").groupBy("page_id").agg(_element(F.when(F.col("det_idx") % 4 != 3, F.array("x2", "y2", "x1", "y2", "x1", "y1", "x2", "y1")).alias("position")).alias("e"))
    .select("page_id", F.posexplode(models.cell_elements(F.col("e"), F.lit(PAGE_W), F.lit(PAGE_H))).alias("pos", "o")).select("page_id", "o.det_idx", "pos")
)
query("line_element_order", f"""{with_views("boxes")} SELECT page_id, det_idx, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN det_idx % 4 = 3 THEN 0 ELSE class_id END, x1, det_idx) - 1 AS pos FROM boxes""")(
    lambda get: get("boxes").groupBy("page_id").agg(_element(F.when(F.col("det_idx") % 4 != 3, F.col("class_id")).alias("line_number"), F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y")).alias("e"))
    .select("page_id", F.posexplode(models.ordered_elements(F.col("e"))).alias("pos", "o")).select("page_id", "o.det_idx", "pos")
)
query("deskew_angle", f"""{with_views("boxes", "tables")}, p AS (SELECT page_id, (class_id - 5) * 0.5 AS angle, (x1 * 7919 + y1 * 104729) % 100003 AS row_sum FROM boxes),
v AS (SELECT page_id, angle, var_pop(row_sum) AS v FROM p GROUP BY ALL), b AS (SELECT page_id, arg_max(angle, (v, -angle)) AS angle FROM v GROUP BY 1)
SELECT table_id AS crop_id, CAST(CASE WHEN n_rows * 20 >= 60 THEN coalesce(angle, 0) ELSE 0 END AS DOUBLE) AS angle FROM tables LEFT JOIN b ON page_id = table_id""")(
    lambda get: tables.deskew_angle(
        get("tables").select(F.col("table_id").alias("crop_id"), F.col("crop_w").alias("w"), (F.col("n_rows") * 20).alias("h")),
        get("boxes").select(F.col("page_id").alias("crop_id"), ((F.col("class_id") - 5) * F.lit(0.5)).alias("angle"), ((F.col("x1") * 7919 + F.col("y1") * 104729) % 100003).alias("row_sum")),
    )
)
query("cell_upscale", f"""{with_views("tables")} SELECT table_id, CAST(CASE WHEN w < 128 OR h < 128 THEN greatest(CAST(128 AS DOUBLE) / greatest(w, 1), CAST(128 AS DOUBLE) / greatest(h, 1), 1) ELSE 1 END AS DOUBLE) AS scale
FROM (SELECT table_id, crop_w // n_cols AS w, crop_h // n_rows AS h FROM tables)""")(
    lambda get: get("tables").select("table_id", F.floor(F.col("crop_w") / F.col("n_cols")).alias("w"), F.floor(F.col("crop_h") / F.col("n_rows")).alias("h")).select("table_id", tables.upscale(F.col("w"), F.col("h"), 128).alias("scale"))
)
query("table_cells", f"""{with_views("tables")}, r AS (SELECT *, unnest(range(0, n_rows)) AS r FROM tables), c AS (SELECT *, unnest(range(0, n_cols)) AS c FROM r),
s AS (SELECT table_id, r, string_agg(r || ':' || c || CASE WHEN r < header_rows THEN 'header' ELSE 'data' END, ',' ORDER BY c) AS s FROM c GROUP BY table_id, r)
SELECT table_id, string_agg(s, ';' ORDER BY r) AS cells FROM s GROUP BY table_id""")(
    lambda get: tables.regroup(tables.grid(_tables(get)).select("table_id", "r", "c", F.concat(F.col("r").cast("string"), F.lit(":"), F.col("c").cast("string"), "cell_type").alias("content")))
    .select("table_id", F.array_join(F.transform("cells", lambda row: F.array_join(row, ",")), ";").alias("cells"))
)
query("block_durations", f"""{with_views("activity")} SELECT id, round_even(id % 90001 / 100, 0) / 10 AS duration_ms FROM activity""")(
    lambda get: get("activity").select("id", text.duration_ms(F.col("created_at"), F.timestamp_add("MICROSECOND", F.col("id") % 90001, F.col("created_at"))).alias("duration_ms"))
)
query("data_url_bytes", "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN md5(text) END AS digest FROM documents")(
    lambda get: get("texts").select("doc_id", F.md5(text.data_url_bytes(F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))).otherwise("none"))).alias("digest"))
)
