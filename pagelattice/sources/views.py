"""Views that shape the driver's tables into the library's records; one SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PAGE_W, PAGE_H = 2480, 3508

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

VIEWS = {
    "boxes": """
SELECT l_orderkey AS page_id,
       ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS det_idx,
       CAST(l_suppkey % 10 AS INT) AS class_id,
       0.30 + 6 * l_discount AS confidence,
       CAST(CASE WHEN l_partkey % 2 = 0 THEN 120 ELSE 1330 END + l_partkey % 50 AS INT) AS x1,
       CAST((l_partkey * 13 + l_linenumber * 97) % 3600 AS INT) AS y1,
       CAST(CASE WHEN l_partkey % 2 = 0 THEN 120 ELSE 1330 END + l_partkey % 50 + 300 + (l_suppkey * 7) % 700 AS INT) AS x2,
       CAST((l_partkey * 13 + l_linenumber * 97) % 3600 + 40 + 8 * l_quantity AS INT) AS y2
FROM lineitem""",
    "folders": """
SELECT CONCAT('r', CAST(r_regionkey AS STRING)) AS id, r_name AS name, CAST(NULL AS STRING) AS parent_id FROM region
UNION ALL
SELECT CONCAT('n', CAST(n_nationkey AS STRING)), n_name, CONCAT('r', CAST(n_regionkey AS STRING)) FROM nation""",
    "docs": """
SELECT o_orderkey AS id,
       CONCAT('doc_', CAST(o_orderkey AS STRING), CASE o_orderkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.docx' ELSE '' END) AS filename,
       CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'partial' ELSE 'uploaded' END AS status,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CONCAT('n', CAST(c_nationkey AS STRING)) END AS folder_id,
       o_orderkey % 5 = 0 AS is_starred,
       CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate END AS deleted_at,
       CAST(FLOOR(o_totalprice) AS BIGINT) AS file_size,
       o_orderdate AS created_at,
       CAST(1 + o_orderkey % 7 AS INT) AS page_count
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "doc_pages": """
SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS page_number,
       CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'layout-detected' ELSE 'ocr-complete' END AS status
FROM lineitem""",
    "doc_tags": """
SELECT DISTINCT l_orderkey AS document_id, p_type AS tag FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "activity": """
SELECT event_id AS id, user_id AS document_id, CASE WHEN event_type = 'purchase' THEN 'ocr_completed' ELSE 'uploaded' END AS action, ts AS created_at FROM events""",
    "regions": """
SELECT conv_id AS page_id, turn AS reading_order, turn % 2 AS column_idx,
       CASE role WHEN 'system' THEN 'title' ELSE 'plain_text' END AS label,
       CASE WHEN role = 'user' AND turn % 4 = 0 THEN CONCAT('Q', CAST(turn + 1 AS STRING), '. ', text)
            WHEN role = 'assistant' THEN CONCAT('(', SUBSTRING('ABCD', CAST(1 + turn % 4 AS INT), 1), ') ', text) ELSE text END AS value,
       turn * 200 + (conv_id % 3) * (turn % 2) * 60 AS y1, turn * 200 + 150 AS y2
FROM conversations""",
    "sessions": """
SELECT CAST(event_id AS STRING) AS event_id, CONCAT('s', CAST(user_id * 7 + event_id % 3 AS STRING)) AS session_id, ts FROM events""",
    "artifacts": """
SELECT CASE event_id % 3 WHEN 0 THEN 'debug_cache' WHEN 1 THEN 'training_images' ELSE 'tatr_crops' END AS dir,
       CONCAT('s', CAST(event_id * 3 AS STRING), CASE WHEN event_id % 3 = 2 THEN CONCAT('_block_', CAST(event_id % 5 AS STRING)) ELSE '' END) AS stem,
       CAST(FLOOR(value * 1000) AS BIGINT) AS size, ts AS mtime
FROM events""",
    "tables": """
SELECT p_partkey AS table_id, CAST(2 + p_size % 6 AS INT) AS n_rows, CAST(2 + p_partkey % 4 AS INT) AS n_cols,
       CAST(p_partkey % 3 AS INT) AS header_rows, CASE WHEN p_partkey % 2 = 0 THEN 'edited' ELSE 'tatr' END AS source,
       CAST(400 + p_partkey % 200 AS INT) AS crop_w, CAST(300 + p_size * 4 AS INT) AS crop_h
FROM part""",
    "texts": "SELECT doc_id, text FROM documents",
    "formulas": """
SELECT doc_id AS id,
       CONCAT('$$ α', CAST(doc_id % 90 AS STRING), ' × β ≤ γ ', CASE doc_id % 4 WHEN 0 THEN '→' WHEN 1 THEN '<=' WHEN 2 THEN '∑' ELSE '°' END, ' x_', CAST(10 + doc_id % 80 AS STRING), ' $$') AS expr
FROM documents""",
    # a page's OCR output with figures, for the figure and mutation operators
    "figures": """
SELECT l_orderkey AS document_id, l_linenumber AS page_number,
       CONCAT('[{"type":"image","url":"/media/figures/f', CAST(l_partkey AS STRING), '.png"},{"type":"image","url":"/media/figures/g', CAST(l_suppkey AS STRING), '.png"}]') AS old_blocks,
       CASE WHEN l_quantity > 25 THEN CONCAT('[{"url":"/media/figures/g', CAST(l_suppkey AS STRING), '.png"}]') END AS new_blocks
FROM lineitem""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of sf_dir, read by what the plan asks of them; no view of the session is touched."""
    used, sql = {}, VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in TABLES:
        sql, times = re.subn(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        if times:
            used[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(sql, **used)


def with_views(*names: str) -> str:
    """The WITH clause that gives DuckDB the same views."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in names)
