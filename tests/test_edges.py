"""Sources, sinks, model boundaries, streams, and the driver contract without the corpus subpackage."""

import io
import json
import struct
import subprocess
import sys
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from pagelattice import models
from pagelattice.operators import structure, tables, trees
from pagelattice.plans.catalogue import QUERIES
from pagelattice.sources import files, sinks
from pagelattice.streaming import batch, live

ROOT = Path(__file__).resolve().parent.parent
PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)


def test_listing_and_sizes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "s1.jpg").write_bytes(PNG)
    (tmp_path / "b" / "s1.jpg").write_bytes(b"x")
    (tmp_path / "b" / "s2_block_3.jpg").write_bytes(b"yy")
    a, b = files.listing(spark, str(tmp_path / "a")), files.listing(spark, str(tmp_path / "b"))
    assert {r["stem"]: r["size"] for r in b.collect()} == {"s1": 1, "s2_block_3": 2}
    wanted = spark.createDataFrame([("s1",), ("s9",)], "session_id string")
    got = {r["session_id"]: r["path"] for r in files.session_images(wanted, a, b).collect()}
    assert got["s1"].endswith("a/s1.jpg") and got["s9"] is None
    empty = spark.createDataFrame([("none", bytearray(b""))], "path string, content binary")
    read = files.contents(spark, str(tmp_path / "a")).unionByName(files.contents(spark, str(tmp_path / "b"), "s1*")).unionByName(empty)
    got = [(r["s"]["width"], r["s"]["height"], r["s"]["error"]) for r in read.select(files.sized("content").alias("s")).collect()]
    assert sorted(got, key=str) == [(640, 480, None), (None, None, "missing image"), (None, None, "undecodable image")]


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("x.png", bytearray(b"ab")), ("y.png", bytearray(b""))], "name string, content binary")
    got = {r["name"]: (r["bytes"], r["error"]) for r in sinks.write_files(rows, f"file://{tmp_path}/out").collect()}
    assert got == {"x.png": (2, None), "y.png": (0, None)} and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["x.png", "y.png"]


def test_docx(spark):
    trees = spark.createDataFrame(
        [(1, [(0, [("title", [("text", "A & B", None, None)]), ("plain_text", [("text", "b", None, None), ("image", None, "/x.png", None)])])])],
        "page_id long, columns array<struct<column_idx:int,groups:array<struct<label:string,blocks:array<struct<type:string,value:string,url:string,cells:array<array<array<struct<type:string,value:string>>>>>>>>>>",
    )
    xml = zipfile.ZipFile(io.BytesIO(bytes(sinks.docx(trees).first()["docx"]))).read("word/document.xml").decode()
    assert "A &amp; B" in xml and "[image: /x.png]" in xml


def test_models(spark):
    images = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"y"))], "page_id long, content binary")
    boxes = models.detect(images, models.StandIn)
    assert boxes.count() == 8 and boxes.columns[:2] == ["page_id", "det_idx"]
    crops = spark.createDataFrame([(1, "plain_text", bytearray(b"hello")), (2, "title", bytearray(b"")), (3, "table", bytearray(b"t"))], "id int, label string, content binary")
    got = {r["id"]: (len(r["elements"]), r["error"]) for r in models.read(crops, {"text_formula": models.StandIn, "text_only": models.StandIn}).collect()}
    assert got[1] == (1, None) and got[2] == (0, "empty crop") and got[3][0] == 0 and got[3][1]
    e = spark.createDataFrame([(1, 0, "text", " a "), (1, 1, "embedding", r"\mathrm{of}"), (1, 2, "isolated", "α"), (1, 3, "text", " ")], "id int, i int, type string, text string")
    assert sorted(map(tuple, models.to_blocks(e).select("i", "type", "value", "display").collect())) == [(0, "text", "a", False), (1, "text", "of", False), (2, "latex", r"\alpha", True)]


def test_nodes_and_patches(spark):
    doc = json.dumps({"nodes": [{"id": "a", "type": "section", "children": [{"id": "b", "type": "image", "children": [{"id": "c", "type": "image"}]}]}]})
    df = spark.createDataFrame([(1, doc)], "doc_id int, content string")
    got = trees.walk(df).orderBy("path").collect()
    assert [(r["path"], r["depth"], r["id"]) for r in got] == [([0], 0, "a"), ([0, 0], 1, "b"), ([0, 0, 0], 2, "c")]
    patched = trees.with_s3_urls(df, spark.createDataFrame([(1, "c", "u")], "doc_id int, id string, s3_url string")).first()["content"]
    assert json.loads(patched)["nodes"][0]["children"][0]["children"][0]["s3_url"] == "u"


def test_structured_documents_parse(spark):
    for r in QUERIES["structured_content"](spark, "/root/testdata/sf0.001").collect():
        doc = json.loads(r["structured_content"])
        assert doc["version"] == 1 and all(n["type"] in {"section", "paragraph", "error"} for n in doc["nodes"])
        assert all("children" in n for n in doc["nodes"] if n["type"] == "section")


def test_stream_is_batch(spark, tmp_path):
    blocks = spark.createDataFrame([(1, "b0", 0, None), (1, "b1", 1, "unreadable"), (2, "b0", 0, None)], "page_id long, block_id string, reading_order int, error string")
    blocks.write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(blocks.schema).parquet(str(tmp_path / "in"))
    live.ndjson_stream(read, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["block_id"] + str(r["page_id"]) for r in spark.read.schema(blocks.schema).json(str(tmp_path / "out")).collect()) == ["b01", "b02", "b11"]


def test_newest_sessions(spark):
    rows = spark.range(201).select(F.concat(F.lit("s"), "id").alias("session_id"), F.timestamp_seconds("id").alias("ts"))
    for n, kept in ((199, 199), (200, 199), (201, 199)):
        got = batch.newest_sessions(rows.where(F.col("ts") < F.timestamp_seconds(F.lit(n))))
        assert got.count() == kept
    touched = rows.unionByName(rows.where("session_id = 's0'").withColumn("ts", F.timestamp_seconds(F.lit(1000))))
    assert "s0" in {r["session_id"] for r in batch.newest_sessions(touched).collect()}


def test_contract_without_the_corpus_subpackage():
    code = "import re, sys; sys.modules['pagelattice.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(re.match('op[0-9]', k) for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_subpackage():
    for p in (ROOT / "pagelattice").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
