import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from pagelattice.llm import shared, warc
from tests.compare import database, same

SF = "/root/testdata/sf0.001"


def test_matches_sql(spark):
    own, other = same(warc.query(spark, SF), database(SF), warc.ORACLE)
    assert own == other


class Kept(io.BytesIO):
    def close(self):
        pass


def test_bundle_seeks(monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    out = Kept()
    b = warc.Bundle(out)
    raws = [warc.record(i, f"http://x/{i}", b"p" * (i * 37 % 400), "D" * 32, "response" if i % 3 else "revisit", i - 1) for i in range(60)]
    at = [b.add(r) for r in raws]
    b.close()
    reader = warc.Reader(io.BytesIO(out.getvalue()))
    assert len(reader.frames) > 10
    for i in (59, 0, 31, 7):
        assert reader.record(*at[i]) == raws[i]
    head, payload = warc.parse(raws[4])
    assert head["warc-record-id"] == "<urn:page:4>" and len(payload) == 4 * 37 and head["content-length"] == str(len(payload) + len(warc.HTTP))
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(raws)  # the seek table is a frame that plain readers skip


def test_damaged_bundles_are_noticed():
    with pytest.raises(ValueError):
        warc.Reader(io.BytesIO(b"x" * 50))


def test_bundles_are_read_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAMES_A_TASK", 2)
    rows = [(i, f"http://h/{i}", "".join(hashlib.sha256(f"{i}-{k}".encode()).hexdigest() for k in range(600))) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    index = warc.write_bundles(warc.mark(df), shared.new_path(spark, "t"))
    assert index.select("path").distinct().count() >= 2 and index.select("path", "frame").distinct().count() >= 8
    read = warc.read_bundles(index)
    assert read.rdd.getNumPartitions() >= 4 and read.withColumn("p", F.spark_partition_id()).select("p").distinct().count() >= 3
    want = {i: base64.b32encode(hashlib.sha1(html.encode()).digest()).decode() for i, _, html in rows}
    assert {r["page_id"]: r["payload_digest"] for r in read.collect()} == want


def test_odd_rows(spark):
    big = "é" * 300_000
    rows = [(1, "http://a/ b\r\nX: y", "same"), (7, None, "same"), (7, "u", "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (9, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2))
    index = warc.write_bundles(warc.mark(df), shared.new_path(spark, "t"))
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(index).collect())
    assert got == [(0, 4, "response", None), (1, 4, "revisit", 7), (3, 0, "revisit", 4), (4, 0, "response", None), (7, 4, "response", None), (7, 4, "response", None), (9, 600_000, "response", None)]
    assert {r["payload_digest"] for r in warc.read_bundles(index).where("page_id = 1").collect()} == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}
    small = warc.mark(df, least_bytes=5)
    assert {r["record_type"] for r in small.where("payload = 'same'").collect()} == {"response"}
    assert warc.read_bundles(warc.write_bundles(warc.mark(df.limit(0)), shared.new_path(spark, "t"))).collect() == []
