"""Cleanups that are planned, run, cut short and repeated."""

import os

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import library, questions
from pagelattice.plans import catalogue
from pagelattice.sources import cleanup, plugins, store
from tests.compare import database, same


@pytest.fixture
def folder(tmp_path):
    for d, names in {"debug_cache": ["live.jpg", "old.jpg", "new.jpg"], "tatr_crops": ["live_block_1.jpg", "gone_block_2.jpg"]}.items():
        os.makedirs(tmp_path / d)
        for n in names:
            (tmp_path / d / n).write_bytes(b"x" * len(n))
            os.utime(tmp_path / d / n, (1_800_000_000 if n == "new.jpg" else 1_700_000_000,) * 2)
    return tmp_path


def left(folder):
    return sorted(n for d in os.listdir(folder) for n in os.listdir(folder / d))


def test_dry_run_then_deletion_then_again(spark, folder):
    listed = plugins.files(spark, f"file://{folder}").withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))
    sessions = spark.createDataFrame([("live",), ("",), (None,)], "session_id string")
    journal = store.run_folder(spark, "journal")
    wanted = [(None, 2, 23), ("debug_cache", 1, 7), ("tatr_crops", 1, 16)]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(cleanup.clean(listed, sessions, f"file://{folder}", journal, "2025-01-01", dry_run=True)) == sorted(wanted, key=str)
    assert len(left(folder)) == 5
    os.remove(folder / "debug_cache" / "old.jpg")  # as if the run had been cut short after one file
    assert rows(cleanup.clean(listed, sessions, f"file://{folder}", journal, "2025-01-01")) == sorted(wanted, key=str)
    assert left(folder) == ["live.jpg", "live_block_1.jpg", "new.jpg"]
    other = store.run_folder(spark, "journal")
    assert rows(cleanup.clean(listed, sessions, f"file://{folder}", other)) == sorted([(None, 1, 7), ("debug_cache", 1, 7)], key=str)


def test_what_counts_as_nothing(spark):
    values = [None, "", "[]", " [] ", "{}", "null", "0", "false", '""', "[0]", "x"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(library.or_empty(F.col("v"))).collect()
    assert [r[0] for r in got] == ["[]"] * 9 + ["[0]", "x"]


def test_questions_without_blocks(spark):
    blocks = spark.createDataFrame([(1, 0, "text", "Q1. Find the value of x"), (2, 0, "image", "u"), (3, 0, "text", "Q7.")], "question_id int, pos int, type string, value string")
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 4)], "question_id int")
    got = {r["question_id"]: (r["number"], r["type"], r["content"]) for r in questions.parse_questions(blocks, asked).collect()}
    assert got == {1: (1, "integer", ["Find the value of x"]), 2: (None, "subjective", ["u"]), 3: (7, "subjective", []), 4: (None, "unknown", [])}


def waves(monkeypatch):
    """Waves of about 300 files in folders of about 20; how many files lie on disk when each is listed."""
    monkeypatch.setattr(catalogue, "FILES_AT_ONCE", 300)
    monkeypatch.setattr(catalogue, "FILES_IN_FOLDER", 20)
    seen, roots, real = [], [], plugins.files

    def files(spark, root, **options):
        roots.append(root.removeprefix("file:").replace("//", "/").rpartition("/")[0])
        seen.append(sum(n.endswith(".jpg") for _, _, names in os.walk(roots[-1]) for n in names))
        return real(spark, root, **options)

    monkeypatch.setattr(plugins, "files", files)
    return seen, roots


def test_files_lie_on_disk_a_wave_at_a_time(spark, monkeypatch):
    seen, roots = waves(monkeypatch)
    sf = "/root/testdata/sf0.001"
    own, other = same(catalogue.QUERIES["artifact_files"](spark, sf), database(sf), catalogue.ORACLES["artifact_files"])
    assert own == other and own
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    assert len(seen) == -(-total // 300) > 1 and max(seen) < 400 and sum(seen) == total
    assert not [n for _, _, names in os.walk(roots[-1]) for n in names if n.endswith(".jpg")]  # the last wave is gone too


def test_cleanup_by_waves(spark, monkeypatch):
    seen, roots = waves(monkeypatch)
    sf = "/root/testdata/sf0.001"
    own, other = same(catalogue.QUERIES["artifact_cleanup"](spark, sf), database(sf), catalogue.ORACLES["artifact_cleanup"])
    assert own == other and len(seen) > 1 and max(seen) < 400
    assert not [n for _, _, names in os.walk(roots[-1]) for n in names if n.endswith(".jpg")]


def test_a_directory_without_orphans_or_without_others(spark, tmp_path):
    events = [(k, "2024-01-01 00:00:00", k, "view", 0.0 + k) for k in (0, 3, 1, 2, 5)]  # of files s0, s9, s3, s6_block_2, s15_block_0
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(3).collect()
    live = [r.asDict() | {"l_orderkey": d} for r, d in zip(lines, (0, 9, 6), strict=True)]
    spark.createDataFrame(live, spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, catalogue.QUERIES["artifact_cleanup"](spark, str(tmp_path)).select("dir", "files", "would", "left").collect()), key=str)
    assert got == sorted([("debug_cache", 0, 0, 2), ("training_images", 1, 1, 0), ("tatr_crops", 1, 1, 1), (None, 2, 2, 3)], key=str)


def test_cleanup_of_no_files(spark, tmp_path):
    for t in ("events", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert [tuple(r) for r in catalogue.QUERIES["artifact_cleanup"](spark, str(tmp_path)).select("dir", "files", "bytes", "would", "left").collect()] == [(None, 0, 0, 0, 0)]
    assert catalogue.QUERIES["artifact_files"](spark, str(tmp_path)).count() == 0
