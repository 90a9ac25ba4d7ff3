"""The versioned page table: what readers see while saves run, are cut short, or run at once."""

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import mutations
from pagelattice.sources import store, versioned
from pagelattice.sources.versioned import PageTable

SCHEMA = "document_id long, page_number int, status string, ocr_blocks string, structured_content string, structure_status string"


@pytest.fixture
def table(spark):
    rows = [(d, p, "layout-detected", f"b{d}", "s", "edited") for d in range(0, 4000, 10) for p in (1, 2)]
    made = PageTable(spark, store.run_folder(spark, "test"))
    assert made.create(spark.createDataFrame(rows, SCHEMA), span=100) == 1
    return made


def change(spark, *rows):
    return spark.createDataFrame(rows, "document_id long, page_number int, seq int, status string, ocr_blocks string")


def row(table, document, page, **at):
    found = table.read(**at).where((F.col("document_id") == document) & (F.col("page_number") == page)).collect()
    return tuple(found[0])[2:] if found else None


def test_one_bucket_is_rewritten_and_readers_keep_their_version(spark, table):
    before = table.read()
    assert table.save(change(spark, (10, 1, 1, "ocr-complete", None), (20, 9, 1, None, None), (None, 1, 1, "x", "x")), "seq") == 2
    assert [tuple(r) for r in table.history().orderBy("version").collect()] == [(1, 40, 40), (2, 40, 1)]
    assert before.where("status = 'ocr-complete'").count() == 0 and before.count() == 800
    assert row(table, 10, 1) == ("ocr-complete", "b10", "s", "edited")
    assert row(table, 20, 9) == ("idle", "[]", None, "none")
    assert row(table, 10, 1, version=1) == ("layout-detected", "b10", "s", "edited")


def test_saves_equal_one_fold(spark, table):
    changes = [change(spark, (10, 1, 2, "a", None), (10, 1, 1, "z", "new")), change(spark, (10, 1, 1, None, "newer"), (3990, 2, 1, "b", None)), change(spark, (500, 1, 7, "c", "x"))]
    start = table.read()
    for c in changes[:2]:
        table.log(c, "seq")
    assert table.versions() == [1] and row(table, 10, 1, pending=True) == ("a", "newer", None, "none")
    table.save(changes[2], "seq")
    every = changes[0].withColumn("k", F.lit(0)).unionByName(changes[1].withColumn("k", F.lit(1))).unionByName(changes[2].withColumn("k", F.lit(2))).withColumn("place", F.struct("k", "seq"))
    wanted = mutations.upsert_pages(start, every, "place")
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    assert table.versions() == [1, 2]


def test_a_save_cut_short_is_taken_up(spark, table, monkeypatch):
    monkeypatch.setattr(PageTable, "_commit", lambda self, m: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.save(change(spark, (10, 1, 1, "ocr-complete", None)))
    assert row(table, 10, 1)[0] == "layout-detected" and table.versions() == [1]
    monkeypatch.undo()
    again = PageTable(spark, table.root)
    assert again.merge() == 2 and row(again, 10, 1)[0] == "ocr-complete"
    assert again.vacuum(keep=2) == 1  # the folder that nothing names
    assert again.read(1).count() == 800 and again.vacuum(keep=1) == 0 and again.versions() == [2] and again.read().count() == 800


def test_of_two_merges_one_commits(spark, table, monkeypatch):
    table.log(change(spark, (10, 1, 1, "first", None)))
    commit, once = PageTable._commit, []

    def other_first(self, manifest):
        if not once:
            once.append(1)
            other = PageTable(spark, table.root)
            other.log(change(spark, (20, 1, 1, "second", None)))
            assert other.merge() == 2
        return commit(self, manifest)

    monkeypatch.setattr(PageTable, "_commit", other_first)
    assert table.merge() == 2
    assert row(table, 10, 1)[0] == "first" and row(table, 20, 1)[0] == "second"
    assert len(store.names(spark, f"{table.root}/data")) == 2  # what lost is gone


def test_other_ids_and_odd_tables(spark):
    table = PageTable(spark, store.run_folder(spark, "test"))
    pages = spark.createDataFrame([("é", 1, "idle"), (None, 1, "x"), ("b", None, "y")], "document_id string, page_number int, status string")
    table.create(pages)
    with pytest.raises(FileExistsError):
        table.create(pages)
    table.save(spark.createDataFrame([("new", 3, "done", ["status"]), ("é", 1, None, ["status"])], "document_id string, page_number int, status string, fields array<string>"))
    assert sorted(map(tuple, table.read().collect())) == [("new", 3, "done"), ("é", 1, None)]
    empty = PageTable(spark, store.run_folder(spark, "test"))
    empty.create(pages.limit(0))
    assert empty.read().count() == 0 and empty.merge() == 1
    empty.save(spark.createDataFrame([("a", 1)], "document_id string, page_number int"))
    assert [tuple(r) for r in empty.read().collect()] == [("a", 1, "idle")]


def test_too_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(versioned, "MOST_BUCKETS", 3)
    with pytest.raises(ValueError, match="span"):
        PageTable(spark, store.run_folder(spark, "test")).create(spark.range(10).select(F.col("id").alias("document_id"), F.lit(1).alias("page_number")), span=1)


def test_dropped_figures_in_turn(spark):
    fig = lambda *n: "[" + ",".join(f'"/media/figures/{x}.png"' for x in n) + "]"
    pages = spark.createDataFrame([(1, 1, fig("a", "b"), "s"), (2, 1, None, None)], "document_id int, page_number int, ocr_blocks string, structured_content string")
    rows = [(1, 1, 2, fig("c"), None), (1, 1, 1, fig("b", "c"), None), (1, 1, 3, fig(), "whole"), (1, 1, 4, fig("a"), None), (2, 1, 1, fig("x"), None), (3, 1, 1, fig("y"), None), (3, 1, 2, None, "s"), (3, 1, 3, fig(), None)]
    saves = spark.createDataFrame(rows, "document_id int, page_number int, seq int, ocr_blocks string, structured_content string")
    got = sorted(map(tuple, mutations.dropped_figures(pages, saves, "seq").collect()))
    assert got == [(1, 1, "/media/figures/a.png"), (1, 1, "/media/figures/b.png"), (3, 1, "/media/figures/y.png")]


def test_buckets_beyond_a_folder_each(spark):
    table = PageTable(spark, store.run_folder(spark, "test"))
    n = (1 << 16) + 10
    table.create(spark.range(n).select(F.col("id").alias("document_id"), F.lit(1).alias("page_number"), F.lit("idle").alias("status")), span=1)
    table.save(spark.createDataFrame([(d, 1, "done") for d in (0, n // 2, n - 1, 2 * n)], "document_id long, page_number int, status string"))
    assert [tuple(r) for r in table.history().orderBy("version").collect()] == [(1, n, n), (2, n + 1, 4)]
    assert table.read().count() == table.read().select("document_id").distinct().count() == n + 1
    assert sorted(r[0] for r in table.read().where("status = 'done'").collect()) == [0, n // 2, n - 1, 2 * n]
    assert table.read(1).where("status = 'done'").count() == 0 and table.read(1).count() == n
    assert table.read().inputFiles() and len(table.read().inputFiles()) < 100  # files follow the data, not the buckets


def test_a_merge_reads_near_what_it_touches(spark, table):
    near = lambda *buckets: PageTable._near(spark.createDataFrame([(b,) for b in buckets], "bucket long"))
    every = spark.range(100_000).withColumnRenamed("id", "bucket")
    assert every.where(near()).count() == 0 and every.where(near(7)).count() == 1 and every.where(near(7, 99_999)).count() == 2
    many = [*range(0, 100_000, 7)]
    assert every.where(near(*many)).where("bucket % 7 = 0").count() == len(many)
    for d in (0, 3990, 0):
        table.save(change(spark, (d, 1, 1, "ocr-complete", None)))
    assert [tuple(r)[1:] for r in table.history().orderBy("version").collect()] == [(40, 40), (40, 1), (40, 1), (40, 1)]
    assert table.read().count() == 800 and table.read().where("status = 'ocr-complete'").count() == 2
    assert table.vacuum(keep=1) == 1 and table.read().count() == 800  # the second save of document 0 replaced the first
