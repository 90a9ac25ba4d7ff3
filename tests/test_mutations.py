"""Page saves, deletes and updates against loops over single requests."""

import random

from pyspark.sql import functions as F

from pagelattice.operators import library, mutations

COLUMNS = ["status", "ocr_blocks", "structured_content", "structure_status"]
PAGES = "document_id long, page_number int, status string, ocr_blocks string, structured_content string, structure_status string"


def test_saves_are_single_requests(spark):
    r = random.Random(2)
    state = [(d, n, "idle", f"b{d}", "s", "edited") for d in range(6) for n in range(1, 4)]
    model = {row[:2]: dict(zip(COLUMNS, row[2:], strict=True)) for row in state}
    changes = []
    for seq in range(60):
        key = (r.randrange(6), r.randint(1, 5))
        fields = r.sample(COLUMNS[:3], r.randint(0, 3))
        values = {c: r.choice(["x", "y", None]) for c in fields}
        changes.append((*key, seq, fields, *(values.get(c) for c in COLUMNS[:3])))
        page = model.setdefault(key, dict(zip(COLUMNS, ["idle", "[]", None, "none"], strict=True)))
        page.update(values)
        if "ocr_blocks" in fields and "structured_content" not in fields:
            page |= {"structured_content": None, "structure_status": "none"}
    pages = spark.createDataFrame(state, PAGES)
    change = spark.createDataFrame(changes, "document_id long, page_number int, seq int, fields array<string>, status string, ocr_blocks string, structured_content string")
    got = mutations.upsert_pages(pages, change.repartition(5), "seq")
    assert got.columns == pages.columns
    for row in got.collect():
        want = model.pop((row["document_id"], row["page_number"]))
        assert {c: row[c] for c in COLUMNS[:3]} == {c: want[c] for c in COLUMNS[:3]}
    assert not model


def test_partial_save_keeps_the_rest(spark):
    pages = spark.createDataFrame([(1, 1, "idle", "blocks", "s", "edited")], PAGES)
    status = spark.createDataFrame([(1, 1, "ocr-complete"), (2, 1, "idle"), (None, 1, "idle")], "document_id long, page_number int, status string")
    docs = spark.createDataFrame([(1, "partial", 1)], "id long, status string, page_count int")
    saved, rolled, done = mutations.save_pages(docs, pages, status)
    assert [tuple(x) for x in saved.collect()] == [(1, 1, "ocr-complete", "blocks", "s", "edited")]
    assert [tuple(x) for x in rolled.collect()] == [(1, "complete", 1)] and [tuple(x) for x in done.collect()] == [(1, "ocr_completed")]
    blocks = spark.createDataFrame([(1, 1, "new")], "document_id long, page_number int, ocr_blocks string")
    assert tuple(mutations.upsert_pages(pages, blocks).first()) == (1, 1, "idle", "new", None, "none")
    both = blocks.withColumn("structured_content", F.lit("t"))
    assert tuple(mutations.upsert_pages(pages, both).first()) == (1, 1, "idle", "new", "t", "edited")
    assert mutations.upsert_pages(pages, status.limit(0)).collect() == pages.collect()


def test_the_last_page_stays(spark):
    pages = spark.createDataFrame([(d, n, f"s{n}") for d in (1, 2, 3) for n in (1, 2, 3)], "document_id long, page_number int, status string")
    gone = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (2, 9), (3, 1)], "document_id long, page_number int")
    docs = spark.createDataFrame([(1, "blank", 3), (2, "blank", 3), (3, "pdf", 3)], "id long, file_type string, page_count int")
    counted, kept = mutations.delete_pages(docs, pages, gone)
    assert sorted(map(tuple, kept.collect())) == [(1, 1, "s3"), (2, 1, "s1"), (2, 2, "s3"), (3, 1, "s1"), (3, 2, "s2"), (3, 3, "s3")]
    assert sorted(map(tuple, counted.collect())) == [(1, "blank", 1), (2, "blank", 2), (3, "pdf", 3)]


def test_updates_follow_their_order_and_set_nulls(spark):
    state = spark.createDataFrame([(1, "a", "f"), (2, "b", "f")], "id long, filename string, folder_id string")
    change = spark.createDataFrame([(1, 2, ["folder_id"], None, None), (1, 1, ["filename", "folder_id"], "z", "g"), (7, 1, ["filename"], "q", None)], "id long, seq int, fields array<string>, filename string, folder_id string")
    assert sorted(map(tuple, mutations.update(state, change, order="seq").collect())) == [(1, "z", None), (2, "b", "f")]


def test_next_page_of_a_document_without_pages(spark):
    pages = spark.createDataFrame([(1, 4)], "document_id long, page_number int")
    docs = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(map(tuple, library.last_page(pages, docs).collect())) == [(1, 5), (2, 1)]


def test_creation_leaves_out_what_it_must(spark):
    folders = spark.createDataFrame([("f", "F", None)], "id string, name string, parent_id string")
    new = spark.createDataFrame([("a", "  x ", None), ("b", " ", None), ("c", "y", "none"), ("d", "z", "f"), ("e", None, None)], "id string, name string, parent_id string")
    assert sorted(map(tuple, mutations.create_folders(folders, new).collect()), key=str) == [("a", "x", None), ("d", "z", "f"), ("f", "F", None)]
    assert mutations.create_folders(folders, new.limit(0)).count() == 1
    tags = spark.createDataFrame([("t", "old", "red")], "id string, name string, color string")
    more = spark.createDataFrame([("u", "old ", None), ("v", "n", None), ("w", " n", "blue"), ("x", "", None)], tags.schema)
    assert sorted(map(tuple, mutations.create_tags(tags, more).collect())) == [("t", "old", "red"), ("v", "n", "gray")]
    links = spark.createDataFrame([(1, "t"), (2, "u")], "document_id int, tag_id string")
    left, linked = mutations.delete_tags(tags, links, spark.createDataFrame([("t",), ("t",)], "id string"))
    assert left.count() == 0 and [tuple(r) for r in linked.collect()] == [(2, "u")]


def test_moves_to_the_root_and_to_nowhere(spark):
    docs = spark.createDataFrame([(1, "f"), (2, "f"), (3, "f")], "id int, folder_id string")
    folders = spark.createDataFrame([("f",), ("g",)], "id string")
    change = spark.createDataFrame([(1, None), (2, "none"), (3, "g"), (3, None), (9, "g")], docs.schema)
    assert sorted(map(tuple, mutations.move(docs, change, folders).collect())) == [(1, None), (2, "f"), (3, "g")]
