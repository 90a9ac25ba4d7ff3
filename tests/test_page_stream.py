"""The stream of page saves against the batch fold, for orders of arrival and splits into batches."""

import random

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import mutations
from pagelattice.sources import store
from pagelattice.streaming import pages as stream

PAGES = "document_id long, page_number int, status string, ocr_blocks string, structured_content string, structure_status string"
SAVES = "document_id long, page_number int, seq int, fields array<string>, status string, ocr_blocks string, structured_content string"


def figures(r):
    return "[" + ",".join(f'{{"url":"/media/figures/{x}.png"}}' for x in r.sample("abcd", r.randrange(4))) + "]"


def batch_fold(spark, pages, change):
    known = mutations.upsert_pages(pages, change, "seq")
    dropped = mutations.dropped_figures(pages, change, "seq").groupBy("document_id", "page_number").agg(F.array_sort(F.collect_set("url")).alias("dropped"))
    out = known.join(dropped, ["document_id", "page_number"], "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<string>")))
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_split(spark, seed):
    r = random.Random(seed)
    state = [(d, n, "layout-detected", figures(r), r.choice(["s", None]), "edited") for d in range(3) for n in (1, 2)]
    saves = []
    for seq in range(40):
        fields = r.sample(["status", "ocr_blocks", "structured_content"], r.randint(0, 3))
        values = {"status": r.choice(["x", "y", None]), "ocr_blocks": r.choice([figures(r), None]), "structured_content": r.choice(["t", None])}
        saves.append((r.randrange(4), r.randint(1, 2), seq // 2, fields, *(values[c] if c in fields else None for c in ("status", "ocr_blocks", "structured_content"))))
    pages, change = spark.createDataFrame(state, PAGES), spark.createDataFrame(saves, SAVES)
    rows = stream.snapshot(pages).collect() + stream.saves(change, "seq").collect()
    r.shuffle(rows)
    root = store.run_folder(spark, "stream")
    while rows:  # several runs of several batches each: state and place go on over restarts
        for _ in range(2):
            part, rows = rows[: (k := r.randint(5, 30))], rows[k:]
            if part:
                spark.createDataFrame(part, stream.SAVE).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream.fold_files(spark, f"{root}/in", f"{root}/out", f"{root}/check")
    got = sorted((tuple(x) for x in stream.last_emitted(spark, f"{root}/out").collect()), key=str)
    assert got == batch_fold(spark, pages, change)


def test_ties_spaces_and_repeats(spark):
    fig = lambda *n: "".join(f'"/media/figures/{x}.png"' for x in n)
    pages = spark.createDataFrame([(1, 1, "idle", fig("a"), "s", "edited"), (2, 1, "idle", fig("b\u00a0c"), "s", "edited")], PAGES)
    # two saves of one number and value, one of which states the structure; a space that isn't ASCII within a name; a save that comes twice
    saves = [(1, 1, 5, ["ocr_blocks", "structured_content"], None, fig("b"), "t"), (1, 1, 5, ["ocr_blocks"], None, fig("b"), None), (2, 1, 1, ["ocr_blocks"], None, "[]", None), (2, 1, 1, ["ocr_blocks"], None, "[]", None)]
    rows = stream.snapshot(pages).collect() + stream.saves(spark.createDataFrame(saves, SAVES), "seq").collect()
    for k, order in enumerate((rows, rows[::-1])):
        root = store.run_folder(spark, f"stream{k}")
        spark.createDataFrame(order, stream.SAVE).coalesce(1).write.parquet(f"{root}/in")
        stream.fold_files(spark, f"{root}/in", f"{root}/out", f"{root}/check")
        got = {r["document_id"]: (r["structured_content"], r["dropped"]) for r in stream.last_emitted(spark, f"{root}/out").collect()}
        assert got == {1: ("t", ["/media/figures/a.png"]), 2: (None, ["/media/figures/b\u00a0c.png"])}


def test_the_fold_runs_no_python(spark):
    plan = stream.folded(spark.createDataFrame([], stream.SAVE))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "ObjectHashAggregate" in plan
