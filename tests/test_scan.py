"""Running sums and ranks against loops, whatever the ids look like; structures of tables and two-level caches."""

import random

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import scan, tables
from pagelattice.sources import store
from pagelattice.streaming import batch, sessions


@pytest.mark.parametrize("ids", [[k * 10**9 for k in range(3000)], list(range(3000)), [7] * 3000, [None, 1, None, 1] * 50, []])
def test_sums_before_each_row(spark, ids):
    r = random.Random(4)
    rows = [(i, r.randrange(5), r.randrange(100)) for i in ids]
    r.shuffle(rows)
    out = scan.scanned(spark.createDataFrame(rows, "id long, n int, scan_part int"), ["id", "n"], {"before": F.col("n")}, partitions=6).collect()
    wanted, total = [], 0
    for k, row in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
        wanted.append((row[0], row[1], k + 1, total))
        total += row[1]
    assert sorted(((x["id"], x["n"], x["rank"], x["before"]) for x in out), key=lambda x: x[2]) == wanted


def test_sums_within_groups(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), k * 10**8, r.randrange(9)) for k in range(500)]
    out = scan.scanned(spark.createDataFrame(rows, "g string, id long, n int"), ["id"], {"before": F.col("n")}, "g", 5).collect()
    totals, wanted = {}, []
    for g, i, n in rows:
        rank, total = totals.get(g, (0, 0))
        totals[g] = rank + 1, total + n
        wanted.append((g, i, n, rank + 1, total))
    assert sorted(map(tuple, out), key=str) == sorted(wanted, key=str)


def test_no_task_has_all_rows(spark):
    """Ids far apart are dealt out evenly, a single id too."""
    for ids in (F.col("id") * 10**9, F.lit(1)):
        rows = spark.range(8000).select(ids.alias("id"))
        path = {}
        kept = store.run_folder
        store.run_folder = lambda s, name: path.setdefault("at", kept(s, name))
        try:
            assert scan.scanned(rows, ["id"], partitions=8).agg(F.max("rank")).first()[0] == 8000
        finally:
            store.run_folder = kept
        sizes = [x["count"] for x in spark.read.parquet(path["at"]).groupBy("scan_part").count().collect()]
        assert len(sizes) >= 6 and max(sizes) < 3000


def test_structures_of_tables(spark):
    crops = spark.createDataFrame([(1, 200, 100), (2, 50, 50), (3, 10, 10)], "table_id int, w int, h int")
    parts = [
        (1, 0, "table row", 0.9, 0.0, 60.0, 200.0, 100.0), (1, 1, "table row", 0.9, 0.0, 0.0, 200.0, 30.0), (1, 2, "table row", 0.71, 0.0, 31.0, 200.0, 58.0), (1, 3, "table row", 0.7, 0.0, 5.0, 1.0, 6.0),
        (1, 4, "table column", 0.8, 0.0, 0.0, 99.0, 100.0), (1, 5, "table column", 0.8, 102.0, 0.0, 200.0, 100.0), (1, 6, "table column header", 0.8, 0.0, 0.0, 200.0, 30.0), (1, 7, "table", 1.0, 0.0, 0.0, 1.0, 1.0),
        (2, 0, "table row", 0.9, 0.0, 0.0, 50.0, 20.0), (2, 1, "table row", 0.9, 0.0, 0.0, 50.0, 40.0), (9, 0, "table row", 0.9, 0.0, 0.0, 1.0, 1.0),
    ]
    got = tables.structure(crops, spark.createDataFrame(parts, "table_id int, idx int, label string, score double, x1 double, y1 double, x2 double, y2 double"))
    data, head = ["data"] * 2, ["header"] * 2
    assert sorted(map(tuple, got.collect())) == [
        (1, [0.305, 0.59], [0.5025], 1, [head, data, data], "tatr"), (2, [0.2], [], 0, [["data"], ["data"]], "tatr"), (3, [], [], 0, [["data"]], "tatr"),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_two_levels_hold_the_newest_of_all(spark, seed):
    r = random.Random(seed)
    touched = [(f"s{r.randrange(900)}", r.randrange(10**6)) for _ in range(3000)] + [(None, 5), ("s1", None)]
    frame = spark.createDataFrame(touched, "session_id string, sec long").select("session_id", F.timestamp_seconds("sec").alias("ts"))
    root = store.run_folder(spark, "sessions")
    frame.repartition(r.randint(2, 6)).write.parquet(f"{root}/in")
    sessions.fold_files(spark, f"{root}/in", f"{root}/out", f"{root}/state", r.randint(1, 2), shares=2)
    wanted = batch.newest_sessions(frame.where("session_id IS NOT NULL AND ts IS NOT NULL"))
    assert sorted(map(tuple, sessions.merged(spark, f"{root}/out").collect())) == sorted(map(tuple, wanted.collect()))
