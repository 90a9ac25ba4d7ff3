import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from pagelattice.llm import mixing, shared

SF = "/root/testdata/sf0.001"


def level(sizes, weights, pool):
    """Targets by sharing again what lies above the caps, until nothing does."""
    target, capped = {}, set()
    while True:
        free = pool - sum(2 * sizes[s] for s in capped)
        total = sum(weights[s] for s in sizes if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else free * weights[s] / total for s in sizes}
        above = {s for s in sizes if target[s] > 2 * sizes[s]} - capped
        if not above:
            return target
        capped |= above


def corput(k, bits=mixing.BITS):
    return int(f"{k:0{bits}b}"[::-1], 2) / 2**bits


def brute(rows, h):
    """Takes of rows (doc_id, source, text); h gives each document's place in the shuffle."""
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[2] or "")) for r in rows}
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(size[r[0]] for r in rows if r[1] == s) for s in names}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    target = level(sizes, weights, 1.5 * total)
    block = max(16, min(mixing.BLOCK_WORDS, math.ceil(1.5 * total) // mixing.LEAST_SLOTS))
    slots = -(-math.ceil(1.5 * total) // block)
    cum, at = {}, 0.0
    for s in names:
        cum[s] = (at / sum(target.values()), (at + target[s]) / sum(target.values()))
        at += target[s]
    rank, times = defaultdict(int), defaultdict(int)
    for k in range(slots):
        u = corput(k)
        s = next((s for s in names if cum[s][0] <= u < cum[s][1]), None)
        if s is None:
            continue
        blocks = -(-sizes[s] // block)
        if rank[s] < 2 * blocks:
            times[s, rank[s] % blocks] += 1
        rank[s] += 1
    taken = {}
    for s in names:
        start = 0
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (h[r[0]], r[0])):
            n = size[r[0]]
            taken[r[0]] = sum(times[s, b] * (min(start + n, (b + 1) * block) - max(start, b * block)) for b in range(start // block, (start + n - 1) // block + 1)) if n else 0
            start += n
    return {r[0]: (size[r[0]], sizes[r[1]], round(target[r[1]], 6), taken[r[0]]) for r in rows}


def test_is_brute_force(spark):
    docs = shared.table(spark, SF, "documents")
    h = {r["doc_id"]: r["h"] for r in mixing.sized(docs).collect()}
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.query(spark, SF).collect()}
    assert got == brute(rows, h)


def test_targets_are_met_and_bounded(spark):
    out = mixing.query(spark, "/root/testdata/sf0.01")
    per = out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= max(64, 0.01 * r["target"]) for r in per)
    assert out.where("taken > 2 * size").count() == 0
    total = out.agg(F.sum("size")).first()[0]
    assert abs(sum(r["target"] for r in per) - 1.5 * total) < 1e-3 * total


def test_reruns_agree(spark):
    a, b = (sorted(map(tuple, mixing.query(spark, SF).collect())) for _ in range(2))
    assert a == b
    c = sorted(map(tuple, mixing.mix(shared.table(spark, SF, "documents").repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert c == a


def test_odd_rows(spark):
    rows = [(1, "b", "x y z"), (1, "b", "x y z"), (2, None, "a b"), (3, "a", None), (4, "é", "  "), (None, "b", "q")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit(9)).withColumn("sid", F.lit(9))
    got = sorted((r["doc_id"] or 0, r["source"] or "", r["size"], r["source_size"]) for r in mixing.mix(df).collect())
    assert got == [(0, "b", 1, 7), (1, "b", 3, 7), (1, "b", 3, 7), (2, "", 2, 2), (3, "a", 0, 0), (4, "é", 0, 0)]
    assert mixing.mix(df.limit(0)).collect() == []
    assert [r["taken"] for r in mixing.mix(df.where("doc_id IN (3, 4)")).collect()] == [0, 0]
    staged = mixing.stage(spark, df.where("doc_id = 2"), "")
    assert staged.columns == df.columns and {r["doc_id"] for r in staged.collect()} <= {2}


def test_small_sources_beside_large_ones(spark):
    sizes = {f"big{i:02}": 6_000_000 for i in range(20)} | {"small0": 5, "small1": 300, "small2": 1_500, "small3": 20_000}
    rows = [(i * 10 + k, s, n // 10 if n >= 10 else n) for i, (s, n) in enumerate(sizes.items()) for k in range(10 if n >= 10 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n int").select("doc_id", "source", F.repeat(F.lit("a "), F.col("n")).alias("text"))
    per = mixing.mix(docs).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(per) == 24
    assert all(abs(r["taken"] - r["target"]) <= max(1, 0.01 * r["target"]) for r in per), per
    assert all(r["taken"] <= 2 * r["source_size"] for r in per)
