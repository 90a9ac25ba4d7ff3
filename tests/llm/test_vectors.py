import numpy as np
from pyspark.sql import functions as F

from pagelattice.llm import shared, vectors


def brute(ids, xs, least=vectors.LEAST_COSINE):
    ok = [x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x) for x in xs]
    near = np.zeros((len(ids), len(ids)), bool)
    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and len(xs[i]) == len(xs[j]):
                a, b = np.array(xs[i], np.float32).astype(float), np.array(xs[j], np.float32).astype(float)
                near[i, j] = near[j, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least - 1e-15
    comp = list(ids)
    for _ in ids:
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
    return sorted((i, int(n), c, i == c) for i, n, c in zip(ids, near.sum(1), comp, strict=True))


def test_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = shared.table(spark, sf, "embeddings").collect()
    got = sorted(map(tuple, vectors.query(spark, sf).collect()))
    assert got == brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_dense_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    r = np.random.default_rng(1)
    centre = r.standard_normal((3, 16))
    xs = [(centre[i % 3] + 0.08 * r.standard_normal(16)).tolist() for i in range(60)] + [centre[0].tolist()] * 5 + [r.standard_normal(16).tolist() for _ in range(20)]
    ids = [100 - i for i in range(len(xs))]
    df = spark.createDataFrame(list(zip(ids, xs, strict=True)), "vec_id long, vec array<float>")
    assert sorted(map(tuple, vectors.near_duplicates(df, window=3).collect())) == brute(ids, xs)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    xs = [None, [], [0.0, 0.0], [1.0, nan], [1.0, None], [1.0, inf], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0, 0.0, 0.0], [1e-30, 0.0]]
    ids = list(range(len(xs)))
    df = spark.createDataFrame(list(zip(ids, xs, strict=True)), "vec_id long, vec array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df.withColumn("rep", F.lit(1))).collect()}
    assert got == {i: (0, i, True) for i in range(6)} | {6: (3, 6, True), 7: (3, 6, False), 8: (3, 6, False), 9: (0, 9, True), 10: (3, 6, False)}
    assert vectors.near_duplicates(df.limit(0)).collect() == []
    again = vectors.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, vec array<float>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in again) == [(0, 0, 0), (1, 1, 1), (1, 1, 1)]


def test_pairs_in_hot_groups_are_found(spark):
    """Isolated pairs at the least cosine within groups of mutual cosine 0.9, at several sizes, against brute force."""
    for n in (1_000, 3_000):
        r = np.random.default_rng(n)
        unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
        centre = unit(r.standard_normal(64))
        hot = unit(np.sqrt(0.9) * centre + np.sqrt(0.1) * unit(r.standard_normal((n, 64))))
        twins = unit(hot[:150] + 0.31 * unit(r.standard_normal((150, 64))))
        x = np.vstack([hot, twins]).astype(np.float32)
        d = vectors.unit([v.tobytes() for v in x], 64)
        near = d @ d.T >= vectors.LEAST_COSINE
        np.fill_diagonal(near, False)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<float>")
        got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df).collect()}
        assert near.sum() >= 150 and got == dict(enumerate(near.sum(1).tolist()))
