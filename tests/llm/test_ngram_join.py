import random
import re

import numpy as np
import pytest

from pagelattice.llm import ngram_join as op

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows):
    """Set sizes and components of (doc_id, text) with exact shingles, all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                k = len(sets[i] & sets[j])
                if (k and 100 * k >= 75 * len(sets[i] | sets[j])) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return {r[0]: (len(s), c) for r, s, c in zip(rows, sets, comp, strict=True)}


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r["doc_id"]: r["component_id"] for r in op.join(df).collect()}
    return {r["doc_id"]: (r["n"], groups.get(r["doc_id"], r["doc_id"])) for r in op.low_shingles(df).collect()}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    texts = []
    for _ in range(40):
        texts.append(" ".join(r.choice(words) for _ in range(r.randint(1, 120))))
    for base in texts[:12]:
        for _ in range(r.randint(1, 8)):
            w = base.split(" ")
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    texts += [passage + " " + " ".join(r.choice(words) for _ in range(r.randint(5, 200))) for _ in range(25)]
    texts += [texts[0], texts[0].upper(), "one two", "ONE\ttwo", "", " \n ", None, "a b c d e", "a b c d e f"]
    # a chain: each is near the next, the ends are far apart
    chain = [f"c{i}" for i in range(100)]
    for k in range(12):
        texts.append(" ".join(chain[k * 4 : k * 4 + 60]))
    r.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_is_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_small_blocks_divide_regions(spark, monkeypatch):
    """Regions of many blocks, one pair of blocks a task, and divided again within it."""
    monkeypatch.setattr(op, "BLOCK_SHINGLES", 1500)
    monkeypatch.setattr(op, "LEAF", 3)
    monkeypatch.setattr(op, "PIVOTS", 2)
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("cover", [0.01, 0.45])
def test_any_cover_is_exact(spark, monkeypatch, cover):
    """With next to nothing covered by elected pivots, and with much more than by default."""
    monkeypatch.setattr(op, "COVER", cover)
    monkeypatch.setattr(op, "FAR", cover + op.NEAR)
    rows = corpus(5)
    assert run(spark, rows) == brute(rows)


def test_dense_group_is_divided_into_regions(spark, monkeypatch):
    """Copies with up to a third of their words changed: regions with windows, members that no pivot is near."""
    monkeypatch.setattr(op, "COVER", 0.6)
    monkeypatch.setattr(op, "FAR", 0.6 + op.NEAR)
    r = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    base = [r.choice(words) for _ in range(150)]
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    reps = op.full_sets(df).selectExpr("key AS rep", "n", "shingles").dropDuplicates(["rep"])
    distances = op.around_pivots(op.shingle_index(reps), reps)
    placed = op.voronoi(distances)
    assert placed.where("owned").groupBy("rep").count().where("count > 1").count() == 0
    assert placed.where("owned").count() > 50 and placed.where("NOT owned").count() > 0
    assert run(spark, rows) == brute(rows)


def sets_frame(spark, sets):
    return spark.createDataFrame([(i, len(x), sorted(x)) for i, x in enumerate(sets)], "rep long, n int, shingles array<long>")


def test_a_common_passage_comes_last(spark):
    """60 pairs of sets, all of which share 56 of 100 shingles: what only the pair shares comes first, wherever it hashes to."""
    r = random.Random(11)
    draw = lambda k: {r.randrange(-(1 << 63), 1 << 63) for _ in range(k)}
    passage = draw(56)
    sets = []
    for _ in range(60):
        both = draw(42)
        sets += [passage | both | draw(2), passage | both | draw(2)]
    rows = op.shingle_index(sets_frame(spark, sets)).collect()
    assert len(rows) == 120 * (51 - 2) and sum(x["first"] for x in rows) == 120 * (26 - 2)
    assert sum(x["h"] in passage for x in rows) == 120 * 7 and not any(x["first"] and x["h"] in passage for x in rows)


def test_sets_that_stand_too_far_alone_are_not_indexed(spark):
    """Shingles of the whole range count: 25 of 100 that no other set has are few enough for a link, 26 aren't."""
    passage = set(range(74))
    sets = [passage | {1000 * k + i for i in range(26)} for k in range(1, 9)] + [passage | {-1} | {-k - i for i in range(25)} for k in (8000, 9000)]
    assert {x["rep"] for x in op.shingle_index(sets_frame(spark, sets)).collect()} == {8, 9}


def test_regions_recurse_exactly():
    r = np.random.default_rng(4)
    centres = [np.sort(r.choice(5000, 60, replace=False)) for _ in range(30)]
    sets = []
    for i in range(500):
        s = set(centres[i % 30].tolist())
        for _ in range(int(r.integers(0, 16))):
            s.discard(int(r.choice(list(s))))
            s.add(int(r.integers(0, 5000)))
        sets.append(np.array(sorted(s), dtype=np.int64))
    found = op._Union(len(sets))
    op.join_region(sets, found=found)
    other = op._Union(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if op.linked(k, len(sets[i]), len(sets[j])):
                other.join(i, j)
    assert [found.root(i) for i in range(len(sets))] == [other.root(i) for i in range(len(sets))]


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in op.join(df).collect() if r["doc_id"] in (3, 5)} == {3: 3, 5: 3}
    kept = op.stage(spark, df.selectExpr("doc_id", "text", "1 AS n", "2 AS rep"), "")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "a b c d e f"), (3, "a b c d e f"), (7, ""), (8, "")]
    assert op.join(df.limit(0)).collect() == []


def test_rows_that_repeat_an_id(spark):
    text, near, alone = (" ".join(f"{p}{i}" for i in range(80)) for p in ("a", "a", "b"))
    near = near.replace("a79", "z")
    rows = [(9, text), (9, alone), (4, near), (9, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in op.join(df).collect()} == {9: 4, 4: 4}
    apart = spark.createDataFrame([(9, text), (9, alone), (9, text)], "doc_id long, text string")
    assert sorted(r["text"] for r in op.stage(spark, apart, "").collect()) == [text, alone]


def test_long_words_and_texts():
    long = "x" * 100_000 + " b c d e"
    s = op.shingle_sets([long, long.upper(), long[1:], "ä b c d e", "Ä b c d e"])
    assert (s[0] == s[1]).all() and s[0][0] != s[2][0] and s[3][0] != s[4][0]
