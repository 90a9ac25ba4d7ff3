import hashlib
import random
import time

import numpy as np
import pytest

from pagelattice.llm import fingerprints as op
from pagelattice.llm import shared

SF = "/root/testdata/sf0.001"


def walk(text):
    """One text's fingerprint, a step at a time."""
    if not text:
        return bytes(op.SLOTS)
    code = [ord(c) for c in text] + [0] * op.GRAM
    cls = [((c * 0x9E3779B97F4A7C15) % 2**64 >> 40) % (op.CLASSES - 1) + 1 for c in code[: len(text)]] + [0] * op.GRAM
    at, i = [], 0
    for t in range(2 * len(text)):
        at.append(i)
        i += int(op.walk_bits()[t % op.PERIOD][cls[i]])
    out = bytearray()
    for k, places in enumerate(op.records()):
        i = at[max(p for p in places.tolist() if p < 2 * len(text))]
        h = k + 1
        for g in range(op.GRAM):
            h = ((h ^ code[i + g]) * 0x9E3779B97F4A7C15) % 2**64
            h ^= h >> 29
        out.append(h >> 56 if i < len(text) else 0)
    return bytes(out)


def test_together_is_one_by_one():
    texts = ["", "a", "ab", "the quick brown fox " * 9, "ünïcödé 漢字 😀 " * 5, "x" * 700, "the quick brown fox"]
    got = op.fingerprints(texts)
    assert [g.tobytes() for g in got] == [walk(t) for t in texts]
    assert (op.fingerprints(texts[::-1])[::-1] == got).all()


def test_query_is_brute_force(spark):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in shared.table(spark, SF, "documents").collect()), reverse=True)
    got = sorted(op.query(spark, SF).collect(), key=lambda r: -r["doc_id"])
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    texts = [t for _, t in rows]
    new = [op.edited(t, texts[(i + 1) % len(texts)]) for i, t in enumerate(texts)]
    a, b = op.fingerprints(texts), op.fingerprints(new)
    assert [r["edited_sha256"] for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in new]
    assert [r["fingerprint"] for r in got] == [x.tobytes().hex() for x in a] and [r["edited_fingerprint"] for r in got] == [x.tobytes().hex() for x in b]
    assert np.allclose([r["near_next"] for r in got], op.likeness(a, np.roll(a, -1, 0))) and np.allclose([r["near_edited"] for r in got], op.likeness(a, b))
    assert np.mean([r["near_edited"] for r in got]) > 0.5 > 0.1 > np.mean([r["near_next"] for r in got])


@pytest.mark.parametrize("chunk", [50, 6_000_000])
def test_odd_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK_CHARS", chunk)
    rows = [(1, "one one one"), (9, "nine nine"), (5, None), (5, "again"), (None, "last"), (2, "two " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS at")
    got = {(r["doc_id"], r["n_chars"]): r["edited_sha256"] for r in op.compare_with_next(df).collect()}
    order = ["nine nine", "", "again", "two " * 40, "one one one", "last"]
    ids = [9, 5, 5, 2, 1, None]
    assert got == {(i, len(t)): hashlib.sha256(op.edited(t, order[(k + 1) % 6]).encode()).hexdigest() for k, (i, t) in enumerate(zip(ids, order, strict=True))}
    assert op.compare_with_next(df.limit(0)).collect() == []
    assert op.compare_with_next(df.where("doc_id = 9")).first()["near_next"] == 1.0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_distance_is_the_table():
    r = random.Random(6)
    for _ in range(1500):
        a, b = ("".join(r.choice("abé😀") for _ in range(r.randint(0, 90 if r.random() < 0.1 else 9))) for _ in range(2))
        n = distance(a, b)
        assert op.edit_distance_within(a, b, n) == n and op.edit_distance_within(a, b, 200) == n
        assert n == 0 or op.edit_distance_within(a, b, n - 1) is None
    for _ in range(1500):
        a = "".join(r.choice("ab😀") for _ in range(r.randint(0, 60)))
        b = edit(r, a, r.randint(0, 4))
        n = distance(a, b)
        assert op._least_edits(a, b) <= n and op.verified(a, b) == (n if n <= op.MOST_SHARE * max(len(a), len(b)) else None)
    long = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    began = time.process_time()
    assert op.edit_distance_within(long, long[:30_000] + "XY" + long[30_001:], 6_000) == 2 and time.process_time() - began < 20


def edit(r, text, n):
    chars = list(text)
    for _ in range(n):
        at = r.randrange(len(chars) + 1)
        kind = r.randrange(3)
        if kind == 0:
            chars.insert(at, r.choice("qxz"))
        elif at < len(chars):
            chars[at : at + 1] = [] if kind == 1 else r.choice("qxz")
    return "".join(chars)


def test_near_links_are_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8)))
    rows, pairs = [], set()
    for i in range(60):
        text = " ".join(word() for _ in range(r.randint(30, 200)))
        rows.append((3 * i, text))
        rows.append((3 * i + 1, edit(r, text, max(1, len(text) * r.randint(1, 3) // 100))))
        if i % 5 == 0:
            rows.append((3 * i + 2, text))
        pairs.add((3 * i, 3 * i + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["v"], x["u"]): x["edits"] for x in op.near_links(df).collect()}
    texts = dict(rows)
    assert all(n == distance(texts[v], texts[u]) <= op.MOST_SHARE * max(len(texts[v]), len(texts[u])) for (v, u), n in got.items())
    near = {(v, u) for v in texts for u in texts if v < u and u % 3 != 2 and v % 3 != 2 and op.verified(texts[v], texts[u]) is not None}
    assert set(got) <= near and len(set(got) & pairs) >= 0.9 * len(pairs)
    classes = {x["doc_id"]: x["rep"] for x in op.text_classes(df).collect()}
    assert all(classes[i] == (i - 2 if i % 3 == 2 else i) for i in texts)


def test_near_links_in_blocks_lose_none(spark, monkeypatch):
    r = random.Random(8)
    text = "".join(r.choice("abcdefghijkl ") for _ in range(600))
    rows = [(i, edit(r, text, 3)) for i in range(40)] + [(99, None), (100, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rep", "2 AS band")
    linked = []
    for size in (op.BLOCK_CHARS, 3_000):
        monkeypatch.setattr(op, "BLOCK_CHARS", size)
        up = {i: i for i, _ in rows}
        for x in op.near_links(df).collect():
            a, b = up[x["u"]], up[x["v"]]
            up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
        linked.append(up)
    assert linked[0] == linked[1] and sum(linked[0][i] == 0 for i in range(40)) >= 36
    assert op.near_links(df.limit(0)).collect() == []


def test_query_bands_and_verifies(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in shared.table(spark, SF, "documents").collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    seen = 0
    for r in op.query(spark, SF).collect():
        own, following = texts[r["doc_id"]], texts[after[r["doc_id"]]]
        same = own == following
        assert r["bands_next"] == op.BANDS if same else r["bands_next"] <= op.BANDS
        assert r["edits_next"] == (op.verified(own, following) if r["bands_next"] else None)
        assert r["edits_edited"] == (op.verified(own, op.edited(own, following)) if r["bands_edited"] else None)
        seen += r["edits_next"] is not None or r["edits_edited"] is not None
    rows = spark.createDataFrame([(3, texts[order[0]]), (2, texts[order[0]]), (1, texts[order[0]][:-1])], "doc_id long, text string")
    got = {r["doc_id"]: (r["bands_next"] > 0, r["edits_next"]) for r in op.compare_with_next(rows).collect()}
    assert got[3] == (True, 0) and got[2] == (True, 1)
