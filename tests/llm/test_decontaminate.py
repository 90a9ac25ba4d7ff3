"""Decontamination against windows looked up word by word."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelattice.llm import decontaminate, postings, shared

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, size=10):
    wanted = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            for k in range(max(1, len(w) - size + 1)):
                wanted.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wanted:
                    named |= wanted[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        out.append((doc_id, len(w), len(hit), sorted(named)))
    return sorted(out, key=str)


def brute_near(docs, items, size, times):
    out = []
    for doc_id, text in docs:
        w, named = words(text), set()
        for item, t in items:
            v = words(t)
            for k in range(max(1, len(v) - size + 1)) if v else ():
                window = v[k : k + size]
                runs = [w[i : i + times * len(window)] for i in range(max(1, len(w)))]
                if any(all(r.count(x) >= window.count(x) for x in window) for r in runs):
                    named.add(item)
        out.append((doc_id, sorted(named)))
    return sorted(out, key=str)


def found(spark, docs, items, size=10, **more):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    return decontaminate.contaminated(d, i, size, **more)[0]


def exact(rows):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["item_ids"])) for r in rows.collect()), key=str)


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "Short one"), (3, None), (4, "..!"), (5, "c d e f g h i j k l m n"), (6, "short ONE"), (7, "x " * 30), (None, "never named at all"), (1, "another text of the item with the same id as one above")]
DOCS = [
    (1, "A b C d e f g h i j"), (2, "a b c d e f g h i"), (3, None), (4, ""), (5, "one short one, short. one"), (6, "a b c d e f g h i j k l m n"), (6, "a b c d e f g h i j k l m n"),
    (7, "x " * 9), (8, "x " * 50), (9, "j"), (10, "a b c d e f g h i"), (11, "j k l"), (None, "é short one é"), (12, "another text of the item with the same id as"), (13, "never named at all"), (14, "Short\x00one 短い"),
]


@pytest.mark.parametrize("blocks", [1000, 7])
def test_cases(spark, monkeypatch, blocks):
    monkeypatch.setattr(decontaminate, "STARTS", 3)
    assert exact(found(spark, DOCS, ITEMS, block_windows=blocks)) == brute(DOCS, ITEMS)


def test_near(spark):
    items = [(1, "red green blue"), (2, "red red sky"), (3, "lone")]
    docs = [(1, "blue and green or red"), (2, "green x x x x x red blue"), (3, "red sky over red"), (4, "red sky"), (5, "sky a b c d e red red"), (6, "red green blue lone"), (7, None)]
    rows = found(spark, docs, items, 3)
    assert sorted(((r["doc_id"], sorted(r["near_ids"])) for r in rows.collect()), key=str) == brute_near(docs, items, 3, decontaminate.NEAR)


def test_random_texts(spark):
    import random

    rng = random.Random(5)
    text = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    docs = [(i, text(rng.randrange(60), "abc")) for i in range(120)]
    items = [(i, text(rng.randrange(1, 9), "abc")) for i in range(30)]
    rows = found(spark, docs, items, 4)
    assert exact(rows) == brute(docs, items, 4)
    assert sorted(((r["doc_id"], sorted(r["near_ids"])) for r in rows.collect()), key=str) == brute_near(docs, items, 4, decontaminate.NEAR)


def test_long_texts_and_segments(spark, monkeypatch):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    docs = [(1, long), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (3, long[::-1]), (4, long)]
    items = [(1, " ".join(f"w{i}" for i in range(970, 977)) + " w0 w1 w2 w3"), (2, " ".join(f"w{i}" for i in range(3, 15)))]
    assert exact(found(spark, docs, items)) == brute(docs, items)


def test_no_items_and_no_documents(spark):
    assert exact(found(spark, DOCS, [])) == brute(DOCS, [])
    assert exact(found(spark, [], ITEMS)) == []


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, c: [tuple(r) for r in shared.table(spark, sf, t).select(c, "text").collect()]
    wanted = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    named = lambda x: hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest()
    wanted = [(d, n, hit, len(x), named(x), hit > 0) for d, n, hit, x in wanted]
    assert sorted((tuple(r)[:6] for r in decontaminate.query(spark, sf).collect()), key=str) == sorted(wanted, key=str)
    assert decontaminate.query(spark, sf).where(F.col("n_near") < F.col("n_items")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**35 - 1), max_size=50))
def test_packed_numbers(values):
    packed, ends = postings.pack(values)
    assert list(postings.unpack(packed)) == values
    assert all(list(postings.unpack(packed[a:b])) == [v] for v, a, b in zip(values, ends[:-1], ends[1:], strict=True))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_terms(text):
    assert [t.decode() for t in postings.terms(text.encode())] == words(text)
