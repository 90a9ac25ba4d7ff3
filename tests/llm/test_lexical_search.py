"""Ranked search against scores of every document, one by one."""

import math
import random
import re
from collections import Counter

import pytest

from pagelattice.llm import lexical_search
from tests.compare import database, same

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, most):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n, length = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 50 + 50 * c.total() * n // length if c else 0
            points = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if points > 0:
                scores.append((-points, d is None, d))
        out += [(item, k + 1, d, -p) for k, (p, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:most])]
    return sorted(out, key=str)


def found(spark, docs, items, most=50, **more):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, block int").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, query int")
    rows = lexical_search.search(d, i, most, **more)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


DOCS = [(1, "The cat sat"), (2, "cat CAT cat"), (3, None), (4, ""), (5, "dog"), (5, "dog"), (6, "the the dog é"), (7, "..."), (None, "dog"), (8, "katze" + " x" * 9000), (9, "cat\x00sat"), (10, "É é")]
ITEMS = [(1, "cat sat"), (2, None), (3, "?"), (4, "unheard of"), (5, "dog dog THE"), (5, "katze x"), (None, "é"), (6, "dog")]


@pytest.mark.parametrize("docs_in_block", [64, 1])
def test_cases(spark, monkeypatch, docs_in_block):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", docs_in_block)
    monkeypatch.setattr(lexical_search, "CELLS", 4)
    assert found(spark, DOCS, ITEMS, 3) == brute(DOCS, ITEMS, 3)


def test_pruning_and_query_blocks(spark, monkeypatch):
    """Many small blocks, few results: most blocks lie under the thresholds; queries in several parts."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(600)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 12)))) for i in range(40)]
    docs += [(1000 + i, items[i % 40][1]) for i in range(80)]
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 4)
    assert found(spark, docs, items, 5, query_terms=60) == brute(docs, items, 5)


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    rows = [(i, "rare common" if i < 8 else "common filler words") for i in range(400)]
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 4)
    index = lexical_search.Index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    q = lexical_search.Queries([[b"rare", b"common"]], {b"rare": 8, b"common": 400}, index.n)
    from pagelattice.llm import postings

    bounds = [q.bounds(r["terms"], postings.unpack(r["most"]))[0] for r in index.blocks.select("terms", "most").collect()]
    least = index.search([[b"rare", b"common"]], 5).agg({"score": "min"}).first()[0]
    assert sum(b >= least for b in bounds) == 2 and len(bounds) == 100


def test_scores_beyond_doubles(monkeypatch, spark):
    monkeypatch.setattr(lexical_search, "EXACT", 1)
    assert found(spark, DOCS, ITEMS, 3) == brute(DOCS, ITEMS, 3)


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == []
    assert found(spark, DOCS, []) == []
    assert found(spark, [(1, None)], ITEMS) == []


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    own, other = same(lexical_search.query(spark, sf), database(sf), lexical_search.ORACLE)
    assert own == other
