"""Merkle manifest against a tree built node by node."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagelattice.llm import merkle
from tests.compare import database, same

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, tree string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([h("".join(now[k : k + fanout])) for k in range(0, len(now), fanout)])
    return out


def brute_path(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        run = i - i % fanout
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
        i //= fanout
    return out


def brute(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        changed = [*r[:3], None if r[3] is None else r[3] + hit, r[4]]
        trees[r[2]].append((r[0] is not None, r[0] or 0, h("".join(map(field, r[:5]))), h("".join(map(field, changed))), r[0]))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort()
    levels = {k: brute_levels([x[2] for x in t], fanout) for k, t in trees.items()}
    top = brute_levels([levels[k][-1][0] for k in langs], fanout) if langs else []
    out = []
    for n, k in enumerate(langs):
        for i, (_, _, leaf, claimed, doc_id) in enumerate(trees[k]):
            path = brute_path(levels[k], i, fanout) + brute_path(top, n, fanout)
            folded = claimed
            for left, right in path:
                folded = h(left + folded + right)
            out.append((doc_id, leaf, levels[k][-1][0], top[-1][0], h("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(docs, fanout, most):
    rows = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, fanout, most)
    folded = merkle.fold_path(F.coalesce("claimed", "leaf"), F.col("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: s["others"]), ""), 256)
    return sorted((tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", proof, folded, folded == F.col("root")).collect()), key=str)


@pytest.mark.parametrize(("fanout", "most", "n"), [(2, 12, 90), (2, 2, 61), (3, 1, 40), (4, 2, 33), (2, 1, 1), (2, 2, 8)])
def test_trees_of_blocks(spark, fanout, most, n):
    rows = [(i, f"s{i % 3}", ["en", "de", None, "é"][min(i % 7, 3)], i * 3, f"text {i}" * (i % 4), "x", "y") for i in range(n)]
    assert found(spark.createDataFrame(rows, SCHEMA), fanout, most) == brute(rows, fanout)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, "a", "b"), (None, None, None, None, "", None, None), (3, "é", "zh", None, "\U0001f600" * 5000, "", "")]
    rows += [(5, "s", "en", 4, "same", "n", "t")] * 7 + [(5, "s", "en", 4, f"other {i}", "n", "t") for i in range(3)] + [(-7, "", "", -1, None, "", "")]
    assert found(spark.createDataFrame(rows, SCHEMA), 2, 2) == brute(rows)
    assert found(spark.createDataFrame(rows, SCHEMA), 2, 12) == brute(rows)


def test_many_languages(spark):
    rows = [(i, "s", f"l{i % 37:02}", i, "t", "", "") for i in range(150)]
    assert found(spark.createDataFrame(rows, SCHEMA), 2, 2) == brute(rows)


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA), 2, 12) == []


def test_ranks_of_one_row_repeated(spark):
    rows = merkle.ranked(spark.createDataFrame([("g", 1)] * 500 + [("h", 2)] * 3, "g string, x long"), "g", ["x"], "ranks")
    assert sorted(map(tuple, rows.collect())) == [("g", 1, i, 500) for i in range(500)] + [("h", 2, i, 3) for i in range(3)]


def test_sql(spark):
    own, other = same(merkle.query(spark, "/root/testdata/sf0.001"), database("/root/testdata/sf0.001"), merkle.ORACLE)
    assert own == other
