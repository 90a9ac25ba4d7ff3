"""Folder trees against loops over parents, deep and with cycles."""

import random

import pytest

from pagelattice.operators import folders, mutations

SCHEMA = "id long, parent_id long"


def brute(rows):
    """Per folder: (id, root, depth, in_cycle), and the folders above it with their least distance."""
    parent = dict(rows)
    out, above = [], {}
    for i in parent:
        seen, at = {}, i
        while at in parent and at not in seen:
            seen[at] = len(seen)
            at = parent[at] if parent[at] in parent else None
        above[i] = seen
        top = list(seen)[-1]
        out.append((i, top, seen[top], False) if at is None else (i, None, None, at == i))
    return sorted(out), above


def random_forest(seed, n):
    r = random.Random(seed)
    rows = [(i, r.choice([None, r.randrange(n), max(0, i - 1), r.randrange(max(i, 1)), n + 5])) for i in range(n)]
    return rows


@pytest.mark.parametrize("rows", [random_forest(1, 60), random_forest(2, 90), [(1, 1)], [(1, 2), (2, 1), (3, 2), (4, None), (5, 4)], [(7, 8)]])
def test_forests(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    places, above = brute(rows)
    assert sorted(map(tuple, folders.placed(table).collect())) == places
    assert sorted(map(tuple, folders.tree(table).collect())) == sorted((a, i, d) for i, seen in above.items() for a, d in seen.items())
    wanted = {rows[0][0], rows[-1][0], 10**6}
    got = folders.under(table, spark.createDataFrame([(w,) for w in wanted] * 2, "id long"))
    assert sorted(r["id"] for r in got.collect()) == sorted(i for i, seen in above.items() if wanted & set(seen))


def test_a_chain_of_ten_thousand_and_a_cycle(spark):
    n = 10_000
    rows = [(i, i - 1 if i else None) for i in range(n)] + [(n + i, n + (i + 1) % 100) for i in range(100)] + [(n + 100 + i, n + 99 + i) for i in range(50)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    wanted = [(i, 0, i, False) for i in range(n)] + [(n + i, None, None, i < 100) for i in range(150)]
    assert sorted(map(tuple, folders.placed(table).collect())) == wanted
    got = folders.under(table, spark.createDataFrame([(9000,), (n + 120,)], "id long"))
    assert sorted(r["id"] for r in got.collect()) == [*range(9000, n), *range(n + 120, n + 150)]


def test_odd_tables(spark):
    rows = spark.createDataFrame([(None, 1), (1, None), (1, None), (2, 1), (2, None), (3, 99)], SCHEMA)
    assert sorted(map(tuple, folders.placed(rows).collect())) == [(1, 1, 0, False), (2, 1, 1, False), (3, 3, 0, False)]
    empty = spark.createDataFrame([], SCHEMA)
    assert folders.placed(empty).count() == folders.tree(empty).count() == folders.under(empty, rows.select("id")).count() == 0


def test_deleting_a_folder_of_a_cycle(spark):
    table = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "c", None)], "id long, name string, parent_id long")
    docs = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "id long, folder_id long")
    kept, moved = mutations.delete_folders(table, docs, spark.createDataFrame([(1,)], "id long"))
    assert [r["id"] for r in kept.collect()] == [3] and sorted(map(tuple, moved.collect())) == [(10, None), (11, None), (12, 3)]


def test_repeated_ids_add_one_folder_and_one_tag(spark):
    table = spark.createDataFrame([("f", "F", None)], "id string, name string, parent_id string")
    new = spark.createDataFrame([("f", "again", None), ("g", "two", None), ("g", "one", "f"), (None, "x", None)], table.schema)
    assert sorted(map(tuple, mutations.create_folders(table, new).collect())) == [("f", "F", None), ("g", "one", "f")]
    tags = spark.createDataFrame([("t", "old", "red")], "id string, name string, color string")
    more = spark.createDataFrame([("t", "other", "x"), ("u", "b", None), ("u", "a", "x"), (None, "q", None), ("v", "a", "y")], tags.schema)
    assert sorted(map(tuple, mutations.create_tags(tags, more).collect())) == [("t", "old", "red"), ("u", "a", "x")]


def test_tags_are_renamed_and_recoloured(spark):
    tags = spark.createDataFrame([("a", "one", "red"), ("b", "two", "red"), ("c", "three", "red"), ("d", "four", "red")], "id string, name string, color string")
    change = spark.createDataFrame([("a", " uno ", None), ("b", "three", "blue"), ("c", "same", None), ("d", "same", None), ("x", "new", "y")], tags.schema)
    assert sorted(map(tuple, mutations.save_tags(tags, change).collect())) == [("a", "uno", "red"), ("b", "two", "blue"), ("c", "three", "red"), ("d", "four", "red")]
    colours = spark.createDataFrame([("a", "green"), ("b", None)], "id string, color string")
    assert sorted(map(tuple, mutations.save_tags(tags, colours).collect()))[:2] == [("a", "one", "green"), ("b", "two", "red")]
