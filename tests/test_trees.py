"""Walks and patches of trees against recursion."""

import json
import random

from pagelattice.operators import trees

SCHEMA = "doc_id long, content string, kind string"


def random_tree(r, depth=0):
    node = {"id": r.choice("abcdefgh"), "type": r.choice(["image", "section", "paragraph"]), "n": r.choice([1, 2.5, None, True, "é\"\n", {"z": [1, "x"], "a": {}}])}
    if r.random() < 0.7 and depth < 4:
        node["children"] = [random_tree(r, depth + 1) for _ in range(r.randrange(4))]
    return node


def brute_walk(content):
    def walk(nodes, path):
        for i, n in enumerate(nodes or []):
            yield [*path, i], len(path), n.get("id"), n.get("type")
            yield from walk(n.get("children"), [*path, i])

    return list(walk(json.loads(content).get("nodes"), []))


def brute_patch(content, node_id, url):
    doc, hit = json.loads(content), False
    todo = list(doc.get("nodes") or [])
    while todo:
        n = todo.pop()
        if n.get("id") == node_id and n.get("type") == "image":
            n["s3_url"], hit = url, True
        todo += n.get("children") or []
    return doc, hit


def test_random_trees(spark):
    r = random.Random(8)
    contents = [json.dumps({"version": 1, "nodes": [random_tree(r) for _ in range(r.randrange(4))], "more": {"k": [1]}}, ensure_ascii=r.random() < 0.5) for _ in range(40)]
    docs = spark.createDataFrame([(i, c, "x") for i, c in enumerate(contents)], SCHEMA)
    got = [tuple(x) for x in trees.walk(docs).orderBy("doc_id", "path").collect()]
    assert got == [(i, *row) for i, c in enumerate(contents) for row in brute_walk(c)]  # each before its children
    patches = spark.createDataFrame([(i, "b", f"u{i}") for i in range(0, 40, 2)] + [(0, "b", "z"), (1, None, "q"), (99, "b", "u")], "doc_id long, id string, s3_url string")
    for row in trees.with_s3_urls(docs, patches).collect():
        i = row["doc_id"]
        wanted, hit = brute_patch(contents[i], "b" if i % 2 == 0 else None, f"u{i}")
        assert json.loads(row["content"]) == wanted and row["kind"] == "x"
        assert hit or row["content"] == contents[i]


def test_deep_and_odd_documents(spark):
    deep = '{"nodes":[' + '{"id":"s","type":"section","children":[' * 15 + '{"id":"i","type":"image","s3_url":"old"}' + "]}" * 15 + "]}"
    odd = [(1, deep), (2, None), (3, "not json"), (4, "{}"), (5, '{"nodes":[]}'), (6, '{"nodes":{"id":"i"}}'), (7, '{"nodes":["text",{"id":"i","type":"image","children":[]}]}'), (8, "[1]")]
    docs = spark.createDataFrame([(*x, "") for x in odd], SCHEMA)
    rows = trees.walk(docs).collect()
    assert sorted((x["doc_id"], x["depth"]) for x in rows) == sorted([(1, d) for d in range(16)] + [(7, 0)] * 2)
    out = {x["doc_id"]: x["content"] for x in trees.with_s3_urls(docs, spark.createDataFrame([(i, "i", "new") for i in range(9)], "doc_id long, id string, s3_url string")).collect()}
    assert out[1] == deep.replace("old", "new") and out[7] == '{"nodes":["text",{"id":"i","type":"image","s3_url":"new","children":[]}]}'
    assert all(out[i] == c for i, c in odd if i not in (1, 7))
    none = docs.limit(0)
    assert trees.walk(none).count() == trees.with_s3_urls(none, spark.createDataFrame([], "doc_id long, id string, s3_url string")).count() == 0
