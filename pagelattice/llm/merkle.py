"""Merkle manifest of a dataset: one tree of hashes a language, one over the languages' roots, and a proof for every row.

A node's text is the lowercase hex of a SHA-256; the node above a run of FANOUT consecutive ones is the hash of their texts
written one after another. Nodes are numbered by exact ranks and fall into aligned blocks of FANOUT ** BLOCK_LEVELS. A task
holds a block as a matrix of 64-byte rows: reshaped by the fanout its rows are the runs, whose hashes are the next matrix,
and positions divided by the fanout address every sibling. The roots of blocks are the leaves of the next round, so a tree
of any size takes a few rounds, and no task sees more than a block. Proofs go the same way down: a block gets its own root's proof
once and puts it behind those of its rows.

The hashes are recomputed from the proofs by Catalyst expressions, apart from the code that made them.

Nulls and oddities: a null field is hashed as `-`; rows of null lang are a tree of their own, ordered first; null ids come first
in a tree, rows with equal ids follow the order of their hashes, and equal rows are separate leaves, of which it makes no difference
which comes first; empty and very long texts are hashed whole, outside Python; a single row is its tree's root, a single tree's root the
root; an empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

FANOUT = 2
#: Levels of a tree that one task folds: 4,096 nodes of 64 bytes for a fanout of two.
BLOCK_LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "path array<struct<at:int,others:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value behind its length in bytes, which no other value's form begins like; `-` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The hash of a row."""
    return digest(*(field(c) for c in columns))


def ranked(rows: DataFrame, group: str | None, order: list, name: str) -> DataFrame:
    """rows with idx (rank from 0 within the group) and n (the group's rows).

    The rows are sorted by ranges and written, each with its part and its place in it; a group's parts are summed up, so that no
    task sees a group. Rows equal in all of `order` are dealt out by their number, so copies of one row don't meet in one part.
    """
    part, place, salt = (shared.private(c, rows) for c in ("part", "place", "salt"))
    keys = [F.col(group).asc_nulls_first()] if group else []
    keys += [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order] + [F.col(salt)]
    numbered = rows.withColumn(salt, F.monotonically_increasing_id())
    placed = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(salt)
    kept = shared.cut(placed.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()), name)
    by = [group] if group else []
    parts = kept.groupBy(*by, part).agg(F.count("*").alias("m"), F.min(place).alias("first"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(part)
    spans = parts.withColumns(
        {"base": F.sum("m").over(before) - F.col("m") - F.col("first"), "n": F.sum("m").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    ).drop("m", "first")
    names = {c: shared.private(f"own_{c}", kept) for c in [*by, part]}
    spans = spans.select(*(F.col(c).alias(k) for c, k in names.items()), "base", "n")
    same = [kept[c].eqNullSafe(spans[k]) for c, k in names.items()]
    on = same[0] if len(same) == 1 else same[0] & same[1]
    return kept.join(spans, on).select(*rows.columns, (F.col(place) + F.col("base")).alias("idx"), "n")


def levels_of(n: int, fanout: int, most: int) -> int:
    """Levels that a block of a tree of n nodes folds: to its root, or `most`."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // fanout), k + 1
    return k


def matrices(hexes: list, n: int, fanout: int, most: int) -> list:
    """The matrices of a block's levels, 64 bytes a row; hexes: its nodes in order, of a tree of n nodes."""
    import numpy as np

    out = [np.frombuffer(b"".join(hexes), np.uint8).reshape(-1, 64)]
    for _ in range(levels_of(n, fanout, most)):
        now = out[-1]
        whole = len(now) // fanout
        runs = [r.tobytes() for r in now[: whole * fanout].reshape(whole, fanout * 64)]
        if whole * fanout < len(now):
            runs.append(now[whole * fanout :].tobytes())
        above = b"".join(hashlib.sha256(r).hexdigest().encode() for r in runs)
        out.append(np.frombuffer(above, np.uint8).reshape(-1, 64))
    return out


def fold_block(table, fanout: int, most: int):
    """One row (tree, idx, node) of a block's rows (tree, block, idx, n, node)."""
    import pyarrow as pa

    rows = table.select(["idx", "node"]).sort_by("idx")
    top = matrices(rows["node"].cast(pa.binary()).to_pylist(), table["n"][0].as_py(), fanout, most)[-1]
    return pa.table({"tree": table["tree"].slice(0, 1), "idx": table["block"].slice(0, 1), "node": pa.array([top.tobytes().decode()])})


def siblings(level, fanout: int) -> tuple[list, list]:
    """For each node of a level: where it stands among the characters of its run's others, and these."""
    text, at, others = level.tobytes().decode(), [], []
    for p in range(len(level)):
        run = p - p % fanout
        at.append((p - run) * 64)
        others.append(text[run * 64 : p * 64] + text[(p + 1) * 64 : (run + fanout) * 64])
    return at, others


def unfold_block(children, parents, fanout: int, most: int, extra: list):
    """Rows (tree, idx, *extra, path): each child's siblings, level by level, then its block's own path."""
    import numpy as np
    import pyarrow as pa

    children = children.sort_by("idx")
    levels = matrices(children["node"].cast(pa.binary()).to_pylist(), children["n"][0].as_py(), fanout, most)
    above = parents["path"].combine_chunks()
    above = (above.chunk(0) if isinstance(above, pa.ChunkedArray) else above).flatten()
    at, others, first, take = [], [], 0, []
    place = np.arange(children.num_rows)
    for level in levels[:-1]:
        a, o = siblings(level, fanout)
        take.append(first + place)
        at, others, first, place = at + a, others + o, first + len(a), place // fanout
    take += [np.full(children.num_rows, first + k) for k in range(len(above))]
    values = pa.StructArray.from_arrays(
        [pa.concat_arrays([pa.array(at, pa.int32()), above.field("at").cast(pa.int32())]), pa.concat_arrays([pa.array(others, pa.string()), above.field("others").cast(pa.string())])], ["at", "others"]
    )
    picked = values.take(pa.array(np.stack(take, 1).ravel() if take else [], pa.int64()))
    path = pa.ListArray.from_arrays(pa.array(np.arange(children.num_rows + 1) * len(take), pa.int32()), picked)
    return children.select(["tree", "idx", *extra]).append_column("path", path)


class Forest:
    """Trees over nodes (tree long, idx long, n long, node string and whatever else), folded and unfolded block by block."""

    def __init__(self, nodes: DataFrame, fanout: int = FANOUT, most: int = BLOCK_LEVELS) -> None:
        self.fanout, self.most, self.size = fanout, most, fanout**most
        self.rounds = [nodes]
        left = nodes.agg(F.max("n")).first()[0] or 0
        while left > 1:
            self.rounds.append(self._above(self.rounds[-1]))
            left = -(-left // self.size)

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.floor(F.col("idx") / self.size).cast("long"))

    def _above(self, nodes: DataFrame) -> DataFrame:
        fold = partial(fold_block, fanout=self.fanout, most=self.most)
        sizes = nodes.select("tree", F.ceil(F.col("n") / self.size).cast("long").alias("n")).distinct()
        blocks = self._blocks(nodes.select("tree", "idx", "n", "node")).groupBy("tree", "block").applyInArrow(lambda t: fold(t), "tree long, idx long, node string")
        return shared.cut(blocks.join(sizes, "tree"), "nodes")

    def roots(self) -> DataFrame:
        """(tree, node)"""
        return self.rounds[-1].select("tree", "node")

    def paths(self, above: DataFrame) -> DataFrame:
        """The nodes with their path; above: (tree, path), the path of each tree's root."""
        out = self.rounds[-1].join(above, "tree")
        for nodes in reversed(self.rounds[:-1]):
            out = self._below(nodes, out)
        return out

    def _below(self, nodes: DataFrame, parents: DataFrame) -> DataFrame:
        extra = [c for c in nodes.columns if c not in ("tree", "idx", "n", "node")] if nodes is self.rounds[0] else []
        extra = [*extra, "n", "node"]
        unfold = partial(unfold_block, fanout=self.fanout, most=self.most, extra=extra)
        schema = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in ["tree", "idx", *extra]) + ", " + PATH
        left = self._blocks(nodes).groupBy("tree", "block")
        right = parents.select("tree", F.col("idx").alias("block"), "path").groupBy("tree", "block")
        return left.cogroup(right).applyInArrow(lambda c, p: unfold(c, p), schema)


def fold_path(node: Column, path: Column) -> Column:
    """The root that a node and its path lead to."""
    step = lambda h, s: digest(F.left(s["others"], s["at"]), h, F.substring(s["others"], s["at"] + 1, F.length(s["others"])))
    return F.aggregate(path, node, step)


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, most: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, lang, leaf, claimed, subroot, root, path) a row of docs (doc_id, source, lang, n_chars, text).

    path: for each level from the leaf to the root the texts of the run's others, and before which of their characters the node stands.
    claimed is the hash of the row with n_chars one higher where `tampered` says so, else null.
    """
    fields = [F.col(c) for c in FIELDS]
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = docs.select("doc_id", "lang", leaf(*fields).alias("node"), F.when(hit, leaf(*changed)).alias("claimed"))
    rows = ranked(leaves, "lang", ["doc_id", "node"], "leaves")
    langs = ranked(rows.select("lang", "n").distinct().withColumnRenamed("n", "size"), None, ["lang"], "trees")
    trees = shared.cut(langs.select("lang", "size", F.col("idx").alias("tree"), F.col("n").alias("trees")), "trees")
    named = trees.select(F.col("lang").alias("own"), "tree")
    forest = Forest(rows.join(named, F.col("lang").eqNullSafe(F.col("own"))).drop("own"), fanout, most)
    subroots = shared.cut(forest.roots().join(trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), "node"), "subroots")
    top = Forest(subroots, fanout, most)
    root = top.roots().withColumnRenamed("node", "root")
    none = root.select("tree", F.array().cast(PATH.split(" ", 1)[1]).alias("path"))
    heads = top.paths(none).select(F.col("idx").alias("tree"), F.col("node").alias("subroot"), "path", F.lit(0).cast("long").alias("one"))
    heads = shared.cut(heads.join(root.withColumnRenamed("tree", "one"), "one").drop("one"), "heads")
    found = forest.paths(heads.select("tree", "path")).join(heads.select("tree", "subroot", "root"), "tree")
    return found.select("doc_id", "lang", F.col("node").alias("leaf"), "claimed", "subroot", "root", "path")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every row proved against the root, some of them changed after the manifest was made."""
    docs = shared.table(spark, sf_dir, "documents")
    rows = manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    checked = rows.withColumn("folded_root", fold_path(F.coalesce("claimed", "leaf"), F.col("path")))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: s["others"]), ""), 256)
    return checked.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in FIELDS) + ")"
_CHANGED = "sha256(" + " || ".join(_FIELD.format(c="(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS) + ")"
#: One step a bit: at every eighth the next byte goes in.
_CRC = """list_reduce(range(0, 8 * length(CAST(doc_id AS VARCHAR))), lambda a, j:
  CASE WHEN (CASE WHEN j % 8 = 0 THEN xor(a, ascii(substr(CAST(doc_id AS VARCHAR), 1 + j // 8, 1))) ELSE a END) & 1 = 1
    THEN xor((CASE WHEN j % 8 = 0 THEN xor(a, ascii(substr(CAST(doc_id AS VARCHAR), 1 + j // 8, 1))) ELSE a END) >> 1, 3988292384)
    ELSE (CASE WHEN j % 8 = 0 THEN xor(a, ascii(substr(CAST(doc_id AS VARCHAR), 1 + j // 8, 1))) ELSE a END) >> 1 END, 4294967295::BIGINT)"""
ORACLE = f"""WITH RECURSIVE l AS (
  SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN xor({_CRC}, 4294967295::BIGINT) % 7 = 0 THEN {_CHANGED} END AS claimed FROM documents),
r AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
t(lv, tree, i, n, h) AS (SELECT 0, tree, i, n, leaf FROM r
  UNION ALL SELECT lv + 1, tree, i // 2, any_value(n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lv, tree, i // 2),
s AS (SELECT tree, h AS subroot, (SELECT count(DISTINCT tree) FROM r) AS n FROM t WHERE n = 1),
u(lv, i, n, h) AS (SELECT 0, tree, n, subroot FROM s
  UNION ALL SELECT lv + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lv, i // 2),
root AS (SELECT h AS root FROM u WHERE n = 1),
a AS (SELECT lv, tree, i, n, h FROM t WHERE n > 1 UNION ALL SELECT 100 + lv, -1, i, n, h FROM u WHERE n > 1),
e AS (SELECT r.tree, r.i AS leaf_i, lv, a.tree = -1 AS up, unnest([lv]) AS one, CASE WHEN a.tree = -1 THEN r.tree // CAST(pow(2, lv - 100) AS BIGINT) ELSE r.i // CAST(pow(2, lv) AS BIGINT) END AS p
  FROM r JOIN (SELECT DISTINCT lv, tree FROM a) a ON a.tree = r.tree OR a.tree = -1),
x AS (SELECT e.tree, leaf_i, e.lv, p % 2 AS odd, coalesce(a.h, '') AS other, row_number() OVER (PARTITION BY e.tree, leaf_i ORDER BY e.lv) AS step
  FROM e LEFT JOIN a ON a.lv = e.lv AND a.tree = CASE WHEN up THEN -1 ELSE e.tree END AND a.i = xor(p, 1)),
p AS (SELECT tree, leaf_i, sha256(string_agg(other, '' ORDER BY step)) AS proof_sha256, max(step) AS steps FROM x GROUP BY ALL),
f(tree, i, step, h) AS (SELECT tree, i, 0::BIGINT, coalesce(claimed, leaf) FROM r
  UNION ALL SELECT f.tree, f.i, f.step + 1, sha256(CASE WHEN odd = 1 THEN other || h ELSE h || other END) FROM f JOIN x ON x.tree = f.tree AND x.leaf_i = f.i AND x.step = f.step + 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM r JOIN s USING (tree) JOIN root ON true LEFT JOIN p ON p.tree = r.tree AND p.leaf_i = r.i JOIN f ON f.tree = r.tree AND f.i = r.i AND f.step = coalesce(p.steps, 0)"""
