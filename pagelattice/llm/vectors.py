"""Embedding near-duplicates by sorted projection passes.

Each pass gives a vector the signs of random projections, concatenated to a word, and sorts all vectors by it. The sorted list is cut into blocks; each vector is
compared, in double precision, with all of its block and at least the HALO vectors that follow the block, wherever Spark's
partitions end. Where more vectors than that share a prefix of the word, the window is extended for as long as the prefix lasts, in pairs of blocks that different
tasks compare. The verified pairs of all passes are united. Equal vectors are one vector with a multiplicity throughout.

Only keys are sorted; a block then gets its vectors. The prefix and the passes follow the number of vectors: about `window` unrelated vectors share a prefix,
and there are so many passes that a pair at the least cosine shares none with a chance of MISS at most, whatever lies around it
(neighbours with other prefixes come on top). A dense group makes long runs, which cost comparisons but no links.

Links are counted in a second step, exactly: all pairs within a component. Only a link that would join two components and
whose ends shared no run in any pass is missed.

Nulls and oddities: a vector that is null, empty, zero or holds a null or non-finite component links with nothing, not
even with its copies; vectors of different length don't link; rows without an id link with nothing and belong to no
component; a repeated row is another vector, linked to its copies; an empty table gives an empty table; a cosine equal to the least one links,
as far as doubles tell. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

LEAST_COSINE = 0.95
#: Unrelated vectors that share a prefix, about, and the chance at which a pair at the least cosine may share none.
WINDOW, MISS = 256, 1e-4
#: Bits of a word, rows of a block of the sorted list and of those that follow it.
BITS, BLOCK, HALO = 62, 1024, 256
#: Rows that the passes of one round sort, and rows of components that go to one call.
ROUND_ROWS, BIN_ROWS = 4_000_000, 4096
SEED = 20_011


def planes(dim: int, number: int, bits: int, seed: int = SEED) -> np.ndarray:
    """The hyperplanes of a pass for vectors of one length; the same wherever they are drawn."""
    return np.random.default_rng([seed, dim, number]).standard_normal((dim, bits))


def plan(n: int, window: int, least: float) -> tuple[int, int]:
    """Bits of a prefix and passes for n vectors."""
    bits = min(BITS, max(0, math.ceil(math.log2(max(n, 1) / window))))
    shared_run = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return bits, 1 if shared_run == 1 else math.ceil(math.log(MISS) / math.log1p(-shared_run))


def unit(raw, dim: int) -> np.ndarray:
    """Rows of single-precision bytes as unit vectors of doubles."""
    x = np.frombuffer(b"".join(raw), dtype=np.float32).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def good() -> Column:
    """Whether a row's vector can link."""
    return F.coalesce(F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vec", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()


def usable(rows: DataFrame) -> DataFrame:
    """(rep, times, vec, dim, raw): each distinct vector that can link, under its smallest id, with its bytes in single precision."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(dim=batch["vec"].map(len).astype("int32"), raw=[np.asarray(v, dtype=np.float32).tobytes() for v in batch["vec"]])

    return rows.where(good()).groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")).mapInPandas(pack, "vec array<float>, rep long, times long, dim int, raw binary")


def in_blocks(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """rows of groups of two or more, once for each pair of blocks they are counted in: with columns b, lo, hi, large, bin.

    n is about the number of rows; small groups share a bin, so that there aren't more groups than work.
    """
    bins = max(16, n // BIN_ROWS)
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return (
        rows.join(sizes, key)
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("b", "other"))
        .withColumn("hi", F.greatest("b", "other"))
        .withColumn("large", F.col("blocks") > 1)
        .withColumn("bin", F.when(F.col("large"), F.xxhash64(*key)).otherwise(F.pmod(F.xxhash64(*key), F.lit(bins))))
        .drop("n", "blocks", "other")
    )


def sorted_keys(reps: DataFrame, first: int, last: int, bits: int) -> DataFrame:
    """(block, place, dim, pass, prefix, rep): the sorted lists of passes first to last - 1, one after another, in blocks; a written table."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[int, np.ndarray] = {}
        count = last - first
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                dim = int(dim)
                if dim not in drawn:
                    drawn[dim] = np.hstack([planes(dim, p, BITS) for p in range(first, last)])
                for at in range(0, len(part), 1000):
                    own = part.iloc[at : at + 1000]
                    signs = ((unit(own["raw"], dim) @ drawn[dim]) > 0).reshape(len(own), count, BITS)
                    words = signs.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pd.DataFrame({"dim": dim, "pass": np.tile(np.arange(first, last), len(own)), "word": words.ravel(), "rep": np.repeat(own["rep"].to_numpy(), count)})

    keyed = shared.cut(reps.select("rep", "dim", "raw").mapInPandas(keys, "dim int, pass int, word long, rep long"), "keys")
    order = ["dim", "pass", "word", "rep"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits of the id count the rows of a partition, the others are its number
    listed = dealt.withColumn("id", F.monotonically_increasing_id()).select(
        F.shiftright("id", 33).alias("part"), F.expr(f"(id & {(1 << 33) - 1}) div {BLOCK}").alias("own"), F.expr(f"CAST((id & {(1 << 33) - 1}) % {BLOCK} AS int)").alias("place"), "dim", "pass", F.shiftright("word", BITS - bits).alias("prefix"), "rep"
    )
    listed = shared.cut(listed, "sorted")
    shared.forget(keyed)
    parts = listed.groupBy("part").agg((F.max("own") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return listed.join(bases, "part").select((F.col("base") + F.col("own")).alias("block"), "place", "dim", "pass", "prefix", "rep")


def meetings(listed: DataFrame) -> DataFrame:
    """(lo, hi, side, rep): what is compared. lo = hi: a block (side 0) with itself and with the HALO rows that follow (side 1); else two blocks of a run."""
    key = ["dim", "pass", "prefix"]
    own = listed.select(F.col("block").alias("lo"), F.col("block").alias("hi"), F.lit(0).alias("side"), "rep")
    follow = listed.where((F.col("place") < HALO) & (F.col("block") > 0)).select((F.col("block") - 1).alias("lo"), (F.col("block") - 1).alias("hi"), F.lit(1), "rep")
    held = listed.groupBy("block", *key).agg(F.max("place").alias("place"))
    runs = held.groupBy(*key).agg(F.min("block").alias("from"), F.max("block").alias("to"), F.max_by("place", "block").alias("place"))
    beyond = runs.where((F.col("to") > F.col("from")) & ((F.col("to") - F.col("from") > 1) | (F.col("place") >= HALO)))
    # by block, so that no run, however long, is one task's
    reach = held.select("block", *key).join(beyond.select(*key, "from", "to"), key)
    far = listed.join(reach, ["block", *key]).withColumn("other", F.explode(F.sequence("from", "to"))).where("other <> block")
    far = far.select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int"), "rep")
    return own.union(follow).union(far)


def pass_edges(reps: DataFrame, first: int, last: int, bits: int, least: float) -> DataFrame:
    """(u, v): verified pairs that connect what the windows of passes first to last - 1 connect."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        same = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        for dim, part in pdf.groupby("dim", sort=False):
            x, ids, side = unit(part["raw"], int(dim)), part["rep"].to_numpy(), part["side"].to_numpy()
            left = side == 0
            right = np.ones(len(ids), bool) if same else ~left
            near = x[left] @ x[right].T >= least
            a, b = ids[left], ids[right]
            # in its own block each vector meets itself
            rows = near.sum(axis=1) > int(same)
            if rows.any():
                out.extend((a[rows][i], b[j]) for i, j in _spanning(near[rows]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    met = meetings(sorted_keys(reps, first, last, bits)).join(reps.select("rep", "dim", "raw"), "rep")
    return met.groupBy("lo", "hi").applyInPandas(compare, "u long, v long").where("u <> v").distinct()


def run_edges(reps: DataFrame, passes: int | None, window: int, least: float) -> DataFrame:
    """(u, v) of all passes. As many passes as sort about ROUND_ROWS rows are one round, whose shuffle files go with it."""
    n = reps.count()
    bits, needed = plan(n, window, least)
    passes = passes or needed
    step = min(passes, max(1, ROUND_ROWS // max(n, 1)))
    edges = None
    for first in range(0, passes, step):
        found = shared.cut(pass_edges(reps, first, min(passes, first + step), bits, least), "near")
        edges = found if edges is None else edges.unionByName(found)
    return edges


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Cells of a boolean matrix that connect the rows and columns that its true cells connect, fewer than both together."""
    found, done, fresh = [], np.zeros(len(near), bool), np.ones(near.shape[1], bool)
    for start in np.flatnonzero(near.any(axis=1)):
        queue = [] if done[start] else [start]
        done[start] = True
        while queue:
            i = queue.pop()
            columns = np.flatnonzero(near[i] & fresh)
            if not len(columns):
                continue
            fresh[columns] = False
            found.extend((i, j) for j in columns)
            part = near[:, columns]
            rows = np.flatnonzero(part.any(axis=1) & ~done)
            done[rows] = True
            found.extend(zip(rows, columns[part[rows].argmax(axis=1)], strict=True))
            queue.extend(rows)
    return found


def count_links(members: DataFrame, least: float) -> DataFrame:
    """(rep, links) of members (component, rep, times, dim, raw): links of each vector to other vectors of its component, with multiplicity."""
    placed = in_blocks(members, ["component"], 4096 * BIN_ROWS)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, dim), part in pdf.groupby(["component", "dim"]):
            x, ids, times, b = unit(part["raw"], int(dim)), part["rep"].to_numpy(), part["times"].to_numpy(), part["b"].to_numpy()
            lo, hi = part["lo"].iloc[0], part["hi"].iloc[0]
            if lo == hi:
                near = x @ x.T >= least
                np.fill_diagonal(near, False)
                out.append((ids, near @ times))
            else:
                left, right = b == lo, b == hi
                near = x[left] @ x[right].T >= least
                out.append((ids[left], near @ times[right]))
                out.append((ids[right], near.T @ times[left]))
        return pd.DataFrame({"rep": np.concatenate([o[0] for o in out]), "links": np.concatenate([o[1] for o in out])})

    return placed.groupBy("large", "bin", "lo", "hi").applyInPandas(pairs, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vec: array<float>)."""
    rows = vectors.select("vec_id", F.col("vec").cast("array<float>").alias("vec"))
    reps = shared.cut(usable(rows), "vectors")
    found = shared.components(run_edges(reps, passes, window, least)).select(F.col("node").alias("rep"), "component")
    members = shared.cut(reps.drop("vec").join(found, "rep"), "members")
    links = count_links(members, least)
    whole = (
        reps.join(members.select("rep", "component"), "rep", "left")
        .join(links, "rep", "left")
        .select("vec", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    none = [F.lit(None).cast("long").alias(c) for c in "nc"]
    joined = rows.where(good()).join(whole, "vec", "left").select("vec_id", "n", "c").unionByName(rows.where(~good()).select("vec_id", *none))
    mine = F.col("vec_id").isNotNull()
    return joined.select(
        "vec_id",
        F.when(mine, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(mine, F.coalesce("c", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all embeddings, whatever their labels."""
    return near_duplicates(shared.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec")))
