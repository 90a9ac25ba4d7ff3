"""N-gram Jaccard join in the metric space of shingle sets: exact links and components at a Jaccard distance of 1/4 or less.

Pivots create Voronoi regions, triangle-inequality windows replicate what lies near a region's border, and regions are
joined recursively, by exact counts. Almost every distance between documents is exactly 1, so pivots must lie close to
what they divide; they are elected, not drawn:

1. Filters. A document more than a quarter of whose shingles stand in no other document has no partner; counting this over
   the lowest LOW_EIGHTHS of the hash range drops most documents and never one with a partner. Documents with equal sets become
   one set; then all shingles of what is left are counted, and the same filter is used once more. Shingles get one order, rare
   before frequent: two linked sets share one of the first n // 4 + 1 of either, two sets within FAR one of the first half.
2. Pivots. Each set elects, of all sets it shares a row of this index with, the one of least random priority; those elected
   are pivots. All sets within FAR of a pivot are found and their distances counted.
3. Regions. A set within COVER of a pivot is owned by its nearest one. A partner of it, at most 1/4 away, lies within COVER +
   1/4 = FAR of that pivot, and within its own nearest distance + 1/2: so far a region's window reaches, and all in the
   window are repeated in the region. Sets that no pivot covers get regions of their own: each shingle they might share with a
   linked set has a pivot, the least set under it, and all sets under a pivot's shingles are its region.
4. Joining. Sets within 1/4 of a pivot are linked to it; what these links connect needs no comparison. The others are
   compared with all members of a region that owns one end of the pair, in blocks of bounded size that different tasks
   compare. Within a task `join_region` goes on: pivots, nearest regions, windows of nearest distance + 1/2, until a region is small.

What is found is exact up to 64-bit hash collisions of shingles and sets. Components come from the links; copies and stars
are never expanded into pairs. A region costs the product of its members and those of them that no pivot's links connect.

Nulls and oddities: a null or wordless text has the empty set, links with nothing and is its own component; a very long text
is read whole and its set is one row; ties of priority and distance are settled by the set's hash; rows without an id
keep a null component; of rows that repeat an id, with equal or different texts, each is returned with the id's component; an
empty table gives an empty table. Extra columns are ignored; the stage keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .url_filter import passes

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: The part of the hash range, from below, in which shingles are counted first: eighths.
LOW_EIGHTHS = 3
LOW_BELOW = np.uint64(LOW_EIGHTHS << 61)
#: Greatest distance of a link, of a set to the pivot that covers it, and of what meets in a region.
NEAR = 1 - PERCENT / 100
COVER = 0.25
FAR = COVER + NEAR
#: Shingles of a block of a region, and of small regions that go to one call.
BLOCK_SHINGLES, BIN_SHINGLES = 150_000, 150_000
#: Members at which a region isn't divided further within a task, and pivots it is divided by.
LEAF, PIVOTS = 48, 8
CHUNK_BYTES = 2 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    r = np.random.default_rng(77_003)
    byte = r.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    word = r.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return byte, word, space, lower


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch raw[start:end]: one step of all words at a time, the longest words first."""
    codes = _tables()[0][raw]
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    begin, falling = starts[order], -sizes[order]
    acc = np.zeros(len(order), dtype=np.uint64)
    for at in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(falling, -at, side="left"))
        acc[:live] = acc[:live] * np.uint64(0x9E3779B97F4A7C15) + codes[begin[:live] + at]
    h = np.empty_like(acc)
    h[order] = acc
    return _mix(h ^ (sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; whole texts, in chunks of bounded size."""
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    size = 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        chunk.append(b)
        size += len(b)
        if size >= CHUNK_BYTES:
            out += _sets_of(chunk)
            chunk, size = [], 0
    return out + _sets_of(chunk)


def _sets_of(chunk: list[bytes]) -> list[np.ndarray]:
    if not chunk:
        return []
    _, word, space, lower = _tables()
    n = WORDS
    raw = np.frombuffer(b" ".join(chunk).translate(lower) + b" ", dtype=np.uint8)
    limits = np.cumsum([len(b) + 1 for b in chunk])
    blank = space[raw]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    hashes = _word_hashes(raw, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    until = np.searchsorted(starts, limits)
    with np.errstate(over="ignore"):
        if len(hashes) >= n:
            rolled = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
            for k in range(n):
                rolled += hashes[k : len(hashes) - n + 1 + k] * word[k]
            rolled = _mix(rolled)
        out, at = [], 0
        for end in until.tolist():
            k = end - at
            if k >= n:
                out.append(np.unique(rolled[at : end - n + 1]))
            elif k:
                own = np.uint64(k)
                for i in range(k):
                    own = own + hashes[at + i] * word[i]
                out.append(_mix(np.array([own ^ np.uint64(0xA5A5A5A5A5A5A5A5)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at = end
    return out


def _signed(h: np.ndarray) -> np.ndarray:
    """Hashes as longs that sort as the unsigned hashes do."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def _lists(values: list[np.ndarray]):
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, dtype=np.int64), pa.int64()))


def low_shingles(docs: DataFrame) -> DataFrame:
    """(doc_id, n, low): the size of each document's set and its shingles in the low part of the range."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in shared.slices(batches, 1):
            sizes, low = [], []
            for s in shingle_sets(b.column(1).to_pylist()):
                sizes.append(len(s))
                low.append(_signed(s[: np.searchsorted(s, LOW_BELOW)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), _lists(low)], names=["doc_id", "n", "low"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, low array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, shingles): the whole sets and a digest that equal sets share; without the empty ones."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in shared.slices(batches, 1):
            sets = [_signed(s) for s in shingle_sets(b.column(1).to_pylist())]
            keys = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.int64()), _lists(sets)], names=["doc_id", "n", "key", "shingles"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, key long, shingles array<long>").where("n > 0")


def with_chance(low: DataFrame) -> DataFrame:
    """(doc_id): ids of low_shingles() without documents of which more than a quarter of the shingles stand in them alone.

    An id that several rows have stays.
    """
    rows = low.where("doc_id IS NOT NULL")
    shingles = rows.select("doc_id", F.col("n").cast("int").alias("n"), F.explode("low").alias("h"))
    alone = shingles.groupBy("h").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id"), F.min("n").alias("n")).where("c = 1")
    gone = alone.groupBy("doc_id").agg(F.count("*").alias("u"), F.min("n").alias("n")).where(f"u > FLOOR(n * {100 - PERCENT} / 100)").select("doc_id", "u")
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("times"))
    return ids.join(gone, "doc_id", "left").where("u IS NULL OR times > 1").select("doc_id")


def linked(inter, a, b):
    """Whether sets of sizes a and b with an intersection of this size are linked."""
    return inter * 100 >= (a + b - inter) * PERCENT


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, by products of incidence matrices in slices of bounded size."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared_values = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])

    def columns(flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared_values, flat)
        ok = at < len(shared_values)
        ok[ok] = shared_values[at[ok]] == flat[ok]
        return rows[ok], at[ok]

    (ra, ca), (rb, cb) = columns(flat_a, row_a), columns(flat_b, row_b)
    step = max(256, 4_000_000 // (len(a) + len(b)))
    for lo in range(0, len(shared_values), step):
        width = min(step, len(shared_values) - lo)
        ma, mb = np.zeros((len(a), width), dtype=np.float32), np.zeros((len(b), width), dtype=np.float32)
        ka, kb = (ca >= lo) & (ca < lo + width), (cb >= lo) & (cb < lo + width)
        ma[ra[ka], ca[ka] - lo] = 1
        mb[rb[kb], cb[kb] - lo] = 1
        out += ma @ mb.T
    return out


def join_region(sets: list[np.ndarray], left: np.ndarray | None = None, right: np.ndarray | None = None, found: _Union | None = None, members: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links between sets of `left` and of `right` (masks; all sets, if not given) connect; exact.

    found: what is connected already. Pivots divide a region by nearest distance; a member is repeated in each region
    whose pivot is at most its nearest distance + 1/2 away, since a partner of it (at most 1/4 away) may be owned there. A
    region that hardly shrinks is compared as it is.
    """
    every = np.ones(len(sets), dtype=bool)
    left, right = every if left is None else left, every if right is None else right
    members = np.flatnonzero(left | right) if members is None else members
    found = found or _Union(len(sets))
    a, b = members[left[members]], members[right[members]]
    if not len(a) or not len(b):
        return []
    links: list[tuple[int, int]] = []
    size = np.array([len(s) for s in sets], dtype=np.float64)
    if len(members) > LEAF:
        few = min(a, b, key=len)
        pivots = few[np.unique(np.linspace(0, len(few) - 1, PIVOTS).astype(int))]
        inter = intersections([sets[i] for i in pivots], [sets[i] for i in members])
        d = 1 - inter / (size[pivots][:, None] + size[members][None, :] - inter)
        own = d.argmin(axis=0)
        inside = d <= d.min(axis=0) + 2 * NEAR + 1e-12
        regions = [members[inside[k]] for k in range(len(pivots)) if (own == k).any()]
        if max(len(r) for r in regions) < 0.9 * len(members) and sum(len(r) ** 2 for r in regions) < 0.9 * len(members) ** 2:
            for r in regions:
                links += join_region(sets, left, right, found, r)
            return links
    inter = intersections([sets[i] for i in a], [sets[i] for i in b])
    for i, j in zip(*np.nonzero(linked(inter, size[a][:, None], size[b][None, :])), strict=True):
        x, y = int(a[i]), int(b[j])
        if x != y and found.join(x, y):
            links.append((x, y))
    return links


def shingle_index(reps: DataFrame) -> DataFrame:
    """(h, rep, n, first): the shingles of each set (rep, n, shingles) that one within FAR of it shares with it.

    They come first in the global order, rare before frequent over all shingles, without those no other set has; first:
    whether a linked set shares one of these. A set of which more than a quarter stands nowhere else has no rows.
    """
    link = F.floor(F.col("n") * (100 - PERCENT) / 100).cast("int") + 1
    far = F.col("n") - F.ceil(F.col("n") * (1 - FAR)).cast("int") + 1
    rows = reps.select("rep", F.explode("shingles").alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    own = rows.join(often.hint("merge"), "h").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("own"))
    ranked = own.join(reps.select("rep", "n", link.alias("k1"), far.alias("k2")).hint("merge"), "rep").withColumn("alone", F.col("n") - F.size("own")).where("k1 > alone")
    kept = ranked.select("rep", "n", (F.col("k1") - F.col("alone")).alias("k"), F.posexplode(F.slice("own", F.lit(1), F.greatest("k1", "k2") - F.col("alone"))).alias("at", "o"))
    return kept.select("o.h", "rep", "n", (F.col("at") < F.col("k")).alias("first"))


def elected(index: DataFrame) -> DataFrame:
    """(rep): the sets that each set elects, of all it shares a row (h, rep) with; a dense group elects few."""
    voters = index.select("h", "rep")
    least = voters.groupBy("h").agg(F.min(F.struct(F.xxhash64("rep").alias("priority"), "rep")).alias("p"))
    return voters.join(least.hint("merge"), "h").groupBy("rep").agg(F.min("p").alias("p")).select(F.col("p.rep").alias("rep")).distinct()


def measured(met: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, pivot, d, near) of pairs (rep, n, pivot, pn): their distances, by exact counts."""
    side = reps.select("rep", "shingles")
    both = met.join(side.toDF("rep", "x").hint("merge"), "rep").join(side.toDF("pivot", "y").hint("merge"), "pivot")
    inter = both.withColumn("inter", F.size(F.array_intersect("x", "y")).cast("long"))
    d = 1 - F.col("inter") / (F.col("n") + F.col("pn") - F.col("inter"))
    return inter.select("rep", "pivot", d.alias("d"), linked(F.col("inter"), F.col("n"), F.col("pn")).alias("near"))


def around_pivots(index: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, pivot, d, near): all sets within FAR of each elected pivot, itself included."""
    pivots = shared.cut(elected(index), "pivots")
    chosen = index.join(pivots, "rep", "left_semi").select("h", F.col("rep").alias("pivot"), F.col("n").alias("pn"))
    least = 1 - FAR
    # of two sets the one whose rows end first in the global order shares with the other no more than the common rows and what it has behind its rows
    behind = F.greatest(F.ceil(F.col("n") * least), F.ceil(F.col("pn") * least)) - 1
    common = index.select("h", "rep", "n").join(chosen.hint("merge"), "h").where(F.least("n", "pn") >= least * F.greatest("n", "pn")).groupBy("rep", "pivot", "n", "pn").agg(F.count("*").alias("c"))
    met = common.where(F.col("c") + behind + 1e-6 >= least / (1 + least) * (F.col("n") + F.col("pn"))).drop("c")
    met = shared.cut(met, "met")  # the sets come when the rows of all pairs are gone
    return shared.cut(measured(met, reps).where(F.col("d") <= FAR + 1e-12), "distances")


def nearest(distances: DataFrame) -> DataFrame:
    """(rep, own, m): the nearest pivot of each set and its distance."""
    return distances.groupBy("rep").agg(F.min(F.struct("d", "pivot")).alias("b")).select("rep", F.col("b.pivot").alias("own"), F.col("b.d").alias("m"))


def voronoi(distances: DataFrame) -> DataFrame:
    """(region, pivot, rep, owned): the sets of each pivot's region, its own and those of its window."""
    placed = distances.join(nearest(distances).hint("merge"), "rep").withColumn("owned", (F.col("pivot") == F.col("own")) & (F.col("m") <= COVER))
    return placed.where(F.col("owned") | (F.col("d") <= F.col("m") + 2 * NEAR + 1e-12)).select(F.col("pivot").alias("region"), "pivot", "rep", "owned")


def around_shingles(index: DataFrame, distances: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions of sets that no pivot covers, which own themselves there; and the distances (rep, pivot, d, near) in them.

    Each of the shingles that a linked set shares makes the least set under it a pivot, and all sets under the shingles of a
    pivot its region; a set has no more of these pivots than rows.
    """
    covered = nearest(distances).where(F.col("m") <= COVER).select("rep", F.lit(False).alias("owned"))
    rows = index.where("first").select("h", "rep", "n").join(covered, "rep", "left").withColumn("owned", F.coalesce("owned", F.lit(True)))
    pivots = rows.groupBy("h").agg(F.min(F.struct("rep", "n")).alias("p"), F.count("*").alias("c"), F.max("owned").alias("open")).where("c > 1 AND open").select("h", "p")
    under = rows.join(pivots.hint("merge"), "h").groupBy("rep", "n", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn")).agg(F.max("owned").alias("owned"))
    under = shared.cut(under, "under")
    regions = under.select(F.bitwise_not("pivot").alias("region"), "pivot", "rep", "owned")
    return regions, shared.cut(measured(under.where("rep <> pivot").drop("owned"), reps), "distances")


#: Members of a region by class: owned by its pivot or of its window, loose (not yet connected with the pivot) or not.
OWNED_LOOSE, OWNED, WINDOW_LOOSE, WINDOW = range(4)
#: Classes that each class is compared with: an end of a pair is owned, and its ends aren't connected by the pivot.
AGAINST = {OWNED_LOOSE: (OWNED_LOOSE, OWNED, WINDOW_LOOSE, WINDOW), OWNED: (OWNED_LOOSE, WINDOW_LOOSE), WINDOW_LOOSE: (OWNED_LOOSE, OWNED), WINDOW: (OWNED_LOOSE,)}
#: Parts that a region's members are dealt out by, so that a hot one isn't one task's.
SALTS = 16


def salted(rows: DataFrame) -> DataFrame:
    """One row a region, repeated for each salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def region_links(regions: DataFrame, reps: DataFrame, known: DataFrame) -> DataFrame:
    """(u, v): components of `known` (node, component) that links within regions (region, pivot, rep, owned) connect.

    A link is looked for in a region that owns one of its ends.
    """
    of = known.select(F.col("node").alias("rep"), "component")
    members = regions.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(reps.select("rep", "n"), "rep")
    members = shared.cut(members, "members")
    heads = members.where("rep = pivot").select("region", F.col("component").alias("head"))
    loose = F.col("component") != F.col("head")
    cls = F.when(F.col("owned"), F.when(loose, OWNED_LOOSE).otherwise(OWNED)).otherwise(F.when(loose, WINDOW_LOOSE).otherwise(WINDOW))
    placed = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(salted(heads), ["region", "salt"]).withColumn("cls", cls).drop("head", "owned")
    held = [F.coalesce(F.sum(F.when(F.col("cls") == c, F.col("n"))), F.lit(0)) for c in range(4)]
    sizes = placed.groupBy("region").agg(*(x.alias(f"s{c}") for c, x in enumerate(held))).where("s0 > 0 OR s1 > 0 AND s2 > 0")
    total = F.col("s0") + F.col("s1") + F.col("s2") + F.when(F.col("s0") > 0, F.col("s3")).otherwise(0)
    sizes = sizes.withColumn("total", total).withColumn("blocks", F.array(*(F.ceil(F.col(f"s{c}") / BLOCK_SHINGLES).cast("int") for c in range(4)))).select("region", "total", "blocks")
    sizes = shared.cut(sizes, "regions")
    bins = max(64, (sizes.agg(F.sum("total")).first()[0] or 0) // BIN_SHINGLES)
    # blocks are numbered through the classes; a task is a pair of blocks of classes to be compared, a small region one task
    first = [F.aggregate(F.slice("blocks", F.lit(1), F.lit(c)), F.lit(0), lambda x, y: x + y) for c in range(4)]

    def partners(c: int) -> Column:
        of_class = [F.when(F.get("blocks", F.lit(k)) > 0, F.sequence(first[k], first[k] + F.get("blocks", F.lit(k)) - 1)).otherwise(F.array().cast("array<int>")) for k in AGAINST[c]]
        mine = first[c] + F.pmod(F.xxhash64("rep"), F.get("blocks", F.lit(c))).cast("int")
        return F.transform(F.concat(*of_class), lambda j: F.struct(F.least(mine, j).alias("lo"), F.greatest(mine, j).alias("hi"), mine.alias("mine")))

    small = F.col("total") <= BLOCK_SHINGLES
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("mine")))
    tasks = F.when(small & ((F.col("cls") < WINDOW) | (F.get("blocks", F.lit(0)) > 0)), whole).when(small, F.slice(whole, 1, 0))
    for c in range(4):
        tasks = tasks.when(F.col("cls") == c, partners(c))
    dealt = placed.join(salted(sizes), ["region", "salt"]).select("region", "rep", "component", "cls", small.alias("small"), F.explode(tasks).alias("t")).select("region", "rep", "component", "cls", "small", "t.*")
    dealt = dealt.withColumn("bin", F.when(F.col("small"), F.pmod(F.xxhash64("region"), F.lit(bins))).otherwise(F.xxhash64("region", "lo", "hi")))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby(["region", "lo", "hi"]):
            part = part.sort_values("rep").reset_index(drop=True)
            own, cls, sets = part["component"].to_numpy(), part["cls"].to_numpy(), [np.asarray(s) for s in part["shingles"]]
            found = _Union(len(own))
            for same in part.groupby("component").indices.values():
                for i in same[1:]:
                    found.join(int(same[0]), int(i))
            if part["small"].iloc[0]:
                sides = [(cls == OWNED_LOOSE, cls >= OWNED_LOOSE), (cls == OWNED, cls == WINDOW_LOOSE)]
            else:
                sides = [((part["mine"] == part["lo"]).to_numpy(), (part["mine"] == part["hi"]).to_numpy())]
            for left, right in sides:
                out += [(own[i], own[j]) for i, j in join_region(sets, left, right, found)]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    with_sets = dealt.join(reps.select("rep", "shingles").hint("merge"), "rep")
    return with_sets.groupBy("small", "bin").applyInPandas(work, "u long, v long")


def join(docs: DataFrame, low: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) of the documents (doc_id, text) that may have a link; component_id is the smallest id reachable.

    low: low_shingles() of docs, if it is there already.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    own_low = low or shared.cut(low_shingles(rows), "low")
    left = shared.cut(with_chance(own_low), "left")
    if low is None:
        shared.forget(own_low)
    # a filter of bounded size keeps most texts out of the exact join; an inner join, since Spark would move a semi join below it
    maybe = passes(rows, left.select(F.col("doc_id").alias("key")), left.count(), "doc_id")
    sets = shared.cut(full_sets(maybe.join(left.hint("merge"), "doc_id")), "sets")
    members = shared.cut(sets.select("doc_id", "key").distinct(), "keys")
    reps = shared.cut(sets.groupBy(F.col("key").alias("rep")).agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "reps")
    shared.forget(sets)
    index = shared.cut(shingle_index(reps), "index")
    distances = around_pivots(index, reps)
    others, more = around_shingles(index, distances, reps)
    shared.forget(index)
    stars = distances.unionByName(more).where("near AND rep <> pivot").select(F.col("rep").alias("u"), F.col("pivot").alias("v"))
    # an id with several sets connects them
    ties = members.join(members.groupBy("doc_id").agg(F.min("key").alias("v"), F.count("*").alias("c")).where("c > 1"), "doc_id").select(F.col("key").alias("u"), "v")
    known = shared.components(stars.unionByName(ties))
    met = shared.components(region_links(voronoi(distances).unionByName(others), reps, known)).toDF("c", "last")
    known = known.join(met, known["component"] == met["c"], "left").select("node", F.coalesce("last", "component").alias("component")).unionByName(met.select(F.col("c").alias("node"), F.col("last").alias("component")))
    groups = shared.cut(known.groupBy("node").agg(F.min("component").alias("component")), "groups")
    placed = members.join(groups, members["key"] == groups["node"], "left").select("doc_id", F.coalesce("component", "key").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "component").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's set size and component."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    low = shared.cut(low_shingles(docs), "low")
    groups = join(docs, low).withColumnRenamed("doc_id", "id")
    counted = shared.cut(low.select("doc_id", "n"), "counts")
    shared.forget(low)
    return counted.join(groups, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays.

    Of rows that repeat an id and its text one stays; rows without an id stay.
    """
    gone = join(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id")
    named = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
