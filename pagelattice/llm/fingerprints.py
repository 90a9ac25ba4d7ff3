"""Document fingerprints by a randomised edit embedding.

A pointer walks over a text: at step t it stays or moves on by one, as a random bit shared by all texts says for step t
and the character under it. The characters it visits are the embedded text, 2 steps for each character; two texts a few
edits apart are soon in step again, so their embedded texts differ in few places. A fingerprint samples SLOTS of these
places: slot k takes, of the places the embedded text has, the one whose random priority for k is least, so texts of
about one length sample the same places. It keeps one byte a slot, a hash of the GRAM characters from the pointer on.
The likeness of two fingerprints is the share of equal slots.

A band samples BAND_BITS of a fingerprint's bits; texts that agree in a whole band are candidates, and verification counts
their edits exactly. `compare_with_next` bands and verifies the pairs that it makes (a text with its edited text, a text
with the next one), `near_links` all documents: those that share a band meet in a bucket, which is compared in blocks of bounded size.

Nulls and oddities: a null text is an empty text, whose slots are all zero; a very long text is walked over whole, in time
in proportion, and its edits are counted in time of the product of lengths over 64, only for candidates; of the documents with one id the order is
that of their texts; rows without an id come last; the only document is its own next; an empty table gives an empty
table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SLOTS, GRAM = 128, 4
#: Steps after which the shared random bits repeat, and classes of characters that have bits of their own.
PERIOD, CLASSES = 4096, 256
SEED = 40_961
#: Bands, the bits that each samples, and the edits that verification allows, as a share of the longer text.
BANDS, BAND_BITS, MOST_SHARE = 64, 24, 0.05
#: Walks that near_links embeds each text by: an edit may keep two texts out of step for long in one, hardly in all.
WALKS = 4
#: Characters of a block of a bucket.
BLOCK_CHARS = 1_000_000
#: Characters that are walked over at once, and the longest embedded text that priorities are drawn for.
CHUNK_CHARS, LONGEST = 6_000_000, 1 << 40


@lru_cache(maxsize=None)
def walk_bits(walk: int = 0) -> np.ndarray:
    """bits[t % PERIOD][class] of one of several independent walks; class 0 pads and never moves."""
    bits = np.random.default_rng(SEED if not walk else [SEED, walk]).integers(0, 2, (PERIOD, CLASSES), dtype=np.int64)
    bits[:, 0] = 0
    return bits


@lru_cache(maxsize=1)
def records() -> list[np.ndarray]:
    """For each slot the rising places at which its least priority so far stands.

    The place after a record at j is the first whose priority is lower: drawn as j / u for uniform u, as record places are.
    """
    out = []
    for k in range(SLOTS):
        r = np.random.default_rng([SEED, k])
        at = [0]
        while at[-1] < LONGEST:
            at.append(int((at[-1] + 1) / r.uniform(1e-9, 1.0)))
            if at[-1] <= at[-2]:
                at[-1] = at[-2] + 1
        out.append(np.array(at[:-1], dtype=np.int64))
    return out


def fingerprints(texts: list[str], walk: int = 0) -> np.ndarray:
    """One row of SLOTS bytes for each text; all texts walk in step."""
    out = np.zeros((len(texts), SLOTS), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[: int((sizes > 0).sum())]
    if not len(order):
        return out
    n = sizes[order]
    code = np.frombuffer("".join(texts[i] + "\0" * GRAM for i in order).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cls = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (CLASSES - 1) + 1
    starts = np.concatenate([[0], np.cumsum(n + GRAM)[:-1]])
    for k in range(GRAM):
        cls[starts + n + k] = 0
    cls = cls.astype(np.uint8)
    bits, places = walk_bits(walk), records()
    steps = 2 * n
    times = np.unique(np.concatenate([p[p < steps[0]] for p in places]))
    seen = np.empty((len(times), len(order)), dtype=np.int64 if len(code) >= 1 << 31 else np.int32)
    p = starts.copy()
    # how many texts still walk when a stretch of steps begins
    t, j, stretch = 0, 0, 32
    last = int(steps[0])
    while t < last:
        active = int(np.searchsorted(-steps, -t, side="left"))
        if active == 0:
            break
        own = p[:active]
        stop = min(t + stretch, last)
        while t < stop:
            if j < len(times) and times[j] == t:
                seen[j, :active] = own
                j += 1
            own += bits[t % PERIOD].take(cls.take(own))
            t += 1
    rows = np.arange(len(order))
    mix = np.uint64(0x9E3779B97F4A7C15)
    for k, at in enumerate(places):
        place = at[np.searchsorted(at, steps, side="left") - 1]
        where = seen[np.searchsorted(times, place), rows].astype(np.int64)
        h = np.full(len(order), k + 1, dtype=np.uint64)
        for g in range(GRAM):
            h = (h ^ code[where + g]) * mix
            h ^= h >> np.uint64(29)
        out[order, k] = np.where(where < starts + n, (h >> np.uint64(56)).astype(np.uint8), 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


@lru_cache(maxsize=1)
def sampled_bits() -> np.ndarray:
    """The bits of a fingerprint that each band samples."""
    return np.random.default_rng(SEED + 1).integers(0, 8 * SLOTS, (BANDS, BAND_BITS))


def bands(prints: np.ndarray) -> np.ndarray:
    """One row of BANDS longs for each fingerprint."""
    packed = np.packbits(np.unpackbits(prints, axis=1)[:, sampled_bits()], axis=2).astype(np.int64)
    return packed @ (1 << 8 * np.arange(packed.shape[2], dtype=np.int64))


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many first characters of the following text, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, sentinel, doc_id, text), dealt by bucket and sorted, that stand before the document they are followed by.

    Buckets are ranges of ids, highest first; the first document of each is repeated at the end of the bucket before it,
    as a sentinel. What comes to the driver is the bounds of the buckets, as many as shuffle partitions.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / parts for i in range(1, parts)], 0.2 / parts)))
    above = F.array(*(F.lit(b) for b in bounds)) if bounds else F.array().cast("array<double>")
    bucket = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(F.size(F.filter(above, lambda b: b >= F.col("doc_id").cast("double"))))
    placed = rows.withColumn("bucket", bucket.cast("int"))
    heads = placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    before = {heads[i]["head"]: heads[i - 1]["bucket"] for i in range(len(heads))}
    known = {h: b for h, b in before.items() if h is not None}
    sentinel = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[F.col("doc_id")] if known else F.lit(None)
    if None in before:
        sentinel = F.when(F.col("doc_id").isNull(), before[None]).otherwise(sentinel)
    both = placed.withColumn("at", F.explode(F.filter(F.array(F.struct("bucket", F.lit(0).alias("sentinel")), F.struct(sentinel.cast("int").alias("bucket"), F.lit(1).alias("sentinel"))), lambda s: s["bucket"].isNotNull())))
    # the key that hash partitioning sends to partition i stands for bucket i, so that no task gets two and another none
    sent = spark.range(64 * parts).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("i")).agg(F.min("k").alias("k")).orderBy("i").collect()
    keys = F.array(*(F.lit(r["k"]) for r in sent))
    dealt = both.select("at.bucket", "at.sentinel", "doc_id", "text").repartition(parts, F.get(keys, F.col("bucket") % len(sent)))
    return dealt.sortWithinPartitions("bucket", "sentinel", F.desc_nulls_last("doc_id"), "text")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) against its edited text and the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, bands_edited, bands_next,
    edits_edited, edits_next): bands are those that two fingerprints share, edits the verified number of edits between the texts, null
    if they share no band or more than MOST_SHARE of the longer text is edited.
    """

    def work(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        # rows: (bucket, doc_id, text) in order, the last one only as the next of the one before it
        keep = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0]]
        if not keep:
            return
        texts = [r[2] for r in rows]
        changed = [edited(texts[i], texts[i + 1]) for i in keep]
        prints = fingerprints(texts + changed)
        own, new = prints[: len(texts)], prints[len(texts) :]
        at = np.array(keep)
        banded, new_bands = bands(own), bands(new)
        shared_edited, shared_next = (banded[at] == new_bands).sum(axis=1), (banded[at] == banded[at + 1]).sum(axis=1)
        yield pd.DataFrame(
            {
                "doc_id": pd.array([rows[i][1] for i in keep], dtype="Int64"),
                "n_chars": [len(texts[i]) for i in keep],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                "fingerprint": [own[i].tobytes().hex() for i in keep],
                "edited_fingerprint": [x.tobytes().hex() for x in new],
                "near_edited": likeness(own[at], new),
                "near_next": likeness(own[at], own[at + 1]),
                "bands_edited": shared_edited,
                "bands_next": shared_next,
                "edits_edited": pd.array([verified(texts[i], t) if k else None for i, t, k in zip(keep, changed, shared_edited, strict=True)], dtype="Int64"),
                "edits_next": pd.array([verified(texts[i], texts[i + 1]) if k else None for i, k in zip(keep, shared_next, strict=True)], dtype="Int64"),
            }
        )

    def run(batches: Iterator) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        chars, ended = 0, None
        for batch in batches:
            for bucket, sentinel, doc_id, text in zip(batch["bucket"], batch["sentinel"], batch["doc_id"], batch["text"], strict=True):
                if sentinel and ended == bucket:
                    continue  # another row with the id of the bucket's successor
                ended = bucket if sentinel else None
                rows.append((bucket, None if pd.isna(doc_id) else int(doc_id), text))
                chars += len(text)
                if chars >= CHUNK_CHARS:
                    yield from work(rows)
                    rows, chars = rows[-1:], len(rows[-1][2])
        yield from work(rows)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema += ", bands_edited long, bands_next long, edits_edited long, edits_next long"
    return with_next(docs).mapInPandas(run, schema)


def edit_distance_within(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most `most`, else None.

    All cells of a column of the distance matrix are one integer's bits (differences to the cell above), so a column
    costs a few operations on integers of the shorter text's length.
    """
    if abs(len(a) - len(b)) > most:
        return None
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = every, 0, len(a)
    for j, c in enumerate(b, 1):
        same = at.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(diagonal | up) & every, up & diagonal
        if right & last:
            distance += 1
        elif left & last:
            distance -= 1
        if distance - (len(b) - j) > most:
            return None
        right, left = (right << 1 | 1) & every, left << 1 & every
        up, down = left | ~(diagonal | right) & every, right & diagonal
    return distance if distance <= most else None


def _common(a: str, b: str) -> int:
    """The length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _least_edits(a: str, b: str) -> int:
    """A lower bound of the edit distance: an edit changes three triples of characters on either side at most."""

    def triples(t: str) -> np.ndarray:
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        return c[:-2] << 42 | c[1:-1] << 21 | c[2:]

    x, y = triples(a), triples(b)
    kinds, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    n = np.bincount(at[: len(x)], minlength=len(kinds)) - np.bincount(at[len(x) :], minlength=len(kinds))
    return -(-int(np.abs(n).sum()) // 6)


def verified(a: str, b: str) -> int | None:
    """The number of edits between two texts if it is within MOST_SHARE of the longer one."""
    most = int(MOST_SHARE * max(len(a), len(b)))
    if a == b or abs(len(a) - len(b)) > most:
        return 0 if a == b else None
    n = _common(a, b)
    a, b = a[n:], b[n:]
    if n := _common(a[::-1], b[::-1]):
        a, b = a[:-n], b[:-n]
    return None if _least_edits(a, b) > most else edit_distance_within(a, b, most)


def text_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, rep): of the documents (doc_id, text) with one text the smallest id stands for all."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    return rows.join(least, "digest").select("doc_id", "rep").distinct()


def near_links(docs: DataFrame) -> DataFrame:
    """(u, v, edits), u > v: verified links between texts of rows (doc_id, text), by the smallest id of each text (text_classes).

    In every bucket the links connect all that all its links connect; pairs that are connected already are not verified.
    Buckets with the same members are one. An id should have one text; of several the smallest counts.
    """

    def print_bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = np.hstack([bands(fingerprints(list(batch["text"]), walk)) for walk in range(WALKS)])
            count = own.shape[1]
            yield pd.DataFrame({"rep": np.repeat(batch["rep"].to_numpy(), count), "n": np.repeat(batch["text"].map(len).to_numpy(), count), "band": np.tile(np.arange(count), len(own)), "key": own.ravel()})

    rows = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("rep")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    chosen = shared.cut(rows.join(text_classes(docs).where("doc_id = rep").select("rep"), "rep"), "texts")
    banded = shared.cut(chosen.mapInPandas(print_bands, "rep long, n long, band int, key long"), "bands")
    digest = [F.sum(F.xxhash64("rep", F.lit(i)).cast("decimal(38,0)")).alias(f"d{i}") for i in range(2)]
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("c"), F.sum("n").alias("chars"), *digest).where("c > 1")
    unlike = buckets.groupBy("c", "d0", "d1").agg(F.min(F.struct("band", "key", "chars")).alias("b")).select("b.*")
    sized = unlike.withColumn("blocks", F.ceil((F.col("chars") + 1) / BLOCK_CHARS).cast("int"))
    dealt = (
        banded.join(sized, ["band", "key"])
        .withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "key", "rep", "b", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"))
    )

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        ids, texts, block = pdf["rep"].tolist(), pdf["text"].tolist(), pdf["b"].tolist()
        group = list(range(len(ids)))
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        out = []
        for i in range(len(ids)):
            for j in range(i):
                if group[i] != group[j] and (lo == hi or block[i] != block[j]):
                    edits = verified(texts[i], texts[j])
                    if edits is not None:
                        out.append((ids[i], ids[j], edits))
                        old = group[i]
                        group = [group[j] if g == old else g for g in group]
        return pd.DataFrame(out, columns=["u", "v", "edits"], dtype="int64")

    whole = dealt.join(chosen.hint("merge"), "rep")
    return whole.groupBy("band", "key", "lo", "hi").applyInPandas(verify, "u long, v long, edits long").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document against its edited text and the next document."""
    return compare_with_next(shared.table(spark, sf_dir, "documents"))
