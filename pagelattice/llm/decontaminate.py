"""Benchmark decontamination with a distributed positional inverted index.

Every term of the training texts is posted. Documents follow one another in segments of about SEGMENT_BYTES, whose words are numbered with a
gap between documents; a row of the index is a segment with its terms and for each term its places, as packed steps. A test window asks for
its terms at their offsets: the list of its rarest term (counted over the whole index), less its offset, holds the starts there may
be, and the lists of the next rarer terms are intersected with it until all terms have been. So a match is exact, and a place is
only looked at if the window's rarest term stands there. Segments are read where they lie, without a shuffle; of their lists
only those of test terms are unpacked. A frequent term is a list in every segment and never one row. Test windows are dealt
out in blocks of a bounded size, and only these blocks are sent to all tasks.

Besides exact phrases the index gives proximity matches: all terms of a window, in any order, within NEAR times as many words.

Nulls and oddities: a null or empty text has no words and no hits; items without words match nothing; a word of a document
counts once, however many windows cover it; rows with equal ids, of either table, are told apart, and equal item ids are named once;
items with equal windows are all named; items of null id can't be named and are left out; windows never
reach over the end of a document; a very long text is a segment of its own; empty tables give no rows, or rows without
hits. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import postings, shared

#: Words of a window, and how many times as many words its terms may stand within for a proximity match.
WINDOW, NEAR = 10, 2
#: Text bytes and documents of a segment of the index.
SEGMENT_BYTES, SEGMENT_DOCS = 6 << 20, 4096
#: Windows of items sent to all tasks at once, on average; more are matched block after block.
BLOCK_WINDOWS = 200_000
#: Starts that are looked at at once within a task.
STARTS = 1 << 20


def post(docs: DataFrame) -> DataFrame:
    """The index of (doc_id, text), a row a segment: its documents (ids, first, sizes), its terms, joined by spaces, how often each
    stands there, where its list begins, and the lists.

    first is the number of a document's first word in its segment; a list holds the packed steps from one place of a term to
    the next.
    """
    kind = docs.schema["doc_id"].dataType
    schema = f"segment long, ids array<{kind.simpleString()}>, first array<long>, sizes array<long>, terms binary, counts binary, begins binary, places binary"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        of = pa.list_(to_arrow_type(kind))
        for segment, ids, texts in postings.segments(batches, SEGMENT_BYTES, SEGMENT_DOCS):
            seen: dict = defaultdict()
            seen.default_factory = seen.__len__
            numbers = [np.asarray(postings.number(postings.terms(t), seen), np.int32) for t in texts]
            sizes = np.array([len(n) for n in numbers], np.int64)
            first = np.cumsum(sizes + 1) - sizes - 1
            words = np.concatenate(numbers)
            place = np.arange(len(words)) + np.repeat(np.arange(len(texts)), sizes)
            place, counts = place[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(seen))
            starts = np.cumsum(counts) - counts
            steps = np.diff(place, prepend=0)
            steps[starts] = place[starts]
            packed, ends = postings.pack(steps)
            blobs = [b" ".join(seen), postings.pack(counts)[0], postings.pack(ends[starts])[0], packed]
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int64()), pa.array([ids], of), pa.array([first.tolist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in blobs)],
                names=["segment", "ids", "first", "sizes", "terms", "counts", "begins", "places"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def term_counts(index: DataFrame, wanted) -> DataFrame:
    """(term, n) of the index for the terms of a bounded set, sent to all tasks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = postings.unpack(counts)
                for i, t in enumerate(terms.split()):
                    if t in wanted.value:
                        total[t] += int(n[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    return index.select("terms", "counts").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def windows(items: DataFrame, words: int = WINDOW) -> DataFrame:
    """(item_id, terms) of (item_id, text): every run of so many words; all words of an item that has fewer."""
    found = F.regexp_extract_all(shared.lower_ascii(F.col("text")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    listed = items.select("item_id", found.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (words - 1)))
    return listed.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, words))).alias("terms"))


class Windows:
    """A block of distinct windows as arrays: their terms from the rarest on, with offsets, as numbers of the block's terms.

    owners: for each window the numbers of its items. Distinct terms come a second time, with how often each is a window's.
    """

    def __init__(self, listed: list[list[bytes]], owners: list[list[int]], counts: dict[bytes, int]) -> None:
        import numpy as np

        ends = lambda parts: np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        flat = lambda parts: np.array([x for p in parts for x in p], np.int64)
        self.number = {t: i for i, t in enumerate(sorted({t for w in listed for t in w}))}
        ranked = [sorted(range(len(w)), key=lambda k, w=w: (counts.get(w[k], 0), k)) for w in listed]
        self.size, self.first, self.offset = flat([[len(w)] for w in listed]), ends(ranked), flat(ranked)
        self.term = flat([[self.number[w[k]] for k in r] for w, r in zip(listed, ranked, strict=True)])
        often = [list(Counter(self.number[w[k]] for k in r).items()) for w, r in zip(listed, ranked, strict=True)]
        self.kind_first, self.kind, self.often = ends(often), flat([[t for t, _ in o] for o in often]), flat([[n for _, n in o] for o in often])
        self.owner_first, self.owner = ends(owners), flat(owners)


def phrases(lists, found: Windows) -> Iterator[tuple]:
    """(window, start) arrays of a segment's exact matches; lists: the sorted keys term << 40 | place of the segment's test terms."""
    import numpy as np

    begin = np.searchsorted(lists, found.term[found.first[:-1]] << 40)
    end = np.searchsorted(lists, found.term[found.first[:-1]] + 1 << 40)
    for part in _parts(end - begin):
        many = (end - begin)[part]
        w = np.repeat(part, many)
        place = lists[np.repeat(begin[part] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(w))] & (1 << 40) - 1
        start = place - found.offset[found.first[w]]
        w, start = w[start >= 0], start[start >= 0]
        k = 1
        while len(w) and (longer := found.size[w] > k).any():
            at = found.first[w[longer]] + k
            key = (found.term[at] << 40) + start[longer] + found.offset[at]
            i = np.minimum(np.searchsorted(lists, key), len(lists) - 1)
            stays = ~longer
            stays[longer] = lists[i] == key
            w, start, k = w[stays], start[stays], k + 1
        if len(w):
            yield w, start


def near(lists, found: Windows, first, times: int = NEAR) -> Iterator[tuple]:
    """(window, place of its rarest term) arrays of a segment's proximity matches: one is all terms of a window, each as often as it
    is one of the window's, within times as many words of one document. first: where the segment's documents begin."""
    import numpy as np

    begin = np.searchsorted(lists, found.term[found.first[:-1]] << 40)
    end = np.searchsorted(lists, found.term[found.first[:-1]] + 1 << 40)
    reach = found.size * times
    for part in _parts(end - begin):
        many = (end - begin)[part]
        w = np.repeat(part, many)
        place = lists[np.repeat(begin[part] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(w))] & (1 << 40) - 1
        k = 1
        while len(w) and (longer := found.size[w] > k).any():
            # some place of the next rarer term within reach on either side; a place less would make the key another term's
            base = found.term[found.first[w[longer]] + k] << 40
            i = np.minimum(np.searchsorted(lists, base + np.maximum(place[longer] - reach[w[longer]] + 1, 0)), len(lists) - 1)
            there = (lists[i] >= base) & (lists[i] < base + place[longer] + reach[w[longer]])
            stays = ~longer
            stays[longer] = there
            w, place, k = w[stays], place[stays], k + 1
        if len(w):
            slot = np.searchsorted(first, place, side="right")
            good = _within(lists, found, w, place, reach[w], first[slot - 1], np.append(first, 1 << 40)[slot])
            yield w[good], place[good]


def _within(lists, found: Windows, w, place, reach, low, high):
    """Whether some run of `reach` places, the given one among them, holds all of a window's terms between low and high."""
    import numpy as np

    good = np.zeros(len(w), bool)
    kinds = np.diff(found.kind_first)
    for back in range(int(reach.max())):
        left = np.flatnonzero(~good & (reach > back) & (place - back >= low))
        k = 0
        while len(left) and (more := kinds[w[left]] > k).any():
            own = left[more]
            at, start = found.kind_first[w[own]] + k, place[own] - back
            base = found.kind[at] << 40
            i = np.searchsorted(lists, base + start) + found.often[at] - 1
            there = i < len(lists)
            there[there] = lists[i[there]] < (base + np.minimum(start + reach[own], high[own]))[there]
            stays = ~more
            stays[more] = there
            left, k = left[stays], k + 1
        good[left] = True
    return good


def _parts(many) -> Iterator:
    """Windows with starts, in runs of about STARTS starts."""
    import numpy as np

    there = np.flatnonzero(many)
    runs = np.cumsum(many[there]) // STARTS
    return (there[runs == r] for r in np.unique(runs))


def merged(item, start, stop):
    """The runs (item, start, stop) that places of one item make; an item's are given with stops in the order of their starts."""
    import numpy as np

    order = np.lexsort((start, item))
    item, start, stop = item[order], start[order], stop[order]
    fresh = np.ones(len(item), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (start[1:] > stop[:-1])
    return item[fresh], start[fresh], stop[np.append(fresh[1:], True)[: len(item)]]


def _match(index: DataFrame, listed: list[list[bytes]], owners: list[list[int]], with_near: bool) -> DataFrame:
    """(segment, slot, item, start, stop, exact) of a block of windows, slot being a document of the segment and item a number of owners:
    runs of its words that exact matches cover, and single words, of the rarest terms, of proximity matches."""
    spark = index.sparkSession
    terms = spark.sparkContext.broadcast({t for w in listed for t in w})  # of one block
    counts = {bytes(r["term"]): r["n"] for r in term_counts(index, terms).collect()}
    sent = spark.sparkContext.broadcast(Windows(listed, owners, counts))

    def match(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        block, names = sent.value, ["segment", "slot", "item", "start", "stop", "exact"]
        for batch in batches:
            for segment, first, words, begins, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = np.append(postings.unpack(begins), len(places))
                lists = [np.empty(0, np.int64)]
                for i, t in enumerate(words.split()):
                    if (number := block.number.get(t)) is not None:
                        lists.append((number << 40) + np.cumsum(postings.unpack(places[ends[i] : ends[i + 1]])))
                keys, first, parts = np.sort(np.concatenate(lists)), np.array(first), []
                if not len(keys):
                    continue
                kinds = [(True, [(w, s, s + block.size[w]) for w, s in phrases(keys, block)]), (False, [(w, p, p + 1) for w, p in near(keys, block, first)] if with_near else [])]
                for exact, found in kinds:
                    for w, start, stop in found:
                        many = np.diff(block.owner_first)[w]
                        item = block.owner[np.repeat(block.owner_first[w] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
                        parts.append((*merged(item, np.repeat(start, many), np.repeat(stop, many)), exact))
                for item, start, stop, exact in parts:
                    slot = np.searchsorted(first, start, side="right") - 1
                    columns = [np.full(len(item), segment), slot, item, start - first[slot], stop - first[slot]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([exact] * len(item), pa.bool_())], names=names)

    return index.select("segment", "first", "terms", "begins", "places").mapInArrow(match, "segment long, slot long, item long, start long, stop long, exact boolean")


def contaminated(docs: DataFrame, items: DataFrame, words: int = WINDOW, with_near: bool = True, block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_words, n_hit, item_ids, near_ids) of docs (doc_id, text), and the matches they come from:
    (segment, slot, item_id, start, stop, exact), starts and stops being those of the document's words. items: (item_id, text)."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    index = shared.cut(post(docs), "postings")
    asked = shared.cut(windows(items, words).where("item_id IS NOT NULL").distinct(), "windows")
    blocks = max(1, -(-asked.count() // block_windows))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)))
    matches = spark.createDataFrame([], f"segment long, slot long, item_id {kind}, start long, stop long, exact boolean")
    for b in range(blocks):
        own = numbered.where(F.col("block") == b).select("terms", "item_id").collect()  # about block_windows rows
        if own:
            ids = sorted({r["item_id"] for r in own})
            at, owners = {i: k for k, i in enumerate(ids)}, defaultdict(list)
            for r in own:
                owners[tuple(t.encode() for t in r["terms"])].append(at[r["item_id"]])
            named = F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind}"))  # of one block
            found = _match(index, [list(w) for w in owners], list(owners.values()), with_near).join(named, "item")
            matches = matches.unionByName(shared.cut(found.select(*matches.columns), "matches"))
    document = Window.partitionBy("segment", "slot")
    before = document.orderBy(F.col("exact").desc(), "start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("exact"), F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0)))))
    sums = matches.withColumn("fresh", fresh).groupBy("segment", "slot").agg(
        F.sum("fresh").alias("n_hit"), F.collect_set(F.when(F.col("exact"), F.col("item_id"))).alias("item_ids"), F.collect_set(F.when(~F.col("exact"), F.col("item_id"))).alias("near_ids")
    )
    documents = index.select("segment", F.posexplode(F.arrays_zip("ids", "sizes")).alias("slot", "d")).select("segment", F.col("slot").cast("long").alias("slot"), F.col("d.ids").alias("doc_id"), F.col("d.sizes").alias("n_words"))
    rows = documents.join(sums, ["segment", "slot"], "left")
    none = F.array().cast(f"array<{kind}>")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("near_ids", none).alias("near_ids")), matches


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the words of every document that stand in a window of a benchmark item."""
    rows, _ = contaminated(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    named = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near_ids").cast("long").alias("n_near"),
    )
