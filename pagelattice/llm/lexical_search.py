"""Ranked lexical search with block-max pruning.

Documents are indexed in blocks of consecutive ones. A block is a forward index: for each of its documents the terms and how often
each occurs. Once the corpus is counted, the block also gets for each of its terms the number of documents that hold it and the greatest
score that it gives any of them, before the term's weight. The sum of a query's weighted maxima is the most a document of the block
can score.

A search reads the maxima alone first: the blocks with the highest bounds of each query are scored, and their 50th best score is
a threshold that no better block can lie under. Then each task goes through its blocks by their bound, scoring a query's blocks until the
bound drops below the threshold, which what it finds raises. Equal bounds are still scored, since equal scores are ordered by
id. Results of tasks are merged by rank. Queries go in blocks of a bounded size, which are sent to all tasks.

Scores are whole numbers below 2**53, so products of matrices of doubles give them exactly; where a query's bound isn't below that, they are
summed as integers.

Nulls and oddities: a null or empty text has no terms, isn't counted and never found; items of which no term is found in any document give no
rows; rows with equal ids, of either table, are told apart; equal scores are ordered by doc_id, null last; a very long text is
a block of its own; empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import postings, shared

MOST = 50
#: Documents and text bytes of a block.
BLOCK_DOCS, BLOCK_BYTES = 16, 1 << 20
#: Blocks of a query that are scored for its first threshold.
FIRST_BLOCKS = 32
#: Distinct terms of queries that are sent to all tasks at once, counted for each query, on average.
QUERY_TERMS = 200_000
#: Cells of a matrix of a block's terms and queries that is held at once.
CELLS = 1 << 22
#: Sums of doubles are exact below this.
EXACT = 1 << 53


def forward(docs: DataFrame) -> DataFrame:
    """Blocks of (doc_id, text): (block, ids, sizes, terms, entries, entry_terms, entry_counts).

    sizes: terms of each document with repeats; terms: the block's distinct terms, joined by spaces; entries: distinct terms of each
    document; then for each of these the term's number and how often it occurs, document after document, packed.
    """
    kind = docs.schema["doc_id"].dataType
    schema = f"block long, ids array<{kind.simpleString()}>, sizes array<long>, terms binary, entries binary, entry_terms binary, entry_counts binary"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        of = pa.list_(to_arrow_type(kind))
        for block, ids, texts in postings.segments(batches, BLOCK_BYTES, BLOCK_DOCS):
            seen: dict = defaultdict()
            seen.default_factory = seen.__len__
            numbers = [np.asarray(postings.number(postings.terms(t), seen), np.int64) for t in texts]
            sizes = np.array([len(n) for n in numbers], np.int64)
            pairs, counts = np.unique(np.concatenate(numbers) + np.repeat(np.arange(len(texts)) * len(seen), sizes), return_counts=True)
            entries = np.bincount(pairs // max(len(seen), 1), minlength=len(texts))
            blobs = [b" ".join(seen), *(postings.pack(x)[0] for x in (entries, pairs % max(len(seen), 1), counts))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([ids], of), pa.array([sizes.tolist()], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in blobs)],
                names=["block", "ids", "sizes", "terms", "entries", "entry_terms", "entry_counts"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def impacts(counts, sizes, n: int, length: int):
    """What a term's occurrences add to a document's score, before the term's weight; n documents with terms have `length` together."""
    import numpy as np

    m = np.array([50 + 50 * int(s) * n // length for s in sizes], np.int64) if length * 50 >= 1 << 31 or n >= 1 << 31 else 50 + 50 * sizes * n // length
    return 1_000_000_000 * counts // (1000 * counts + 20 * m)


def maxima(blocks: DataFrame, n: int, length: int) -> DataFrame:
    """Blocks with (holders, most): how many documents hold each of its terms, and the greatest impact, packed. Blocks without terms go."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, (sizes, entries, numbers, counts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("sizes", "entries", "entry_terms", "entry_counts")), strict=True)):
                entries, numbers, counts = (postings.unpack(x) for x in (entries, numbers, counts))
                if len(numbers):
                    gives = impacts(counts, np.repeat(np.array(sizes, np.int64), entries), n, length)
                    holding = np.bincount(numbers)
                    most = np.maximum.reduceat(gives[np.argsort(numbers, kind="stable")], np.cumsum(holding) - holding)
                    blobs = [pa.array([postings.pack(x)[0]], pa.binary()) for x in (holding, most)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *blobs], names=names)

    names = [*blocks.columns, "holders", "most"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema)
    return blocks.mapInArrow(run, f"{kinds}, holders binary, most binary")


def holders(blocks: DataFrame, wanted) -> DataFrame:
    """(term, df) of blocks with maxima, for the terms of a bounded set, sent to all tasks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict = defaultdict(int)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = postings.unpack(counts)
                for i, t in enumerate(terms.split()):
                    if t in wanted.value:
                        total[t] += int(n[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

    return blocks.select("terms", "holders").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Queries:
    """A block of queries: their distinct terms as numbers of the block's terms, with weights, query after query."""

    def __init__(self, queries: list[list[bytes]], frequency: dict[bytes, int], n: int) -> None:
        import numpy as np

        self.number = {t: i for i, t in enumerate(sorted(frequency))}
        weight = np.zeros(len(self.number) + 1, np.int64)
        for t, df in frequency.items():
            weight[self.number[t]] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        listed = [sorted({self.number[t] for t in q if t in self.number}) for q in queries]
        self.size = np.array([len(q) for q in listed], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.term = np.array([t for q in listed for t in q], np.int64)
        self.weight = weight[self.term]

    def known(self, terms: bytes):
        """Which of a block's terms are terms of queries, by their places, and their numbers."""
        import numpy as np

        found = [(i, self.number[t]) for i, t in enumerate(terms.split()) if t in self.number]
        return np.array(found, np.int64).reshape(-1, 2).T

    def bounds(self, terms: bytes, most):
        """The most that a document of a block can score, for each query."""
        import numpy as np

        at, number = self.known(terms)
        best = np.zeros(len(self.number), np.int64)
        best[number] = most[at]
        return np.bincount(np.repeat(np.arange(len(self.size)), self.size), self.weight * best[self.term], len(self.size)).astype(np.int64) if len(self.term) else self.size * 0

    def scores(self, active, known, doc, number, gives, n_docs: int, exact: bool):
        """Scores (documents x active queries) of a block's entries: their documents, terms (numbers of the block) and impacts."""
        import numpy as np

        at, own = known
        column = np.full(int(max(number.max(initial=0), at.max(initial=0))) + 1, -1)
        column[at] = np.arange(len(at))
        there = column[number] >= 0
        kind = np.int64 if exact else np.float64
        left = np.zeros((n_docs, len(at)), kind)
        left[doc[there], column[number[there]]] = gives[there]
        place = np.full(len(self.number) + 1, -1)
        place[own] = np.arange(len(at))
        right = np.zeros((len(at), len(active)), kind)
        many = self.size[active]
        terms = np.repeat(self.first[active] - np.cumsum(many) + many, many) + np.arange(many.sum())
        row, col = place[self.term[terms]], np.repeat(np.arange(len(active)), many)
        right[row[row >= 0], col[row >= 0]] = self.weight[terms[row >= 0]]
        return (left @ right).astype(np.int64)


def _top_bounds(blocks: DataFrame, sent, most: int) -> DataFrame:
    """(query, block, bound): each query's blocks with the highest bounds."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        q = sent.value
        for batch in batches:
            rows = [q.bounds(terms, postings.unpack(m)) for terms, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            bounds, numbers = np.array(rows).reshape(len(rows), -1), batch.column(0).to_numpy()
            for best in np.argsort(-bounds, axis=0, kind="stable")[:most]:  # the k-th best block of each query
                value = bounds[best, np.arange(bounds.shape[1])]
                there = np.flatnonzero(value > 0)
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(numbers[best[there]], pa.int64()), pa.array(value[there], pa.int64())], names=["query", "block", "bound"])

    found = blocks.select("block", "terms", "most").mapInArrow(run, "query long, block long, bound long")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def _scored(blocks: DataFrame, sent, thresholds, only, n: int, length: int, most: int) -> DataFrame:
    """(query, doc_id, score) of the best documents of each query in each task, none below the query's threshold.

    only: if given, a set of blocks for each query, the ones to score. Blocks come with their maxima (column most).
    """
    kind = blocks.schema["ids"].dataType.elementType

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        q, least = sent.value, thresholds.value.copy()
        wanted = only.value if only is not None else None
        best: list = [([], []) for _ in least]
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            bounds = np.array([q.bounds(r[3], postings.unpack(r[7])) for r in rows]).reshape(len(rows), -1)
            for i in np.argsort(-bounds.max(axis=1, initial=0), kind="stable"):
                block, ids, sizes, terms, entries, numbers, counts, _ = rows[i]
                active = np.flatnonzero((bounds[i] > 0) & (bounds[i] >= least))
                if wanted is not None:
                    active = np.array([a for a in active if block in wanted.get(int(a), ())], np.int64)
                if not len(active):
                    continue
                entries, numbers, counts = (postings.unpack(x) for x in (entries, numbers, counts))
                gives = impacts(counts, np.repeat(np.array(sizes, np.int64), entries), n, length)
                known, doc = q.known(terms), np.repeat(np.arange(len(ids)), entries)
                step = max(1, CELLS // max(len(known[0]), 1))
                for a, points_of in ((a, p) for k in range(0, len(active), step) for a, p in zip(active[k : k + step], q.scores(active[k : k + step], known, doc, numbers, gives, len(ids), bool((bounds[i][active] >= EXACT).any())).T, strict=True)):
                    good = np.flatnonzero((points_of > 0) & (points_of >= least[a]))
                    if len(good):
                        own, points = [*best[a][0], *(ids[g] for g in good)], [*best[a][1], *points_of[good].tolist()]
                        order = sorted(range(len(own)), key=lambda x: (-points[x], own[x] is None, own[x]))[:most]
                        best[a] = [own[x] for x in order], [points[x] for x in order]
                        if len(order) == most:
                            least[a] = max(least[a], best[a][1][-1])
        columns = [[a for a, b in enumerate(best) for _ in b[0]], [x for b in best for x in b[0]], [x for b in best for x in b[1]]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], to_arrow_type(kind)), pa.array(columns[2], pa.int64())], names=["query", "doc_id", "score"])

    return blocks.select("block", "ids", "sizes", "terms", "entries", "entry_terms", "entry_counts", "most").mapInArrow(run, f"query long, doc_id {kind.simpleString()}, score long")


def _best(scored: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


class Index:
    """A corpus indexed for search: tables in the shared folder, and the counts N and L."""

    def __init__(self, docs: DataFrame) -> None:
        counted = shared.cut(forward(docs), "forward")
        sizes = counted.select(F.explode("sizes").alias("s")).where("s > 0").agg(F.count("*").alias("n"), F.sum("s").alias("length")).first()
        self.n, self.length = sizes["n"], sizes["length"] or 0
        self.blocks = shared.cut(maxima(counted, self.n, max(self.length, 1)), "blocks")
        shared.forget(counted)

    def search(self, queries: list[list[bytes]], most: int = MOST, first: int = FIRST_BLOCKS) -> DataFrame:
        """(query, doc_id, score, rank): the best documents of a block of queries, each given by its terms."""
        import numpy as np

        context = self.blocks.sparkSession.sparkContext
        terms = context.broadcast({t for q in queries for t in q})
        frequency = {bytes(r["term"]): r["df"] for r in holders(self.blocks, terms).collect()}
        sent = context.broadcast(Queries(queries, frequency, self.n))
        only = defaultdict(set)
        for r in _top_bounds(self.blocks, sent, first).collect():  # FIRST_BLOCKS for each query of a bounded block
            only[r["query"]].add(r["block"])
        started = context.broadcast(dict(only))
        named = self.blocks.sparkSession.createDataFrame([(b,) for b in sorted(set().union(*only.values()))], "block long")
        seeds = _scored(self.blocks.join(F.broadcast(named), "block", "left_semi"), sent, context.broadcast(np.zeros(len(queries), np.int64)), started, self.n, self.length, most)
        least = np.zeros(len(queries), np.int64)
        for r in _best(seeds, most).where(F.col("rank") == most).collect():
            least[r["query"]] = r["score"]
        return _best(_scored(self.blocks, sent, context.broadcast(least), None, self.n, self.length, most), most)


def search(docs: DataFrame, items: DataFrame, most: int = MOST, query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id, text) the best of docs (doc_id, text), at most so many."""
    spark = docs.sparkSession
    found = F.regexp_extract_all(shared.lower_ascii(F.col("text")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    asked = items.select("item_id", F.array_distinct(found).alias("terms")).where(F.size("terms") > 0)
    asked = shared.cut(asked.withColumn("number", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // query_terms))
    numbered = asked.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    kind, id_kind = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    index, out = None, spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {id_kind}, score long")
    for b in range(blocks):
        own = numbered.where(F.col("part") == b).select("item_id", "terms").collect()  # about query_terms terms
        if own:
            index = index or Index(docs)
            names = F.broadcast(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"query long, item_id {kind}"))  # of one block
            best = index.search([[t.encode() for t in r["terms"]] for r in own], most)
            out = out.unionByName(best.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: each benchmark item's best documents."""
    return search(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents),
g AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) GROUP BY k, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, g),
m AS (SELECT k, doc_id, 50 + (50 * len(t) * n) // l AS m FROM d, g WHERE len(t) > 0),
b AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS t FROM benchmark),
s AS (SELECT q, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM (SELECT q, item_id, unnest(t) AS term FROM b) JOIN w USING (term) JOIN p USING (term) JOIN m USING (k) GROUP BY q, k),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= {MOST}"""
