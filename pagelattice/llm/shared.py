"""What the corpus operators share: table reads, cut lineage, slices of Arrow batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes of an Arrow batch that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a local session may leave it unset: it gets a temporary folder, which the setting then names. On a cluster that
    is an error, since executors would write where others can't read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='pagelattice-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what stands there goes when the application ends."""
    path = f"{shared_dir(spark)}/pagelattice/{name}-{uuid.uuid4().hex}"
    files, at = _hadoop(spark, path)
    files.deleteOnExit(at)
    return path


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind when they have ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation of what is above."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with without_shuffle_files(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*cuts: DataFrame) -> None:
    """Delete the files behind cuts that nothing reads any more."""
    for df in cuts:
        files, at = _hadoop(df.sparkSession, df.cut_path)
        files.delete(at, True)


def slices(batches: Iterator, column: int) -> Iterator:
    """Arrow batches in slices whose texts, in the column of this number, hold about SLICE_BYTES or are one text."""
    import pyarrow.compute as pc

    for batch in batches:
        at = size = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if i > at and size + (n or 0) > SLICE_BYTES:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        yield batch.slice(at)


def private(name: str, *frames: DataFrame) -> str:
    """A column name that starts like `name` and that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(c: Column) -> Column:
    """Lower-case A to Z and leave every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edges_digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    edges has two long columns u and v. Large-star and small-star steps alternate until the edge set stands still; a
    node's neighbours are never gathered, only their minimum, so one hub may hold a third of all edges. Self-edges and
    repeated edges do no harm; rows with a null end are left out.
    """
    now = cut(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    seen = edges_digest(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # every edge of large runs from a node to a smaller one, which is what the small step needs
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        nxt = cut(small, "edges")
        digest = edges_digest(nxt)
        forget(now)
        now = nxt
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
