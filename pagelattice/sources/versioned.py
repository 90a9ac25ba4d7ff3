"""The page table as versions over Parquet: a change log, buckets of documents rewritten copy-on-write, manifests readers follow.

A version is a manifest, a file written once, that names a map: for each bucket of documents the save that wrote it last. A save
first adds its change to the log; then the buckets that the pending changes touch are read, merged and written to a folder of its own, sorted by
bucket, and a new map gives it these buckets and the saves before all others. Readers take of each folder the buckets that the map gives it.
What a manifest names is never changed, so a reader keeps seeing the version it began with, and a save that is cut short
leaves the last version and its change in the log: the next merge takes it up. Of merges that run at once one commits; the
others find the change done.

Buckets stay in tables: the map is joined, never collected. Files follow the amount of data and not the number of buckets. A row for
each save that a version still reads passes the driver.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mutations import PAGE_KEY, upsert_pages
from . import store

#: Documents in a bucket, by ranges of whole-numbered ids; buckets that other ids are dealt to; buckets at which a span is taken for a mistake.
SPAN, HASHED, MOST_BUCKETS = 256, 1024, 1 << 31
#: Ranges of touched buckets by which a merge skips what it needn't read.
RANGES = 64
MAP = "bucket long, made string"


class PageTable:
    """Pages, with one row for each (document_id, page_number), below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    # --- versions ---

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in store.names(self.spark, f"{self.root}/manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(store.read_text(self.spark, f"{self.root}/manifest/{version or max(self.versions()):012}.json"))

    def _commit(self, manifest: dict) -> bool:
        if manifest["buckets"] > MOST_BUCKETS:
            raise ValueError(f"more than {MOST_BUCKETS} buckets: create the table with a greater span")
        return store.put_once(self.spark, f"{self.root}/manifest/{manifest['version']:012}.json", json.dumps(manifest))

    def _bucket(self, span: int, rows: DataFrame) -> Column:
        key = F.col("document_id")
        whole = isinstance(rows.schema["document_id"].dataType, T.IntegralType)
        return F.floor(key / span).cast("long") if whole else F.pmod(F.xxhash64(key), F.lit(HASHED))

    def _write(self, rows: DataFrame, span: int, before: DataFrame | None = None) -> dict:
        """Rows in a new folder, and a map with their buckets and those of the map before that they don't replace; nothing names either yet."""
        made, at = uuid.uuid4().hex, f"maps/{uuid.uuid4().hex}"
        folder = f"{self.root}/data/made={made}"
        rows.withColumn("bucket", self._bucket(span, rows)).repartition("bucket").sortWithinPartitions("bucket").write.parquet(folder)
        new = self.spark.read.schema("bucket long").parquet(folder).distinct().withColumn("made", F.lit(made))
        (new if before is None else before.join(new, "bucket", "left_anti").unionByName(new)).write.parquet(f"{self.root}/{at}")
        counts = {r["made"]: r["count"] for r in self._map({"map": at}).groupBy("made").count().collect()}  # saves, not buckets
        return {"map": at, "made": sorted(counts), "buckets": sum(counts.values()), "rewritten": counts.get(made, 0), "own": made}

    def _map(self, manifest: dict) -> DataFrame:
        return self.spark.read.schema(MAP).parquet(f"{self.root}/{manifest['map']}")

    @staticmethod
    def _near(touched: DataFrame) -> Column:
        """A condition on bucket that Parquet files skip by: at most RANGES ranges with all touched buckets."""
        least, most = touched.agg(F.min("bucket"), F.max("bucket")).first()
        if least is None:
            return F.lit(False)
        width = (most - least) // RANGES + 1
        ends = touched.groupBy(F.floor((F.col("bucket") - least) / width)).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).collect()  # RANGES rows at most
        return reduce(or_, (F.col("bucket").between(r["a"], r["b"]) for r in ends))

    def _read(self, manifest: dict, touched: DataFrame | None = None) -> DataFrame:
        """The pages of a manifest, of touched buckets (bucket) only if they are given."""
        schema = T.StructType.fromJson(manifest["schema"])
        if not manifest["made"]:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField("bucket", T.LongType()), T.StructField("made", T.StringType())])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.root}/data").parquet(*(f"{self.root}/data/made={m}" for m in manifest["made"]))
        live = self._map(manifest)
        if touched is not None:
            rows, live = rows.where(self._near(touched)), live.join(touched, "bucket", "left_semi")
        elif len(manifest["made"]) == 1:
            return rows.select(*schema.names)  # nothing in the only folder is replaced
        return rows.join(live, ["bucket", "made"], "left_semi").select(*schema.names)

    # --- what users call ---

    def create(self, pages: DataFrame, span: int = SPAN) -> int:
        """Version 1 of rows with different keys; rows without a whole key are left out."""
        kept = pages.where("document_id IS NOT NULL AND page_number IS NOT NULL")
        manifest = {"version": 1, "log": 0, "span": span, "schema": json.loads(pages.schema.json())}
        if not self._commit(manifest | self._write(kept, span)):
            raise FileExistsError(f"{self.root} has versions already")
        return 1

    def read(self, version: int | None = None, pending: bool = False) -> DataFrame:
        """The pages of a version, the newest if none is named; pending: with the changes that only the log has."""
        manifest = self.manifest(version)
        pages = self._read(manifest)
        change = self._pending(manifest)[0] if pending else None
        return upsert_pages(pages, change, "place") if change is not None else pages

    def log(self, change: DataFrame, order: str | None = None) -> int:
        """Adds a change (see upsert_pages) to the log; its number. Rows of later changes follow those of earlier ones."""
        folder = f"log/{uuid.uuid4().hex}"
        change.withColumn("place", F.col(order).cast("long") if order else F.lit(0).cast("long")).write.parquet(f"{self.root}/{folder}")
        number = 1 + max([int(n.removesuffix(".json")) for n in store.names(self.spark, f"{self.root}/changes") if n.endswith(".json")], default=0)
        while not store.put_once(self.spark, f"{self.root}/changes/{number:012}.json", json.dumps({"folder": folder})):
            number += 1
        return number

    def _pending(self, manifest: dict) -> tuple[DataFrame | None, int]:
        """The changes that the log has beyond a manifest, and the number of the last one."""
        out, last = None, manifest["log"]
        for n in store.names(self.spark, f"{self.root}/changes"):
            number = int(n.removesuffix(".json")) if n.endswith(".json") else 0
            if number > manifest["log"]:
                own = self.spark.read.parquet(f"{self.root}/{json.loads(store.read_text(self.spark, f'{self.root}/changes/{n}'))['folder']}")
                # what a change doesn't state must stay unstated beside changes that do
                fields = F.col("fields") if "fields" in own.columns else F.filter(F.array(*(F.when(F.col(c).isNotNull(), c) for c in own.columns if c not in (*PAGE_KEY, "place"))), lambda c: c.isNotNull())
                own = own.withColumns({"fields": fields, "place": F.struct(F.lit(number).alias("change"), "place")})
                out, last = own if out is None else out.unionByName(own, allowMissingColumns=True), number
        return out, last

    def merge(self) -> int:
        """Writes the pending changes into a new version, rewriting the buckets they touch; the newest version."""
        while True:
            manifest = self.manifest()
            change, last = self._pending(manifest)
            if change is None:
                return manifest["version"]
            change = change.where("document_id IS NOT NULL AND page_number IS NOT NULL")
            touched = change.select(self._bucket(manifest["span"], change).alias("bucket")).distinct().cache()
            pages = upsert_pages(self._read(manifest, touched), change, "place")
            new = manifest | {"version": manifest["version"] + 1, "log": last} | self._write(pages, manifest["span"], self._map(manifest))
            touched.unpersist()
            if self._commit(new):
                return new["version"]
            for gone in (f"data/made={new['own']}", new["map"]):
                store.remove(self.spark, f"{self.root}/{gone}")  # another merge was first: look again

    def save(self, change: DataFrame, order: str | None = None) -> int:
        """Logs and merges a change; the version that has it."""
        self.log(change, order)
        return self.merge()

    def history(self) -> DataFrame:
        """(version, buckets, rewritten): for each version how many buckets it has and how many of them it wrote."""
        kept = [self.manifest(v) for v in self.versions()]
        return self.spark.createDataFrame([(m["version"], m["buckets"], m["rewritten"]) for m in kept], "version long, buckets long, rewritten long")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests before the last `keep` and folders and maps that none of these names; how many folders. No save may be running."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        for v in versions[:-keep]:
            store.remove(self.spark, f"{self.root}/manifest/{v:012}.json")
        gone = {}
        for kind, named in (("data", {f"made={m}" for k in kept for m in k["made"]}), ("maps", {k["map"].removeprefix("maps/") for k in kept})):
            gone[kind] = [n for n in store.names(self.spark, f"{self.root}/{kind}") if n not in named]
            for n in gone[kind]:
                store.remove(self.spark, f"{self.root}/{kind}/{n}")
        return len(gone["data"])
