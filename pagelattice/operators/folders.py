"""Folder trees of any depth, with or without cycles, by doubling of pointers: each round joins twice the distance.

A round is a join of the pointers with themselves, written below the shared folder so that the plan doesn't grow; a tree of depth n
takes about log2(n) rounds. A folder whose parent isn't there is a root. The table may hold cycles, since nothing that writes
it forbids them; a row with a null id is left out, and of rows with one id the one with the least parent counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = store.run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pointers(folders: DataFrame) -> DataFrame:
    """(id, at): each folder's parent, null for a root."""
    own = folders.where("id IS NOT NULL").groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    there = own.select(F.col("id").alias("parent_id"), F.col("id").alias("at"))
    return own.join(there, "parent_id", "left").select("id", "at")


def placed(folders: DataFrame) -> DataFrame:
    """(id, root, depth, in_cycle): the top folder above each one and how far up it is; both null on a cycle and below one."""
    start = pointers(folders)
    now = _kept(start.select("id", F.coalesce("at", "id").alias("at"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("at").isNull().alias("done")), "placed")
    n, reach = now.count(), 1
    while reach < 2 * n and not now.where("NOT done").isEmpty():
        next_ = now.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        moved = now.where("NOT done").join(next_, "at").select("id", F.col("further").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"))
        now, reach = _kept(now.where("done").unionByName(moved), "placed"), 2 * reach
    # all that still moves has gone further than there are folders, so it stands on a cycle, and every folder of a cycle is stood on
    on = now.where("NOT done").select(F.col("at").alias("id"), F.lit(True).alias("on")).distinct()
    out = now.join(on, "id", "left")
    return out.select("id", F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("steps")).alias("depth"), F.coalesce("on", F.lit(False)).alias("in_cycle"))


def under(folders: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): the folders of ids that are there, and all that lie below them."""
    hit = ids.select("id", F.lit(True).alias("hit")).distinct()
    now = _kept(pointers(folders).join(hit, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "under")
    n, reach = now.count(), 1
    while reach <= n and not now.where("NOT hit AND at IS NOT NULL").isEmpty():
        open_ = F.col("at").isNotNull() & ~F.col("hit")
        next_ = now.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("hit").alias("above"))
        moved = now.where(open_).join(next_, "at").select("id", F.col("further").alias("at"), F.col("above").alias("hit"))
        now, reach = _kept(now.where(~open_).unionByName(moved), "under"), 2 * reach
    return now.where("hit").select("id")


def tree(folders: DataFrame) -> DataFrame:
    """(root, id, level): every folder under itself and each folder above it, with the least distance; as many rows as that is."""
    jump = _kept(pointers(folders).where("at IS NOT NULL"), "jump")
    above = _kept(pointers(folders).select(F.col("id").alias("root"), "id", F.lit(0).cast("long").alias("level")), "tree")
    n, reach = above.count(), 1
    while reach <= n and not jump.isEmpty():
        further = above.join(jump.select(F.col("id").alias("root"), "at"), "root").select(F.col("at").alias("root"), "id", (F.col("level") + reach).alias("level"))
        # without cycles the distances differ, and nothing is found twice
        above = _kept(above.unionByName(further).groupBy("root", "id").agg(F.min("level").alias("level")), "tree")
        jump = _kept(jump.join(jump.select(F.col("id").alias("at"), F.col("at").alias("further")), "at").select("id", F.col("further").alias("at")), "jump")
        reach *= 2
    return above
