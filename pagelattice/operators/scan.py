"""Ranks and running sums over a whole table, or within groups, that no task sees whole.

The rows are sorted by ranges of their order and written, each with its part and its place in it; the sums of the parts are added up,
a row a part, and what comes before a row is what comes before its part and within it. Parts are of equal size by the
sampled ranges, whatever the keys look like: sparse, clustered or all in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def _free(name: str, rows: DataFrame) -> str:
    while name in rows.columns:
        name += "_"
    return name


def scanned(rows: DataFrame, order: list[str], sums: dict[str, Column] | None = None, group: str | None = None, partitions: int | None = None) -> DataFrame:
    """rows with rank, from 1 in the order given (nulls first), and for each of sums its total over the rows before, whole numbers.

    Rows equal in all of `order` follow one another in any order. With a group, ranks and sums begin anew in each.
    """
    sums = sums or {}
    part, place, salt = (_free(c, rows) for c in ("scan_part", "scan_place", "scan_salt"))
    keys = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order] + [F.col(salt)]
    numbered = rows.withColumns({salt: F.monotonically_increasing_id(), **{f"{part}_{k}": c.cast("long") for k, c in sums.items()}})
    dealt = numbered.repartitionByRange(partitions, *keys) if partitions else numbered.repartitionByRange(*keys)
    placed = dealt.sortWithinPartitions(*keys).drop(salt).withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()})
    path = store.run_folder(rows.sparkSession, "scan")
    placed.write.parquet(path)
    kept = rows.sparkSession.read.schema(placed.schema).parquet(path)
    by = [group] if group else []
    inside = Window.partitionBy(part, *by).orderBy(place)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = {"rank": F.lit(1), **{k: F.col(f"{part}_{k}") for k in sums}}
    parts = kept.groupBy(part, *by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{k}") for k, c in totals.items()))
    bases = parts.select(F.col(part).alias("own_part"), *(F.col(c).alias("own_group") for c in by), *(F.coalesce(F.sum(f"all_{k}").over(before), F.lit(0)).alias(f"base_{k}") for k in totals))
    on = kept[part] == bases["own_part"]
    joined = kept.withColumns({f"in_{k}": F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1 if k != "rank" else 0)), F.lit(0)) for k, c in totals.items()})
    joined = joined.join(bases, on & joined[group].eqNullSafe(bases["own_group"]) if group else on)
    return joined.select(*rows.columns, *((F.col(f"base_{k}") + F.col(f"in_{k}")).alias(k) for k in totals))
