"""The incremental operators over a finished table; `live` runs them as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sessions that stay after one is registered; the cache is cut below its cap of 200.
CAP = 200
KEPT = CAP - 1


def newest_sessions(sessions: DataFrame, kept: int = KEPT) -> DataFrame:
    """(session_id, ts): the sessions touched last; what a cache that only keeps the newest holds in the end."""
    return sessions.groupBy("session_id").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), F.desc("session_id")).limit(kept)


def ndjson(blocks: DataFrame) -> DataFrame:
    """(page_id, seq, line): one JSON line a block in reading order; a failed block is a line with its error."""
    order = Window.partitionBy("page_id").orderBy("reading_order", "block_id")
    return blocks.withColumn("seq", F.row_number().over(order) - 1).select("page_id", "seq", F.to_json(F.struct("block_id", "label", "blocks", "error")).alias("line"))
