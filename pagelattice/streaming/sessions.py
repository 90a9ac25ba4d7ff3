"""The session cache as a stream in two levels: each share of the sessions keeps its newest, and these are merged."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .batch import KEPT, newest_sessions
from .pages import ROCKS

SESSION = "session_id string, ts timestamp"
#: Shares that sessions are dealt to by their id.
SHARES = 64


class NewestOfShare(StatefulProcessor):
    """A share's newest sessions, KEPT at most, and no more state than that.

    A session that falls out of its share was touched before KEPT others of it, which can only have been touched later since, so it
    isn't among the newest of all either until it is touched again. So the order of arrival doesn't matter.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "sessions string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = dict(json.loads(self.held.get()[0])) if self.held.exists() else {}
        for row in rows:
            now[row["session_id"]] = max(row["us"], now.get(row["session_id"], row["us"]))
        kept = sorted(now.items(), key=lambda s: (s[1], s[0].encode()), reverse=True)[:KEPT]
        self.held.update((json.dumps(kept),))
        for session, us in kept:
            yield Row(share=key[0], session_id=session, us=us)

    def close(self) -> None:
        pass


def newest_of_shares(sessions: DataFrame, shares: int = SHARES) -> DataFrame:
    """The stream (share, session_id, us) of what the shares that a batch touches hold after it, of a stream (session_id, ts)."""
    rows = sessions.where("session_id IS NOT NULL AND ts IS NOT NULL").select(F.pmod(F.xxhash64("session_id"), F.lit(shares)).alias("share"), "session_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("share").transformWithState(NewestOfShare(), outputStructType="share long, session_id string, us long", outputMode="Update", timeMode="None")


def fold_files(spark: SparkSession, source: str, target: str, checkpoint: str, files_in_batch: int = 1, shares: int = SHARES) -> None:
    """Feeds the Parquet files (session_id, ts) of a folder batch by batch; goes on where it ended before."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    rows = own.readStream.schema(SESSION).option("maxFilesPerTrigger", files_in_batch).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    newest_of_shares(rows, shares).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(spark: SparkSession, target: str) -> DataFrame:
    """(session_id, ts): the newest of all, from what each share held last, SHARES * KEPT rows at most."""
    rows = spark.read.schema("share long, session_id string, us long, batch long").parquet(target)
    last = rows.groupBy("share").agg(F.max("batch").alias("batch"))
    return newest_sessions(rows.join(last, ["share", "batch"]).select("session_id", F.timestamp_micros("us").alias("ts")))
