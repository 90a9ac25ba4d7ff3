"""The incremental operators as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.mutations import append
from .batch import CAP, KEPT


def ndjson_stream(blocks: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each arriving block as a JSON line; a failed block is a line with its error."""
    return blocks.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class Newest(StatefulProcessor):
    """Keeps the sessions touched last, one under the cap after each registration; emits the ones it holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "session_id string", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = {k[0]: v[0] for k, v in self.held.iterator()}
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            if row.session_id not in now:
                while len(now) >= CAP:
                    now.pop(min(now, key=lambda s: (now[s], s)))
            now[row.session_id] = max(row.ts, now.get(row.session_id, row.ts))
        for k in sorted(now, key=lambda s: (now[s], s))[: max(0, len(now) - KEPT)]:
            now.pop(k)
        for k in [k[0] for k in self.held.keys()]:
            if k not in now:
                self.held.removeKey((k,))
        for k, v in now.items():
            self.held.updateValue((k,), (v.to_pydatetime() if hasattr(v, "to_pydatetime") else v,))
        yield pd.DataFrame({"session_id": list(now), "ts": list(now.values())})

    def close(self) -> None:
        pass


def newest_sessions_stream(sessions: DataFrame) -> DataFrame:
    """The cache as a stream (session_id, ts): all state lies under one key, which is sound for a cache of a fixed small cap."""
    keyed = sessions.select("session_id", "ts", F.lit(0).alias("one"))
    return keyed.groupBy("one").transformWithStateInPandas(Newest(), outputStructType="session_id string, ts timestamp", outputMode="Update", timeMode="None")


def log_activity(rows: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends activities to a Parquet log."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["Newest", "append", "log_activity", "ndjson_stream", "newest_sessions_stream"]
