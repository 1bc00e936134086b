"""Geofences on a stream of positions: state holds each point's last position, everything else is the batch operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.geofence import NEAREST, classify

COLUMNS = "move_id bigint, point_id bigint, ts timestamp, lat double, lon double, old_lat double, old_lon double"


def stepped(moves: DataFrame) -> DataFrame:
    """Streamed moves (move_id, point_id, ts, lat, lon) with the position before, across micro-batches. Within a batch the order is that of time, then move_id."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "move_id"], kind="stable")
        before = state.get if state.exists else (None, None)
        rows["old_lat"] = rows["lat"].shift(1).astype(float)
        rows["old_lon"] = rows["lon"].shift(1).astype(float)
        if before[0] is not None:
            rows.iloc[0, rows.columns.get_loc("old_lat")] = before[0]
            rows.iloc[0, rows.columns.get_loc("old_lon")] = before[1]
        state.update((float(rows["lat"].iloc[-1]), float(rows["lon"].iloc[-1])))
        yield rows[["move_id", "point_id", "ts", "lat", "lon", "old_lat", "old_lon"]]

    own = moves.select("move_id", "point_id", "ts", "lat", "lon")
    return own.groupBy("point_id").applyInPandasWithState(follow, COLUMNS, "lat double, lon double", "append", GroupStateTimeout.NoTimeout)


def watch(moves: DataFrame, circles: DataFrame, path: str, checkpoint: str, k: int = NEAREST) -> StreamingQuery:
    """Writes fence events of streamed moves to Parquet, one folder a micro-batch, so a repeated batch replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        classify(batch, circles, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stepped(moves).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
