"""Event-time windows and incremental consensus."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; zone-less ones are taken as UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """(start, keys, n, total) per window; later than ``late`` behind is dropped in a stream."""
    return _windowed(events, F.window(ts, width), late, keys, value, ts)


def sliding(events: DataFrame, width: str, step: str, late: str, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    return _windowed(events, F.window(ts, width, step), late, keys, value, ts)


def sessions(events: DataFrame, gap: str, late: str, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    return _windowed(events, F.session_window(ts, gap), late, keys, value, ts)


def _windowed(events: DataFrame, window, late: str, keys: list[str], value: str, ts: str) -> DataFrame:
    rows = event_time(events, ts).withWatermark(ts, late)
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def incremental_consensus(observations: DataFrame, gid: str = "gid", weight: str = "weight", value: str = "value") -> DataFrame:
    """(gid, w, s): mergeable sums; as a stream in update mode, late views are harmless."""
    return observations.groupBy(gid).agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(value)).alias("s"))


def merge_into(batch: DataFrame, state: DataFrame | None, gid: str = "gid") -> DataFrame:
    """State after a micro-batch, for ``foreachBatch``: sums of partial sums."""
    rows = batch if state is None else state.unionByName(batch)
    return rows.groupBy(gid).agg(F.sum("w").alias("w"), F.sum("s").alias("s"))


def run_to_memory(stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Drives a stream over what is there now; for tests."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def last_node_stream(dominant: DataFrame, gid: str = "gid") -> DataFrame:
    """(gid, a, b): the online form of last-node links. Each row (gid, view, node) of the stream
    is linked with the node that the point had in its view before; a point's state is that
    view and node alone. Views that come late, or again, link nothing and change nothing."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        view, node = state.get if state.exists else (None, None)
        links = []
        for v, n in sorted((int(v), int(n)) for f in frames for v, n in zip(f["view"], f["node"], strict=True)):
            if view is not None and v <= view:
                continue
            if node is not None:
                links.append((key[0], node, n))
            view, node = v, n
        if view is not None:
            state.update((view, node))
        yield pd.DataFrame(links, columns=[gid, "a", "b"])

    return dominant.select(gid, "view", "node").groupBy(gid).applyInPandasWithState(run, f"{gid} bigint, a bigint, b bigint", "view bigint, node bigint", "append", GroupStateTimeout.NoTimeout)
