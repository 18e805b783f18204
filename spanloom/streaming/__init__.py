"""Structured Streaming forms of operators whose state is small: signal histograms, points annotated by fixed intervals, islands of intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import interval_joins, intervals, signal, tiles


def histogram_stream(track: DataFrame, low: float, high: float, n_bins: int, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the histogram of a streamed track (``chrom, start, end, value``) up to date as the in-memory table ``table``; the state is one row a bin.

    Start it again with the same ``checkpoint`` folder to go on after a failure."""
    counts = signal.histogram(track, low, high, n_bins)
    return counts.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).start()


def annotate_stream(points: DataFrame, targets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet the pairs of streamed intervals and the fixed ``targets`` that they overlap: an equi-join of bins without state."""
    pairs = interval_joins.overlap_join(points, targets)
    return pairs.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()


def _islands(width: int):
    def run(key: tuple[str, int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chrom, tile = key
        border = (int(tile) + 1) * width * 1000  # positions are event times in seconds
        if state.hasTimedOut:
            starts, ends = state.get
            state.remove()
            yield pd.DataFrame({"chrom": chrom, "start": list(starts), "end": list(ends)})
            return
        rows = pd.concat(list(batches))
        spans = sorted([*(zip(*state.get, strict=True) if state.exists else []), *zip(rows["start"].tolist(), rows["end"].tolist(), strict=True)])
        merged: list[list[int]] = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        state.update(([int(s) for s, _ in merged], [int(e) for _, e in merged]))
        state.setTimeoutTimestamp(border)

    return run


def islands_stream(rows: DataFrame, path: str, checkpoint: str, slack: int, width: int = tiles.TILE) -> StreamingQuery:
    """Append to Parquet the islands of streamed intervals ``chrom, start, end`` (start at 0 or more, end behind it).

    The position is the event time: once a start has been seen that lies more than ``slack`` bases behind the end of a tile of ``width`` bases, on any chromosome,
    the tile's islands are given out, cut at its borders, and its state goes. What comes later for it is left out, and ``late_rows`` of the query's
    progress tells how much. The state of a (chromosome, tile) holds its merged pieces, so it is as small as its islands are few. Read the result by
    ``read_islands``. Start it again with the same ``checkpoint`` folder to go on after a failure; no island is given out twice."""
    cut = tiles.cut_at_tiles(rows.where("`end` > start"), width)
    timed = cut.withColumn("_at", F.timestamp_seconds("start")).withWatermark("_at", f"{slack} seconds").select("chrom", "_tile", "start", "end", "_at")
    found = timed.groupBy("chrom", "_tile").applyInPandasWithState(_islands(width), "chrom string, start long, end long", "starts array<long>, ends array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()


def read_islands(spark: SparkSession, path: str) -> DataFrame:
    """Islands that ``islands_stream`` has given out, joined where tiles met."""
    return intervals.merge(spark.read.parquet(path).select("chrom", "start", "end"))


def late_rows(query: StreamingQuery) -> int:
    """Pieces that came after their tile was given out, over the progress that Spark still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
