"""Streams give what the same operators give of the whole input."""

import random

from pyspark.sql import functions as F

from spanloom import streaming
from spanloom.operators import interval_joins, intervals, signal


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(200).select(F.concat(F.lit("c"), F.col("id") % 3).alias("chrom"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 7).alias("end"), ((F.col("id") % 17) / 4.0).alias("value"))
    for part in (0, 1):
        rows.where(F.col("start") % 20 == part * 10).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(source)
    q = streaming.histogram_stream(stream, 0.0, 4.0, 8, "hist_table", str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("hist_table").collect()) == sorted(signal.histogram(rows, 0.0, 4.0, 8).collect())
    targets = spark.createDataFrame([("c0", 5, 400, "a"), ("c1", 0, 15, "b"), ("c2", 100, 9000, "d")], "chrom string, start long, end long, name string")
    q = streaming.annotate_stream(stream, targets, str(tmp_path / "out"), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    want = interval_joins.overlap_join(rows, targets)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(want.columns).collect()) == sorted(want.collect())


def test_islands(spark, tmp_path):
    """Any order within the slack gives the batch result, with a stop between; what comes too late is counted."""
    rng, slack, width = random.Random(3), 300, 500
    rows = []
    for chrom in ("a", "b"):
        at = 0
        for _ in range(250):
            at += rng.randint(0, 30)
            rows.append((chrom, at, at + rng.choice([1, 5, 20, 20, 700])))
    rows.sort(key=lambda r: r[1] + rng.randint(0, slack - 60))
    schema, source = "chrom string, start long, end long", str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    end = [("a", 10**6, 10**6 + 1)]

    def feed(own):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(source)
        q = streaming.islands_stream(stream, str(tmp_path / "out"), str(tmp_path / "c"), slack, width)
        q.processAllAvailable()
        dropped = streaming.late_rows(q)
        q.stop()
        return dropped

    for i in range(0, len(rows), 100):
        feed(rows[i : i + 100])
    assert 0 < streaming.read_islands(spark, str(tmp_path / "out")).count()
    feed(end)
    feed([("a", 10**6 + 1, 10**6 + 2)])  # a further batch sees the watermark
    assert feed([("b", 40, 60)]) == 1
    pieces = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(pieces) == len(set(pieces))
    assert sorted(streaming.read_islands(spark, str(tmp_path / "out")).collect()) == sorted(intervals.merge(spark.createDataFrame(rows, schema)).collect())
