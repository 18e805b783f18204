"""Shards hold every row once in shuffled order, sizes as array_split, and failed or repeated tasks leave nothing behind."""

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from spanloom.sources import shards


def lines(path):
    with open(path, "rb") as file:
        return [json.loads(x) for x in zstandard.ZstdDecompressor().stream_reader(file).read().decode().splitlines()]


@pytest.mark.parametrize(("rows", "n"), [(1003, 7), (5, 8), (0, 2)])
def test_round_trip(spark, tmp_path, rows, n):
    df = spark.range(rows).select(F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") % 3 > 0, F.lit("ACgtÉ")).alias("seq"))
    shards.write_zstd_shards(df.repartition(5), str(tmp_path / "out"), n, seed=3)
    files = sorted((tmp_path / "out").iterdir())
    assert [f.name for f in files] == [f"shard_{i:05d}.jsonl.zst" for i in range(n)]
    got = [lines(f) for f in files]
    assert [len(x) for x in got] == [len(x) for x in np.array_split(np.arange(rows), n)]
    flat = [x for own in got for x in own]
    assert sorted(x["id"] for x in flat) == sorted(f"r{i}" for i in range(rows)) and all(x["seq"] == ("ACgtÉ" if int(x["id"][1:]) % 3 else None) for x in flat)
    if rows > 100:
        assert [x["id"] for x in flat] != sorted(x["id"] for x in flat)
    shards.write_zstd_shards(df, f"file://{tmp_path}/again", n, seed=3)
    assert [lines(f) for f in sorted((tmp_path / "again").iterdir())] == got


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 777, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.lit("A")).alias("seq"))
    with pytest.raises(Exception, match="broken"):
        shards.write_zstd_shards(bad, str(tmp_path / "out"), 4, seed=1)
    assert not list(Path(tmp_path).rglob("*.zst")) and not list(Path(tmp_path).rglob("_writing*"))


def test_repeated_attempts(tmp_path):
    """A task that was killed half-way and run again, and one that ran twice: only what is committed appears."""
    writer = shards.ShardWriter(str(tmp_path), 3, 3)
    one, two = (pa.RecordBatch.from_pydict({"shard": pa.array(s, pa.int32()), "line": [f'{{"x":{i}}}' for i in range(len(s))]}) for s in ([0, 0, 2], [1]))

    def killed():
        yield one
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(killed())
    good, twice, other = writer.write(iter([one])), writer.write(iter([one])), writer.write(iter([two]))
    assert good.files != twice.files
    writer.commit([good, other, None])
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"shard_{i:05d}.jsonl.zst" for i in range(3)]
    assert [len(lines(p)) for p in sorted(tmp_path.iterdir())] == [2, 1, 1]
    half = shards.ShardWriter(str(tmp_path), 3, 3)
    half.write(iter([two]))
    half.abort([None])
    assert len(list(tmp_path.iterdir())) == 3
