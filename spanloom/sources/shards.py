"""A sink for shards of text lines, compressed by zstd in the tasks themselves, so no native Hadoop library is needed.

Each task attempt streams its shards to files under a name of its own in a hidden folder beside the shards; the driver moves the files of
the attempts that were committed to their final names and deletes the rest. A task that is killed, repeated or run twice leaves nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import RecordBatch, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.sequence import with_reverse_complements
from ..operators.sampling import with_shard


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The files of one task attempt: shard, file and lines of each."""

    files: list[tuple[int, str, int]]


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, shards: int, level: int) -> None:
        self.path, self.shards, self.level, self.hidden = path.rstrip("/"), shards, level, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[RecordBatch]) -> Written:
        import zstandard

        store, path = _store(self.path)
        folder = f"{path}/{self.hidden}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        written: list[tuple[int, str, int]] = []
        shard = out = file = None

        def close() -> None:
            if out is not None:
                out.close()
                file.close()

        try:
            for batch in iterator:
                shards, lines = batch.column("shard").to_pylist(), batch.column("line").to_pylist()
                for own, line in zip(shards, lines, strict=True):
                    if own != shard:  # rows come sorted by shard, so each is one frame
                        close()
                        shard, name = own, f"{folder}/{own}"
                        file = store.open_output_stream(name, compression=None)
                        out = zstandard.ZstdCompressor(self.level).stream_writer(file, closefd=False)
                        written.append((own, name, 0))
                    out.write(line.encode() + b"\n")
                    written[-1] = (*written[-1][:2], written[-1][2] + 1)
        finally:
            close()
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        import zstandard

        store, path = _store(self.path)
        there = {}
        for m in messages:
            for shard, name, _ in m.files if m else []:
                if shard in there:
                    raise ValueError(f"shard {shard} comes from two tasks")
                there[shard] = name
        for shard in range(self.shards):
            final = f"{path}/shard_{shard:05d}.jsonl.zst"
            if shard in there:
                store.move(there[shard], final)
            else:
                with store.open_output_stream(final, compression=None) as file:
                    zstandard.ZstdCompressor(self.level).stream_writer(file, closefd=False).close()
        store.delete_dir(f"{path}/{self.hidden}")

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        if store.get_file_info(f"{path}/{self.hidden}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.hidden}")


class Shards(DataSource):
    """``df.write.format("zstd_shards")`` of columns ``shard`` (int) and ``line``, sorted by shard in each partition, a shard whole in one of them."""

    @classmethod
    def name(cls) -> str:
        return "zstd_shards"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options["shards"]), int(self.options.get("level", 3)))


def write_zstd_shards(df: DataFrame, path: str, n: int, seed: int, add_rc: bool = False, key: str = "id", level: int = 3) -> None:
    """``df`` as ``n`` shuffled shards ``shard_00000.jsonl.zst``, ..., of even size as ``numpy.array_split`` cuts them; with ``add_rc`` every ``id, seq`` row also
    reverse-complemented. A shard is one task's, streamed line by line. ``path``: a shared folder or a URI that Arrow opens; shards of the same name there
    are replaced."""
    df.sparkSession.dataSource.register(Shards)
    placed = with_shard(with_reverse_complements(df) if add_rc else df, n, seed, key)
    columns = [c for c in placed.columns if c not in ("shard", "place")]
    lines = placed.select("shard", "place", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))
    lines = lines.repartition(n, "shard").sortWithinPartitions("shard", "place").select("shard", "line")
    lines.write.format("zstd_shards").option("path", path).option("shards", n).option("level", level).mode("append").save()
