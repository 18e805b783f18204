"""bigWig tracks as a data source.

The driver reads a file's header, its chromosome tree and those nodes of its R-tree that filters on ``chrom``, ``start`` and ``end`` don't rule
out, and deals the blocks that are left to partitions of bounded size, in the order of the file. Tasks read runs of neighbouring blocks at
once, inflate them and give Arrow batches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .stores import opened, read_at

# Magic numbers of the file, its chromosome tree and its R-tree, and the kinds of data blocks.
FILE_MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BED_GRAPH, VARIABLE_STEP, FIXED_STEP = 1, 2, 3
SCHEMA = "chrom string, start long, end long, value double"
#: Compressed bytes of a partition, about, and of one read.
PARTITION_BYTES, READ_BYTES = 32 << 20, 4 << 20


@dataclass
class Bounds:
    """What filters leave: chromosomes (all if None) and runs that end after ``after`` and start before ``before``."""

    chroms: set[str] | None = None
    after: float = -1
    before: float = float("inf")

    def narrow(self, f: Filter) -> None:
        """Take in a filter as far as it prunes; others change nothing."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name == "chrom" and isinstance(f, (EqualTo, In)):
            own = set(f.value) if isinstance(f, In) else {f.value}
            self.chroms = own if self.chroms is None else self.chroms & own
        elif name == "start" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            self.before = min(self.before, f.value + (not isinstance(f, LessThan)))
        elif name == "start" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.after = max(self.after, f.value)  # a run that starts there ends behind it
        elif name == "end" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            self.after = max(self.after, f.value - (not isinstance(f, GreaterThan)))
        elif name == "end" and isinstance(f, (LessThan, LessThanOrEqual)):
            self.before = min(self.before, f.value)


class Track:
    """The structure of an open bigWig file."""

    def __init__(self, file) -> None:
        self.file = file
        head = read_at(file, 0, 64)
        self.order = next((o for o in "<>" if struct.unpack(f"{o}I", head[:4])[0] == FILE_MAGIC), None)
        if self.order is None:
            raise ValueError("not a bigWig file")
        _, _, _, self.tree_at, _, self.index_at, _, _, _, _, self.inflated, _ = self.unpack("IHHQQQHHQQIQ", head)
        self.chroms = dict(self._chroms())

    def unpack(self, kinds: str, data: bytes) -> tuple:
        return struct.unpack_from(self.order + kinds, data)

    def _node(self, at: int, width: int) -> tuple[bool, int, bytes]:
        leaf, _, n = self.unpack("BBH", read_at(self.file, at, 4))
        return bool(leaf), n, read_at(self.file, at + 4, n * width)

    def _chroms(self) -> Iterator[tuple[int, tuple[str, int]]]:
        """Number, and name and size, of each chromosome."""
        magic, _, key, value, _, _ = self.unpack("IIIIQQ", read_at(self.file, self.tree_at, 32))
        if magic != TREE_MAGIC or value != 8:
            raise ValueError("no chromosome tree")
        todo = [self.tree_at + 32]
        while todo:
            leaf, n, items = self._node(todo.pop(), key + 8)
            for i in range(n):
                name, rest = items[i * (key + 8) :][:key], items[i * (key + 8) + key :]
                if leaf:
                    number, size = self.unpack("II", rest)
                    yield number, (name.rstrip(b"\0").decode(), size)
                else:
                    todo.append(self.unpack("Q", rest)[0])

    def blocks(self, bounds: Bounds) -> list[tuple[int, int]]:
        """Offset and size of the data blocks that may hold runs within the bounds, in the order of the file."""
        if self.unpack("I", read_at(self.file, self.index_at, 4))[0] != INDEX_MAGIC:
            raise ValueError("no index")
        wanted = sorted(i for i, (name, _) in self.chroms.items() if bounds.chroms is None or name in bounds.chroms)
        found, todo = [], [self.index_at + 48]
        while todo and wanted:
            at = todo.pop()
            leaf, n, _ = self._node(at, 0)
            kind = np.dtype([(c, f"{self.order}u4") for c in ("c0", "b0", "c1", "b1")] + [("at", f"{self.order}u8")] + [("size", f"{self.order}u8")] * leaf)
            items = np.frombuffer(read_at(self.file, at + 4, n * kind.itemsize), kind)
            first = np.searchsorted(wanted, items["c0"])
            keep = np.searchsorted(wanted, items["c1"], "right") > first
            one = items["c0"] == items["c1"]  # a node over several chromosomes has no bounds in any of them
            keep &= ~one | ((items["b1"] > bounds.after) & (items["b0"] < bounds.before))
            if leaf:
                found += [(int(i["at"]), int(i["size"])) for i in items[keep]]
            else:
                todo += items["at"][keep].tolist()
        return sorted(found)

    def runs(self, block: bytes) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """Chromosome, starts, ends and values of one block."""
        data = zlib.decompress(block) if self.inflated else block
        number, start, _, step, span, kind, _, n = self.unpack("IIIIIBBH", data)
        o, body = self.order, memoryview(data)[24:]
        if kind == BED_GRAPH:
            rows = np.frombuffer(body, np.dtype([("s", f"{o}u4"), ("e", f"{o}u4"), ("v", f"{o}f4")]), n)
            starts, ends, values = rows["s"].astype(np.int64), rows["e"].astype(np.int64), rows["v"]
        elif kind == VARIABLE_STEP:
            rows = np.frombuffer(body, np.dtype([("s", f"{o}u4"), ("v", f"{o}f4")]), n)
            starts, values = rows["s"].astype(np.int64), rows["v"]
            ends = starts + span
        elif kind == FIXED_STEP:
            values = np.frombuffer(body, f"{o}f4", n)
            starts = start + step * np.arange(n, dtype=np.int64)
            ends = starts + span
        else:
            raise ValueError(f"data block of kind {kind}")
        return self.chroms[number][0], starts, ends, values.astype(np.float64)


@dataclass
class Blocks(InputPartition):
    path: str
    blocks: list[tuple[int, int]]


class BigWigReader(DataSourceReader):
    def __init__(self, paths: list[str], bounds: Bounds, partition_bytes: int) -> None:
        self.paths, self.bounds, self.partition_bytes = paths, bounds, partition_bytes

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            self.bounds.narrow(f)
            yield f  # blocks hold more than the filter lets through, so Spark applies it too

    def partitions(self) -> list[Blocks]:
        out = []
        for path in self.paths:
            with opened(path) as file:
                own, size = [], 0
                for at, n in Track(file).blocks(self.bounds):
                    if own and size + n > self.partition_bytes:
                        out.append(Blocks(path, own))
                        own, size = [], 0
                    own.append((at, n))
                    size += n
                if own:
                    out.append(Blocks(path, own))
        return out or [Blocks("", [])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        names = ["chrom", "start", "end", "value"]
        with opened(partition.path) as file:
            track = Track(file)
            chroms = self.bounds.chroms
            for at, n, parts in joined(partition.blocks):
                data = read_at(file, at, n)
                for a, size in parts:
                    chrom, starts, ends, values = track.runs(data[a - at : a - at + size])
                    keep = ~np.isnan(values) & (ends > self.bounds.after) & (starts < self.bounds.before)
                    if keep.any() and (chroms is None or chrom in chroms):
                        columns = [pa.array([chrom] * int(keep.sum()), pa.string()), pa.array(starts[keep]), pa.array(ends[keep]), pa.array(values[keep])]
                        yield pa.RecordBatch.from_arrays(columns, names=names)


def joined(blocks: list[tuple[int, int]], most: int = READ_BYTES) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Runs of blocks that lie one after another, as start, length and their parts, for one read each."""
    run: list[tuple[int, int]] = []
    for at, n in blocks:
        if run and (at != sum(run[-1]) or at + n - run[0][0] > most):
            yield run[0][0], sum(run[-1]) - run[0][0], run
            run = []
        run.append((at, n))
    if run:
        yield run[0][0], sum(run[-1]) - run[0][0], run


class BigWig(DataSource):
    """``spark.read.format("bigwig").load(path)``; options ``chroms`` (separated by commas), ``start`` and ``end`` limit what is read, ``partitionBytes``
    sets the compressed bytes of a partition. Filters are pushed down, so ``spark.sql.python.filterPushdown.enabled`` must be set."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BigWigReader:
        o = self.options
        bounds = Bounds(set(o["chroms"].split(",")) if "chroms" in o else None, int(o.get("start", -1)), float(o.get("end", "inf")))
        return BigWigReader(o["path"].split("\n"), bounds, int(o.get("partitionBytes", PARTITION_BYTES)))


def read_bigwig(spark: SparkSession, path: str | list[str], chroms: Iterable[str] | None = None, start: int | None = None, end: int | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """A signal track as runs ``chrom, start, end, value`` (values as doubles; NaN is a gap).

    ``chroms``: only these, unknown ones give no rows; ``start`` and ``end``: only runs that touch the range. Only the blocks that can hold such runs are read, and
    so for filters on these columns: the session's ``spark.sql.python.filterPushdown.enabled`` is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BigWig)
    read = spark.read.format("bigwig").option("path", path if isinstance(path, str) else "\n".join(path)).option("partitionBytes", partition_bytes)
    for name, value in (("chroms", None if chroms is None else ",".join(chroms)), ("start", start), ("end", end)):
        if value is not None:
            read = read.option(name, value)
    return read.load()
