"""Sequences of indexed genomes by position: FASTA with ``.fai``, bgzip FASTA with ``.fai`` and ``.gzi``, and 2bit.

Windows are looked up in tasks: each opens the file, seeks to the bytes that its windows need and reads no more. The driver reads the index
only. ``read_genome`` gives a whole genome as chunks for joins by position, one partition for a run of chunks.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import opened, read_at, whole

# The magic number of 2bit and its bases in the order of their codes.
TWO_BIT_MAGIC, TWO_BIT_BASES = 0x1A412743, b"TCAG"
_COMPLEMENT = bytes.maketrans(b"ACGTNacgtn", b"TGCANtgcan")
_FOUR = np.frombuffer(bytes(TWO_BIT_BASES[(b >> s) & 3] for b in range(256) for s in (6, 4, 2, 0)), np.uint8).reshape(256, 4)


@dataclass
class Fasta:
    """A FASTA file by its index: name to (size, offset of the first base, bases a line, bytes a line); ``blocks``: where bgzip blocks begin,
    in the file and in the text."""

    path: str
    lines: dict[str, tuple[int, int, int, int]]
    blocks: tuple[list[int], list[int]] | None = None

    @property
    def sizes(self) -> dict[str, int]:
        return {name: x[0] for name, x in self.lines.items()}

    def bases(self, file, chrom: str, start: int, end: int) -> bytes:
        _, first, per_line, width = self.lines[chrom]
        a = first + start // per_line * width + start % per_line
        b = first + (end - 1) // per_line * width + (end - 1) % per_line + 1
        data = read_at(file, a, b - a) if self.blocks is None else self._inflated(file, a, b)
        return data.translate(None, b"\r\n")

    def _inflated(self, file, a: int, b: int) -> bytes:
        """Bytes ``[a, b)`` of the text of a bgzip file: blocks are inflated from the one that holds ``a`` on."""
        i = bisect.bisect_right(self.blocks[1], a) - 1
        at, begin, out = self.blocks[0][i], self.blocks[1][i], []
        skip = a - begin
        while begin < b:
            head = read_at(file, at, 12)
            if head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
                raise ValueError("not a bgzip block")
            extra = read_at(file, at + 12, struct.unpack("<H", head[10:12])[0])
            size = next(struct.unpack_from("<H", extra, k + 4)[0] + 1 for k in _fields(extra) if extra[k : k + 2] == b"BC")
            text = zlib.decompress(read_at(file, at + 12 + len(extra), size - 12 - len(extra) - 8), -15)
            if not text:
                raise ValueError("the file ends before the window")
            out.append(text)
            at, begin = at + size, begin + len(text)
        return b"".join(out)[skip : skip + b - a]


def _fields(extra: bytes) -> Iterator[int]:
    k = 0
    while k < len(extra):
        yield k
        k += 4 + struct.unpack_from("<H", extra, k + 2)[0]


@dataclass
class TwoBit:
    """A 2bit file: name to size, offset of the packed bases, and starts and ends of the runs of N and of soft-masked bases."""

    path: str
    records: dict[str, tuple[int, int]]
    order: str = "<"
    known: dict[str, tuple] = field(default_factory=dict)

    @property
    def sizes(self) -> dict[str, int]:
        return {name: x[0] for name, x in self.records.items()}

    def bases(self, file, chrom: str, start: int, end: int) -> bytes:
        if chrom not in self.known:
            self.known[chrom] = self._record(file, self.records[chrom][1])
        packed, gaps, masks = self.known[chrom]
        codes = np.frombuffer(read_at(file, packed + start // 4, (end + 3) // 4 - start // 4), np.uint8)
        out = _FOUR[codes].reshape(-1)[start % 4 :][: end - start].copy()
        for (starts, ends), change in ((gaps, lambda x: ord("N")), (masks, lambda x: x | 0x20)):
            for i in range(np.searchsorted(ends, start, "right"), np.searchsorted(starts, end)):
                a, b = max(int(starts[i]) - start, 0), min(int(ends[i]), end) - start
                out[a:b] = change(out[a:b])
        return out.tobytes()

    def _record(self, file, at: int) -> tuple:
        runs, at = [], at + 4
        for _ in range(2):
            (n,) = struct.unpack(f"{self.order}I", read_at(file, at, 4))
            both = np.frombuffer(read_at(file, at + 4, 8 * n), f"{self.order}u4").astype(np.int64).reshape(2, n)
            runs.append((both[0], both[0] + both[1]))
            at += 4 + 8 * n
        return at + 4, *runs


def open_genome(path: str) -> Fasta | TwoBit:
    """The index of a genome: of a 2bit file its own, of a FASTA file ``path.fai``, and ``path.gzi`` for one that bgzip compressed."""
    with opened(path) as file:
        head = read_at(file, 0, min(16, file.size()))
        order = next((o for o in "<>" if len(head) == 16 and struct.unpack(f"{o}I", head[:4])[0] == TWO_BIT_MAGIC), None)
        if order:
            at, places = 16, []
            for _ in range(struct.unpack(f"{order}I", head[8:12])[0]):
                n = read_at(file, at, 1)[0]
                entry = read_at(file, at + 1, n + 4)
                places.append((entry[:n].decode(), struct.unpack(f"{order}I", entry[n:])[0]))
                at += 5 + n
            return TwoBit(path, {name: (struct.unpack(f"{order}I", read_at(file, p, 4))[0], p) for name, p in places}, order)
    rows = [line.split("\t") for line in whole(f"{path}.fai").decode().splitlines()]
    lines = {r[0]: tuple(map(int, r[1:5])) for r in rows}
    if head[:2] != b"\x1f\x8b":
        return Fasta(path, lines)
    pairs = np.frombuffer(whole(f"{path}.gzi"), "<u8")[1:].reshape(-1, 2)
    return Fasta(path, lines, ([0, *pairs[:, 0].tolist()], [0, *pairs[:, 1].tolist()]))


def window(genome: Fasta | TwoBit, file, chrom: str, start: int, end: int, strand: str = "+", upper: bool = False) -> str:
    """Bases ``[start, end)`` with N beyond both ends of the chromosome, reversed and complemented on the minus strand. An unknown chromosome or
    strand, a start behind the end and a window that lies outside the chromosome are errors."""
    size = genome.sizes.get(chrom)
    if size is None:
        raise ValueError(f"no chromosome {chrom}")
    if strand not in ("+", "-"):
        raise ValueError(f"strand {strand}")
    if start > end or end < 0 or start >= size:
        raise ValueError(f"window {start}-{end} of {chrom}, which has {size} bases")
    a, b = max(start, 0), min(end, size)
    seq = b"N" * (min(0, end) - min(start, 0)) + (genome.bases(file, chrom, a, b) if a < b else b"") + b"N" * (end - max(b, a))
    if strand == "-":
        seq = seq.translate(_COMPLEMENT)[::-1]
    return (seq.upper() if upper else seq).decode()


def attach_windows(df: DataFrame, path: str, name: str = "seq", upper: bool = False) -> DataFrame:
    """``df`` (``chrom``, ``start``, ``end`` and, if there is one, ``strand``) with the bases of each row's window as ``name``.

    Rows stay in their partitions and are read in the order of the file inside a batch. A row with a null in those columns has a null window."""
    genome = open_genome(path)
    strand = F.col("strand") if "strand" in df.columns else F.lit("+")
    kept = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(path) as file:
            for batch in batches:
                asked = list(zip(*(batch.column(c).to_pylist() for c in ("chrom", "start", "end", "_strand")), strict=True))
                got: list[str | None] = [None] * len(asked)
                for i in sorted((i for i, x in enumerate(asked) if None not in x), key=lambda i: asked[i][:2]):
                    got[i] = window(genome, file, *asked[i], upper=upper)
                columns = [batch.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(got, pa.string())], names=[*kept, name])

    return df.withColumn("_strand", strand).mapInArrow(run, f"{fields}, `{name}` string")


def read_genome(spark: SparkSession, path: str, size: int = 1 << 16, upper: bool = False, per_partition: int = 64) -> DataFrame:
    """A whole genome as ``chrom, chunk, seq`` of ``size`` bases each, the last of a chromosome shorter: the input of ``variants.bases_at``."""
    sizes = open_genome(path).sizes
    names = spark.createDataFrame(list(sizes.items()), "chrom string, bases long")
    chunks = names.select("chrom", "bases", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("bases") / size) - 1)).alias("chunk")).where("bases > 0")
    parts = max(1, sum(-(-n // size) for n in sizes.values()) // per_partition)
    places = chunks.repartitionByRange(parts, "chrom", "chunk").select("chrom", "chunk", (F.col("chunk") * size).alias("start"), F.least(F.col("chunk") * size + size, F.col("bases")).alias("end"))
    return attach_windows(places, path, upper=upper).select("chrom", "chunk", "seq")
