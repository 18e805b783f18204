"""bigWig, indexed FASTA and 2bit files written by hand, read in parts."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import variants
from spanloom.sources import bigwig, genomes
from spanloom.sources.stores import opened

BASES = {"chrA": "", "chrB": "", "empty": "", "c": "acgtN"}


def write_bigwig(path, chroms, blocks, order="<", fan=3):
    """``blocks``: (chromosome number, kind, start, step, span, rows) in order. An R-tree of at most ``fan`` children a node."""
    pack = lambda kinds, *x: struct.pack(order + kinds, *x)
    key = max(len(n) for n, _ in chroms)
    out = bytearray(64)
    tree_at = len(out)
    out += pack("IIIIQQ", bigwig.TREE_MAGIC, len(chroms), key, 8, len(chroms), 0)
    # a chromosome tree of two levels
    half = (len(chroms) + 1) // 2
    parts = [list(enumerate(chroms))[:half], list(enumerate(chroms))[half:]]
    at = len(out) + 4 + 2 * (key + 8)
    out += pack("BBH", 0, 0, 2)
    for p in parts:
        out += (p or parts[0])[0][1][0].encode().ljust(key, b"\0") + pack("Q", at)
        at += 4 + len(p) * (key + 8)
    for p in parts:
        out += pack("BBH", 1, 0, len(p))
        for i, (name, size) in p:
            out += name.encode().ljust(key, b"\0") + pack("II", i, size)
    data_at, leaves, runs = len(out), [], []
    for number, kind, start, step, span, rows in blocks:
        if kind == bigwig.BED_GRAPH:
            body, own = b"".join(pack("IIf", *r) for r in rows), [tuple(r) for r in rows]
        elif kind == bigwig.VARIABLE_STEP:
            body, own = b"".join(pack("If", *r) for r in rows), [(s, s + span, v) for s, v in rows]
        else:
            body, own = b"".join(pack("f", v) for v in rows), [(start + i * step, start + i * step + span, v) for i, v in enumerate(rows)]
        a, b = own[0][0], own[-1][1]
        block = zlib.compress(pack("IIIIIBBH", number, a, b, step, span, kind, 0, len(rows)) + body)
        leaves.append(((number, a, number, b), len(out), len(block)))
        out += block
        runs += [(chroms[number][0], s, e, float(np.float32(v))) for s, e, v in own if v == v]
    index_at = len(out)
    out += pack("IIQIIIIQII", bigwig.INDEX_MAGIC, fan, len(leaves), 0, 0, 0, 0, index_at, 1, 0)
    levels = [[leaves[i : i + fan] for i in range(0, len(leaves), fan)]]
    while len(levels[0]) > 1:
        levels.insert(0, [levels[0][i : i + fan] for i in range(0, len(levels[0]), fan)])

    def span_of(node):
        own = [x[0] if isinstance(x, tuple) else span_of(x) for x in node]
        return (*own[0][:2], *max(x[2:] for x in own))

    at, places = len(out), {}
    for level in levels:
        for node in level:
            places[id(node)] = at
            at += 4 + len(node) * (32 if isinstance(node[0], tuple) else 24)
    for level in levels:
        for node in level:
            leaf = isinstance(node[0], tuple)
            out += pack("BBH", leaf, 0, len(node))
            for x in node:
                out += pack("IIIIQQ", *x[0], x[1], x[2]) if leaf else pack("IIIIQ", *span_of(x), places[id(x)])
    out[:64] = pack("IHHQQQHHQQIQ", bigwig.FILE_MAGIC, 4, 0, tree_at, data_at, index_at, 0, 0, 0, 0, 1 << 16, 0)
    path.write_bytes(out)
    return runs


def blocks_of(rng):
    out = []
    for number in range(5):
        at = rng.randint(0, 50)
        for _ in range(9):
            kind, n, span = rng.choice([1, 2, 3]), rng.randint(1, 40), rng.randint(1, 5)
            step, values = span + rng.randint(0, 3), [rng.choice([rng.uniform(-9, 9), float("nan"), 0.0]) for _ in range(n)]
            if kind == 1:
                rows, start = [], at
                for v in values:
                    end = at + rng.randint(1, 6)
                    rows.append((at, end, v))
                    at = end + rng.randint(0, 2)
            elif kind == 2:
                start, rows = at, [(at + i * step, v) for i, v in enumerate(values)]
            else:
                start, rows = at, values
            out.append((number, kind, start, step, span, rows))
            at = max(at, start + n * step) + rng.randint(0, 30)
    return out


@pytest.mark.parametrize("order", ["<", ">"])
def test_bigwig(spark, tmp_path, order):
    chroms = [(n, 10_000) for n in ("chr1", "chr10", "chr2", "chrX", "z", "unused")]
    path = tmp_path / "track.bw"
    runs = write_bigwig(path, chroms, blocks_of(random.Random(4)), order)
    got = bigwig.read_bigwig(spark, str(path), partition_bytes=500)
    assert got.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, got.collect())) == sorted(runs)
    own = bigwig.read_bigwig(spark, str(path), chroms=["chr2", "nowhere"], start=100, end=200)
    assert sorted(map(tuple, own.collect())) == sorted(r for r in runs if r[0] == "chr2" and r[2] > 100 and r[1] < 200)
    assert bigwig.read_bigwig(spark, f"file://{path}", chroms=["unused"]).count() == 0


def test_bigwig_filters_read_only_their_blocks(spark, tmp_path):
    path = tmp_path / "track.bw"
    runs = write_bigwig(path, [(n, 10_000) for n in ("a", "b", "c", "d", "e")], blocks_of(random.Random(8)))
    with opened(str(path)) as file:
        track = bigwig.Track(file)
        assert len(track.blocks(bigwig.Bounds())) == 45
        for name in "abcde":
            own = track.blocks(bigwig.Bounds({name}))
            assert len(own) == 9 and {track.runs(file.read_at(n, at))[0] for at, n in own} == {name}
        _, low, high, _ = [r for r in runs if r[0] == "c"][60]
        middle = track.blocks(bigwig.Bounds({"c"}, low, high))
        assert 1 <= len(middle) < 9
    df = bigwig.read_bigwig(spark, str(path), partition_bytes=1)
    few = df.where((F.col("chrom") == "c") & (F.col("start") < high) & (F.col("end") > low))
    assert few.rdd.getNumPartitions() == len(middle)
    assert sorted(map(tuple, few.collect())) == sorted(r for r in runs if r[0] == "c" and r[1] < high and r[2] > low)
    (tmp_path / "bad.bw").write_bytes(bytes(64))
    with pytest.raises(ValueError, match="not a bigWig"), opened(str(tmp_path / "bad.bw")) as file:
        bigwig.Track(file)


def sequences(rng):
    out = {}
    for name, n in (("chrA", 1000), ("chrB", 77), ("one", 1), ("chrC", 333)):
        seq = [rng.choice("ACGT") for _ in range(n)]
        for _ in range(n // 60):
            a = rng.randrange(n)
            b = min(n, a + rng.randint(1, 30))
            seq[a:b] = ["N"] * (b - a) if rng.random() < 0.5 else [c.lower() for c in seq[a:b]]
        out[name] = "".join(seq)
    return out


def write_fasta(path, seqs, line=60, end="\n"):
    text, index = "", ""
    for name, seq in seqs.items():
        text += f">{name} described{end}"
        index += f"{name}\t{len(seq)}\t{len(text)}\t{line}\t{line + len(end)}\n"
        text += "".join(seq[i : i + line] + end for i in range(0, len(seq), line))
    path.write_text(text, newline="")
    path.with_name(path.name + ".fai").write_text(index)
    return text.encode()


def write_bgzip(path, text, most=100):
    out, index = b"", []
    for i in range(0, len(text), most):
        if i:
            index.append((len(out), i))
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(text[i : i + most]) + z.flush()
        extra = b"XX" + struct.pack("<H", 2) + b"ab" + b"BC" + struct.pack("<HH", 2, 12 + 12 + len(body) + 8 - 1)
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(text[i : i + most]), len(text[i : i + most]))
    path.write_bytes(out)
    path.with_name(path.name + ".gzi").write_bytes(struct.pack("<Q", len(index)) + b"".join(struct.pack("<QQ", *x) for x in index))


def write_two_bit(path, seqs, order="<"):
    pack = lambda kinds, *x: struct.pack(order + kinds, *x)
    records = []
    for seq in seqs.values():
        out = pack("I", len(seq))
        for test in (lambda c: c in "Nn", str.islower):
            flags = [test(c) for c in seq]
            starts = [i for i, f in enumerate(flags) if f and not (i and flags[i - 1])]
            sizes = [next((j for j in range(s, len(seq)) if not flags[j]), len(seq)) - s for s in starts]
            out += pack(f"I{len(starts)}I{len(starts)}I", len(starts), *starts, *sizes)
        codes = ["TCAG".find(c.upper()) % 4 if c not in "Nn" else 0 for c in seq]
        codes += [0] * (-len(codes) % 4)
        records.append(out + pack("I", 0) + bytes(sum(codes[i + k] << (6 - 2 * k) for k in range(4)) for i in range(0, len(codes), 4)))
    at = 16 + sum(5 + len(n) for n in seqs)
    out = pack("IIII", genomes.TWO_BIT_MAGIC, 0, len(seqs), 0)
    for name, record in zip(seqs, records, strict=True):
        out += bytes([len(name)]) + name.encode() + pack("I", at)
        at += len(record)
    path.write_bytes(out + b"".join(records))


def plain(seqs, chrom, start, end, strand):
    seq = "".join(seqs[chrom][i] if 0 <= i < len(seqs[chrom]) else "N" for i in range(start, end))
    return seq[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca")) if strand == "-" else seq


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder, seqs = tmp_path_factory.mktemp("genome"), sequences(random.Random(5))
    text = write_fasta(folder / "g.fa", seqs)
    write_fasta(folder / "dos.fa", seqs, 50, "\r\n")
    write_bgzip(folder / "g.fa.gz", text)
    (folder / "g.fa.gz.fai").write_text((folder / "g.fa.fai").read_text())
    write_two_bit(folder / "g.2bit", seqs)
    write_two_bit(folder / "big.2bit", seqs, ">")
    return folder, seqs


@pytest.mark.parametrize("name", ["g.fa", "dos.fa", "g.fa.gz", "g.2bit", "big.2bit"])
def test_windows(spark, files, name):
    folder, seqs = files
    rng, rows = random.Random(6), []
    for chrom, seq in seqs.items():
        for _ in range(150):
            start = rng.randint(-20, len(seq) - 1)
            rows.append((chrom, start, start + rng.randint(max(0, -start), 130), rng.choice("+-")))
    df = spark.createDataFrame([*rows, (None, 1, 2, "+"), ("chrA", 1, None, "+")], "chrom string, start long, end long, strand string").withColumn("n", F.lit(1))
    got = genomes.attach_windows(df, str(folder / name))
    assert got.columns == [*df.columns, "seq"]
    assert sorted(((*r[:4], r["seq"]) for r in got.collect()), key=repr) == sorted([*((*r, plain(seqs, *r)) for r in rows), (None, 1, 2, "+", None), ("chrA", 1, None, "+", None)], key=repr)
    one = genomes.attach_windows(df.drop("strand").limit(5), f"file://{folder}/{name}", name="bases", upper=True)
    assert all(r["bases"] == plain(seqs, r["chrom"], r["start"], r["end"], "+").upper() for r in one.collect())


@pytest.mark.parametrize("name", ["g.fa.gz", "g.2bit"])
def test_chunks_and_bounds(spark, files, name):
    folder, seqs = files
    chunks = genomes.read_genome(spark, str(folder / name), size=64, per_partition=3)
    whole = {}
    for r in sorted(chunks.collect()):
        whole[r["chrom"]] = whole.get(r["chrom"], "") + r["seq"]
    assert whole == seqs
    spots = spark.createDataFrame([(i, "chrA", p) for i, p in enumerate((1, 64, 65, 1000))], "row_id long, chrom string, pos long")
    assert {r["pos"]: r["window"] for r in variants.bases_at(spots, chunks, 3, 4, size=64).collect()} == {p: plain(seqs, "chrA", p - 4, p + 4, "+") for p in (1, 64, 65, 1000)}
    genome = genomes.open_genome(str(folder / name))
    with opened(str(folder / name)) as file:
        for bad in (("nowhere", 0, 1), ("chrA", 5, 4), ("chrA", -5, -1), ("chrA", 1000, 1001), ("chrA", 0, 1, "*")):
            with pytest.raises(ValueError):
                genomes.window(genome, file, *bad)
        assert genomes.window(genome, file, "chrA", -3, 0) == "NNN" and genomes.window(genome, file, "one", 0, 0) == ""
