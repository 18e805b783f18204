"""Operators that SQL can't check, against plain versions, and round trips of readers and writers."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.functions import sequence as Q
from spanloom.operators import annotation, interval_joins, intervals, matching, metrics, regions, sampling, selection, signal, tables, variants
from spanloom.sources import readers, writers


def fails(df):
    with pytest.raises(Exception):
        df.collect()


def plain_match(pos, neg, features, k):
    """Greedy: positives in order take the nearest free negatives of their stratum."""
    strata = {p["chrom"] for p in pos}
    usable = [n for n in neg if n["chrom"] in strata]
    both = pos + usable
    center = {f: np.percentile([r[f] for r in both], [25, 50, 75]) for f in features}
    scale = {f: (c[1], (c[2] - c[0]) or 1.0) for f, c in center.items()}
    out = {}
    for chrom in strata:
        free = [n for n in sorted(usable, key=lambda r: r["id"]) if n["chrom"] == chrom]
        for p in sorted((p for p in pos if p["chrom"] == chrom), key=lambda r: r["id"]):
            far = lambda n: sum(((n[f] - scale[f][0]) / scale[f][1] - (p[f] - scale[f][0]) / scale[f][1]) ** 2 for f in features)  # noqa: B023, E731
            best = sorted(free, key=lambda n: (far(n), n["id"]))[:k]
            free = [n for n in free if n not in best]
            out[p["id"]] = {n["id"] for n in best}
    return out


def test_match_features(spark):
    rng = np.random.default_rng(4)
    row = lambda i: {"id": i, "chrom": f"c{i % 3}", "x": float(rng.integers(0, 50)), "y": float(rng.normal())}
    pos, neg = [row(i) for i in range(30)], [row(i) for i in range(100, 400)]
    got = matching.match_features(spark.createDataFrame(pos), spark.createDataFrame(neg), ["id"], ["x", "y"], ["chrom"], 2).collect()
    found = {}
    for r in got:
        if not r["label"]:
            found.setdefault(int(r["match_group"]), set()).add(r["id"])
    assert found == plain_match(pos, neg, ["x", "y"], 2)
    with pytest.raises(ValueError):
        matching.match_features(spark.createDataFrame(pos), spark.createDataFrame(neg), ["id"], ["z"], ["chrom"])


def test_gc_repeat_match(spark):
    rng = np.random.default_rng(5)
    row = lambda i: (f"r{i}", f"c{i % 2}", float(rng.random()), float(rng.random()))
    pos, neg = [row(i) for i in range(40)], [row(i) for i in range(1000, 1400)]
    schema = "id string, chrom string, gc double, repeats double"
    got = matching.gc_repeat_match(spark.createDataFrame(pos, schema), spark.createDataFrame(neg, schema)).collect()
    where = {r[0]: r for r in pos + neg}
    assert sorted(r["positive_id"] for r in got) == sorted(r[0] for r in pos) and len({r["id"] for r in got}) == 40
    assert all(where[r["id"]][1] == where[r["positive_id"]][1] for r in got)
    assert np.mean([abs(where[r["id"]][2] - where[r["positive_id"]][2]) for r in got]) < 0.08


def test_bootstrap(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(g, bool(i == 0), round(float(rng.normal() + (i == 0)), 1)) for g in range(60) for i in range(3)]
    df = spark.createDataFrame(rows, "match_group long, label boolean, score double").withColumn("subset", F.lit("a"))
    alone = spark.createDataFrame([(1, True, 0.5), (2, True, 0.7)], "match_group long, label boolean, score double").withColumn("subset", F.lit("b"))
    y, x, g = (np.array([r[k] for r in rows]) for k in (1, 2, 0))
    own = []
    for _ in range(2000):
        weight = np.bincount(rng.integers(0, 60, 60), minlength=60)[g]
        own.append(metrics.average_precision(y[weight > 0].astype(float), x[weight > 0], weight[weight > 0].astype(float)))
    found = set()
    for bucket_groups in (1024, 4):  # one bucket, and a tree of fifteen
        monkeypatch.setattr(metrics, "BUCKET_GROUPS", bucket_groups)
        got = {r["subset"]: r for r in metrics.bootstrap_auprc(df.union(alone), ["subset"], draws=1000, seed=bucket_groups).collect()}
        assert got["a"]["value"] == pytest.approx(metrics.average_precision(y.astype(float), x))
        assert got["a"]["n_draws"] == 1000 and got["a"]["se"] == pytest.approx(np.std(own, ddof=1), rel=0.1)
        assert (got["b"]["value"], got["b"]["se"], got["b"]["n_draws"]) == (None, None, 0)
        again = metrics.bootstrap_auprc(df.union(alone).repartition(5), ["subset"], draws=1000, seed=bucket_groups).where("subset = 'a'").first()
        assert again["se"] == pytest.approx(got["a"]["se"], rel=1e-9)
        found.add(round(got["a"]["se"], 9))
    assert len(found) == 2


def test_picks_of_a_tree():
    counts, draws = np.array([5, 1, 9, 40, 3]), np.full(4000, 58)
    parts = np.stack([metrics._part(counts, i, draws, [3, 1]) for i in range(5)])
    assert (parts.sum(0) == 58).all() and parts.mean(1) == pytest.approx(counts, rel=0.06)
    assert parts[2].var() == pytest.approx(58 * (9 / 58) * (49 / 58), rel=0.1)


FREE = [("c0", 0, 50), ("c0", 100, 3_000_000), ("c1", 7, 9), ("c1", 40, 700), ("c2", 5, 9)]


def placement_rows(spark):
    rows = [(i, f"c{i % 2}", 10 * i, 10 * i + 5 + i % 3) for i in range(200)] + [(200, "c2", 0, 5), (201, "c2", 0, 4), (202, "c3", 0, 1), (203, "c0", 0, 2_999_000)]
    return spark.createDataFrame(rows, "row_id long, chrom string, start long, end long"), spark.createDataFrame(FREE, "chrom string, start long, end long")


def check_places(got, times):
    assert sorted(r["row_id"] for r in got) == sorted(list(range(204)) * times)
    for r in got:
        i = r["row_id"]
        if r["start"] is None:
            continue
        assert r["end"] - r["start"] == {200: 5, 201: 4, 202: 1, 203: 2_999_000}.get(i, 5 + i % 3) and r["chrom"] == {200: "c2", 201: "c2", 202: "c3", 203: "c0"}.get(i, f"c{i % 2}")
        assert any(c == r["chrom"] and s <= r["start"] and r["end"] <= e for c, s, e in FREE)


def test_random_placement(spark):
    rows, free = placement_rows(spark)
    got = regions.place_at_random(rows, free, 3, 5).collect()
    assert sorted(got, key=repr) == sorted(regions.place_at_random(rows.repartition(3), free.repartition(5), 3, 5).collect(), key=repr)
    check_places(got, 5)
    assert {r["row_id"] for r in got if r["start"] is None} == {200, 202}
    starts = [r["start"] for r in got if r["row_id"] < 200 and r["chrom"] == "c0"]
    assert np.mean(starts) == pytest.approx(1_500_000, rel=0.15)


def test_placement_apart(spark):
    rows, free = placement_rows(spark)
    got = regions.place_apart(rows, free, 3).collect()
    assert sorted(got, key=repr) == sorted(regions.place_apart(rows.repartition(3), free, 3).collect(), key=repr)
    check_places(got, 1)
    lost = {r["row_id"] for r in got if r["start"] is None}
    assert {200, 202} <= lost and len(lost) <= 40  # 600 bases among 660 on c1: tight, so some don't fit
    placed = sorted((r["chrom"], r["start"], r["end"]) for r in got if r["start"] is not None)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(placed, placed[1:], strict=False))


def test_overlaps_of_mixed_lengths(spark):
    rng = np.random.default_rng(12)

    def some(n):
        length = (2.0 ** rng.uniform(0, 28.5, n)).astype(np.int64)
        start = np.where(rng.random(n) < 0.3, rng.integers(-3, 10, n) * (1 << 16), rng.integers(-1000, 300_000_000, n))
        return [(i, f"c{i % 2}", int(s), int(s + k)) for i, (s, k) in enumerate(zip(start, length, strict=True))]

    a, b = some(150), some(150)
    a += [(150, "c0", 0, 100_000_000), (151, "c1", 5, 5)]
    left, right = (spark.createDataFrame(x, "row_id long, chrom string, start long, end long") for x in (a, b))
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r["row_id"], r["row_id_b"]) for r in interval_joins.overlap_join(left, right).collect()) == want
    for how, keep in (("left_semi", True), ("left_anti", False)):
        assert {r["row_id"] for r in interval_joins.overlap_join(left, right, how).collect()} == {x[0] for x in a if (x[0] in {i for i, _ in want}) == keep}
    levels = len(interval_joins.LEVELS)
    for side in (True, False):
        made = interval_joins._binned(left.where("row_id = 150"), side).groupBy(F.pmod("_bin", F.lit(16))).count().collect()
        assert len(made) <= 2 * levels and all(r["count"] <= 2 for r in made)


def test_profile_without_a_row_for_each_offset(spark):
    rng = np.random.default_rng(2)
    anchors = [("c", int(p), s) for p, s in zip(rng.integers(0, 400, 60), rng.choice(["+", "-"], 60), strict=True)]
    cuts = sorted(rng.choice(600, 80, replace=False).tolist())
    track = [("c", s, e, float(rng.normal())) for s, e in zip(cuts[::2], cuts[1::2], strict=True)]
    got = {r["offset"]: (r["n"], r["mean"]) for r in signal.anchor_profile(spark.createDataFrame(anchors, "chrom string, pos long, strand string"), spark.createDataFrame(track, "chrom string, start long, end long, value double"), 50).collect()}
    at = {p: v for _, s, e, v in track for p in range(s, e)}
    for k in [k for k in range(-50, 51) if k]:
        places = [p + (k if s == "+" else -k) for _, p, s in anchors]
        own = [at.get(p, 0.0) for p in places if p >= 0]
        assert got[k] == (len(own), pytest.approx(np.mean(own)))
    assert len(got) == 100


def test_merge_over_tiles(spark):
    rng = np.random.default_rng(7)
    rows = [("c", int(s), int(s + n)) for s, n in zip(rng.integers(-300, 3000, 400), rng.integers(0, 25, 400), strict=True)] + [("c", 640, 1984), ("c", 2048, 2048)]
    other = [("c", int(s), int(s + n)) for s, n in zip(rng.integers(0, 3000, 100), rng.integers(1, 60, 100), strict=True)] + [("c", 100, 700)]
    df, b = (spark.createDataFrame(r, "chrom string, start long, end long") for r in (rows, other))
    want = []
    for _, s, e in sorted(rows):
        if want and s <= want[-1][1]:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    assert sorted([r["start"], r["end"]] for r in intervals.merge(df, 64).collect()) == want
    cover = lambda own: {x for _, s, e in own for x in range(s, e)}
    for keep, places in ((lambda x, y: (x > 0) & (y == 0), cover(rows) - cover(other)), (lambda x, y: (x > 0) & (y > 0), cover(rows) & cover(other))):
        got = sorted((r["start"], r["end"]) for r in intervals.sweep(df, b, keep, 64).collect())
        assert {x for s, e in got for x in range(s, e)} == places and all(a[1] < c[0] for a, c in zip(got, got[1:], strict=False))


def test_errors(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    fails(tables.strict_join(df, df.where("k = 'a'").withColumn("x", F.lit(1)), ["k"], "x"))
    fails(tables.side_by_side(df, df.where("k = 'a'").withColumnRenamed("n", "m"), ["k"]))
    fails(df.select(C.mapped(F.col("k"), {"a": "x"}, strict=True)))
    assert [r[0] for r in df.select(C.mapped(F.col("k"), {"a": "x"}, F.lit("y"))).collect()] == ["x", "y"]
    fails(intervals.checked(spark.createDataFrame([("c", 5, 3)], "chrom string, start long, end long")))
    with pytest.raises(ValueError):
        tables.genome_set(df.withColumnRenamed("k", "accession"), accessions=["a", "zzz"])
    with pytest.raises(ValueError):
        annotation.require_protein_coding(spark.createDataFrame([("transcript", 'transcript_biotype "mRNA";')], "feature string, attribute string"))
    with pytest.raises(ValueError):
        regions.build("v2", {})


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(C.sigmoid(F.lit(0.0))) == 0.5 and value(C.clip(F.lit(7.0), 0, 5)) == 5 and value(C.folded_frequency(F.lit(0.75))) == 0.25
    assert value(C.with_prefix(F.lit("1"))) == "chr1" and value(C.with_prefix(F.lit("chr1"))) == "chr1"
    assert value(C.euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 5.0
    p, q = np.log([0.1, 0.2, 0.3, 0.4]), np.log([0.25] * 4)
    arrays = [F.array(*[F.lit(float(x)) for x in a]) for a in (p, q)]
    m = np.log((np.exp(p) + np.exp(q)) / 2)
    kl = lambda a, b: float((np.exp(a) * (a - b)).sum())
    assert value(C.kl_divergence(*arrays)) == pytest.approx(kl(p, q)) and value(C.js_divergence(*arrays)) == pytest.approx((kl(p, m) + kl(q, m)) / 2)
    assert value(C.subset_bins(F.lit("other"), F.lit(1), {"a": [0, 1]})) == "NA"
    assert value(Q.substitutions(F.lit("aGt"), 1)) == ["aAt", "aCt", "aGt", "aTt"]
    assert metrics.sign_test(3, 9) == pytest.approx(2 * sum(math.comb(12, i) for i in range(4)) / 2**12)
    assert (Q.variant_index(5, "+"), Q.variant_index(4, "+"), Q.variant_index(4, "-")) == (2, 2, 1)
    shifted = intervals.add_random_shift(spark.createDataFrame([("c", i, i + 9) for i in range(100)], "chrom string, start long, end long").withColumn("was", F.col("start")), 4, 1).collect()
    assert all(abs(r["start"] - r["was"]) <= 4 and r["end"] - r["start"] == 9 for r in shifted) and len({r["start"] - r["was"] for r in shifted}) > 3


def test_project_records(spark):
    rows = [("q1", "sp", "c1", "+", 100, 180), ("q1", "sp", "c1", "+", 190, 220), ("q2", "sp", "c1", "+", 1, 50), ("q2", "sp", "c2", "+", 1, 50), ("q3", "sp", "zz", "+", 1, 100), ("q4", "sp", "c1", "-", 0, 90)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "query_name string, species string, t_chrom string, t_strand string, t_start long, t_end long, t_src_size long")
    sizes = spark.createDataFrame([("c1", 1000), ("c2", 1000)], "chrom string, size long")
    got = {r["query_name"] for r in selection.project_records(df, sizes, 50, 200, 101).collect()}
    assert got == {"q1", "q4"}


def test_chunks_of_records(spark):
    rng = np.random.default_rng(8)
    rows = [(f"c{i % 2}", i, "".join(rng.choice(list("acgt"), rng.integers(0, 40)))) for i in range(300)]
    got = {}
    for r in sorted(variants.chunks_of_records(spark.createDataFrame(rows, "chrom string, ord long, seq string"), 16, 8).collect()):
        assert r["chunk"] * 16 == len(got.get(r["chrom"], ""))
        got[r["chrom"]] = got.get(r["chrom"], "") + r["seq"]
    assert got == {c: "".join(s for k, _, s in rows if k == c) for c in ("c0", "c1")}


@pytest.fixture
def write(tmp_path):
    def make(name, text):
        path = tmp_path / name
        path.write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
        return str(path)

    return make


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_interval_readers(spark, write, tmp_path):
    gtf = '#x\nc1\ts\texon\t11\t20\t.\t+\t.\tgene_id "g"; note "a;b";\nc1\ts\texon\t11\t20\t.\t.\t.\tx\n'
    got = readers.read_gtf(spark, write("a.gtf.gz", gtf)).collect()
    assert [(r["start"], r["end"], r["attribute"]) for r in got] == [(10, 20, 'gene_id "g"; note "a;b";')]
    bed = write("a.bed.gz", "1\t0\t5\n1\t5\t9\n2\t1\t2\n")
    assert rows(readers.read_bed(spark, bed)) == [("1", 0, 9), ("2", 1, 2)] and len(rows(readers.read_bed(spark, bed, merged=False))) == 3
    assert rows(readers.read_bed4(spark, write("b.bed", "c\t1\t2\tn\n"))) == [("c", 1, 2, "n")]
    lifted = readers.read_projected_bed(spark, write("c.bed", "c\t1\t2\tq\t0\t-\n"), "mouse")
    assert rows(lifted.select("t_chrom", "query_name", "t_strand", "species")) == [("c", "q", "-", "mouse")]
    assert rows(readers.read_projected_bed(spark, write("d.bed", ""), "mouse")) == rows(readers.read_hits(spark, write("e.tsv", ""))) == []
    assert rows(readers.read_regions_bed(spark, write("r.bed", "chr1\t1\t9\ta\tb\tPLS\nchrUn\t1\t2\ta\tb\tPLS\n"), ["1"])) == [("1", 1, 9, "PLS")]
    assert rows(readers.read_bedgraph(spark, write("g.bg", "track x\nc\t0\t5\t1.5\nc\t5\t6\tNaN\n"))) == [("c", 0, 5, 1.5)]
    assert rows(readers.read_chrom_sizes(spark, write("s.tsv", "c\t10\n"))) == [("c", 10)]
    spark.createDataFrame([("c", 0, 5), ("c", 3, 9)], "chrom string, start long, end long").write.parquet(str(tmp_path / "p"))
    assert rows(readers.read_parquet_intervals(spark, str(tmp_path / "p"))) == [("c", 0, 9)] and readers.parquet_rows(spark, str(tmp_path / "p")) == 2


def test_sequence_readers(spark, write):
    assert rows(readers.read_fasta(spark, write("a.fa", ">x one\nACG\nTn\n>y\nGG\n"))) == [("x", "ACGTn"), ("y", "GG")]
    good = readers.read_getfasta(spark, write("b.fa", ">a(+)\nAC\n>b(-)\nGG\n"))
    assert rows(good) == [("a", "+", "AC"), ("b", "-", "GG")]
    fails(readers.read_getfasta(spark, write("c.fa", ">a(+)\n>b(-)\nGG\n")))
    assert rows(readers.drop_reverse_complements(spark.createDataFrame([("a_+",), ("a_-",)], "id string"))) == [("a_+",)]
    got = readers.split_id(spark.createDataFrame([("NC:1:5-9",)], "id string")).first()
    assert (got["chrom"], got["start"], got["end"]) == ("NC:1", 5, 9)
    both = rows(tables.labelled_sequences(spark.createDataFrame([("c:5-9", "AACG")], "id string, seq string"), 1, "hs", True).select("id", "seq", "chrom", "start", "label", "genome"))
    assert both == [("c:5-9_+", "AACG", "c", 5, 1, "hs"), ("c:5-9_-", "CGTT", "c", 5, 1, "hs")]
    base = spark.createDataFrame([("a",), ("b",)], "id string")
    seqs = spark.createDataFrame([("a", "ACGT"), ("b", "AC")], "id string, sequence string")
    fails(tables.attached_sequences(base, seqs, ["id"], 4))
    assert len(tables.attached_sequences(base.where("id = 'a'"), seqs, ["id"], 4).collect()) == 1


def test_table_readers(spark, write):
    vcf = "##h\n#CHROM\n1\t5\t.\tA\tC\t.\t.\tCLNVC=single_nucleotide_variant\n1\t6\t.\tA\tC,G\t.\t.\tx=1\n1\t7\t.\tAT\tA\t.\t.\tx=1\n1\t8\t.\tA\tC\t.\t.\tx=1\n1\t9\t.\tA\tC\t.\t.\tCLNVC=Deletion\n"
    assert [(r["pos"], r["alt"]) for r in readers.read_vcf(spark, write("a.vcf", vcf)).collect()] == [(5, "C")]
    got = readers.read_table(spark, write("t.tsv", "a\tb\tc\n1\tNA\tx\nq\t2.5\ty\n"), {"a": "int", "b": "double"}).collect()
    assert [tuple(r) for r in got] == [(1, None), (None, 2.5)]
    assert rows(readers.read_table(spark, write("t.csv", "A,B\n1,2\n"), {"B": "int"}, ",", rename={"B": "b"})) == [(2,)]
    locus = readers.read_locus_table(spark, write("l.tsv.gz", 'locus\talleles\tAF\n1:5\t["A","C"]\t0.75\n'), ["AF"]).first()
    assert (locus["chrom"], locus["pos"], locus["ref"], locus["alt"], locus["MAF"]) == ("1", 5, "A", "C", 0.25)
    sheets = [write(f"s{i}.csv", "chrom,pos\n1,%d\n" % i) for i in range(3)]
    assert rows(readers.read_sheets(spark, sheets, {"chrom": "string", "pos": "int"})) == [("1", 1), ("1", 2)]
    assert rows(readers.read_names(spark, write("n.txt", "#c\n\n a \nb\na\n"))) == [("a",), ("b",)]
    tax = readers.read_taxonomy(spark, write("x.jsonl", json.dumps({"accession": "A1", "taxonomy": {"classification": {"order": {"name": "Primates"}}}}) + "\n"), ["order", "family"])
    assert rows(tax) == [("A1", "Primates", None)]
    genomes = spark.createDataFrame([("A1", 5), ("A2", 6)], "accession string, n int")
    assert rows(readers.with_taxonomy(genomes, tax.union(tax))) == [("A1", 5, "Primates", "unknown"), ("A2", 6, "unknown", "unknown")]
    assert rows(readers.read_newick_leaves(spark, write("t.nw", "((a_x:1,b:2)anc1:3,c:1)root;"))) == [("a_x",), ("b",), ("c",)]
    assert rows(readers.read_after_header(spark, write("h.tsv", "junk\nmore\nx\t1\ny\t2\n"), 2, ["a", "b"])) == [("x", "1"), ("y", "2")]
    models = readers.read_registry(spark, write("m.json", json.dumps([{"id": "a", "family": "lm"}, {"id": "b", "family": "track", "display": "B"}])), ["lm", "track"])
    assert rows(models.select("id", "family")) == [("a", "lm"), ("b", "track")]
    with pytest.raises(ValueError):
        readers.read_registry(spark, write("d.json", json.dumps([{"id": "a", "family": "lm"}, {"id": "a", "family": "lm"}])), ["lm"])
    comp = readers.read_composition(spark, write("c.tsv", "label\tn\tfraction\ncds\t5\t0.5\njunk\t5\t0.5\n"), ["cds", "utr3"])
    assert rows(comp) == [("cds", 5, 0.5)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("c", 1, 5, 0.5, "q", "+"), ("c", 5, 9, 1.0, "r", "-")], "chrom string, start long, end long, score double, name string, strand string")
    path = lambda n: str(tmp_path / n)
    writers.write_bed(df, path("bed"))
    assert rows(readers.read_bed(spark, path("bed"), merged=False)) == [("c", 1, 5), ("c", 5, 9)]
    writers.write_bed6(df.withColumnsRenamed({"chrom": "t_chrom", "start": "t_start", "end": "t_end", "name": "query_name", "strand": "t_strand"}), path("bed6"))
    assert len(rows(readers.read_projected_bed(spark, path("bed6"), "x"))) == 2
    writers.write_bedgraph(df, path("bg"), "t")
    assert rows(readers.read_bedgraph(spark, path("bg"))) == [("c", 1, 5, 0.5), ("c", 5, 9, 1.0)]
    seqs = spark.createDataFrame([(f"s{i}", "ACGTN"[: 1 + i % 5]) for i in range(20)], "id string, seq string")
    writers.write_fasta(seqs, path("fa"))
    assert rows(readers.read_fasta(spark, path("fa"))) == rows(seqs)
    writers.write_shards(seqs, path("shards"), 3, 1, add_rc=True)
    back = spark.read.json(path("shards"))
    assert back.count() == 40 and sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [13, 13, 14]
    writers.write_shards_of([seqs, seqs.withColumn("id", F.concat(F.lit("z"), "id"))], path("many"), 2, 1)
    assert spark.read.json(path("many")).count() == 40
    writers.write_histogram(spark.createDataFrame([(0, 5), (1, 2)], "bin long, n long"), path("hist"))
    assert rows(spark.read.parquet(path("hist"))) == [(0, 5), (1, 2)]
    text = writers.report(spark.createDataFrame([("_global_", "a", 0.5, 0.01), ("x", "a", 0.25, 0.02)], "subset string, score_type string, value double, se double"), "subset", "score_type")
    assert text.splitlines()[2:] == ["| _global_ | 0.500 ± 0.010 |", "| x | 0.250 ± 0.020 |"]
    card = writers.dataset_card("Name", {"train": 1200, "test": 34}, spark.createDataFrame([("cds", 10, 8)], "subset string, n_input long, n_kept long"))
    assert "1,234" in card and "| cds | 10 | 8 | 80.0 % |" in card
    assert json.loads(writers.as_json(spark.createDataFrame([("a", None)], "x string, y string"))) == [{"x": "a"}]


def test_shards_and_samples(spark):
    df = spark.range(100)
    assert sampling.sample(df, 7, 1, "id").count() == 7
    assert sampling.shard_bounds(10, 3) == [(0, 4), (4, 7), (7, 10)]


def test_numbers_in_hot_groups(spark):
    """Indices and gap checks by cells and tiles equal those over whole groups, with a hot group, ties, nulls and neighbours across tiles."""
    rng = np.random.default_rng(3)
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", None if i % 50 == 0 else int(rng.integers(0, 400))) for i in range(3000)] + [(9999, None, 4)]
    got = {r["i"]: r["index"] for r in tables.index_in_group(spark.createDataFrame(rows, "i long, g string, v long"), ["g"], ["v", "i"]).collect()}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in own] == list(range(len(own)))
    spans = sorted(("c", int(s), int(s + n)) for s, n in zip(rng.integers(0, 40 << 20, 300), rng.integers(1, 400_000, 300), strict=True))
    want = {a for a, b in zip(spans, spans[1:], strict=False) if b[1] < a[2]}
    assert {tuple(r) for r in tables.gaps_in_order(spark.createDataFrame(spans, "chrom string, start long, end long"), "chrom").collect()} == want


def test_examples_and_vocabulary(spark):
    assert Q.char_vocabulary() == {"[PAD]": 0, "[UNK]": 1, "a": 2, "c": 3, "g": 4, "t": 5}
    assert Q.char_vocabulary(True, True) == {"[PAD]": 0, "[UNK]": 1, "[BOS]": 2, "[EOS]": 3, "a": 4, "c": 5, "g": 6, "t": 7}
    one = spark.createDataFrame([("aCGnT",)], "w string")
    for bos, eos in ((False, False), (True, False), (True, True)):
        ids = Q.char_vocabulary(bos, eos)
        got = one.select(Q.likelihood_example(F.col("w"), bos, eos).alias("x"), Q.special_token_counts(Q.char_tokens(F.lit("a"), bos, eos), 2 if bos else None, 2 + bos if eos else None).alias("n")).first()
        assert got["x"]["input_ids"] == [ids.get("[BOS]")] * bos + [ids.get(c.lower(), 1) for c in "aCGnT"] + [ids.get("[EOS]")] * eos
        assert got["x"]["is_upper"] == [False] * bos + [False, True, True, False, True] + [False] * eos
        assert tuple(got["n"]) == (int(bos), int(eos))
    import io

    import pyarrow.parquet as pq

    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    assert pq.read_table(io.BytesIO(writers.as_parquet(df))).to_pylist() == [{"n": 1, "s": "a"}, {"n": 2, "s": None}]


def test_pruned_join_reads_only_what_it_needs(spark, tmp_path):
    table = spark.range(200_000).select(F.concat(F.lit("c"), F.col("id") % 5).alias("chrom"), (F.col("id") * 3).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.concat(F.lit("x"), F.col("id")).alias("consequence"))
    path = str(tmp_path / "table")
    variants.write_by_chromosome(table.withColumn("junk", F.rand(1)), path)
    keys = [("c2", 2 * 3, "A", "C"), ("c2", 7 * 3, "A", "C"), ("c2", 100_002 * 3, "A", "C"), ("c2", 8, "A", "C"), ("c2", 7 * 3, "A", "G"), ("nowhere", 5, "A", "C"), (None, 5, "A", "C")]
    df = spark.createDataFrame(keys, "chrom string, pos long, ref string, alt string")
    assert variants.position_ranges(df, width=16, most=2) == {"c2": [(6, 21), (300_006, 300_006)], "nowhere": [(5, 5)]}
    got = variants.attach_from_table(df, path, ["consequence"])
    assert sorted((r["pos"], r["alt"], r["consequence"]) for r in got.collect() if r["chrom"] == "c2") == [(6, "C", "x2"), (8, "C", None), (21, "C", "x7"), (21, "G", None), (300_006, "C", "x100002")]
    assert got.count() == len(keys)
    few = variants.attach_from_table(df.where("chrom = 'c2' and pos < 100"), path, ["consequence"])
    few.collect()
    leaves = few._jdf.queryExecution().executedPlan().finalPhysicalPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    scans = [s.plan() if "QueryStage" in s.nodeName() else s for s in scans]
    found = []

    def walk(node):
        if "Scan parquet" in node.nodeName():
            found.append({k: node.metrics().apply(k).value() for k in ("numFiles", "numOutputRows")})
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    for s in scans:
        walk(s)
    (scan,) = found
    assert scan["numFiles"] <= 20 and 0 < scan["numOutputRows"] <= 20_000  # one folder of five, with its share of 64 files, and few of 200,000 rows


def test_many_sets_in_one_sweep(spark):
    rng = np.random.default_rng(5)
    own = {n: [("c", int(s), int(s + k)) for s, k in zip(rng.integers(-50, 2500, 60), rng.integers(0, 60, 60), strict=True)] for n in "abcd"}
    own["d"].append(("e", 10, 20))
    sets = {n: spark.createDataFrame(r, "chrom string, start long, end long") for n, r in own.items()}
    rules = {"any": lambda o: (o["a"] > 0) | (o["b"] > 0), "only": lambda o: (o["d"] > 0) & (o["a"] + o["b"] + o["c"] == 0), "twice": lambda o: o["c"] >= 2, "none": lambda o: o["a"] < 0}
    cover = {n: {(c, x): sum(1 for cc, s, e in r if cc == c and s <= x < e) for c, x in {(c, x) for c, s, e in r for x in range(s, e)}} for n, r in own.items()}
    at = lambda n, p: cover[n].get(p, 0)
    places = {p for n in own for p in cover[n]}
    want = {"any": {p for p in places if at("a", p) or at("b", p)}, "only": {p for p in places if at("d", p) and not (at("a", p) + at("b", p) + at("c", p))}, "twice": {p for p in places if at("c", p) >= 2}, "none": set()}
    got = intervals.sweep_many(sets, rules, 64).collect()
    for label, own_places in want.items():
        found = sorted((r["chrom"], r["start"], r["end"]) for r in got if r["label"] == label)
        assert {(c, x) for c, s, e in found for x in range(s, e)} == own_places
        assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize(("slab", "k"), [(20_000, 2), (12, 1), (9, 2)])
def test_matches_of_many_strata(spark, monkeypatch, slab, k):
    """Random strata with ties, as one slab each and cut to small ones, equal the plain loop."""
    monkeypatch.setattr(matching, "SLAB", slab)
    rng = np.random.default_rng(slab + k)
    pos, neg, i = [], [], 0
    for s in range(50):
        p = int(rng.integers(1, 9))
        for own, n in ((pos, p), (neg, k * p + int(rng.integers(0, 20)))):
            for _ in range(n):
                i += 1
                own.append({"id": i, "chrom": f"c{s}", "x": float(rng.integers(0, 6)), "y": round(float(rng.normal()), 1)})
    pos = [pos[j] for j in rng.permutation(len(pos))]
    got = matching.match_features(spark.createDataFrame(pos), spark.createDataFrame(neg), ["id"], ["x", "y"], ["chrom"], k).collect()
    found = {}
    for r in got:
        if not r["label"]:
            found.setdefault(int(r["match_group"]), set()).add(r["id"])
    assert found == plain_match(pos, neg, ["x", "y"], k) and sum(r["label"] for r in got) == len(pos)
