"""Variant tables keyed by ``chrom, pos, ref, alt`` (``pos`` 1-based)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .interval_joins import nearest, overlap_join

KEY = ["chrom", "pos", "ref", "alt"]


def snvs(df: DataFrame) -> DataFrame:
    """Single-base changes between two of A, C, G, T."""
    base = ["A", "C", "G", "T"]
    return df.where(F.col("ref").isin(base) & F.col("alt").isin(base) & (F.col("ref") != F.col("alt")))


def lift_over(variants: DataFrame, blocks: DataFrame) -> DataFrame:
    """Move positions through chain blocks ``chrom, start, end, to_chrom, to_start, to_strand, to_size``.

    On the minus strand the position counts from the other end and both alleles are complemented. Unmapped variants keep their
    chromosome and get ``pos`` -1. ``row_id`` must be unique."""
    spots = variants.select("row_id", "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    b = blocks.select("chrom", "start", "end", "to_chrom", "to_start", "to_strand", "to_size")
    hit = overlap_join(spots, b).groupBy("row_id").agg(F.min(F.struct(F.col("start_b").alias("s"), F.col("to_chrom_b").alias("c"), F.col("to_start_b").alias("t"), F.col("to_strand_b").alias("x"), F.col("to_size_b").alias("z"))).alias("h"))
    out = variants.join(hit.hint("merge"), "row_id", "left")
    ahead = F.col("h.t") + F.col("pos") - 1 - F.col("h.s")
    minus = F.coalesce(F.col("h.x") == "-", F.lit(False))
    pos = F.when(F.col("h").isNull(), -1).when(minus, F.col("h.z") - ahead).otherwise(ahead + 1)
    return out.withColumns({"chrom": F.coalesce("h.c", "chrom"), "pos": pos, "ref": F.when(minus, reverse_complement("ref")).otherwise(F.col("ref")), "alt": F.when(minus, reverse_complement("alt")).otherwise(F.col("alt"))}).drop("h")


def genome_chunks(sequences: DataFrame, size: int = 1 << 16) -> DataFrame:
    """``chrom, seq`` rows as chunks ``chrom, chunk, seq`` of fixed length, for joins by position."""
    n = F.greatest(F.lit(0), F.ceil(F.length("seq") / size) - 1)
    return sequences.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("chunk"), "seq").select("chrom", "chunk", F.substring("seq", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("seq"))


def chunks_of_records(records: DataFrame, size: int = 1 << 16, block: int = 4096) -> DataFrame:
    """Chunks as ``genome_chunks`` gives them, of chromosomes that come as records ``chrom, ord, seq`` to be read in the order of ``ord`` (unique
    whole numbers). Offsets are sums of lengths by blocks of ``ord`` and inside them; no row or task ever holds a whole chromosome."""
    rows = records.where("seq <> ''").select("chrom", "ord", "seq", F.length("seq").cast("long").alias("n"), F.floor(F.col("ord") / block).alias("_block"))
    line = Window.partitionBy("chrom").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("chrom", "_block").agg(F.sum("n").alias("_n")).select("chrom", "_block", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("chrom", "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(before, ["chrom", "_block"]).withColumn("_at", F.col("_before") + F.sum("n").over(inner) - F.col("n"))
    parts = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.col("n") - 1) / size))))
    skip = F.greatest(F.lit(0), F.col("chunk") * size - F.col("_at"))
    room = F.col("chunk") * size + size - F.col("_at") - skip
    piece = F.substring("seq", (skip + 1).cast("int"), room.cast("int"))
    own = parts.select("chrom", "chunk", F.struct(F.col("_at").alias("at"), piece.alias("seq")).alias("x")).groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return own.select("chrom", "chunk", F.array_join("x.seq", "").alias("seq"))


def bases_at(df: DataFrame, chunks: DataFrame, before: int, after: int, size: int = 1 << 16, pos: str = "pos") -> DataFrame:
    """``window``: bases from ``before`` before to ``after`` after the 1-based position, N beyond the ends. ``row_id`` must be unique."""
    first, last = F.col(pos) - 1 - before, F.col(pos) - 1 + after
    need = df.select("row_id", "chrom", first.alias("_a"), last.alias("_b"), F.explode(F.sequence(F.floor(F.greatest(first, F.lit(0)) / size), F.floor(F.greatest(last, F.lit(0)) / size))).alias("chunk"))
    got = need.join(chunks.hint("merge"), ["chrom", "chunk"]).select("row_id", "_a", "chunk", F.col("chunk").alias("_c"), F.substring("seq", F.greatest(F.lit(1), F.col("_a") - F.col("chunk") * size + 1).cast("int"), (F.col("_b") - F.greatest(F.col("_a"), F.col("chunk") * size) + 1).cast("int")).alias("_s"))
    whole = got.groupBy("row_id").agg(F.min("_a").alias("_a"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_s"))), lambda x: x["_s"]), "").alias("_seq"))
    length = before + after + 1
    padded = F.rpad(F.concat(F.repeat(F.lit("N"), F.greatest(F.lit(0), -F.col("_a")).cast("int")), F.col("_seq")), length, "N")
    return df.join(whole.select("row_id", padded.alias("window")).hint("merge"), "row_id", "left").withColumn("window", F.coalesce("window", F.lit("N" * length)))


def check_reference(df: DataFrame, chunks: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Swap alleles where the reference base is the other allele; drop rows where it is neither."""
    out = bases_at(df, chunks, 0, 0, size).withColumn("_base", F.upper("window")).drop("window").where("_base = ref or _base = alt")
    swap = F.col("_base") != F.col("ref")
    return out.withColumns({"ref": F.when(swap, F.col("alt")).otherwise(F.col("ref")), "alt": F.when(swap, F.col("ref")).otherwise(F.col("alt"))}).drop("_base")


def attach_consequences(variants: DataFrame, consequences: DataFrame, column: str = "consequence") -> DataFrame:
    """Left join on the variant key; tables stored by chromosome are pruned by Spark's own runtime filters."""
    return variants.join(consequences.select(*KEY, column).hint("merge"), KEY, "left")


#: Ranges of positions of a chromosome that are pushed to a scan.
RANGES = 64


def write_by_chromosome(df: DataFrame, path: str, files: int = 8) -> None:
    """A table of variants laid out for ``attach_from_table``: a folder for each chromosome, each file a range of positions in their order."""
    df.repartitionByRange(files * 8, "chrom", "pos").sortWithinPartitions("chrom", "pos").write.mode("overwrite").partitionBy("chrom").parquet(path)


def position_ranges(variants: DataFrame, width: int = 1 << 16, most: int = RANGES) -> dict[str, list[tuple[int, int]]]:
    """Ranges of positions that hold all of ``variants``, at most ``most`` a chromosome, cut at the widest gaps between blocks of ``width`` bases.
    Runs a job; the driver gets two numbers a block that holds a variant."""
    blocks = variants.groupBy("chrom", F.floor(F.col("pos") / width).alias("b")).agg(F.min("pos").alias("low"), F.max("pos").alias("high")).where("chrom is not null and b is not null")
    found: dict[str, list[tuple[int, int]]] = {}
    for chrom, _, low, high in sorted(map(tuple, blocks.toLocalIterator())):
        found.setdefault(chrom, []).append((low, high))
    for chrom, own in found.items():
        gaps = sorted(((own[i + 1][0] - own[i][1], i) for i in range(len(own) - 1)), reverse=True)[: most - 1]
        cuts = [-1, *sorted(i for _, i in gaps), len(own) - 1]
        found[chrom] = [(own[a + 1][0], own[b][1]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return found


def attach_from_table(variants: DataFrame, path: str, columns: Sequence[str]) -> DataFrame:
    """Left join of ``columns`` of a table that ``write_by_chromosome`` wrote, by the variant key. Only the folders of the variants' chromosomes are
    listed, and the ranges of their positions go to the scan as filters, so files and row groups without any are left unread. Runs a job to
    find the ranges."""
    table = variants.sparkSession.read.parquet(path).withColumn("chrom", F.col("chrom").cast("string"))
    wanted = position_ranges(variants)
    where = F.lit(False)
    for chrom, ranges in wanted.items():
        inside = F.lit(False)
        for low, high in ranges:
            inside = inside | F.col("pos").between(low, high)
        where = where | ((F.col("chrom") == chrom) & inside)
    # the filter by chromosome alone prunes folders, the ranges of all chromosomes together prune row groups
    low, high = min((r[0][0] for r in wanted.values()), default=0), max((r[-1][1] for r in wanted.values()), default=-1)
    few = table.where(F.col("chrom").isin(list(wanted)) & F.col("pos").between(low, high) & where)
    return variants.join(few.select(*KEY, *columns).hint("merge"), KEY, "left")


# Consequences of variants outside exons.
NON_EXONIC = ("intergenic_variant", "intron_variant", "upstream_gene_variant", "downstream_gene_variant")


def _nearest_of_both(spots: DataFrame, coding: DataFrame, noncoding: DataFrame, what: str) -> DataFrame:
    out = None
    for kind, table in (("pc", coding), ("nc", noncoding)):
        own = nearest(spots, table.select("chrom", "start", "end", "gene_id"), "gene_id")
        own = own.select("row_id", F.col("distance").alias(f"distance_{what}_{kind}"), F.col("gene_id").alias(f"{what}_closest_{kind}_gene_id"))
        out = own if out is None else out.join(own.hint("merge"), "row_id")
    first = F.col(f"distance_{what}_pc") <= F.col(f"distance_{what}_nc")
    gene = F.when(first, F.col(f"{what}_closest_pc_gene_id")).otherwise(F.col(f"{what}_closest_nc_gene_id"))
    return out.withColumns({f"distance_{what}": F.least(f"distance_{what}_pc", f"distance_{what}_nc"), f"{what}_closest_gene_id": gene})


def evaluation_table(
    variants: DataFrame, exons: tuple[DataFrame, DataFrame], starts: tuple[DataFrame, DataFrame], excluded: Sequence[str], exon_near: int, start_near: int, groups: dict[str, Sequence[str]]
) -> DataFrame:
    """The whole build of an evaluation set, sorted by coordinates.

    ``variants``: unique ``row_id``, the variant key, ``label``, ``consequence``, ``consequence_cre``. ``exons``, ``starts``: coding and non-coding features with
    ``gene_id``. Consequences in ``excluded`` go. Distances to and genes of the nearest exon and start of both kinds are attached.
    ``consequence_final`` is ``tss_proximal`` within ``start_near`` of a start for what lies outside exons, else ``exon_proximal`` within ``exon_near`` of an exon
    for introns, else ``consequence_cre``. Only final consequences that occur among positives stay. ``consequence_group`` is the name in ``groups``
    that lists the final consequence, or that itself; a null one fails the query.
    """
    own = variants.where(~F.col("consequence").isin(list(excluded)))
    spots = own.select("row_id", "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    out = own.join(_nearest_of_both(spots, *exons, "exon").hint("merge"), "row_id").join(_nearest_of_both(spots, *starts, "tss").hint("merge"), "row_id")
    near_start = F.col("consequence").isin(*NON_EXONIC) & (F.col("distance_tss") <= start_near)
    near_exon = (F.col("consequence") == "intron_variant") & (F.col("distance_exon") <= exon_near)
    out = out.withColumn("consequence_final", F.when(near_start, "tss_proximal").when(near_exon, "exon_proximal").otherwise(F.col("consequence_cre")))
    out = keep_positive_classes(out, "consequence_final")
    names = {c: g for g, own in groups.items() for c in own}
    group = F.coalesce(*[F.when(F.col("consequence_final") == c, F.lit(g)) for c, g in names.items()], F.col("consequence_final"))
    checked = F.coalesce(group, F.raise_error(F.lit("a variant without a group")).cast("string"))
    return out.withColumn("consequence_group", checked).orderBy(*KEY)


def dual_nearest(variants: DataFrame, coding: DataFrame, noncoding: DataFrame, near: int, override: str) -> DataFrame:
    """Distances to the nearest coding and non-coding feature (``gene_id``), the smaller of them with its gene (the coding one on a tie), and
    ``consequence`` replaced by ``override`` within ``near`` bases of a feature."""
    spots = variants.select("row_id", "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    found = []
    for name, table in (("pc", coding), ("nc", noncoding)):
        found.append(nearest(spots, table.select("chrom", "start", "end", "gene_id"), "gene_id").select("row_id", F.col("distance").alias(f"distance_{name}"), F.col("gene_id").alias(f"gene_{name}")))
    out = variants.join(found[0].hint("merge"), "row_id").join(found[1].hint("merge"), "row_id")
    first = F.col("distance_nc").isNull() | (F.col("distance_pc") <= F.col("distance_nc"))
    out = out.withColumns({"distance": F.least("distance_pc", "distance_nc"), "gene": F.when(first, F.col("gene_pc")).otherwise(F.col("gene_nc"))})
    return out.withColumn("consequence", F.when(F.col("distance") <= near, F.lit(override)).otherwise(F.col("consequence")))


def keep_positive_classes(df: DataFrame, column: str = "consequence") -> DataFrame:
    """Rows whose class occurs among the positives."""
    return df.join(df.where("label").select(column).distinct(), column, "left_semi")


def unambiguous(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of keys with one distinct value in each column (null counts as a value)."""
    n = df.groupBy(key).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"_{c}") for c in columns])
    return df.join(n.where(" and ".join(f"`_{c}` = 1" for c in columns)).select(key).hint("merge"), key, "left_semi")
