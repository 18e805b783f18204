"""Features of gene annotation tables (GTF rows with a 0-based start and ``attribute`` text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import group_one
from . import intervals

# Biotypes of non-coding transcripts that count as functional.
NCRNA_BIOTYPES = (
    "lnc_RNA", "miRNA", "snoRNA", "tRNA", "snRNA", "rRNA", "antisense_RNA", "ncRNA", "scRNA",
    "vault_RNA", "Y_RNA", "scaRNA", "RNase_P_RNA", "RNase_MRP_RNA", "telomerase_RNA", "SRP_RNA", "piRNA",
)


def attribute(name: str, column: str = "attribute") -> Column:
    """The value of ``name "value";``, null without it."""
    return group_one(F.col(column), rf'(?:^|[ ;]){name} "([^"]*)"')


def with_attributes(ann: DataFrame, *names: str) -> DataFrame:
    return ann.withColumns({n: attribute(n) for n in names})


def transcript_exons(ann: DataFrame, biotypes: Sequence[str] | None = None) -> DataFrame:
    """Exons with ``transcript_id``: those of messenger RNA (by biotype or gbkey), or of the given biotypes."""
    rows = with_attributes(ann.where("feature = 'exon'"), "transcript_id", "transcript_biotype", "gbkey", "gene_id")
    if biotypes is None:
        return rows.where("transcript_biotype = 'mRNA' or gbkey = 'mRNA'")
    return rows.where(F.col("transcript_biotype").isin(*biotypes))


def ncrna_exons(ann: DataFrame, biotypes: Sequence[str] = NCRNA_BIOTYPES) -> DataFrame:
    """Exons of functional non-coding RNA, by biotype or gbkey. Pseudogenes (by mark or by a biotype of transcript or gene), partial
    records, unspecific transcripts, decay candidates and low-quality products are left out."""
    rows = with_attributes(ann.where("feature = 'exon'"), "transcript_id", "transcript_biotype", "gbkey", "gene_id", "gene_biotype", "description", "product")
    has = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    marked = has("attribute", '(pseudo|partial) "true"') | has("transcript_biotype", "(?i)pseudogenic|^(primary_)?transcript$") | has("gene_biotype", "(?i)pseudogene")
    doubtful = has("description", "(?i)NMD candidate") | has("product", "(?i)NMD candidate") | has("product", "LOW QUALITY")
    return rows.where((F.col("transcript_biotype").isin(*biotypes) | F.col("gbkey").isin(*biotypes)) & ~marked & ~doubtful)


def coding(ann: DataFrame) -> DataFrame:
    """Coding stretches with ``transcript_id``, by feature or gbkey."""
    rows = with_attributes(ann, "transcript_id", "gbkey")
    return rows.where("feature = 'CDS' or gbkey = 'CDS'")


def exon_set(ann: DataFrame) -> DataFrame:
    return intervals.merge(ann.where("feature = 'exon'"))


def masking_exons(ann: DataFrame, excluded: Sequence[str] = ("TEC", "artifact")) -> DataFrame:
    """Exons to mask: rows of excluded biotypes go and rows without a biotype stay, if fewer than half lack one; else all rows stay."""
    rows = with_attributes(ann.where("feature = 'exon'"), "transcript_biotype")
    n = rows.agg(F.count("*").alias("n"), F.sum(F.col("transcript_biotype").isNull().cast("long")).alias("null")).first()
    if (n["null"] or 0) < n["n"] // 2:
        rows = rows.where(F.col("transcript_biotype").isNull() | ~F.col("transcript_biotype").isin(*excluded))
    return intervals.merge(rows)


def functional_exons(ann: DataFrame, excluded: Sequence[str] = ("TEC", "artifact")) -> DataFrame:
    """Exons whose biotype is known and not excluded."""
    return intervals.merge(with_attributes(ann.where("feature = 'exon'"), "transcript_biotype").where(~F.col("transcript_biotype").isin(*excluded)))


def extents(exons: DataFrame) -> DataFrame:
    return exons.groupBy("transcript_id").agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.min("start").alias("start"), F.max("end").alias("end"))


def promoters(exons: DataFrame, upstream: int, downstream: int) -> DataFrame:
    """Windows about each transcript's first base along its strand, merged."""
    start = F.when(F.col("strand") == "+", F.col("start") - upstream).otherwise(F.col("end") - downstream)
    t = extents(exons).select("chrom", start.alias("start"))
    return intervals.merge(t.withColumn("end", F.col("start") + upstream + downstream))


def _beside_coding(exons: DataFrame, cds: DataFrame, five: bool) -> DataFrame:
    bounds = cds.groupBy("transcript_id").agg(F.min("start").alias("cds_start"), F.max("end").alias("cds_end"))
    rows = exons.join(bounds.hint("merge"), "transcript_id")
    low = (F.col("strand") == "+") if five else (F.col("strand") == "-")
    part = rows.withColumns({"_s": F.when(low, F.col("start")).otherwise(F.greatest("start", "cds_end")), "_e": F.when(low, F.least("end", "cds_start")).otherwise(F.col("end"))})
    return intervals.merge(part.where("_s < _e").select("chrom", F.col("_s").alias("start"), F.col("_e").alias("end")))


def utr5(exons: DataFrame, cds: DataFrame) -> DataFrame:
    """Exon parts before the coding stretch of their transcript, merged."""
    return _beside_coding(exons, cds, True)


def utr3(exons: DataFrame, cds: DataFrame) -> DataFrame:
    return _beside_coding(exons, cds, False)


def beside_cds(cds: DataFrame, n: int, upstream: bool) -> DataFrame:
    """``n`` bases before (or after) each transcript's coding stretch along its strand, merged."""
    t = extents(cds)
    low = (F.col("strand") == "+") if upstream else (F.col("strand") == "-")
    return intervals.merge(t.select("chrom", F.when(low, F.col("start") - n).otherwise(F.col("end")).alias("start"), F.when(low, F.col("start")).otherwise(F.col("end") + n).alias("end")))


def start_sites(ann: DataFrame, keep: Column | None = None) -> DataFrame:
    """Distinct one-base start sites of transcripts with ``gene_id``; ``keep`` is a condition on ``gene_biotype``, ``transcript_biotype``."""
    rows = with_attributes(ann.where("feature = 'transcript'"), "gene_id", "gene_biotype", "transcript_biotype")
    rows = rows if keep is None else rows.where(keep)
    at = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end") - 1)
    return rows.select("chrom", at.alias("start"), (at + 1).alias("end"), "gene_id").distinct()


def canonical(ann: DataFrame, tag: str = "Ensembl_canonical") -> DataFrame:
    """Rows of transcripts whose transcript row bears the tag."""
    rows = with_attributes(ann, "transcript_id")
    tagged = rows.where((F.col("feature") == "transcript") & F.col("attribute").contains(f'tag "{tag}"')).select("transcript_id").distinct()
    return rows.join(tagged.hint("merge"), "transcript_id", "left_semi")


def gene_biotypes(ann: DataFrame) -> DataFrame:
    return with_attributes(ann, "gene_id", "gene_biotype").where("gene_id is not null").select("gene_id", "gene_biotype").distinct()


def spliced_distance(variants: DataFrame, exons: DataFrame, cds: DataFrame) -> DataFrame:
    """Least and greatest distance, counted over exon bases only, of each position (``chrom, pos``, 0-based) to the coding start or end of the
    transcripts whose exons hold it: bases of exons between the position and the nearest coding bound along the transcript; 0 inside it."""
    bounds = cds.groupBy("transcript_id").agg(F.min("start").alias("cds_start"), F.max("end").alias("cds_end"))
    from .interval_joins import overlap_join

    spots = variants.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")).distinct()
    held = overlap_join(spots, exons.select("chrom", "start", "end", "transcript_id")).select("chrom", F.col("start").alias("pos"), F.col("transcript_id_b").alias("transcript_id")).distinct()
    pairs = held.join(bounds.hint("merge"), "transcript_id").join(exons.select("transcript_id", F.col("start").alias("s"), F.col("end").alias("e")).hint("merge"), "transcript_id")
    between = lambda a, b: F.greatest(F.lit(0), F.least("e", b) - F.greatest("s", a))
    left, right = between(F.col("pos"), F.col("cds_start")), between(F.col("cds_end"), F.col("pos") + 1)
    per = pairs.groupBy("chrom", "pos", "transcript_id").agg(F.sum(F.when(F.col("pos") < F.col("cds_start"), left).when(F.col("pos") >= F.col("cds_end"), right).otherwise(0)).alias("d"))
    return per.groupBy("chrom", "pos").agg(F.min("d").alias("least"), F.max("d").alias("greatest"))


def transcript_set(ann: DataFrame) -> DataFrame:
    """Exons of messenger RNA and of functional non-coding RNA, merged."""
    return intervals.merge(functional_transcript_exons(ann))


def functional_transcript_exons(ann: DataFrame) -> DataFrame:
    columns = ["chrom", "start", "end", "strand", "transcript_id"]
    return transcript_exons(ann).select(columns).union(ncrna_exons(ann).select(columns))


def coding_set(ann: DataFrame) -> DataFrame:
    return intervals.merge(coding(ann))


def exons_of_biotype(ann: DataFrame, biotypes: Sequence[str] | None = ("protein_coding",)) -> DataFrame:
    """Exons with ``transcript_id`` in the vocabulary that says ``protein_coding``; of all transcripts where ``biotypes`` is None."""
    rows = with_attributes(ann.where("feature = 'exon'"), "transcript_id", "transcript_biotype", "gene_id").where("transcript_id is not null")
    return rows if biotypes is None else rows.where(F.col("transcript_biotype").isin(*biotypes))


def gene_bodies(ann: DataFrame) -> DataFrame:
    return intervals.merge(ann.where("feature = 'gene'"))


def noncoding_exons(ann: DataFrame, biotypes: Sequence[str]) -> DataFrame:
    """Exons of the listed transcript biotypes, without pseudogenes and partial records; the list must not be empty."""
    if not biotypes:
        raise ValueError("name at least one biotype")
    rows = with_attributes(ann.where("feature = 'exon'"), "transcript_id", "transcript_biotype", "gene_biotype").where(F.col("transcript_biotype").isin(*biotypes))
    bad = F.col("attribute").rlike('(pseudo|partial) "true"') | F.coalesce(F.col("gene_biotype").rlike("(?i)pseudogene"), F.lit(False)) | F.col("transcript_biotype").rlike("(?i)pseudogenic")
    return rows.where(~F.coalesce(bad, F.lit(False)))


def require_protein_coding(ann: DataFrame) -> DataFrame:
    """``ann``, or an error if none of its transcripts is called ``protein_coding`` (the other vocabulary says ``mRNA``)."""
    named = ann.where(F.col("feature") == "transcript").where(attribute("transcript_biotype") == "protein_coding")
    if named.isEmpty():
        raise ValueError("no protein_coding transcript: another annotation vocabulary")
    return ann


def start_bands(exons: DataFrame, flank: int) -> DataFrame:
    """``flank`` bases to both sides of each transcript's start, merged."""
    return promoters(exons, flank, flank)


def coding_bounds(ann: DataFrame) -> DataFrame:
    """``transcript_id, cds_start, cds_end`` over the coding rows of each transcript."""
    return coding(ann).groupBy("transcript_id").agg(F.min("start").alias("cds_start"), F.max("end").alias("cds_end"))


def utr3_table(ann: DataFrame) -> DataFrame:
    """Parts of messenger exons behind the coding stretch, with its bounds, ``gene_id`` and ``gene_name`` (null where none is given)."""
    rows = transcript_exons(ann).withColumn("gene_name", attribute("gene")).join(coding_bounds(ann).hint("merge"), "transcript_id")
    plus = F.col("strand") == "+"
    part = rows.withColumns({"start": F.when(plus, F.greatest("start", "cds_end")).otherwise(F.col("start")), "end": F.when(plus, F.col("end")).otherwise(F.least("end", "cds_start"))})
    return part.where("start < end").select("chrom", "start", "end", "strand", "transcript_id", "cds_start", "cds_end", "gene_id", "gene_name")


def coding_table(ann: DataFrame) -> DataFrame:
    return with_attributes(ann.where("feature = 'CDS'"), "transcript_id", "gene_id").select("chrom", "start", "end", "strand", "transcript_id", "gene_id")


def messenger_exon_table(ann: DataFrame) -> DataFrame:
    return transcript_exons(ann).select("chrom", "start", "end", "strand", "transcript_id", "gene_id")


def noncoding_table(ann: DataFrame, biotypes: Sequence[str] = NCRNA_BIOTYPES) -> DataFrame:
    """Exons of everything but messenger RNA that has a biotype (else the gbkey), and whether that is a listed one."""
    rows = with_attributes(ann.where("feature = 'exon'"), "transcript_id", "transcript_biotype", "gbkey", "gene_id").withColumn("gene_name", attribute("gene"))
    rows = rows.withColumn("biotype", F.coalesce("transcript_biotype", "gbkey")).where("biotype is not null and coalesce(transcript_biotype, '') <> 'mRNA' and coalesce(gbkey, '') <> 'mRNA'")
    return rows.select("chrom", "start", "end", "strand", "transcript_id", "gene_id", "gene_name", "biotype", F.col("biotype").isin(*biotypes).alias("in_list"))


def distance_to_cds(start: str | Column, cds_start: str | Column, cds_end: str | Column, strand: str | Column) -> Column:
    """Bases, introns included, from the end of the coding stretch along the strand to a 0-based position behind it."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(strand) == "+", c(start) - c(cds_end)).otherwise(c(cds_start) - c(start) - 1)


def transcript_sizes(exons: DataFrame) -> DataFrame:
    """Summed exon lengths of each transcript."""
    return exons.groupBy("transcript_id").agg(F.sum(F.col("end") - F.col("start")).alias("transcript_size"))


def least_size_at(positions: DataFrame, exons: DataFrame) -> DataFrame:
    """Per ``chrom, pos`` the size of the smallest of its transcripts; ``positions`` has ``chrom, pos, transcript_id``."""
    return positions.join(transcript_sizes(exons).hint("merge"), "transcript_id", "left").groupBy("chrom", "pos").agg(F.min("transcript_size").alias("transcript_size"))
