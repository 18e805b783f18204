"""Readers of genomics text formats as DataFrames with declared schemas; files in any store that Spark reads, compressed or not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import group_one
from ..operators import intervals

GTF = "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attribute string"


def _tsv(spark: SparkSession, path: str | list[str], schema: str, **options: str) -> DataFrame:
    return spark.read.schema(schema).options(sep="\t", **options).csv(path)


def read_gtf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """GTF or GFF rows with a strand, start made 0-based."""
    return _tsv(spark, path, GTF, comment="#", quote="").withColumn("start", F.col("start") - 1).where(F.col("strand").isin("+", "-"))


def read_bed(spark: SparkSession, path: str | list[str], merged: bool = True) -> DataFrame:
    rows = _tsv(spark, path, "chrom string, start long, end long", comment="#", mode="PERMISSIVE")
    return intervals.merge(rows) if merged else rows


def read_bed4(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _tsv(spark, path, "chrom string, start long, end long, name string", comment="#")


def read_projected_bed(spark: SparkSession, path: str | list[str], species: str) -> DataFrame:
    rows = _tsv(spark, path, "t_chrom string, t_start long, t_end long, query_name string, score string, t_strand string")
    return rows.drop("score").withColumn("species", F.lit(species))


def read_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignment hits; an empty file gives no rows."""
    return _tsv(spark, path, "query string, target string, tstart long, tend long, bits double, evalue double, fident double, qcov double, tcov double")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``id, seq``: a record a row, whatever its line breaks; the id ends at the first blank."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^(\S*)", 1)
    return records.select(head.alias("id"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "").alias("seq"))


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Single-nucleotide rows (by length and by ``CLNVC``; rows without it go) with one alternative, and INFO as a map."""
    rows = _tsv(spark, path, "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string", comment="#", quote="")
    info = F.str_to_map("info", F.lit(";"), F.lit("="))
    one = rows.withColumn("info", info).where(~F.col("alt").contains(",") & (F.length("ref") == 1) & (F.length("alt") == 1))
    return one.where(F.try_element_at("info", F.lit("CLNVC")) == "single_nucleotide_variant")


def read_table(spark: SparkSession, path: str | list[str], columns: dict[str, str], sep: str = "\t", nulls: str = "NA", rename: dict[str, str] | None = None) -> DataFrame:
    """A table with a header: only the named columns, cast to the given types (null where a value doesn't fit), with a null token, and renamed."""
    raw = spark.read.options(header="true", sep=sep, nullValue=nulls, enforceSchema="false").csv(path)
    return raw.select(*[F.col(c).try_cast(t).alias((rename or {}).get(c, c)) for c, t in columns.items()])


def read_sheets(spark: SparkSession, paths: list[str], columns: dict[str, str]) -> DataFrame:
    """The sheets of a workbook, saved as CSV in their order, together; the first one is a title page and left out."""
    out = None
    for path in paths[1:]:
        own = read_table(spark, path, columns, ",")
        out = own if out is None else out.unionByName(own)
    return out


def read_locus_table(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """Tables with ``locus`` (chrom:pos) and ``alleles`` (["A","C"]) columns, parsed; ``AF`` is folded."""
    raw = spark.read.options(header="true", sep="\t").csv(path)
    alleles = F.split(F.regexp_replace("alleles", r'[\[\]"\s]', ""), ",")
    out = raw.select(F.split("locus", ":")[0].alias("chrom"), F.split("locus", ":")[1].cast("long").alias("pos"), alleles[0].alias("ref"), alleles[1].alias("alt"), *columns)
    return out.withColumn("MAF", F.least(F.col("AF").cast("double"), 1.0 - F.col("AF").cast("double"))) if "AF" in columns else out


def read_regions_bed(spark: SparkSession, path: str | list[str], chroms: Sequence[str]) -> DataFrame:
    """Candidate regulatory regions: chromosome without ``chr``, start, end and class (sixth column), on the given chromosomes."""
    rows = _tsv(spark, path, "chrom string, start long, end long, a string, b string, cre_class string")
    return rows.withColumn("chrom", F.regexp_replace("chrom", "^chr", "")).where(F.col("chrom").isin(*chroms)).select("chrom", "start", "end", "cre_class")


def read_bedgraph(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A signal track as runs; NaN becomes a gap."""
    rows = spark.read.text(path).where(~F.col("value").rlike("^(track|browser|#)"))
    part = F.split("value", r"\s+")
    out = rows.select(part[0].alias("chrom"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"), part[3].cast("double").alias("value"))
    return out.where(~F.isnan("value"))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "chrom string, size long")


def read_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct trimmed lines without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')").distinct()


def read_taxonomy(spark: SparkSession, path: str | list[str], ranks: Sequence[str]) -> DataFrame:
    """JSON lines with ``accession`` and a nested classification; a missing rank is null."""
    rows = spark.read.text(path)
    cols = [F.get_json_object("value", f"$.taxonomy.classification.{r}.name").alias(r) for r in ranks]
    return rows.select(F.get_json_object("value", "$.accession").alias("accession"), *cols)


def with_taxonomy(genomes: DataFrame, taxonomy: DataFrame, key: str = "accession", unknown: str = "unknown") -> DataFrame:
    """``genomes`` with the ranks of their accession; a missing accession or rank is ``unknown``, a repeated accession of the taxonomy counts once."""
    ranks = [c for c in taxonomy.columns if c != key]
    once = taxonomy.groupBy(key).agg(*[F.max(c).alias(c) for c in ranks])
    return genomes.join(once, key, "left").fillna(unknown, ranks)


def read_newick_leaves(spark: SparkSession, path: str) -> DataFrame:
    """Leaf names of a tree; names of inner nodes, which follow a bracket, are left out."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(r"[(,]\s*([^(),:;\s]+)"), F.lit(1))).alias("leaf"))


def read_after_header(spark: SparkSession, path: str, lines: int, columns: Sequence[str]) -> DataFrame:
    """A small TSV (each file is one row at first) with free text in its first ``lines`` lines, which are told by their place in the file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    part = F.split("line", "\t")
    return rows.where((F.col("at") >= lines) & (F.col("line") != "")).select(*[F.get(part, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def drop_reverse_complements(df: DataFrame, column: str = "id") -> DataFrame:
    return df.where(~F.col(column).endswith("_-"))


def split_id(df: DataFrame, column: str = "id") -> DataFrame:
    """``chrom:start-end`` taken apart at its last colon."""
    place = F.substring_index(column, ":", -1)
    return df.withColumns({"chrom": group_one(F.col(column), r"^(.*):[^:]*$"), "start": F.split(place, "-")[0].cast("long"), "end": group_one(place, r"-(\d+)").cast("long")})


def read_getfasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``name, strand, seq`` of records of two lines each, ``>name(strand)`` and the sequence; a record of another shape fails the query."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    form = r"^(.*)\(([+-])\)\r?\n([^\n]+)\n?$"
    good = F.when(F.col("value").rlike(form), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("malformed record: "), F.substring("value", 1, 60))).cast("string"))
    return records.select(*[F.regexp_extract(good, form, i).alias(n) for i, n in enumerate(("name", "strand", "seq"), 1)])


def read_parquet_intervals(spark: SparkSession, path: str | list[str], merged: bool = True) -> DataFrame:
    rows = spark.read.parquet(path if isinstance(path, str) else path[0], *([] if isinstance(path, str) else path[1:])).select("chrom", "start", "end")
    return intervals.merge(rows) if merged else rows


def parquet_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table; Spark reads only the files' footers for it."""
    return spark.read.parquet(path).count()


def read_registry(spark: SparkSession, path: str, families: Sequence[str]) -> DataFrame:
    """A small registry of methods, a JSON list of objects with ``id`` and ``family``; repeated ids and unknown families are errors."""
    rows = spark.read.option("multiLine", "true").json(path)
    bad = rows.where(~F.coalesce(F.col("family").isin(*families), F.lit(False))).select("id").union(rows.groupBy("id").count().where("count > 1").select("id")).limit(20).collect()
    if bad:
        raise ValueError(f"repeated ids or unknown families: {sorted(str(r[0]) for r in bad)}")
    return rows


def read_composition(spark: SparkSession, path: str, labels: Sequence[str]) -> DataFrame:
    """``label, n, fraction`` rows of the known labels."""
    return read_table(spark, path, {"label": "string", "n": "long", "fraction": "double"}).where(F.col("label").isin(*labels))
