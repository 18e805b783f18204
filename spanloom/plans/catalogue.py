"""A query for each operator over the demo views, and the same result in plain SQL for DuckDB.

Every query is a callable of ``(spark, sf_dir)``. Bounds are named ``s`` and ``e`` in results, and doubles are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import sequence as Q
from ..operators import aggregates, annotation, interval_joins, intervals, matching, metrics, sampling, selection, signal, variants
from .views import sql_for_duckdb, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name. It gets a function from a view's name to its DataFrame."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: view(spark, sf_dir, name)).withColumnsRenamed({"start": "s", "end": "e"})

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql_for_duckdb(sql)
        return f

    return register


def merged(name: str, source: str) -> str:
    """Common table expressions that end in ``name``, the merged intervals of ``source``."""
    return f"""{name}_x AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({source}) AS src),
{name}_y AS (SELECT chrom, s, e, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_x),
{name} AS (SELECT chrom, min(s) AS s, max(e) AS e FROM {name}_y GROUP BY chrom, island)"""


def covered(name: str, windows: str, region: str, key: str = "row_id") -> str:
    return f"{name} AS (SELECT w.{key}, sum(least(w.e, m.e) - greatest(w.s, m.s)) AS bp FROM {windows} AS w JOIN {region} AS m ON w.chrom = m.chrom AND w.s < m.e AND m.s < w.e GROUP BY w.{key})"


def without(name: str, a: str, b: str) -> str:
    """What the merged ``a`` has and the merged ``b`` has not."""
    return f"""{name}_o AS (SELECT a.chrom, a.s, a.e, b.s AS bs, b.e AS be FROM {a} AS a LEFT JOIN {b} AS b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e),
{name}_g AS (SELECT *, lag(be) OVER (PARTITION BY chrom, s ORDER BY bs) AS pe, lead(bs) OVER (PARTITION BY chrom, s ORDER BY bs) AS nb FROM {name}_o),
{name} AS (SELECT * FROM (SELECT chrom, coalesce(pe, s) AS s, coalesce(bs, e) AS e FROM {name}_g UNION ALL SELECT chrom, be, e FROM {name}_g WHERE nb IS NULL AND be IS NOT NULL) AS pieces WHERE s < e)"""


def r6(name: str):
    return F.round(F.col(name).cast("double"), 6).alias(name)


A, B = merged("ma", "SELECT chrom, s, e FROM iv_a"), merged("mb", "SELECT chrom, s, e FROM iv_b")


@query(f"WITH {A} SELECT chrom, s, e FROM ma")
def interval_merge(v):
    return intervals.merge(v("iv_a"))


@query(f"WITH {merged('m', 'SELECT chrom, s, e FROM iv_a UNION ALL SELECT chrom, s, e FROM iv_b')} SELECT chrom, s, e FROM m")
def interval_union(v):
    return intervals.union(v("iv_a"), v("iv_b"))


@query(f"WITH {A}, {B} SELECT ma.chrom, greatest(ma.s, mb.s) AS s, least(ma.e, mb.e) AS e FROM ma JOIN mb ON ma.chrom = mb.chrom AND ma.s < mb.e AND mb.s < ma.e")
def interval_intersect(v):
    return intervals.intersect(v("iv_a"), v("iv_b"))


@query(f"WITH {A}, {B}, {without('d', 'ma', 'mb')} SELECT chrom, s, e FROM d")
def interval_subtract(v):
    return intervals.subtract(v("iv_a"), v("iv_b"))


@query(f"WITH {B}, sizes AS (SELECT chrom, CAST(0 AS BIGINT) AS s, max(e) + 100 AS e FROM iv_b GROUP BY chrom), {without('d', 'sizes', 'mb')} SELECT chrom, s, e FROM d")
def interval_complement(v):
    return intervals.complement(v("iv_b"), v("iv_b").groupBy("chrom").agg((F.max("end") + 100).alias("size")))


@query("SELECT row_id, chrom, s, e FROM iv_b AS b WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM iv_a WHERE e - s > 25) AS a WHERE a.chrom = b.chrom AND a.s < b.e AND b.s < a.e)")
def interval_not_overlapping(v):
    return interval_joins.not_overlapping(v("iv_b"), v("iv_a").where(F.col("end") - F.col("start") > 25))


@query("SELECT count(*) AS n FROM iv_b AS b WHERE EXISTS (SELECT 1 FROM iv_a AS a WHERE a.chrom = b.chrom AND a.s < b.e AND b.s < a.e)")
def interval_semi_overlap(v):
    return interval_joins.overlap_join(v("iv_b"), v("iv_a"), "left_semi").agg(F.count("*").alias("n"))


@query(f"WITH {A}, {covered('c', 'iv_b', 'ma')} SELECT b.row_id, b.chrom, b.s, b.e FROM iv_b AS b JOIN c ON b.row_id = c.row_id WHERE c.bp >= b.e - b.s")
def interval_within(v):
    return interval_joins.within(v("iv_b"), v("iv_a"))


@query(f"WITH {A}, {covered('c', 'iv_b', 'ma')} SELECT b.row_id, b.chrom, b.s, b.e, CAST(coalesce(c.bp, 0) AS BIGINT) AS covered FROM iv_b AS b LEFT JOIN c ON b.row_id = c.row_id")
def coverage_bp(v):
    return interval_joins.coverage(v("iv_b"), v("iv_a"))


@query("SELECT row_id, chrom, s - CAST(floor((30 - (e - s)) / CAST(2 AS DOUBLE)) AS BIGINT) AS s, s - CAST(floor((30 - (e - s)) / CAST(2 AS DOUBLE)) AS BIGINT) + 30 AS e FROM iv_b")
def interval_resize(v):
    return intervals.resize(v("iv_b"), 30)


@query("WITH p AS (SELECT *, CAST(greatest(ceil((30 - (e - s)) / CAST(2 AS DOUBLE)), 0) AS BIGINT) AS pad FROM iv_b) SELECT row_id, chrom, s - pad AS s, e + pad AS e FROM p")
def interval_expand_min(v):
    return intervals.expand_min_size(v("iv_b"), 30)


@query("WITH p AS (SELECT row_id, chrom, greatest(s - 50, 0) AS s, least(e + 50, 70000) AS e FROM iv_b) SELECT *, concat(chrom, ':', s, '-', e) AS name FROM p WHERE s < e")
def interval_flank_clamped(v):
    return intervals.flank_clamped(v("iv_b").withColumn("size", F.lit(70000).cast("long")), 50).drop("size")


@query("WITH p AS (SELECT row_id, chrom, greatest(0, least(CAST(floor((s + e) / CAST(2 AS DOUBLE)) AS BIGINT) - 127, 1000000 - 255)) AS s FROM iv_b) SELECT row_id, chrom, s, s + 255 AS e FROM p")
def clamp_resize(v):
    return intervals.clamp_resize(v("iv_b"), 255, F.lit(1000000).cast("long"))


@query("SELECT count(*) AS n_intervals, CAST(sum(e - s) AS BIGINT) AS total_size FROM iv_a WHERE e - s BETWEEN 10 AND 20")
def interval_size_filter(v):
    return intervals.accessors(intervals.filter_size(v("iv_a"), 10, 20))


@query("SELECT gene, chrom, strand, s, s + 64 AS e FROM (SELECT gene, chrom, strand, unnest(range(s, e - 64 + 1, 32)) AS s FROM genes) AS t")
def tile_sliding(v):
    return intervals.tile(v("genes"), 64, 32)


@query("SELECT chrom, s, s + 4096 AS e FROM (SELECT chrom, unnest(range(0, max(e) - 4096 + 1, 4096)) AS s FROM iv_b GROUP BY chrom) AS t")
def tile_chromosomes(v):
    return intervals.tile_chromosomes(v("iv_b").groupBy("chrom").agg(F.max("end").alias("size")), 4096)


@query("SELECT b.row_id, g.gene FROM iv_b AS b JOIN genes AS g ON b.chrom = g.chrom AND b.s < g.e AND g.s < b.e")
def overlap_join(v):
    return interval_joins.overlap_join(v("iv_b"), v("genes")).select("row_id", F.col("gene_b").alias("gene"))


@query("SELECT x.row_id, count(*) AS n FROM variants AS x JOIN iv_b AS b ON x.chrom = b.chrom AND x.pos - 1 < b.e AND b.s < x.pos GROUP BY x.row_id")
def point_in_interval(v):
    points = v("variants").select("row_id", "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    return interval_joins.overlap_join(points, v("iv_b")).groupBy("row_id").agg(F.count("*").alias("n"))


def _nearest_sql(name: str, genes: str) -> str:
    return f"""{name} AS (SELECT row_id, gene, distance FROM (SELECT x.row_id, g.gene, greatest(0, greatest(g.s - x.pos, x.pos - 1 - g.e)) AS distance,
  row_number() OVER (PARTITION BY x.row_id ORDER BY greatest(0, greatest(g.s - x.pos, x.pos - 1 - g.e)), CASE WHEN g.s < x.pos AND x.pos - 1 < g.e THEN 0 ELSE 1 END, g.gene) AS k
  FROM variants AS x JOIN ({genes}) AS g ON x.chrom = g.chrom) AS t WHERE k = 1)"""


@query(f"WITH {_nearest_sql('n', 'SELECT * FROM genes')} SELECT x.row_id, n.distance, n.gene FROM variants AS x LEFT JOIN n ON x.row_id = n.row_id")
def nearest_distance(v):
    points = v("variants").select("row_id", "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    return interval_joins.nearest(points, v("genes").select("chrom", "start", "end", "gene"), "gene").select("row_id", "distance", "gene")


@query(f"""WITH {_nearest_sql('p', 'SELECT * FROM genes WHERE gene % 48 < 24')}, {_nearest_sql('q', 'SELECT * FROM genes WHERE gene % 48 >= 24')},
d AS (SELECT x.row_id, p.distance AS distance_pc, q.distance AS distance_nc, p.gene AS gp, q.gene AS gq, x.subset FROM variants AS x LEFT JOIN p ON x.row_id = p.row_id LEFT JOIN q ON x.row_id = q.row_id)
SELECT row_id, distance_pc, distance_nc, least(distance_pc, distance_nc) AS distance, CASE WHEN distance_nc IS NULL OR distance_pc <= distance_nc THEN gp ELSE gq END AS gene,
  CASE WHEN least(distance_pc, distance_nc) <= 30 THEN 'near_gene' ELSE subset END AS consequence FROM d""")
def dual_nearest_override(v):
    genes = v("genes").withColumnRenamed("gene", "gene_id")
    out = variants.dual_nearest(v("variants").withColumnRenamed("subset", "consequence"), genes.where("gene_id % 48 < 24"), genes.where("gene_id % 48 >= 24"), 30, "near_gene")
    return out.select("row_id", "distance_pc", "distance_nc", "distance", "gene", "consequence")


@query(f"""WITH {A}, bins AS (SELECT gene * 4 + k AS row_id, gene, k, chrom, s + k * 64 AS s, s + k * 64 + 64 AS e FROM genes CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) AS ks), {covered('c', 'bins', 'ma')}
SELECT gene AS row_id, string_agg(CASE WHEN coalesce(bp, 0) >= 32 THEN '1' ELSE '0' END, '' ORDER BY k) AS labels, CAST(sum(CASE WHEN coalesce(bp, 0) >= 32 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive_bins
FROM bins LEFT JOIN c ON bins.row_id = c.row_id GROUP BY gene""")
def bin_labels(v):
    windows = v("genes").select(F.col("gene").alias("row_id"), "chrom", "start", (F.col("start") + 256).alias("end"))
    return interval_joins.bin_labels(windows, v("iv_a"), 64, 4, 0.5).select("row_id", F.array_join(F.col("labels").cast("array<string>"), "").alias("labels"), "n_positive_bins")


_REGIONS = {"cds": "SELECT chrom, s, e FROM iv_a WHERE e - s <= 15", "utr": "SELECT chrom, s, e FROM iv_a WHERE e - s > 15 AND e - s <= 30", "gene": "SELECT chrom, s, e FROM genes"}


@query(f"""WITH w AS (SELECT row_id, chrom, s - CAST(floor((255 - (e - s)) / CAST(2 AS DOUBLE)) AS BIGINT) AS s, s - CAST(floor((255 - (e - s)) / CAST(2 AS DOUBLE)) AS BIGINT) + 255 AS e FROM iv_b),
{', '.join(merged(f'm_{n}', s) for n, s in _REGIONS.items())}, {merged('m_fun', _REGIONS['cds'] + ' UNION ALL ' + _REGIONS['utr'])},
{', '.join(covered(f'c_{n}', 'w', f'm_{n}') for n in (*_REGIONS, 'fun'))},
f AS (SELECT w.row_id, coalesce(c_cds.bp, 0) / CAST(255 AS DOUBLE) AS cds, coalesce(c_utr.bp, 0) / CAST(255 AS DOUBLE) AS utr, coalesce(c_gene.bp, 0) / CAST(255 AS DOUBLE) AS gene, coalesce(c_fun.bp, 0) / CAST(255 AS DOUBLE) AS fun
  FROM w LEFT JOIN c_cds ON w.row_id = c_cds.row_id LEFT JOIN c_utr ON w.row_id = c_utr.row_id LEFT JOIN c_gene ON w.row_id = c_gene.row_id LEFT JOIN c_fun ON w.row_id = c_fun.row_id)
SELECT row_id, round(cds, 6) AS cds_frac, round(utr, 6) AS utr_frac, round(gene, 6) AS gene_frac, round(greatest(0, gene - fun), 6) AS intron_frac, round(greatest(0, 1 - greatest(gene, fun)), 6) AS intergenic_frac,
  CASE WHEN fun < 0.2 THEN 'background' WHEN cds > 0 THEN 'cds' WHEN utr > 0 THEN 'utr' ELSE 'background' END AS label FROM f""")
def flagship_window_labels(v):
    length = F.col("end") - F.col("start")
    a = v("iv_a")
    regions = {"cds": a.where(length <= 15), "utr": a.where((length > 15) & (length <= 30)), "gene": v("genes").select("chrom", "start", "end")}
    out = interval_joins.priority_labels(intervals.resize(v("iv_b"), 255), regions, ["cds", "utr"], "gene", 0.2)
    return out.select("row_id", *[r6(f"{n}_frac") for n in ("cds", "utr", "gene")], r6("intron_frac"), r6("intergenic_frac"), "label")


@query(f"""WITH b AS (SELECT chrom, s, e, value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM signal WHERE value IS NOT NULL),
cut AS (SELECT max(value) AS c FROM b WHERE k = CAST(floor(0.9 * (n - 1) + 0.5) AS BIGINT) + 1), {merged('m', 'SELECT b.chrom, b.s - 7 AS s, b.s + 18 AS e FROM b, cut WHERE b.value >= cut.c')} SELECT chrom, s, e FROM m""")
def top_quantile_windows(v):
    return interval_joins.top_quantile_windows(v("signal").where("value is not null").withColumnRenamed("value", "logit"), 0.1, 24 + 1)


@query(f"""WITH {merged('m1', 'SELECT chrom, s, e FROM iv_a WHERE e - s >= 10')}, {merged('m2', 'SELECT chrom, s - 20 AS s, e + 20 AS e FROM m1')}, {B}, {without('d', 'm2', 'mb')}
SELECT chrom, s, e FROM d WHERE e - s >= 5""")
def recipe_flank_subtract(v):
    grown = intervals.merge(intervals.add_flank(intervals.merge(intervals.filter_size(v("iv_a"), 10)), 20))
    return intervals.filter_size(intervals.subtract(grown, v("iv_b")), 5)


_T = "nullif(regexp_extract(attribute, 'transcript_id \"([^\"]*)\"', 1), '')"
_EX = f"ex AS (SELECT *, {_T} AS t FROM gtf WHERE feature = 'exon' AND contains(attribute, 'transcript_biotype \"mRNA\"')), cd AS (SELECT {_T} AS t, min(s) AS cs, max(e) AS ce, min(chrom) AS chrom, min(strand) AS strand FROM gtf WHERE feature = 'CDS' GROUP BY 1)"


@query(f"WITH {_EX} SELECT chrom, s, e, strand, t AS transcript_id, regexp_extract(attribute, 'gene_id \"([^\"]*)\"', 1) AS gene_id FROM ex")
def mrna_exons(v):
    return annotation.transcript_exons(v("gtf")).select("chrom", "start", "end", "strand", "transcript_id", "gene_id")


_NC = """SELECT chrom, s, e, strand, attribute FROM gtf WHERE feature = 'exon' AND contains(attribute, 'lnc_RNA') AND NOT contains(attribute, 'pseudo "true"') AND NOT contains(attribute, 'partial "true"')
  AND NOT contains(attribute, 'pseudogene') AND NOT contains(attribute, 'NMD candidate') AND NOT contains(attribute, 'LOW QUALITY')"""


@query(f"SELECT chrom, s, e, {_T} AS transcript_id FROM ({_NC}) AS n")
def ncrna_exons(v):
    return annotation.ncrna_exons(v("gtf")).select("chrom", "start", "end", "transcript_id")


@query(f"WITH {merged('m', 'SELECT chrom, s, e FROM gtf WHERE feature = $$exon$$ AND NOT contains(attribute, $$TEC$$)')} SELECT chrom, s, e FROM m")
def functional_exons(v):
    return annotation.functional_exons(v("gtf"))


@query(f"""WITH {_EX}, t AS (SELECT t, min(chrom) AS chrom, min(strand) AS strand, min(s) AS s, max(e) AS e FROM ex GROUP BY t),
{merged('m', "SELECT chrom, CASE WHEN strand = '+' THEN s - 50 ELSE e - 20 END AS s, CASE WHEN strand = '+' THEN s + 20 ELSE e + 50 END AS e FROM t")} SELECT chrom, s, e FROM m""")
def promoters(v):
    return annotation.promoters(annotation.transcript_exons(v("gtf")), 50, 20)


def _utr_sql(plus: str) -> str:
    low, high = "SELECT ex.chrom, ex.s, least(ex.e, cs) AS e FROM ex JOIN cd ON ex.t = cd.t WHERE ex.strand", "SELECT ex.chrom, greatest(ex.s, ce) AS s, ex.e FROM ex JOIN cd ON ex.t = cd.t WHERE ex.strand"
    parts = f"SELECT * FROM ({low} = '{plus}' UNION ALL {high} <> '{plus}') AS u WHERE s < e"
    return f"WITH {_EX}, {merged('m', parts)} SELECT chrom, s, e FROM m"


@query(_utr_sql("+"))
def utr5(v):
    return annotation.utr5(annotation.transcript_exons(v("gtf")), annotation.coding(v("gtf")))


@query(_utr_sql("-"))
def utr3(v):
    return annotation.utr3(annotation.transcript_exons(v("gtf")), annotation.coding(v("gtf")))


@query(f"WITH {_EX}, {merged('m', "SELECT chrom, CASE WHEN strand = '+' THEN cs - 30 ELSE ce END AS s, CASE WHEN strand = '+' THEN cs ELSE ce + 30 END AS e FROM cd")} SELECT chrom, s, e FROM m")
def upstream_of_cds(v):
    return annotation.beside_cds(annotation.coding(v("gtf")), 30, True)


@query(f"SELECT chrom, feature, s, e, {_T} AS transcript_id FROM gtf WHERE {_T} IN (SELECT {_T} FROM gtf WHERE feature = 'transcript' AND contains(attribute, 'tag \"Ensembl_canonical\"'))")
def canonical_transcripts(v):
    return annotation.canonical(v("gtf")).select("chrom", "feature", "start", "end", "transcript_id")


@query("SELECT DISTINCT chrom, CASE WHEN strand = '+' THEN s ELSE e - 1 END AS s, CASE WHEN strand = '+' THEN s + 1 ELSE e END AS e, regexp_extract(attribute, 'gene_id \"([^\"]*)\"', 1) AS gene_id FROM gtf WHERE feature = 'transcript' AND contains(attribute, 'protein_coding')")
def start_sites(v):
    return annotation.start_sites(v("gtf"), F.col("gene_biotype") == "protein_coding")


@query("SELECT DISTINCT regexp_extract(attribute, 'gene_id \"([^\"]*)\"', 1) AS gene_id, nullif(regexp_extract(attribute, 'gene_biotype \"([^\"]*)\"', 1), '') AS gene_biotype FROM gtf")
def gene_biotypes(v):
    return annotation.gene_biotypes(v("gtf"))


@query(f"""WITH {_EX}, p AS (SELECT DISTINCT chrom, pos - 1 AS pos FROM variants), h AS (SELECT DISTINCT p.chrom, p.pos, ex.t FROM p JOIN ex ON p.chrom = ex.chrom AND p.pos >= ex.s AND p.pos < ex.e),
d AS (SELECT h.chrom, h.pos, h.t, sum(CASE WHEN h.pos < cs THEN greatest(0, least(ex.e, cs) - greatest(ex.s, h.pos)) WHEN h.pos >= ce THEN greatest(0, least(ex.e, h.pos + 1) - greatest(ex.s, ce)) ELSE 0 END) AS d FROM h JOIN cd ON h.t = cd.t JOIN ex ON h.t = ex.t GROUP BY h.chrom, h.pos, h.t)
SELECT chrom, pos, CAST(min(d) AS BIGINT) AS least, CAST(max(d) AS BIGINT) AS greatest FROM d GROUP BY chrom, pos""")
def spliced_distance(v):
    return annotation.spliced_distance(v("variants").select("chrom", (F.col("pos") - 1).alias("pos")), annotation.transcript_exons(v("gtf")), annotation.coding(v("gtf")))


@query("SELECT row_id, chrom, pos, ref, alt FROM variants WHERE ref IN ('A', 'C', 'G', 'T') AND alt IN ('A', 'C', 'G', 'T') AND ref <> alt")
def snv_filter(v):
    return variants.snvs(v("variants")).select("row_id", "chrom", "pos", "ref", "alt")


@query("WITH g AS (SELECT variant, max(pip) AS pip, count(*) - count(pip) AS nulls, count(DISTINCT study) AS n_studies FROM pip GROUP BY variant), l AS (SELECT variant, pip, n_studies, CASE WHEN pip > 0.9 THEN true WHEN pip < 0.8 AND nulls = 0 THEN false END AS label FROM g) SELECT * FROM l WHERE label IS NOT NULL")
def pip_label_guard(v):
    return aggregates.label_by_pip(v("pip"), ["variant"], 0.9, 0.8, extra=[F.count_distinct("study").alias("n_studies")])


@query("""WITH a AS (SELECT variant, max(pip) AS x FROM pip WHERE method = 'A' GROUP BY variant), b AS (SELECT variant, max(pip) AS y FROM pip WHERE method = 'R' GROUP BY variant)
SELECT coalesce(a.variant, b.variant) AS variant, round(coalesce((x + y) / 2, x, y), 6) AS pip, round(abs(x - y), 6) AS pip_gap FROM a FULL JOIN b ON a.variant = b.variant""")
def combine_full_outer(v):
    best = lambda m: v("pip").where(F.col("method") == m).groupBy("variant").agg(F.max("pip").alias("pip"))
    return aggregates.combine_methods(best("A"), best("R"), ["variant"], ["pip"]).select("variant", r6("pip"), r6("pip_gap"))


@query("WITH t AS (SELECT study AS user_key, max(pip) AS af FROM pip GROUP BY study) SELECT x.row_id, coalesce(t.af, 0) AS af FROM variants AS x LEFT JOIN t ON x.row_id = t.user_key WHERE coalesce(t.af, 0) < 0.9")
def af_lookup_default(v):
    t = v("pip").groupBy(F.col("study").alias("row_id")).agg(F.max("pip").alias("af"))
    return aggregates.lookup_or_default(v("variants"), t, ["row_id"], "af", 0.0).where("af < 0.9").select("row_id", "af")


@query("SELECT row_id, subset FROM variants WHERE subset IN (SELECT subset FROM variants WHERE label)")
def positive_classes(v):
    return variants.keep_positive_classes(v("variants"), "subset").select("row_id", "subset")


@query("SELECT DISTINCT variant FROM pip WHERE variant NOT IN (SELECT variant FROM pip WHERE pip > 0.9)")
def anti_join_keys(v):
    return v("pip").select("variant").distinct().join(v("pip").where("pip > 0.9").select("variant").distinct(), "variant", "left_anti")


@query("SELECT query_name, species, min(t_chrom) AS t_chrom, min(t_strand) AS t_strand, min(t_start) AS t_start, max(t_end) AS t_end, min(t_src_size) AS t_src_size FROM (SELECT query AS query_name, 'sp' AS species, target AS t_chrom, CASE WHEN tend < tstart THEN '-' ELSE '+' END AS t_strand, least(tstart, tend) AS t_start, greatest(tstart, tend) AS t_end, CAST(100000 AS BIGINT) AS t_src_size FROM hits WHERE bits > 90000) AS r GROUP BY query_name, species HAVING count(DISTINCT t_chrom) = 1 AND count(DISTINCT t_strand) = 1")
def collapse_single_chrom(v):
    rows = v("hits").where("bits > 90000").select(F.col("query").alias("query_name"), F.lit("sp").alias("species"), F.col("target").alias("t_chrom"), F.when(F.col("tend") < F.col("tstart"), "-").otherwise("+").alias("t_strand"), F.least("tstart", "tend").alias("t_start"), F.greatest("tstart", "tend").alias("t_end"), F.lit(100000).cast("long").alias("t_src_size"))
    return aggregates.single_place_groups(rows)


@query("SELECT variant, array_to_string(list_sort(list(DISTINCT CAST(study AS STRING)) FILTER (WHERE pip > 0.5)), ',') AS studies FROM pip GROUP BY variant HAVING max(pip) > 0.5")
def collect_sorted_join(v):
    strong = v("pip").where("pip > 0.5").groupBy("variant").agg(F.collect_set(F.col("study").cast("string")).alias("x"))
    return strong.select("variant", F.array_join(F.array_sort("x"), ",").alias("studies"))


@query("SELECT subset, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM variants GROUP BY subset")
def region_composition(v):
    return aggregates.composition(v("variants"), ["subset"]).select("subset", "n", r6("share"))


@query("SELECT count(n) AS n, CAST(sum(n) AS DOUBLE) AS total, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, CAST(min(n) AS DOUBLE) AS least, CAST(max(n) AS DOUBLE) AS most FROM (SELECT e - s AS n FROM iv_a) AS t")
def size_stats(v):
    out = aggregates.summary(v("iv_a").select((F.col("end") - F.col("start")).alias("n")), "n")
    return out.select("n", "total", r6("mean"), r6("sd"), "least", "most")


@query("WITH b AS (SELECT e - s AS n, row_number() OVER (ORDER BY e - s) AS k, count(*) OVER () AS m FROM iv_a) SELECT q, CAST(max(n) AS DOUBLE) AS value FROM b, (SELECT unnest([0.1, 0.5, 0.9]) AS q) AS qs WHERE k = CAST(floor(CAST(q AS DOUBLE) * (m - 1) + 0.5) AS BIGINT) + 1 GROUP BY q".replace("SELECT q,", "SELECT CAST(q AS DOUBLE) AS q,"))
def nearest_rank_quantiles(v):
    sizes = v("iv_a").select((F.col("end") - F.col("start")).alias("n"))
    return sizes.sparkSession.createDataFrame([(q, aggregates.nearest_rank(sizes, "n", q)) for q in (0.1, 0.5, 0.9)], "q double, value double")


@query("SELECT chrom, count(*) FILTER (WHERE subset = 'click') AS click, count(*) FILTER (WHERE subset = 'view') AS view, count(*) FILTER (WHERE subset = 'error') AS error FROM variants GROUP BY chrom")
def pivot_counts(v):
    return aggregates.pivot_counts(v("variants"), "chrom", "subset", ["click", "view", "error"])


@query("SELECT chrom, CAST(sum(CASE WHEN label THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, CAST(sum(CASE WHEN label THEN 0 ELSE 1 END) AS BIGINT) AS n_neg, CAST(least(sum(CASE WHEN label THEN 1 ELSE 0 END), floor(sum(CASE WHEN label THEN 0 ELSE 1 END) / CAST(9 AS DOUBLE))) AS BIGINT) AS capacity FROM variants GROUP BY chrom")
def matching_capacity(v):
    return aggregates.matching_capacity(v("variants"), ["chrom"], 9)


@query("WITH q AS (SELECT DISTINCT query FROM hits), n AS (SELECT query, count(DISTINCT target) AS n_hits FROM hits WHERE bits > 60000 GROUP BY query) SELECT q.query, coalesce(n_hits, 0) AS n_hits FROM q LEFT JOIN n ON q.query = n.query")
def leakage_hits(v):
    return aggregates.hits_per_query(v("hits").select("query").distinct(), v("hits").where("bits > 60000"))


@query("""WITH h AS (SELECT b.row_id, sum(CASE WHEN t.value >= 0 THEN least(b.e, t.e) - greatest(b.s, t.s) ELSE 0 END) AS cb, sum(least(b.e, t.e) - greatest(b.s, t.s)) AS nv, sum(t.value * (least(b.e, t.e) - greatest(b.s, t.s))) AS sv
  FROM iv_b AS b JOIN signal AS t ON b.chrom = t.chrom AND b.s < t.e AND t.s < b.e WHERE t.value IS NOT NULL GROUP BY b.row_id)
SELECT b.row_id, CAST(coalesce(cb, 0) AS INTEGER) AS conserved_bases, CAST(coalesce(nv, 0) AS INTEGER) AS n_valid, round(sv / nv, 6) AS mean_score, round(coalesce(cb, 0) / CAST(b.e - b.s AS DOUBLE), 6) AS share FROM iv_b AS b LEFT JOIN h ON b.row_id = h.row_id""")
def window_scoring(v):
    out = signal.score_windows(v("iv_b"), v("signal"), 0.0)
    return out.select("row_id", "conserved_bases", "n_valid", r6("mean_score"), F.round(F.col("conserved_bases") / (F.col("end") - F.col("start")), 6).alias("share"))


@query("SELECT x.row_id, t.value FROM variants AS x LEFT JOIN (SELECT * FROM signal WHERE value IS NOT NULL) AS t ON x.chrom = t.chrom AND x.pos - 1 >= t.s AND x.pos - 1 < t.e")
def values_at_positions(v):
    return signal.values_at(v("variants"), v("signal")).select("row_id", "value")


_HIST = "SELECT CAST(least(floor((greatest(-2.0, least(2.0, value)) + 2.0) / 0.125), 31) AS BIGINT) AS bin, CAST(sum(e - s) AS BIGINT) AS n FROM signal WHERE value IS NOT NULL"


@query(f"{_HIST} GROUP BY bin".replace("GROUP BY bin", "GROUP BY 1"))
def signal_histogram(v):
    t = v("signal")
    parts = [signal.histogram(t.where(F.col("chrom") == "chr1"), -2.0, 2.0, 32), signal.histogram(t.where(F.col("chrom") != "chr1"), -2.0, 2.0, 32)]
    return signal.merge_histograms(*parts)


@query(f"""WITH r AS ({_HIST} AND chrom = 'chr1' GROUP BY 1), t AS ({_HIST} AND chrom <> 'chr1' GROUP BY 1),
c AS (SELECT round_even(sum(n * greatest(0, least(1, (-2.0 + (bin + 1) * 0.125 - 0.3) / 0.125))), 0) / CAST(sum(n) AS DOUBLE) AS share FROM r), g AS (SELECT share, share * (SELECT sum(n) FROM t) AS goal FROM c),
u AS (SELECT bin, n, sum(n) OVER (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS up FROM t)
SELECT round(share, 6) AS share, round((SELECT max_by(-2.0 + bin * 0.125 + (up - goal) / n * 0.125, bin) FROM u WHERE up >= goal), 6) AS threshold FROM g""")
def calibrated_threshold(v):
    t = v("signal")
    hist = lambda rows: signal.histogram(rows, -2.0, 2.0, 32)
    return signal.calibrate(hist(t.where(F.col("chrom") == "chr1")), 0.3, hist(t.where(F.col("chrom") != "chr1")), -2.0, 2.0, 32).select(r6("share"), r6("threshold"))


@query("""WITH a AS (SELECT chrom, s AS pos, strand FROM genes), o AS (SELECT chrom, k AS "offset", pos + CASE WHEN strand = '-' THEN -k ELSE k END AS p FROM a CROSS JOIN (SELECT unnest(range(-20, 21)) AS k) AS ks WHERE k <> 0)
SELECT CAST("offset" AS INTEGER) AS "offset", count(*) AS n, round(sum(coalesce(t.value, 0)) / count(*), 9) AS mean FROM o LEFT JOIN signal AS t ON o.chrom = t.chrom AND o.p >= t.s AND o.p < t.e WHERE p >= 0 GROUP BY 1""")
def anchor_profile(v):
    return signal.anchor_profile(v("genes").select("chrom", F.col("start").alias("pos"), "strand"), v("signal"), 20).select("offset", "n", F.round("mean", 9).alias("mean"))


@query("WITH m AS (SELECT *, min(pos) OVER (PARTITION BY chrom) AS low, max(pos) OVER (PARTITION BY chrom) AS high FROM variants) SELECT row_id, CAST(CASE WHEN high = low THEN 0 ELSE least(4, floor((pos - low) * 5 / CAST(high - low AS DOUBLE))) END AS BIGINT) AS bucket FROM m")
def local_width_bins(v):
    return aggregates.width_buckets(v("variants"), ["chrom"], "pos", 5).select("row_id", F.col("bucket").cast("long").alias("bucket"))


@query("WITH q AS (SELECT chrom, quantile_cont(pos, [0.25, 0.5, 0.75]) AS c FROM variants WHERE NOT label GROUP BY chrom) SELECT row_id, CASE WHEN pos > c[1] THEN 1 ELSE 0 END + CASE WHEN pos > c[2] THEN 1 ELSE 0 END + CASE WHEN pos > c[3] THEN 1 ELSE 0 END AS bucket FROM variants AS x JOIN q ON x.chrom = q.chrom")
def negative_quantile_bins(v):
    return aggregates.quantile_buckets(v("variants"), ["chrom"], "pos", 4, ~F.col("label")).select("row_id", "bucket")


@query("SELECT query, chrom, s, e, strand, bits FROM (SELECT query, target AS chrom, least(tstart, tend) - 1 AS s, greatest(tstart, tend) AS e, CASE WHEN tend < tstart THEN '-' ELSE '+' END AS strand, bits, row_number() OVER (PARTITION BY query ORDER BY bits DESC, target, least(tstart, tend), greatest(tstart, tend)) AS k FROM hits) AS t WHERE k = 1")
def best_hit(v):
    return selection.best_hit(selection.hits_to_intervals(v("hits"))).select("query", "chrom", "start", "end", "strand", "bits")


@query("WITH f AS (SELECT concat('leaf', gene) AS leaf, CASE WHEN gene % 7 = 0 THEN NULL ELSE gene % 50 END AS family, CASE gene % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS quality_source, CASE WHEN gene % 2 = 0 THEN 'Chromosome' ELSE 'Scaffold' END AS assembly_level, e % 1000 AS contig_n50 FROM genes) SELECT leaf, family FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN leaf = 'leaf33' THEN 0 ELSE 1 END, quality_source, assembly_level, contig_n50 DESC, leaf) AS k FROM f WHERE family IS NOT NULL) AS t WHERE k = 1")
def family_dedup(v):
    g = F.col("gene")
    rows = v("genes").select(F.concat(F.lit("leaf"), g).alias("leaf"), F.when(g % 7 != 0, g % 50).alias("family"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (g % 3 + 1).cast("int")).alias("quality_source"), F.when(g % 2 == 0, "Chromosome").otherwise("Scaffold").alias("assembly_level"), (F.col("end") % 1000).alias("contig_n50"))
    return selection.one_per_family(rows, ["leaf33"], ["a", "b", "c"], ["Chromosome", "Scaffold"]).select("leaf", "family")


@query("SELECT * FROM (SELECT id, score, 'false_positive' AS error FROM scored WHERE NOT label ORDER BY score DESC, id LIMIT 10) AS a UNION ALL SELECT * FROM (SELECT id, score, 'false_negative' AS error FROM scored WHERE label ORDER BY score, id LIMIT 10) AS b")
def top_k_errors(v):
    return selection.worst_errors(v("scored"), 10).select("id", "score", "error")


@query("SELECT row_id, chrom, pos, CAST(NULL AS BIGINT) AS gene FROM variants UNION ALL SELECT NULL, chrom, NULL, gene FROM genes")
def diagonal_union(v):
    return aggregates.diagonal_union(v("variants").select("row_id", "chrom", "pos"), v("genes").select("chrom", "gene"))


@query("WITH u AS (SELECT variant, pip, 'first' AS source, 0 AS k FROM pip WHERE method = 'A' UNION ALL SELECT variant, pip, 'second', 1 FROM pip WHERE method = 'R') SELECT variant, pip, source FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY k, pip NULLS LAST) AS n FROM u) AS t WHERE n = 1")
def first_by_source(v):
    part = lambda m: v("pip").where(F.col("method") == m).select("variant", "pip")
    return aggregates.first_by_source([("first", part("A")), ("second", part("R"))], ["variant"])


@query("SELECT concat(id, '_+') AS id, raw AS seq FROM seqs UNION ALL SELECT concat(id, '_-'), reverse(translate(raw, 'ACGTNacgtn', 'TGCANtgcan')) FROM seqs")
def revcomp_augment(v):
    return Q.with_reverse_complements(v("seqs").withColumnRenamed("raw", "seq"))


@query("SELECT id, round(len(regexp_replace(raw, '[^GCgc]', '', 'g')) / CAST(nullif(length(raw), 0) AS DOUBLE), 6) AS gc, round(len(regexp_replace(raw, '[^a-z]', '', 'g')) / CAST(nullif(length(raw), 0) AS DOUBLE), 6) AS repeats FROM seqs")
def gc_repeat_fraction(v):
    return v("seqs").select("id", Q.gc_content("raw").alias("gc"), Q.repeat_fraction("raw").alias("repeats")).select("id", r6("gc"), r6("repeats"))


@query("SELECT id, array_to_string(list_transform(regexp_extract_all(lower(raw), '(?s).{3}'), lambda w: CASE WHEN regexp_full_match(w, '[acgt]{3}') THEN 2 + list_position(['a','c','g','t'], substr(w, 1, 1)) * 16 + list_position(['a','c','g','t'], substr(w, 2, 1)) * 4 + list_position(['a','c','g','t'], substr(w, 3, 1)) - 21 ELSE 1 END), ' ') AS tokens FROM seqs")
def kmer_tokens(v):
    return v("seqs").select("id", F.array_join(Q.kmer_tokens("raw", 3).cast("array<string>"), " ").alias("tokens"))


@query("SELECT id, array_to_string(list_concat([2], list_transform(string_split(lower(raw), ''), lambda c: coalesce(nullif(list_position(['a','c','g','t'], c), 0) + 3, 1)), [3]), ' ') AS tokens FROM seqs WHERE raw <> ''")
def char_tokens(v):
    return v("seqs").where("raw <> ''").select("id", F.array_join(Q.char_tokens("raw", True, True).cast("array<string>"), " ").alias("tokens"))


@query("SELECT id, round(len(regexp_replace(substr(raw, 2), '[^A-Z]', '', 'g')) + 0.25 * len(regexp_replace(substr(raw, 2), '[A-Z]', '', 'g')), 6) AS weight FROM seqs WHERE raw <> ''".replace("0.25", "CAST(0.25 AS DOUBLE)"))
def loss_weights(v):
    return v("seqs").where("raw <> ''").select("id", F.aggregate(Q.loss_weights("raw", 0.25), F.lit(0.0), lambda s, x: s + x).alias("weight")).select("id", r6("weight"))


@query("SELECT id, array_to_string(list_transform(string_split(raw, ''), lambda c, i: CASE WHEN i % 3 = 0 THEN upper(c) ELSE lower(c) END), '') AS seq FROM (SELECT id, regexp_replace(raw, '[^A-Za-z]', 'N', 'g') AS raw FROM seqs WHERE raw <> '') AS t")
def case_encode(v):
    values = F.transform(F.sequence(F.lit(1), F.length("raw")), lambda i: F.when(i % 3 == 0, 3.0).when(i % 3 == 1, float("nan")))
    plain = v("seqs").where("raw <> ''").select("id", F.regexp_replace("raw", "[^A-Za-z]", "N").alias("raw"))
    return plain.select("id", Q.case_encode("raw", values, 2.0).alias("seq"))


@query("""WITH w AS (SELECT id, unnest(range(length(raw) // 11)) AS number, raw FROM seqs), x AS (SELECT id, number, substr(raw, 11 * number + 1, 11) AS f FROM w),
y AS (SELECT *, concat(substr(f, 1, 5), 'A', substr(f, 7)) AS g FROM x), r AS (SELECT id, number, reverse(translate(f, 'ACGTacgt', 'TGCAtgca')) AS f, reverse(translate(g, 'ACGTacgt', 'TGCAtgca')) AS g FROM y)
SELECT id, number, '+' AS strand, substr(f, 1, 5) AS context, substr(f, 6) AS ref_completion, substr(g, 6) AS alt_completion FROM y UNION ALL SELECT id, number, '-', substr(f, 1, 5), substr(f, 6), substr(g, 6) FROM r""")
def context_completion(v):
    """Every window of 11 letters of every text, with an A in its middle as the other base, on both strands."""
    windows = letter_windows(v("seqs"), 11)
    one = lambda strand: Q.context_and_completions(F.col("window"), F.substring("window", 6, 1), F.lit("A"), 11, strand)
    return on_both_strands(windows, one).select("id", "number", "strand", "x.*")


@query("SELECT row_id, CASE WHEN score IS NULL THEN 'OOR' WHEN score >= 0 AND score < 50 THEN 'b0' WHEN score >= 50 AND score < 200 THEN 'b1' WHEN score >= 200 AND score <= 400 THEN 'b2' ELSE 'OOR' END AS bin FROM variants")
def edge_bins(v):
    return v("variants").select("row_id", C.edge_bins(F.col("score"), [0, 50, 200, 400]).alias("bin"))


@query("SELECT row_id, CASE WHEN subset = 'click' THEN CASE WHEN score >= 0 AND score <= 50 THEN 'click:b0' ELSE 'click:OOR' END WHEN subset = 'purchase' THEN CASE WHEN score >= 0 AND score < 10 THEN 'purchase:b0' WHEN score >= 10 AND score <= 90 THEN 'purchase:b1' ELSE 'purchase:OOR' END ELSE 'UNKNOWN' END AS bin FROM variants")
def tiered_bins(v):
    return v("variants").select("row_id", C.subset_bins(F.col("subset"), F.col("score"), {"click": [0, 50], "purchase": [0, 10, 90]}, "UNKNOWN", True).alias("bin"))


@query("SELECT row_id, subset FROM (SELECT row_id, subset, row_number() OVER (PARTITION BY subset ORDER BY md5(concat('7|', row_id)), row_id) AS k FROM variants) AS t WHERE k <= 50")
def cap_per_subset(v):
    return sampling.cap_groups(v("variants"), ["subset"], 50, 7, "row_id").select("row_id", "subset")


@query("SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('3|', row_id)), row_id) AS k, count(*) FILTER (WHERE label) OVER () AS p FROM variants) AS t WHERE label OR k <= CAST(floor(0.25 * p / 0.75) AS BIGINT)")
def background_cap(v):
    return sampling.cap_background(v("variants"), F.col("label"), 0.25, 3, "row_id").select("row_id", "label")


@query("SELECT row_id, CASE WHEN chrom = 'chr0' OR chrom = 'chr23' THEN NULL WHEN CAST(substr(chrom, 4) AS INTEGER) % 2 = 1 THEN 'train' ELSE 'test' END AS split FROM variants")
def chrom_parity_split(v):
    return sampling.chromosome_split(v("variants"), "chr").select("row_id", "split")


@query("WITH p AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat('5|', row_id)), row_id) - 1 AS place, count(*) OVER () AS n FROM variants) SELECT row_id, place, CAST(CASE WHEN place < (n % 7) * (n // 7 + 1) THEN place // (n // 7 + 1) ELSE n % 7 + (place - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS shard FROM p")
def array_split_shards(v):
    return sampling.with_shard(v("variants"), 7, 5, "row_id").select("row_id", F.col("place").cast("long").alias("place"), "shard")


def matched(v) -> DataFrame:
    rows = v("variants").where("score is not null")
    return matching.match_features(rows.where("label").drop("label"), rows.where("not label").drop("label"), variants.KEY + ["row_id"], ["score", "pos"], ["chrom"], k=2)


@query()
def knn_match(v):
    """Greedy over whole strata, which SQL doesn't express; tests hold it against a plain loop."""
    return matched(v).select("row_id", "chrom", "label", "match_group")


@query("""WITH g AS (SELECT match_group, max(CASE WHEN label THEN score END) AS p, max(CASE WHEN NOT label THEN score END) AS q, CASE WHEN match_group % 3 = 0 THEN 'x' ELSE 'y' END AS subset FROM pairs GROUP BY match_group HAVING count(*) = 2),
u AS (SELECT subset, p, q FROM g UNION ALL SELECT '_global_', p, q FROM g),
m AS (SELECT subset, avg(CASE WHEN p > q THEN 1.0 WHEN p = q THEN 0.5 ELSE 0.0 END) AS value, count(*) AS n_pairs, count(*) FILTER (WHERE p = q) AS n_ties FROM u GROUP BY subset), t AS (SELECT *, sqrt(value * (1 - value) / n_pairs) AS se FROM m),
z AS (SELECT subset, value, se, n_pairs, n_ties FROM t UNION ALL SELECT '_macro_avg_', avg(value), sqrt(sum(se * se)) / count(*), count(*), CAST(sum(n_ties) AS BIGINT) FROM t WHERE subset <> '_global_')
SELECT 'score' AS score_type, subset, round(value, 6) AS value, round(se, 6) AS se, n_pairs, n_ties FROM z""")
def pairwise_accuracy_rollup(v):
    whole = v("pairs").groupBy("match_group").agg(F.count("*").alias("n")).where("n = 2").drop("n")
    rows = v("pairs").join(whole, "match_group", "left_semi").withColumn("subset", F.when(F.col("match_group") % 3 == 0, "x").otherwise("y"))
    long = metrics.unpivot_scores(rows, ["match_group", "label", "subset"], ["score"])
    return metrics.pairwise_metrics(long).select("score_type", "subset", r6("value"), r6("se"), "n_pairs", "n_ties")


_STEPS = """g AS (SELECT subset, score, CAST(sum(CASE WHEN label THEN 1 ELSE 0 END) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY subset, score),
st AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER (PARTITION BY subset) AS pp, sum(n) OVER (PARTITION BY subset) AS nn FROM g WINDOW w AS (PARTITION BY subset ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH {_STEPS}, a AS (SELECT subset, sum(p * tp / k) / max(pp) AS auprc, (sum(p * (nn - k + (n + 1) / 2)) - max(pp) * (max(pp) + 1) / 2) / nullif(max(pp) * (max(nn) - max(pp)), 0) AS auroc, CAST(max(pp) AS BIGINT) AS n_pos, CAST(max(nn) - max(pp) AS BIGINT) AS n_neg FROM st GROUP BY subset)
SELECT subset, round(auprc, 6) AS auprc, round(auroc, 6) AS auroc, n_pos, n_neg FROM a""")
def ranking_metrics(v):
    return metrics.ranking_metrics(v("scored"), ["subset"]).select("subset", r6("auprc"), r6("auroc"), "n_pos", "n_neg")


@query(f"WITH {_STEPS} SELECT subset, score AS threshold, round(tp / k, 6) AS precision, round(tp / nullif(pp, 0), 6) AS recall FROM st UNION ALL SELECT DISTINCT subset, NULL, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM st")
def precision_recall(v):
    return metrics.precision_recall(v("scored"), ["subset"], closed=True).select("subset", "threshold", r6("precision"), r6("recall"))


@query()
def bootstrap_auprc(v):
    """Resampled, so SQL has no equal; tests hold the value and its error against NumPy."""
    rows = v("scored").withColumn("match_group", F.floor(F.col("id") / 3)).withColumn("score_type", F.lit("n_chars"))
    return metrics.auprc_metrics(rows).select("score_type", "subset", r6("value"), r6("se"), "n_groups")


@query("SELECT match_group AS variant_id, round(avg(score), 6) AS score FROM pairs GROUP BY match_group")
def strand_average(v):
    rows = v("pairs").select(F.col("match_group").alias("variant_id"), "match_group", F.col("label").cast("string").alias("strand"), F.lit(True).alias("label"), "score", F.lit("x").alias("subset"))
    return metrics.strand_average(rows).select("variant_id", r6("score"))


@query("WITH b AS (SELECT chrom, s, e, gene % 2 = 0 AS minus FROM genes) SELECT x.row_id, coalesce(CASE WHEN b.chrom IS NOT NULL THEN 'new' END, x.chrom) AS chrom, CASE WHEN b.chrom IS NULL THEN -1 WHEN minus THEN 9000000 - (1000 + x.pos - 1 - b.s) ELSE 1000 + x.pos - b.s END AS pos, CASE WHEN minus THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS ref FROM variants AS x LEFT JOIN b ON x.chrom = b.chrom AND x.pos - 1 >= b.s AND x.pos - 1 < b.e")
def lift_over(v):
    blocks = v("genes").select("chrom", "start", "end", F.lit("new").alias("to_chrom"), F.lit(1000).cast("long").alias("to_start"), F.when(F.col("gene") % 2 == 0, "-").otherwise("+").alias("to_strand"), F.lit(9000000).cast("long").alias("to_size"))
    return variants.lift_over(v("variants"), blocks).select("row_id", "chrom", "pos", "ref")


def letter_windows(seqs, size):
    """``id, number, window``: all whole windows of ``size`` letters of each text, one after another."""
    rows = seqs.select("id", F.posexplode(F.regexp_extract_all("raw", F.lit(f"(?s).{{{size}}}"), F.lit(0))).alias("number", "window"))
    return rows.select("id", F.col("number").cast("long").alias("number"), "window")


def on_both_strands(windows, one):
    """``id, number, strand, x``: ``one(strand)`` of each window, which is read once."""
    both = windows.select("id", "number", one("+").alias("plus"), one("-").alias("minus"))
    rows = F.array(*[F.struct(F.lit(strand).alias("strand"), F.col(c).alias("x")) for strand, c in (("+", "plus"), ("-", "minus"))])
    return both.select("id", "number", F.inline(rows))


def genome(v):
    """All texts as 24 chromosomes, in chunks."""
    records = v("seqs").select(F.concat(F.lit("chr"), F.col("id").cast("long") % 24).alias("chrom"), F.col("id").cast("long").alias("ord"), F.col("raw").alias("seq"))
    return variants.chunks_of_records(records, 1 << 12)


@query("""WITH g AS (SELECT concat('chr', CAST(id AS BIGINT) % 24) AS chrom, string_agg(raw, '' ORDER BY CAST(id AS BIGINT)) AS seq FROM seqs GROUP BY 1), x AS (SELECT v.*, upper(substr(g.seq, v.pos, 1)) AS base FROM variants AS v JOIN g ON v.chrom = g.chrom WHERE v.pos <= length(g.seq))
SELECT row_id, CASE WHEN base = ref THEN ref ELSE alt END AS ref, CASE WHEN base = ref THEN alt ELSE ref END AS alt FROM x WHERE base = ref OR base = alt""")
def check_reference(v):
    return variants.check_reference(v("variants"), genome(v), 1 << 12).select("row_id", "ref", "alt")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND text IN (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT lang) + max(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) = 1 AND count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) = 1)")
def unambiguous_ids(v):
    """Documents of one language whose text comes with one language and one source only."""
    return variants.unambiguous(v("documents"), "text", ["lang", "source"]).where("lang = 'en'").select("doc_id")


@query("SELECT source, count(DISTINCT doc_id) AS doc_id, count(DISTINCT lang) AS lang, count(DISTINCT n_chars) AS n_chars FROM documents GROUP BY source")
def distinct_per_group(v):
    rows = v("documents").select("source", "doc_id", "lang", "n_chars")
    return rows.groupBy("source").agg(*[F.count_distinct(c).alias(c) for c in rows.columns[1:]])


@query("""WITH g AS (SELECT concat('chr', CAST(id AS BIGINT) % 24) AS chrom, string_agg(raw, '' ORDER BY CAST(id AS BIGINT)) AS seq FROM seqs GROUP BY 1),
x AS (SELECT v.row_id, rpad(concat(repeat('N', CAST(greatest(0, 5 - pos) AS INTEGER)), coalesce(substr(g.seq, CAST(greatest(1, pos - 4) AS BIGINT), CAST(pos + 3 - greatest(1, pos - 4) + 1 AS BIGINT)), '')), 8, 'N') AS f FROM variants AS v LEFT JOIN g ON v.chrom = g.chrom)
SELECT row_id, '+' AS strand, f AS window, regexp_replace(regexp_replace(f, '[^A-Z]', '0', 'g'), '[A-Z]', '1', 'g') AS upper FROM x
UNION ALL SELECT row_id, '-', reverse(translate(f, 'ACGTacgt', 'TGCAtgca')), reverse(regexp_replace(regexp_replace(f, '[^A-Z]', '0', 'g'), '[A-Z]', '1', 'g')) FROM x""")
def variant_windows(v):
    """The 8 bases about every variant (4 before it) of the genome that all texts make, N beyond its ends, on both strands, and which are upper case."""
    found = variants.bases_at(v("variants"), genome(v), 4, 3, 1 << 12).select("row_id", F.col("window").alias("f"))
    both = found.select("row_id", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("f").alias("window")), F.struct(F.lit("-").alias("strand"), Q.reverse_complement("f").alias("window")))).alias("x"))
    upper = F.array_join(F.transform(Q.upper_mask(F.col("x.window")), lambda u: u.cast("int").cast("string")), "")
    return both.select("row_id", "x.*", upper.alias("upper"))


@query("WITH p AS (SELECT subset, count(*) AS n_input FROM variants WHERE label GROUP BY subset), q AS (SELECT subset, count(*) FILTER (WHERE label) AS n_kept FROM variants WHERE row_id % 2 = 0 GROUP BY subset) SELECT coalesce(p.subset, q.subset) AS subset, coalesce(n_input, 0) AS n_input, coalesce(n_kept, 0) AS n_kept, coalesce(n_input, 0) - coalesce(n_kept, 0) AS n_dropped FROM p FULL JOIN q ON p.subset = q.subset")
def matching_qc(v):
    rows = v("variants").where("score is not null or score is null")
    counts, _ = matching.matching_qc(rows, rows.where("row_id % 2 = 0").withColumn("pos", F.col("pos").cast("double")), ["pos"])
    return counts.select("subset", "n_input", "n_kept", "n_dropped")


from . import region_queries, table_queries  # noqa: E402, F401  they register theirs
