"""Queries of region sets: recipes, validation sets, labelled regions, windows and placements, each with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation, interval_joins, intervals, regions, selection
from .catalogue import _EX, _NC, _T, _utr_sql, merged, query, r6, without

SPAN = 1000000


def _set(name: str, source: str) -> str:
    return merged(name, source)


def _inside(name: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT a.chrom, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM {a} AS a JOIN {b} AS b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e)"


def _utr_rows(plus: str, exons: str, cds: str) -> str:
    low = f"SELECT x.chrom, x.s, least(x.e, cs) AS e FROM {exons} AS x JOIN {cds} AS c ON x.t = c.t WHERE x.strand"
    high = f"SELECT x.chrom, greatest(x.s, ce) AS s, x.e FROM {exons} AS x JOIN {cds} AS c ON x.t = c.t WHERE x.strand"
    return f"SELECT * FROM ({low} = '{plus}' UNION ALL {high} <> '{plus}') AS u WHERE s < e"


def _starts(exons: str, n: int) -> str:
    return f"SELECT chrom, CASE WHEN strand = '+' THEN s - {n} ELSE e - {n} END AS s, CASE WHEN strand = '+' THEN s + {n} ELSE e + {n} END AS e FROM (SELECT t, min(chrom) AS chrom, min(strand) AS strand, min(s) AS s, max(e) AS e FROM {exons} GROUP BY t) AS t"


def _beside(up: bool, n: int) -> str:
    plus = "+" if up else "-"
    return f"SELECT chrom, CASE WHEN strand = '{plus}' THEN cs - {n} ELSE ce END AS s, CASE WHEN strand = '{plus}' THEN cs ELSE ce + {n} END AS e FROM cd"


_SIZES = "(SELECT DISTINCT chrom, CAST(0 AS BIGINT) AS s, CAST({span} AS BIGINT) AS e FROM {table})"
_CONSERVED = "SELECT chrom, s, e FROM (SELECT c.row_id, c.chrom, c.s, c.e, sum(CASE WHEN t.value >= {cut} THEN least(c.e, t.e) - greatest(c.s, t.s) ELSE 0 END) AS n FROM cre AS c JOIN signal AS t ON c.chrom = t.chrom AND c.s < t.e AND t.s < c.e WHERE t.value IS NOT NULL AND c.cre_class IN ('dELS', 'pELS') GROUP BY c.row_id, c.chrom, c.s, c.e) AS k WHERE n >= {least}"
_TOP = "SELECT b.chrom, b.s - 122 AS s, b.s + 133 AS e FROM (SELECT chrom, s, value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM signal WHERE value IS NOT NULL) AS b WHERE b.value >= (SELECT max(value) FROM (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM signal WHERE value IS NOT NULL) AS q WHERE k = CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT) + 1)"
#: Rows of every source set in SQL, over ex and cd (exons and coding bounds by transcript) and nc (non-coding exons).
_SOURCES = {
    "cds": "SELECT chrom, s, e FROM {ann} WHERE feature = 'CDS'",
    "utr5": _utr_rows("+", "ex", "cd"),
    "utr3": _utr_rows("-", "ex", "cd"),
    "ncrna": "SELECT chrom, s, e FROM nc",
    "exons": "SELECT chrom, s, e FROM gtf WHERE feature = 'exon' AND NOT contains(attribute, 'TEC')",
    **{f"promoters_{n}": _starts("(SELECT t, chrom, strand, s, e FROM ex UNION ALL SELECT t, chrom, strand, s, e FROM nc)", n) for n in (256, 2048)},
    **{f"promoters_mrna_{n}": _starts("ex", n) for n in (254, 256, 2048)},
    "upstream_512": _beside(True, 512),
    "downstream_512": _beside(False, 512),
    "downstream_256": _beside(False, 256),
    "els": "SELECT chrom, s, e FROM cre WHERE cre_class IN ('dELS', 'pELS')",
    "pls": "SELECT chrom, s, e FROM cre WHERE cre_class = 'PLS'",
    "start_band_255": _starts("ex", 255),
    "els_conserved_20": _CONSERVED.format(cut="0", least=20),
    "predicted": "SELECT chrom, s, e FROM signal WHERE value >= 0.5",
    "top_bins": _TOP,
    "projected_20": _CONSERVED.format(cut="0", least=20),
    "projected_50": _CONSERVED.format(cut="0", least=50),
    "projected_b_20": _CONSERVED.format(cut="0.5", least=20),
    "projected_b_50": _CONSERVED.format(cut="0.5", least=50),
}


def recipe_sql(recipe: str, ann: str, head: str, exons: str | None = None) -> str:
    """The chain of a recipe as common table expressions."""
    source, steps = regions.RECIPES[recipe]
    rows = {**_SOURCES, **({"exons": exons} if exons else {})}
    parts = [head] if head else []
    have: set[str] = set()

    def need(name: str) -> str:
        if name not in have:
            have.add(name)
            if name in ("defined", "scannable"):
                if "gap" not in have:
                    have.add("gap")
                    parts.append(merged("gap", "SELECT chrom, s, e FROM gaps"))
                    parts.append(f"sizes AS {_SIZES.format(span=SPAN, table='iv_b')}")
                    parts.append(without("s_defined", "sizes", "gap"))
                if name == "scannable":
                    parts.append(without("s_scannable", "s_defined", need("exons")))
            else:
                parts.append(merged(f"s_{name}", rows[name].format(ann=ann)))
        return f"s_{name}"

    now = need(source)
    for i, (kind, *with_) in enumerate(steps):
        name = f"step{i}"
        if kind == "size":
            parts.append(f"{name} AS (SELECT chrom, s, e FROM {now} WHERE e - s BETWEEN {with_[0]} AND {with_[1]})")
        elif kind == "flank":
            parts.append(merged(name, f"SELECT chrom, s - {with_[0]} AS s, e + {with_[0]} AS e FROM {now}"))
        elif kind == "expand":
            pad = f"CAST(greatest(ceil(({with_[0]} - (e - s)) / CAST(2 AS DOUBLE)), 0) AS BIGINT)"
            parts.append(merged(name, f"SELECT chrom, s - {pad} AS s, e + {pad} AS e FROM {now}"))
        elif kind == "resize":
            low = f"s - CAST(floor(({with_[0]} - (e - s)) / CAST(2 AS DOUBLE)) AS BIGINT)"
            parts.append(merged(name, f"SELECT chrom, {low} AS s, {low} + {with_[0]} AS e FROM {now}"))
        elif kind == "minus":
            parts.append(without(name, now, need(with_[0])))
        else:
            parts.append(_inside(name, now, need(with_[0])))
        now = name
    return f"WITH {', '.join(parts)} SELECT chrom, s, e FROM {now}"


_HEAD = f"{_EX}, nc AS (SELECT chrom, s, e, strand, {_T} AS t FROM ({_NC}) AS n)"
_CANONICAL = f"can AS (SELECT *, {_T} AS t FROM ens WHERE {_T} IN (SELECT {_T} FROM ens WHERE feature = 'transcript' AND contains(attribute, 'tag \"Ensembl_canonical\"')))"
_ENS_HEAD = f"""{_CANONICAL}, ex AS (SELECT * FROM can WHERE feature = 'exon' AND contains(attribute, 'protein_coding')), cd AS (SELECT t, min(s) AS cs, max(e) AS ce FROM can WHERE feature = 'CDS' GROUP BY t),
nc AS (SELECT * FROM can WHERE feature = 'exon' AND contains(attribute, 'lncRNA'))"""


def _defined(v):
    return lambda: regions.defined(v("iv_b").select("chrom").distinct().withColumn("size", F.lit(SPAN)), v("gaps"))


def _sets(v) -> dict:
    els = lambda: v("cre").where(F.col("cre_class").isin(*regions.ENHANCER_CLASSES))
    kept = lambda cut, least: (lambda: regions.conserved(els(), v("signal"), cut, least))
    return regions.annotation_sets(v("gtf"), _defined(v)) | {
        "els": els,
        "els_conserved_20": kept(0.0, 20),
        "predicted": lambda: regions.above_threshold(v("signal").withColumnRenamed("value", "logit"), 0.5),
        "top_bins": lambda: interval_joins.top_quantile_windows(v("signal").where("value is not null").withColumnRenamed("value", "logit"), 0.05, 255),
        "projected_20": kept(0.0, 20),
        "projected_50": kept(0.0, 50),
        "projected_b_20": kept(0.5, 20),
        "projected_b_50": kept(0.5, 50),
    }


def _register(name: str, sql: str, run) -> None:
    run.__name__ = name
    query(sql)(run)


for _name in regions.RECIPES:
    if _name.startswith("val_"):
        _register(f"recipe_{_name}", recipe_sql(_name, "can", _ENS_HEAD, "SELECT chrom, s, e FROM ens WHERE feature = 'exon'"), lambda v, r=_name: regions.build(r, regions.validation_sets(v("ens"), v("cre"), _defined(v), ("lncRNA",))))
    else:
        _register(f"recipe_{_name}", recipe_sql(_name, "gtf", _HEAD), lambda v, r=_name: regions.build(r, _sets(v)))


_REGION_ROWS = {
    "cds": "SELECT chrom, s, e FROM ens WHERE feature = 'CDS'",
    "utr3": _utr_rows("-", "ex", "cd"),
    "tss_region_and_utr5": f"{_starts('al', 100)} UNION ALL {_utr_rows('+', 'ex', 'cd')}",
    "ccre_non_promoter": "SELECT chrom, s - 50 AS s, e + 50 AS e FROM cre WHERE cre_class <> 'PLS'",
    "gene_body": "SELECT chrom, s, e FROM ens WHERE feature = 'gene'",
    "all_exons": "SELECT chrom, s, e FROM ens WHERE feature = 'exon'",
}


@query(f"""WITH al AS (SELECT *, {_T} AS t FROM ens WHERE feature = 'exon'), ex AS (SELECT * FROM al WHERE contains(attribute, 'protein_coding')), cd AS (SELECT {_T} AS t, min(s) AS cs, max(e) AS ce FROM ens WHERE feature = 'CDS' GROUP BY 1),
{merged('gap', 'SELECT chrom, s, e FROM gaps')}, sizes AS {_SIZES.format(span=SPAN, table='iv_b')}, {without('d', 'sizes', 'gap')}, {merged('m_pc', 'SELECT chrom, s, e FROM ex')},
{', '.join(merged(f'm_{n}', s) for n, s in _REGION_ROWS.items())}, {without('m_ncrna_exon', 'm_all_exons', 'm_pc')}, {', '.join(_inside(f'r_{n}', f'm_{n}', 'd') for n in (*_REGION_ROWS, 'ncrna_exon'))}
{' UNION ALL '.join(f"SELECT '{n}' AS region, chrom, s, e FROM r_{n}" for n in (*_REGION_ROWS, 'ncrna_exon'))}""")
def region_sets(v):
    return regions.region_sets(v("ens"), v("cre"), _defined(v)(), 100, 50)


@query("""WITH w AS (SELECT chrom, s, s + 255 AS e, concat('win_', chrom, '_', lpad(CAST(s // 128 + 1 AS STRING), 9, '0')) AS name FROM (SELECT chrom, unnest(range(0, max(e) - 254, 128)) AS s FROM iv_b GROUP BY chrom) AS t)
SELECT chrom, s, e, name FROM w WHERE NOT EXISTS (SELECT 1 FROM gaps AS g WHERE g.chrom = w.chrom AND g.s < w.e AND w.s < g.e)""")
def windows_minus_n(v):
    return regions.windows_outside(v("iv_b").groupBy("chrom").agg(F.max("end").alias("size")), v("gaps"), 255, 128)


@query("SELECT row_id, chrom, s, e FROM cre AS c WHERE NOT EXISTS (SELECT 1 FROM gtf AS x WHERE x.feature = 'exon' AND x.chrom = c.chrom AND x.s < c.s - CAST(floor((64 - (c.e - c.s)) / CAST(2 AS DOUBLE)) AS BIGINT) + 64 AND c.s - CAST(floor((64 - (c.e - c.s)) / CAST(2 AS DOUBLE)) AS BIGINT) < x.e)")
def center_outside_exons(v):
    return regions.outside_at_center(v("cre").drop("cre_class"), v("gtf").where("feature = 'exon'"), 64)


@query()
def random_placement(v):
    """Drawn places, which another engine would draw otherwise; tests hold their properties: lengths, chromosomes, no touch of what is excluded."""
    free = intervals.subtract(_defined(v)(), regions.exclusion(v("iv_b"), v("gaps")))
    return regions.place_at_random(v("iv_b"), free, 7)


@query()
def placement_apart(v):
    """Drawn places of which no two overlap; tests hold that, their lengths and chromosomes, and that nothing excluded is touched."""
    free = intervals.subtract(_defined(v)(), regions.exclusion(v("iv_b"), v("gaps")))
    return regions.place_apart(v("iv_b"), free, 7)


@query("SELECT count(*) AS n_intervals, CAST(sum(e - s) AS BIGINT) AS total_bases, CAST(sum(coalesce(n, 0)) AS BIGINT) AS conserved_bases, round(100.0 * sum(coalesce(n, 0)) / CAST(sum(e - s) AS DOUBLE), 6) AS percent FROM cre LEFT JOIN (SELECT c.row_id, sum(CASE WHEN t.value >= 0 THEN least(c.e, t.e) - greatest(c.s, t.s) ELSE 0 END) AS n FROM cre AS c JOIN signal AS t ON c.chrom = t.chrom AND c.s < t.e AND t.s < c.e WHERE t.value IS NOT NULL GROUP BY c.row_id) AS k ON cre.row_id = k.row_id")
def conserved_totals(v):
    return regions.conserved_totals(v("cre"), v("signal"), 0.0).select("n_intervals", "total_bases", "conserved_bases", r6("percent"))


@query(f"""WITH {_EX}, {merged('m', "SELECT chrom, s, e FROM (SELECT chrom, s, e FROM ex UNION ALL SELECT chrom, s, e FROM (" + _NC + ") AS n) AS u")} SELECT chrom, s, e FROM m""")
def functional_transcripts(v):
    return annotation.transcript_set(v("gtf"))


@query(f"WITH {merged('m', 'SELECT chrom, s, e FROM gtf WHERE feature = $$CDS$$')} SELECT chrom, s, e FROM m")
def coding_set(v):
    return annotation.coding_set(v("gtf"))


@query(f"WITH {merged('m', 'SELECT chrom, s, e FROM gtf WHERE feature = $$exon$$ AND NOT contains(attribute, $$TEC$$)')} SELECT chrom, s, e FROM m")
def masking_exons(v):
    return annotation.masking_exons(v("gtf"))


@query(f"WITH {_EX}, {merged('m', _beside(False, 30))} SELECT chrom, s, e FROM m")
def downstream_of_cds(v):
    return annotation.beside_cds(annotation.coding(v("gtf")), 30, False)


@query(f"WITH {merged('m', 'SELECT chrom, s, e FROM ens WHERE feature = $$gene$$')} SELECT chrom, s, e FROM m")
def gene_bodies(v):
    return annotation.gene_bodies(annotation.require_protein_coding(v("ens")))


@query(f"SELECT chrom, s, e, strand, {_T} AS transcript_id FROM ens WHERE feature = 'exon' AND contains(attribute, 'lncRNA')")
def noncoding_exons(v):
    return annotation.noncoding_exons(v("ens"), ["lncRNA"]).select("chrom", "start", "end", "strand", "transcript_id")


@query(f"""WITH ex AS (SELECT *, {_T} AS t FROM ens WHERE feature = 'exon' AND contains(attribute, 'protein_coding')), {merged('m', _starts('ex', 40))} SELECT chrom, s, e FROM m""")
def start_bands(v):
    return annotation.start_bands(annotation.exons_of_biotype(v("ens")), 40)


_G = "regexp_extract(attribute, 'gene_id \"([^\"]*)\"', 1)"


@query(f"""WITH {_EX}, u AS (SELECT ex.chrom, CASE WHEN ex.strand = '+' THEN greatest(ex.s, cs) ELSE ex.s END AS s0, CASE WHEN ex.strand = '+' THEN greatest(ex.s, ce) ELSE ex.s END AS s, CASE WHEN ex.strand = '+' THEN ex.e ELSE least(ex.e, cs) END AS e, ex.strand, ex.t AS transcript_id, cs AS cds_start, ce AS cds_end, {_G} AS gene_id, CAST(NULL AS STRING) AS gene_name FROM ex JOIN cd ON ex.t = cd.t)
SELECT chrom, s, e, strand, transcript_id, cds_start, cds_end, gene_id, gene_name FROM u WHERE s < e""")
def utr3_table(v):
    return annotation.utr3_table(v("gtf"))


@query(f"SELECT chrom, s, e, strand, {_T} AS transcript_id, {_G} AS gene_id FROM gtf WHERE feature = 'CDS'")
def coding_table(v):
    return annotation.coding_table(v("gtf"))


@query(f"SELECT chrom, s, e, strand, {_T} AS transcript_id, {_G} AS gene_id FROM gtf WHERE feature = 'exon' AND contains(attribute, 'gbkey \"mRNA\"')")
def messenger_exon_table(v):
    return annotation.messenger_exon_table(v("gtf"))


@query(f"SELECT chrom, s, e, strand, {_T} AS transcript_id, {_G} AS gene_id, b AS biotype, b = 'lnc_RNA' AS in_list FROM (SELECT *, regexp_extract(attribute, 'transcript_biotype \"([^\"]*)\"', 1) AS b FROM gtf WHERE feature = 'exon') AS x WHERE b <> 'mRNA'")
def noncoding_table(v):
    return annotation.noncoding_table(v("gtf")).drop("gene_name")


@query(f"WITH {_EX} SELECT {_T} AS transcript_id, s, CASE WHEN ex.strand = '+' THEN s - ce ELSE cs - s - 1 END AS distance FROM ex JOIN cd ON ex.t = cd.t")
def distance_to_cds(v):
    rows = annotation.transcript_exons(v("gtf")).join(annotation.coding_bounds(v("gtf")).hint("merge"), "transcript_id")
    return rows.select("transcript_id", "start", annotation.distance_to_cds("start", "cds_start", "cds_end", "strand").alias("distance"))


@query(f"WITH z AS (SELECT {_T} AS t, CAST(sum(e - s) AS BIGINT) AS n FROM gtf WHERE feature = 'exon' GROUP BY 1), p AS (SELECT DISTINCT x.chrom, x.pos, {_T} AS t FROM variants AS x JOIN gtf AS g ON g.feature = 'exon' AND x.chrom = g.chrom AND x.pos - 1 < g.e AND g.s < x.pos) SELECT chrom, pos, min(n) AS transcript_size FROM p LEFT JOIN z ON p.t = z.t GROUP BY chrom, pos")
def least_transcript_size(v):
    exons = annotation.with_attributes(v("gtf").where("feature = 'exon'"), "transcript_id")
    spots = v("variants").select("chrom", "pos", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    held = interval_joins.overlap_join(spots, exons.select("chrom", "start", "end", "transcript_id")).select("chrom", "pos", F.col("transcript_id_b").alias("transcript_id")).distinct()
    return annotation.least_size_at(held, exons)


@query("SELECT query, chrom, s, e FROM (SELECT query, target AS chrom, least(tstart, tend) - 1 - CAST(floor((64 - (greatest(tstart, tend) - least(tstart, tend) + 1)) / CAST(2 AS DOUBLE)) AS BIGINT) AS s, row_number() OVER (PARTITION BY query ORDER BY bits DESC, target, least(tstart, tend), greatest(tstart, tend)) AS k FROM hits) AS t CROSS JOIN LATERAL (SELECT t.s + 64 AS e) AS z WHERE k = 1")
def projected_windows(v):
    best = selection.best_hit(selection.hits_to_intervals(v("hits")))
    return intervals.resize(best, 64).select("query", "chrom", "start", "end")
