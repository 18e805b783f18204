"""Queries of table operators over the demo views, each with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import sequence as Q
from ..operators import aggregates, matching, metrics, selection, tables, variants
from ..operators.kept import shared_folder
from .catalogue import _STEPS, _nearest_sql, letter_windows, on_both_strands, query, r6


@query("WITH f AS (SELECT query, target, min(bits) AS b FROM hits GROUP BY query, target) SELECT query, string_agg(target, '|' ORDER BY b, target) AS target FROM f GROUP BY query")
def collect_in_order(v):
    return tables.joined_in_order(v("hits"), ["query"], ["bits"], "target")


@query("SELECT subset, count(DISTINCT (chrom, pos)) AS n_sites FROM variants GROUP BY subset")
def distinct_pairs(v):
    return v("variants").groupBy("subset").agg(F.count_distinct("chrom", "pos").alias("n_sites"))


@query("""WITH x AS (SELECT chrom, e - s AS n FROM iv_a), r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY n) AS k, count(*) OVER (PARTITION BY chrom) AS m FROM x)
SELECT chrom, count(*) AS n, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, max(CASE WHEN k = CAST(floor(0.1 * (m - 1) + 0.5) AS BIGINT) + 1 THEN n END) AS p10, max(CASE WHEN k = CAST(floor(0.5 * (m - 1) + 0.5) AS BIGINT) + 1 THEN n END) AS p50,
max(CASE WHEN k = CAST(floor(0.9 * (m - 1) + 0.5) AS BIGINT) + 1 THEN n END) AS p90, round(count(*) / CAST((SELECT count(*) FROM x) AS DOUBLE), 6) AS n_share, round(sum(n) / CAST((SELECT sum(n) FROM x) AS DOUBLE), 6) AS total_share FROM r GROUP BY chrom""")
def region_size_stats(v):
    sizes = v("iv_a").select("chrom", (F.col("end") - F.col("start")).alias("n"))
    out = tables.summary_with_quantiles(sizes.withColumnRenamed("n", "size"), "chrom", "size", [0.1, 0.5, 0.9])
    return out.select("chrom", "n", "total", r6("mean"), r6("sd"), "p10", "p50", "p90", r6("n_share"), r6("total_share"))


@query("SELECT concat(CASE subset WHEN 'click' THEN 'rna' WHEN 'view' THEN 'dna' ELSE 'other' END, '_', row_number() OVER (PARTITION BY CASE subset WHEN 'click' THEN 'rna' WHEN 'view' THEN 'dna' ELSE 'other' END ORDER BY row_id) - 1) AS track, score FROM variants")
def indexed_tracks(v):
    names = {s: "other" for s in ("error", "purchase", "scroll", "signup", "login", "logout")} | {"click": "rna", "view": "dna"}
    return tables.wide_row(v("variants").select("row_id", "subset", "score"), names, "subset", "score", ["row_id"])


@query("SELECT row_id, row_number() OVER (PARTITION BY chrom ORDER BY pos, row_id) - 1 AS index FROM variants")
def index_in_group(v):
    return tables.index_in_group(v("variants"), ["chrom"], ["pos", "row_id"]).select("row_id", F.col("index").cast("long").alias("index"))


@query("WITH g AS (SELECT match_group, count(*) AS n, count(DISTINCT label) AS l, count(DISTINCT score) AS k FROM pairs GROUP BY match_group) SELECT count(*) AS groups, CAST(sum(CASE WHEN n <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS bad_size, CAST(sum(CASE WHEN k <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS bad_score, CAST(sum(CASE WHEN l <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS bad_label FROM g")
def group_audit(v):
    return tables.group_audit(v("pairs"), "match_group", 2, ["score"], ["label"])


@query("SELECT round((sum(score) + sum(-score)) / (sum(n) + sum(m)), 6) AS ll_all, round(sum(score) / sum(n), 6) AS ll_upper, round(-sum(score) / sum(m), 6) AS ll_lower, CAST(sum(n) AS BIGINT) AS n_upper, CAST(sum(m) AS BIGINT) AS n_lower, round(sum(score) / sum(n) + sum(score) / sum(m), 6) AS gap FROM (SELECT coalesce(score, 0) AS score, CAST(1 + row_id % 7 AS DOUBLE) AS n, CAST(2 + row_id % 5 AS DOUBLE) AS m FROM variants) AS t")
def likelihood_gap(v):
    s = F.coalesce("score", F.lit(0.0))
    out = tables.likelihood_gap(v("variants").select(s.alias("ll_upper"), (-s).alias("ll_lower"), (1 + F.col("row_id") % 7).alias("n_upper"), (2 + F.col("row_id") % 5).alias("n_lower")))
    return out.select(r6("ll_all"), r6("ll_upper"), r6("ll_lower"), "n_upper", "n_lower", r6("gap"))


@query("SELECT CAST(sum(2 + CASE WHEN label THEN 0 ELSE 1 END) AS BIGINT) AS n_neg, CAST(sum(CASE WHEN label THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, round(sum(2 + CASE WHEN label THEN 0 ELSE 1 END) / CAST(sum(CASE WHEN label THEN 1 ELSE 0 END) AS DOUBLE), 6) AS weight FROM variants")
def class_weight(v):
    return tables.class_weight(v("variants").select(F.array(F.lit(0), F.col("label").cast("int"), F.lit(0)).alias("labels"))).select("n_neg", "n_pos", r6("weight"))


@query("WITH q AS (SELECT DISTINCT query FROM hits), n AS (SELECT query, count(DISTINCT target) AS n FROM hits WHERE bits > 60000 GROUP BY query), a AS (SELECT coalesce(n, 0) AS n FROM q LEFT JOIN n ON q.query = n.query) SELECT count(*) AS n_queries, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(avg(CASE WHEN n > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS share FROM a")
def leakage_stats(v):
    out = tables.leakage_summary(aggregates.hits_per_query(v("hits").select("query").distinct(), v("hits").where("bits > 60000")))
    return out.select("n_queries", "least", "most", r6("mean"), r6("median"), r6("share"))


@query("WITH c AS (SELECT DISTINCT chrom FROM variants), k AS (SELECT unnest(['click', 'view', 'error']) AS subset), n AS (SELECT chrom, subset, count(*) AS n FROM variants GROUP BY chrom, subset) SELECT k.subset, round(avg(coalesce(n, 0)), 6) AS mean, round(quantile_cont(coalesce(n, 0), 0.5), 6) AS median FROM c CROSS JOIN k LEFT JOIN n ON c.chrom = n.chrom AND k.subset = n.subset GROUP BY k.subset")
def pivot_statistics(v):
    return tables.pivot_statistics(v("variants"), "chrom", "subset", ["click", "view", "error"]).select("subset", r6("mean"), r6("median"))


@query("SELECT chrom, pos, min(abs(d)) AS distance FROM (SELECT x.chrom, x.pos, g.s - x.pos AS d FROM variants AS x JOIN genes AS g ON x.chrom = g.chrom AND x.pos - 1 < g.e AND g.s < x.pos) AS t GROUP BY chrom, pos")
def least_distance(v):
    from ..operators.interval_joins import overlap_join

    spots = v("variants").select("chrom", "pos", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    return overlap_join(spots, v("genes")).groupBy("chrom", "pos").agg(F.min(F.abs(F.col("start_b") - F.col("pos"))).alias("distance"))


@query("SELECT 'a' AS step, query, count(*) AS n FROM hits GROUP BY query UNION ALL SELECT 'b', CAST(study AS STRING), count(*) FROM pip GROUP BY study")
def tagged_union(v):
    a = v("hits").groupBy("query").agg(F.count("*").alias("n"))
    return tables.tagged_union({"a": a, "b": v("pip").groupBy(F.col("study").cast("string").alias("query")).agg(F.count("*").alias("n"))}, "step").select("step", "query", "n")


@query("SELECT row_id, chrom, g.n FROM variants JOIN (SELECT chrom AS c, count(*) AS n FROM variants GROUP BY chrom) AS g ON chrom = c")
def strict_join(v):
    n = v("variants").groupBy("chrom").agg(F.count("*").alias("n"))
    return tables.strict_join(v("variants").select("row_id", "chrom"), n, ["chrom"], "n").select("row_id", "chrom", "n")


@query("SELECT row_id, pos, CASE WHEN label THEN 1 ELSE 0 END AS y FROM variants")
def side_by_side(v):
    return tables.side_by_side(v("variants").select("row_id", "pos"), v("variants").select("row_id", F.col("label").cast("int").alias("y")), ["row_id"])


@query("SELECT row_id, greatest(score, CAST(pos AS DOUBLE) / 100, CAST(row_id % 50 AS DOUBLE)) AS best FROM variants")
def row_max(v):
    cols = v("variants").select("row_id", "score", (F.col("pos") / 100).alias("b"), (F.col("row_id") % 50).cast("double").alias("c"))
    return tables.row_max(cols, ["score", "b", "c"], "best").select("row_id", "best")


@query("SELECT row_id, chrom, s, e FROM (SELECT *, lead(s) OVER (PARTITION BY chrom ORDER BY s, e) AS n FROM iv_b) AS t WHERE n < e")
def gap_check(v):
    return tables.gaps_in_order(v("iv_b"), "chrom")


@query("WITH a AS (SELECT DISTINCT variant FROM pip WHERE method = 'A'), b AS (SELECT DISTINCT variant FROM pip WHERE method = 'R') SELECT variant, 'left' AS side FROM a WHERE variant NOT IN (SELECT variant FROM b) UNION ALL SELECT variant, 'right' FROM b WHERE variant NOT IN (SELECT variant FROM a)")
def set_difference(v):
    return tables.value_set_difference(v("pip").where("method = 'A'"), v("pip").where("method = 'R'"), "variant")


_GENOMES = "SELECT concat('acc', gene) AS accession, concat('species ', gene % 300) AS name, CASE WHEN gene % 7 = 0 THEN NULL ELSE gene % 50 END AS family, CASE gene % 4 WHEN 0 THEN 'Complete Genome' WHEN 1 THEN 'Chromosome' WHEN 2 THEN 'Scaffold' ELSE 'Contig' END AS assembly_level, e % 1000 AS size FROM genes"


def _genomes(v):
    g = F.col("gene")
    level = F.element_at(F.array(*[F.lit(x) for x in ("Complete Genome", "Chromosome", "Scaffold", "Contig")]), (g % 4 + 1).cast("int"))
    return v("genes").select(F.concat(F.lit("acc"), g).alias("accession"), F.concat(F.lit("species "), g % 300).alias("name"), F.when(g % 7 != 0, g % 50).alias("family"), level.alias("assembly_level"), (F.col("end") % 1000).alias("size"))


@query(f"WITH g AS ({_GENOMES}) SELECT accession, family FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN accession IN ('acc11', 'acc62') THEN 0 ELSE 1 END, CASE assembly_level WHEN 'Complete Genome' THEN 1 WHEN 'Chromosome' THEN 2 ELSE 3 END, size, name, accession) AS k FROM g WHERE family IS NOT NULL AND assembly_level <> 'Contig' AND size < 900 AND accession <> 'acc12') AS t WHERE k = 1")
def genome_priority_dedup(v):
    return tables.genome_dedup(_genomes(v), "family", ["Complete Genome", "Chromosome", "Scaffold", "Contig"], "Scaffold", 900, ["acc12"], ["acc11", "acc62"]).select("accession", "family")


@query(f"WITH g AS ({_GENOMES}) SELECT 'rank' AS chosen, accession FROM g WHERE family = 3 UNION ALL SELECT 'list', accession FROM g WHERE accession IN ('acc1', 'acc2', 'acc5')")
def genome_sets(v):
    g = _genomes(v)
    return tables.tagged_union({"rank": tables.genome_set(g, "family", 3), "list": tables.genome_set(g, accessions=["acc1", "acc2", "acc5"])}, "chosen").select("chosen", "accession")


@query("""WITH u AS (SELECT 'one' AS species, row_id FROM variants WHERE chrom IN ('chr1', 'chr2') UNION ALL SELECT 'two', row_id FROM variants WHERE chrom = 'chr3')
SELECT species, row_id FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('9|', species, '|', row_id)), species, row_id) AS k FROM u) AS t WHERE k <= 100""")
def species_split(v):
    rows = v("variants").select("row_id", "chrom")
    return tables.species_split({"one": rows, "two": rows}, {"one": ["chr1", "chr2"], "two": ["chr3"]}, 9, ["row_id"], 100).select("species", "row_id")


@query("""WITH p AS (SELECT match_group, label, CASE WHEN match_group % 3 = 0 THEN 'x' ELSE 'y' END AS subset, CASE WHEN score > 200000 THEN NULL ELSE score END AS raw FROM pairs WHERE match_group IN (SELECT match_group FROM pairs GROUP BY match_group HAVING count(*) = 2)),
g AS (SELECT match_group, min(subset) AS subset, max(CASE WHEN label THEN coalesce(raw, 0) END) AS a, max(CASE WHEN NOT label THEN coalesce(raw, 0) END) AS b FROM p GROUP BY match_group), u AS (SELECT subset, a, b FROM g UNION ALL SELECT '_global_', a, b FROM g),
m AS (SELECT subset, avg(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0.0 END) AS value, count(*) AS n_pairs FROM u GROUP BY subset), n AS (SELECT subset, count(*) FILTER (WHERE raw IS NULL) AS n_nan, count(*) AS n_total FROM (SELECT subset, raw FROM p UNION ALL SELECT '_global_', raw FROM p) AS z GROUP BY subset)
SELECT m.subset, round(value, 6) AS value, n_pairs, n_nan, n_total FROM m JOIN n ON m.subset = n.subset UNION ALL SELECT '_macro_avg_', round(avg(value), 6), count(*), CAST(sum(n_nan) AS BIGINT), CAST(sum(n_total) AS BIGINT) FROM m JOIN n ON m.subset = n.subset WHERE m.subset <> '_global_'""")
def conservation_metrics(v):
    whole = v("pairs").groupBy("match_group").agg(F.count("*").alias("n")).where("n = 2").drop("n")
    rows = v("pairs").join(whole, "match_group", "left_semi").select("match_group", "label", F.when(F.col("match_group") % 3 == 0, "x").otherwise("y").alias("subset"), F.lit("track").alias("score_type"), F.when(F.col("score") <= 200000, F.col("score")).alias("score"))
    return tables.conservation_metrics(rows, 30).select("subset", r6("value"), "n_pairs", "n_nan", "n_total")


@query("SELECT concat('m', l_suppkey % 5) AS method_id, concat('Model ', l_suppkey % 5) AS display, CASE WHEN l_suppkey % 5 < 3 THEN 'lm' ELSE 'track' END AS family, CASE WHEN l_suppkey % 5 < 3 THEN CASE WHEN l_returnflag = 'A' THEN 'LLR' ELSE 'JSD' END ELSE 'raw' END AS protocol, concat('s', l_partkey % 3) AS subset, l_quantity AS value, l_tax AS se, l_orderkey AS n_pairs, CAST(0 AS BIGINT) AS n_ties FROM lineitem WHERE l_linenumber = 1 AND CASE WHEN l_suppkey % 5 < 3 THEN l_returnflag IN ('A', 'R') AND l_linestatus = 'O' ELSE l_returnflag = 'N' END")
def leaderboard_tidy(v):
    spark = v("pip").sparkSession
    t = v("lineitem")
    model = F.concat(F.lit("m"), F.col("l_suppkey") % 5)
    rows = t.where("l_linenumber = 1").select(model.alias("model"), F.col("l_returnflag").alias("score_type"), F.col("l_linestatus").alias("split"), F.concat(F.lit("s"), F.col("l_partkey") % 3).alias("subset"), F.col("l_quantity").alias("value"), F.col("l_tax").alias("se"), F.col("l_orderkey").alias("n_groups"))
    methods = spark.createDataFrame([(f"m{i}", f"Model {i}", "lm" if i < 3 else "track") for i in range(5)], "id string, display string, family string")
    protocols = spark.createDataFrame([("lm", "LLR", "A", "O"), ("lm", "JSD", "R", "O"), ("track", "raw", "N", None)], "family string, protocol string, score_type string, split string")
    return tables.leaderboard(rows, methods, protocols)


_RANKS = f"""WITH scored2 AS (SELECT id, label, -score AS score, subset FROM scored UNION ALL SELECT id, label, -score, 'global' FROM scored),
{_STEPS.replace('FROM scored', 'FROM scored2')}, a AS (SELECT subset, CASE WHEN max(pp) > 0 THEN sum(p * tp / k) / max(pp) END AS ap, (sum(p * (nn - k + (n + 1) / 2)) - max(pp) * (max(pp) + 1) / 2) / nullif(max(pp) * (max(nn) - max(pp)), 0) AS auc FROM st GROUP BY subset)"""


@query(f"{_RANKS} SELECT subset, 'AUPRC' AS metric, round(ap, 6) AS value FROM a UNION ALL SELECT subset, 'AUROC', round(auc, 6) FROM a")
def baseline_metrics(v):
    s = v("scored")
    return tables.baseline_metrics(s.drop("score"), s.select("id", "score"), ["id"]).select("subset", "metric", r6("value"))


@query(f"{_RANKS.replace('-score', 'score').replace(chr(39) + 'global' + chr(39), chr(39) + '_global_' + chr(39))} SELECT subset AS genome, round(auc, 6) AS auroc, round(ap, 6) AS auprc FROM a")
def validation_metrics(v):
    return tables.validation_metrics(v("scored").withColumnRenamed("subset", "genome")).select("genome", r6("auroc"), r6("auprc"))


@query("WITH g AS (SELECT match_group, max(CASE WHEN label THEN score END) AS p, max(CASE WHEN NOT label THEN score END) AS q FROM pairs GROUP BY match_group HAVING count(*) = 2) SELECT part, n, wins, accuracy, round(p_exact, 6) AS p_value, round(least(1.0, p_exact * count(*) OVER ()), 6) AS p_adjusted FROM (SELECT match_group % 200 AS part, count(*) AS n, CAST(sum(CASE WHEN p > q THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(avg(CASE WHEN p > q THEN 1.0 WHEN p = q THEN 0.5 ELSE 0.0 END), 6) AS accuracy, least(1.0, 2 * (SELECT sum(exp(lgamma(m + 1) - lgamma(CAST(k AS DOUBLE) + 1) - lgamma(m - k + 1) - m * ln(2.0))) FROM (SELECT unnest(range(0, 1 + least(CAST(sum(CASE WHEN p > q THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN p < q THEN 1 ELSE 0 END) AS BIGINT)))) AS k, CAST(sum(CASE WHEN p <> q THEN 1 ELSE 0 END) AS DOUBLE) AS m) AS r)) AS p_exact FROM g GROUP BY 1) AS t")
def sign_tests(v):
    whole = v("pairs").groupBy("match_group").agg(F.count("*").alias("n")).where("n = 2").drop("n")
    rows = v("pairs").join(whole, "match_group", "left_semi").withColumn("part", F.col("match_group") % 200)
    return tables.sign_tests(rows, ["part"]).select("part", "n", "wins", r6("accuracy"), r6("p_value"), r6("p_adjusted"))


@query(f"WITH {_STEPS}, a AS (SELECT subset, max(pp) AS pp, max(nn) AS nn, sum(p * (nn - k + (n + 1) / 2)) AS rs, sum(n * (nn - k + (n + 1) / 2) * (nn - k + (n + 1) / 2)) AS sq FROM st GROUP BY subset), b AS (SELECT subset, (nn + 1) / 2 AS m, pp, nn, rs, sq, (nn - pp) + (pp + 1) / 2 AS ry, (nn - pp + 1) / 2 AS rn FROM a) SELECT subset, round((rs * ry + (nn * m - rs) * rn - nn * m * m) / nullif(sqrt((sq - nn * m * m) * (pp * ry * ry + (nn - pp) * rn * rn - nn * m * m)), 0), 6) AS spearman FROM b")
def spearman(v):
    return metrics.ranking_metrics(v("scored"), ["subset"]).select("subset", r6("spearman"))


@query("SELECT subset, feature, round(greatest(up, down), 6) AS auprc FROM (SELECT subset, 'pos' AS feature, max(CASE WHEN d = 0 THEN ap END) AS up, max(CASE WHEN d = 1 THEN ap END) AS down FROM (SELECT subset, d, CASE WHEN max(pp) > 0 THEN sum(p * tp / k) / max(pp) END AS ap FROM (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER (PARTITION BY subset, d) AS pp FROM (SELECT subset, d, x, CAST(sum(CASE WHEN y THEN 1 ELSE 0 END) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM (SELECT chrom AS subset, label AS y, 0 AS d, CAST(pos AS DOUBLE) AS x FROM variants UNION ALL SELECT chrom, label, 1, -CAST(pos AS DOUBLE) FROM variants) AS z GROUP BY subset, d, x) AS g WINDOW w AS (PARTITION BY subset, d ORDER BY x DESC ROWS UNBOUNDED PRECEDING)) AS st GROUP BY subset, d) AS a GROUP BY subset) AS b")
def matching_leak(v):
    rows = v("variants").select(F.col("chrom").alias("subset"), "label", F.col("pos").cast("double").alias("pos"))
    _, leak = matching.matching_qc(rows, rows, ["pos"])
    return leak.select("subset", "feature", r6("auprc"))


@query("""WITH w AS (SELECT id, unnest(range(length(raw) // 9)) AS number, raw FROM seqs), x AS (SELECT id, number, substr(raw, 9 * number + 1, 9) AS f, substr('ACGT', CAST(1 + number % 4 AS INTEGER), 1) AS alt FROM w),
y AS (SELECT id, number, '+' AS strand, f, alt FROM x UNION ALL SELECT id, number, '-', reverse(translate(f, 'ACGTacgt', 'TGCAtgca')), translate(alt, 'ACGT', 'TGCA') FROM x)
SELECT id, number, strand, array_to_string(list_transform(string_split(f, ''), lambda c: coalesce(nullif(list_position(['a','c','g','t'], lower(c)), 0) + 1, 1)), ' ') AS input_ids, CAST(list_position(['A','C','G','T'], alt) + 1 AS INTEGER) AS alt_token_id FROM y""")
def variant_examples(v):
    """Every window of 9 letters of every text with another base for its middle, on both strands."""
    windows = letter_windows(v("seqs"), 9)
    alt = F.substring(F.lit("ACGT"), (1 + F.col("number") % 4).cast("int"), F.lit(1))
    return on_both_strands(windows, lambda strand: Q.variant_example(F.col("window"), alt, strand)).select("id", "number", "strand", F.array_join(F.col("x.input_ids").cast("array<string>"), " ").alias("input_ids"), F.col("x.alt_token_id").alias("alt_token_id"))


@query("SELECT row_id, round(u, 6) AS ll_upper, round(l, 6) AS ll_lower, CAST(2 AS BIGINT) AS n_upper, CAST(1 AS BIGINT) AS n_lower FROM (SELECT row_id, 0 - CAST(row_id % 3 AS DOUBLE) - CAST(row_id % 5 AS DOUBLE) / 2 AS u, 0 - CAST(row_id % 7 AS DOUBLE) AS l FROM variants) AS t")
def likelihood_by_case(v):
    r = F.col("row_id")
    log_p = F.array((-(r % 3)).cast("double"), (-(r % 7)).cast("double"), -(r % 5) / 2)
    x = Q.split_log_likelihood(log_p, F.array(F.lit(False), F.lit(True), F.lit(False), F.lit(True)))
    return v("variants").select("row_id", x.alias("x")).select("row_id", "x.*").select("row_id", r6("ll_upper"), r6("ll_lower"), "n_upper", "n_lower")


@query("SELECT row_id, round(-(row_id % 4) / CAST(2 AS DOUBLE) - ln(exp(-(row_id % 4) / CAST(2 AS DOUBLE)) + exp(-(row_id % 3)) + exp(-1.5) + exp(CAST(0 AS DOUBLE))), 6) AS ref_log_prob FROM variants")
def reference_log_probability(v):
    r = F.col("row_id")
    x = Q.reference_log_probability(F.array(-(r % 4) / 2, (-(r % 3)).cast("double"), F.lit(-1.5), F.lit(0.0)), F.lit(0))
    return v("variants").select("row_id", x.alias("ref_log_prob")).select("row_id", r6("ref_log_prob"))


@query("SELECT row_id, concat('species ', subset) AS species, CASE WHEN score IS NULL THEN concat('{\"subset\":\"', subset, '\"}') ELSE concat('{\"subset\":\"', subset, '\",\"known\":true}') END AS json FROM variants")
def names_and_json(v):
    rows = v("variants").select("row_id", tables.plain_species(F.concat(F.lit("species_"), "subset", F.lit("_b"))).alias("species"), F.struct("subset", F.when(F.col("score").isNotNull(), True).alias("known")).alias("x"))
    return rows.select("row_id", "species", F.to_json("x").alias("json"))


@query("SELECT variant, min(pip) AS least, max(pip) AS most FROM pip GROUP BY variant HAVING count(DISTINCT method) = 3")
def widest_methods(v):
    return v("pip").groupBy("variant").agg(F.count_distinct("method").alias("m"), F.min("pip").alias("least"), F.max("pip").alias("most")).where("m = 3").drop("m")


@query("SELECT row_id, chrom, pos, ref, alt, c AS consequence FROM variants LEFT JOIN (SELECT row_id AS k, concat('c', row_id % 4) AS c FROM variants WHERE row_id % 3 = 0) AS t ON row_id = k")
def attach_consequences(v):
    x = v("variants")
    table = x.where("row_id % 3 = 0").select(*variants.KEY, F.concat(F.lit("c"), F.col("row_id") % 4).alias("consequence"))
    return variants.attach_consequences(x.select("row_id", *variants.KEY), table)


@query("SELECT DISTINCT chrom, pos FROM (SELECT chrom, pos FROM variants WHERE label UNION ALL SELECT chrom, s + 1 FROM iv_b)")
def union_of_keys(v):
    return v("variants").where("label").select("chrom", "pos").union(v("iv_b").select("chrom", (F.col("start") + 1).alias("pos"))).distinct()


@query("SELECT (SELECT count(*) FROM (SELECT chrom, s, e FROM iv_b EXCEPT ALL SELECT chrom, s, e FROM gaps)) AS only_left, (SELECT count(*) FROM (SELECT chrom, s, e FROM gaps EXCEPT ALL SELECT chrom, s, e FROM iv_b)) AS only_right, (SELECT count(*) FROM (SELECT chrom, s, e FROM iv_b INTERSECT SELECT chrom, s, e FROM gaps)) AS shared")
def rows_in_common(v):
    a, b = (v(name).select("chrom", "start", "end") for name in ("iv_b", "gaps"))
    counts = [x.agg(F.count("*").alias(name)) for x, name in ((a.exceptAll(b), "only_left"), (b.exceptAll(a), "only_right"), (a.intersect(b), "shared"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))


@query("SELECT subset, chrom, score FROM (SELECT subset, chrom, score, row_number() OVER (PARTITION BY subset ORDER BY score DESC, chrom) AS k FROM (SELECT subset, chrom, round(avg(coalesce(score, 0)), 6) AS score FROM variants GROUP BY subset, chrom) AS m) AS t WHERE k = 1")
def best_of_family(v):
    per = v("variants").groupBy("subset", "chrom").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("score"))
    return selection.best_of_family(per, "subset", "score", "chrom").select("subset", "chrom", "score")


@query("SELECT row_id, -score AS minus_llr, abs(score) AS abs_llr FROM variants")
def score_transforms(v):
    return v("variants").select("row_id", *[c.alias(n) for n, c in C.score_transforms(F.col("score")).items()])


@query("WITH q AS (SELECT subset, quantile_cont(pos, [0, 0.25, 0.5, 0.75, 1]) AS c FROM (SELECT subset, CAST(row_id % 3 AS DOUBLE) AS pos FROM variants) GROUP BY subset), d AS (SELECT subset, list_sort(list_distinct(c)) AS c FROM q) SELECT row_id, CAST(len(list_filter(list_slice(c, 2, len(c) - 1), lambda e: row_id % 3 > e)) AS INTEGER) AS bucket FROM variants JOIN d USING (subset)")
def quantile_cut(v):
    rows = v("variants").select("row_id", "subset", (F.col("row_id") % 3).cast("double").alias("pos"))
    return aggregates.quantile_cut(rows, ["subset"], "pos", 4).select("row_id", "bucket")


@query("""WITH x AS (SELECT row_id, chrom, subset, (row_id % 97) / CAST(97 AS DOUBLE) AS maf FROM variants), m AS (SELECT *, log10(greatest(1e-10, least(maf, 1.0))) AS g FROM x), l AS (SELECT chrom, min(g) AS low, max(g) AS high FROM m GROUP BY chrom)
SELECT row_id, CASE subset WHEN 'click' THEN concat('ll:', CAST(greatest(0, least(3, coalesce(floor((g - low) / nullif((high - low) / 4, 0)), 0))) AS BIGINT)) WHEN 'purchase' THEN concat('purchase:', CASE WHEN maf >= 0 AND maf <= 0.1 THEN 'b0' WHEN maf > 0.1 AND maf <= 0.5 THEN 'b1' ELSE 'OOR' END) ELSE 'UNKNOWN' END AS bin FROM m JOIN l USING (chrom)""")
def scheme_bins(v):
    rows = v("variants").select("row_id", "chrom", "subset", (F.col("row_id") % 97 / 97.0).alias("maf"))
    return aggregates.scheme_bins(rows, "subset", "maf", {"click": 4, "purchase": [0, 0.1, 0.5]}, ["chrom"]).select("row_id", "bin")


@query("SELECT row_id, chrom, pos, ref, alt, c AS consequence FROM (SELECT * FROM variants WHERE chrom IN ('chr3', 'chr7') AND pos < 3000) LEFT JOIN (SELECT row_id AS k, concat('c', row_id % 4) AS c FROM variants WHERE row_id % 3 = 0) AS t ON row_id = k")
def attach_from_table(v):
    """A table of consequences, written by chromosome, of which only folders and row groups with the variants are read."""
    x = v("variants")
    path = f"{shared_folder(x.sparkSession)}/{uuid.uuid4().hex}"
    variants.write_by_chromosome(x.where("row_id % 3 = 0").select(*variants.KEY, F.concat(F.lit("c"), F.col("row_id") % 4).alias("consequence")), path)
    return variants.attach_from_table(x.where("chrom in ('chr3', 'chr7') and pos < 3000").select("row_id", *variants.KEY), path, ["consequence"]).select("row_id", *variants.KEY, "consequence")


_CONSEQUENCE = "CASE row_id % 5 WHEN 0 THEN 'intron_variant' WHEN 1 THEN 'intergenic_variant' WHEN 2 THEN 'missense_variant' WHEN 3 THEN 'upstream_gene_variant' ELSE 'stop_gained' END"


@query(f"""WITH {_nearest_sql('ep', 'SELECT * FROM genes WHERE gene % 48 < 24')}, {_nearest_sql('en', 'SELECT * FROM genes WHERE gene % 48 >= 24')},
{_nearest_sql('tp', "SELECT gene, chrom, CASE WHEN strand = '-' THEN e - 1 ELSE s END AS s, CASE WHEN strand = '-' THEN e ELSE s + 1 END AS e FROM genes WHERE gene % 48 < 24")}, {_nearest_sql('tn', "SELECT gene, chrom, CASE WHEN strand = '-' THEN e - 1 ELSE s END AS s, CASE WHEN strand = '-' THEN e ELSE s + 1 END AS e FROM genes WHERE gene % 48 >= 24")},
x AS (SELECT *, {_CONSEQUENCE} AS consequence, CASE WHEN row_id % 7 = 0 THEN 'PLS' ELSE {_CONSEQUENCE} END AS cre FROM variants),
d AS (SELECT x.*, least(ep.distance, en.distance) AS distance_exon, CASE WHEN ep.distance <= en.distance THEN ep.gene ELSE en.gene END AS exon_closest_gene_id, least(tp.distance, tn.distance) AS distance_tss, CASE WHEN tp.distance <= tn.distance THEN tp.gene ELSE tn.gene END AS tss_closest_gene_id
  FROM x LEFT JOIN ep USING (row_id) LEFT JOIN en USING (row_id) LEFT JOIN tp USING (row_id) LEFT JOIN tn USING (row_id) WHERE consequence <> 'stop_gained'),
f AS (SELECT *, CASE WHEN consequence IN ('intergenic_variant', 'intron_variant', 'upstream_gene_variant', 'downstream_gene_variant') AND distance_tss <= 100 THEN 'tss_proximal' WHEN consequence = 'intron_variant' AND distance_exon <= 20 THEN 'exon_proximal' ELSE cre END AS consequence_final FROM d)
SELECT row_id, distance_exon, exon_closest_gene_id, distance_tss, tss_closest_gene_id, consequence_final, CASE WHEN consequence_final IN ('intergenic_variant', 'upstream_gene_variant') THEN 'distal' WHEN consequence_final IN ('tss_proximal', 'PLS') THEN 'promoter' ELSE consequence_final END AS consequence_group
FROM f WHERE consequence_final IN (SELECT consequence_final FROM f WHERE label)""")
def evaluation_table(v):
    genes = v("genes").withColumnRenamed("gene", "gene_id")
    minus = F.col("strand") == "-"
    starts = genes.select("gene_id", "chrom", F.when(minus, F.col("end") - 1).otherwise(F.col("start")).alias("start"), F.when(minus, F.col("end")).otherwise(F.col("start") + 1).alias("end"))
    both = lambda x: (x.where("gene_id % 48 < 24"), x.where("gene_id % 48 >= 24"))
    own = F.expr(_CONSEQUENCE)
    rows = v("variants").withColumns({"consequence": own, "consequence_cre": F.when(F.col("row_id") % 7 == 0, "PLS").otherwise(own)})
    out = variants.evaluation_table(rows, both(genes), both(starts), ["stop_gained"], 20, 100, {"distal": ["intergenic_variant", "upstream_gene_variant"], "promoter": ["tss_proximal", "PLS"]})
    return out.select("row_id", "distance_exon", "exon_closest_gene_id", "distance_tss", "tss_closest_gene_id", "consequence_final", "consequence_group")
