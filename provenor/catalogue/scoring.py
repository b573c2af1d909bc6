"""Checked queries for scoring, cohort support and clustering."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from provenor.catalogue.base import edge_tasks, query, r6, tab, with_views, x_cluster, x_edges, x_expr, x_map
from provenor.operators import ml, scoring
from provenor.operators.sorting import top_k
from provenor.plans import evidence, mapping, support
from provenor.session import materialise


@query("sco_minmax", """
SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 6) AS price_score, 0.0e0 AS flat_score FROM part""")
def sco_minmax(spark, sf):
    rows = tab(spark, sf, "part").select("p_partkey", "p_retailprice", F.lit(3.0).alias("flat"))
    scaled = scoring.minmax(rows, {"p_retailprice": "price_score", "flat": "flat_score"})
    return scaled.select("p_partkey", r6("price_score").alias("price_score"), "flat_score")


@query("sco_composite", """
SELECT s_suppkey, CASE WHEN s_suppkey % 8 <> 0 THEN round(0.2 * (s_nationkey / 25.0e0) + 0.5 * (s_acctbal / 10000) + 0.3 * (s_suppkey % 10 / 10.0e0), 6) END AS score,
       CASE WHEN s_suppkey % 8 = 0 THEN 'Not Found' WHEN 0.2 * (s_nationkey / 25.0e0) + 0.5 * (s_acctbal / 10000) + 0.3 * (s_suppkey % 10 / 10.0e0) >= 0.75 THEN 'Strong GEO support'
            WHEN 0.2 * (s_nationkey / 25.0e0) + 0.5 * (s_acctbal / 10000) + 0.3 * (s_suppkey % 10 / 10.0e0) >= 0.5 THEN 'Moderate GEO support' ELSE 'Limited GEO support' END AS level FROM supplier""")
def sco_composite(spark, sf):
    rows = tab(spark, sf, "supplier").select(
        "s_suppkey", (F.col("s_nationkey") / 25.0).alias("a"), (F.col("s_acctbal") / 10000).alias("b"), (F.col("s_suppkey") % 10 / 10.0).alias("c")
    )
    absent = F.col("s_suppkey") % 8 == 0
    scored = scoring.composite(rows, {"a": 0.2, "b": 0.5, "c": 0.3}, "score", absent)
    return scored.select("s_suppkey", r6("score").alias("score"), scoring.support_level(F.col("score"), ~absent).alias("level"))


def expression(spark, sf):
    """Derived facts in the shape of the QC-passed expression table."""
    return x_expr(spark, sf).select(
        "sample_id", "case_id", F.col("grp").alias("sample_group"), F.col("gene").alias("gene_id_base"), F.col("gene").alias("gene_name"),
        F.col("value").alias("tpm"), F.col("log_value").alias("log2_tpm"),
    )


def gene_map(spark, sf):
    return x_map(spark, sf).select(
        "protein_id", F.lit(None).cast("string").alias("ensp_id"), F.col("brand").alias("gene_id"), F.col("symbol").alias("gene_name"),
        F.col("symbol_norm").alias("gene_name_norm"), F.col("confidence").alias("gene_confidence"),
    )


def protein_edges(spark, sf):
    return mapping.protein_edges(x_edges(spark, sf))


def ranking_inputs(spark, sf):
    """(mapped evidence, network features) of the derived tables; the tables between phases are stored."""
    genes, edges = gene_map(spark, sf), materialise(protein_edges(spark, sf), "edges")
    diff = evidence.difference(expression(spark, sf), "case", "control")
    mapped = materialise(mapping.mapped_evidence(diff, genes), "mapped")
    parts = edge_tasks(spark, sf, 2)
    return mapped, evidence.network_features(mapped, edges, mapping.protein_nodes(genes, edges, parts), parts)


RANKING_VIEWS = """
, mp AS (SELECT DISTINCT gene, protein_id, effect AS fc, p_value, direction FROM x_diff JOIN (SELECT DISTINCT protein_id, upper(trim(symbol_norm)) AS name FROM x_map WHERE symbol IS NOT NULL) m ON upper(trim(gene)) = m.name WHERE abs(effect) >= 1 AND p_value < 0.05),
both_ways AS (SELECT src AS node, dst AS other, score, weight FROM x_edges UNION ALL SELECT dst, src, score, weight FROM x_edges),
deg AS (SELECT node, count(DISTINCT other) AS degree, sum(weight) AS wd FROM both_ways GROUP BY node),
near AS (SELECT node, count(DISTINCT other) AS n_int, avg(score) AS avg_score FROM (SELECT DISTINCT * FROM both_ways WHERE weight >= 0.4) GROUP BY node),
f AS (SELECT mp.*, coalesce(degree, 0) AS degree, coalesce(wd, 0) AS wd, coalesce(n_int, 0) AS n_int, coalesce(avg_score, 0) AS avg_score, abs(fc) AS afc
      FROM mp LEFT JOIN deg ON deg.node = protein_id LEFT JOIN near ON near.node = protein_id),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY protein_id ORDER BY afc DESC, p_value ASC NULLS LAST, gene) = 1),
sc AS (SELECT *, CASE WHEN max(afc) OVER () > min(afc) OVER () THEN (afc - min(afc) OVER ()) / (max(afc) OVER () - min(afc) OVER ()) ELSE 0 END AS s1,
              CASE WHEN max(wd) OVER () > min(wd) OVER () THEN (wd - min(wd) OVER ()) / (max(wd) OVER () - min(wd) OVER ()) ELSE 0 END AS s2,
              CASE WHEN max(avg_score) OVER () > min(avg_score) OVER () THEN (avg_score - min(avg_score) OVER ()) / (max(avg_score) OVER () - min(avg_score) OVER ()) ELSE 0 END AS s3 FROM b),
rk AS (SELECT *, 0.5 * s1 + 0.3 * s2 + 0.2 * s3 AS final_score, row_number() OVER (ORDER BY round(0.5 * s1 + 0.3 * s2 + 0.2 * s3, 12) DESC, round(afc, 12) DESC, round(wd, 9) DESC, gene, protein_id) AS rank FROM sc)
"""
_RANKED = """SELECT CAST(rank AS INTEGER) AS rank, gene AS gene_name, protein_id, round(fc, 6) AS log2fc, round(p_value, 6) AS p_value, direction, degree, round(wd, 4) AS weighted_degree, n_int,
       round(avg_score, 4) AS avg_score, round(s1, 6) AS expression_score, round(s2, 6) AS network_score, round(s3, 6) AS confidence_score, round(final_score, 6) AS final_score FROM rk"""


def _shown(df, rank_type):
    return df.select(
        F.col("rank").cast(rank_type).alias("rank"), "gene_name", "protein_id", r6("log2FC").alias("log2fc"), r6("p_value").alias("p_value"),
        F.col("deg_direction").alias("direction"), F.col("degree_protein").alias("degree"), r6("weighted_degree_protein", 4).alias("weighted_degree"),
        F.col("num_interactions_in_deg_network").alias("n_int"), r6("avg_combined_score", 4).alias("avg_score"), r6("expression_score").alias("expression_score"),
        r6("protein_network_score").alias("network_score"), r6("string_confidence_score").alias("confidence_score"), r6("final_score").alias("final_score"),
    )


@query("sco_candidate_ranking", with_views("x_edges", "x_map", "x_diff", body=RANKING_VIEWS + _RANKED + " WHERE rank <= 100"))
def sco_candidate_ranking(spark, sf):
    """The flagship: difference test, mapping, network features, scores and the top 100."""
    return _shown(evidence.top_candidate_targets(*ranking_inputs(spark, sf)), "int")


@query("sco_candidate_features", with_views("x_edges", "x_map", "x_diff", body=RANKING_VIEWS + _RANKED.replace("CAST(rank AS INTEGER) AS rank", "rank")))
def sco_candidate_features(spark, sf):
    """All ranked candidates."""
    return _shown(evidence.candidate_features(*ranking_inputs(spark, sf)), "bigint")


def _cohort(spark, sf):
    """(top list, wide matrix, metadata) of the derived tables: brands by supplier nation."""
    supp = tab(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("n"), "s_nationkey").alias("nation"))
    part = tab(spark, sf, "part").where("p_brand <> 'Brand#7'").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    line = tab(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice").join(supp, "l_suppkey").join(part, "l_partkey")
    # one row per brand and type, so brands repeat like probes of a gene do
    wide = line.groupBy("p_brand", "p_type").pivot("nation", [f"n{i}" for i in range(25)]).agg(F.max("l_extendedprice").cast("string"))
    meta = tab(spark, sf, "supplier").where("s_nationkey <> 5").select(F.concat(F.lit(" N"), "s_nationkey").alias("Array"))
    brands = tab(spark, sf, "part").groupBy(F.col("p_brand").alias("gene_name")).agg(F.count(F.lit(1)).alias("n"))
    top = top_k(brands, [F.col("n").desc(), F.col("gene_name")], 100).select(
        "rank", "gene_name", F.concat(F.lit("P"), "rank").alias("protein_id"), F.lit(None).cast("string").alias("ensp_id"), F.col("n").cast("double").alias("final_score")
    )
    return top, wide.drop("p_type").withColumnRenamed("p_brand", "gene_name"), meta


_COHORT_SQL = """
WITH w AS (SELECT p_brand AS gene, p_type, 'N' || s_nationkey AS sample, max(l_extendedprice) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#7' GROUP BY 1, 2, 3),
samples AS (SELECT DISTINCT 'N' || s_nationkey AS sample FROM supplier WHERE s_nationkey <> 5), tot AS (SELECT count(*) AS n FROM samples),
v AS (SELECT upper(gene) AS gene, sample, avg(v) AS v FROM w WHERE sample IN (SELECT sample FROM samples) GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY sample) <= 1 THEN 1 ELSE percent_rank() OVER (PARTITION BY sample ORDER BY v, gene) END AS pct FROM v),
st AS (SELECT gene, count(DISTINCT sample) AS n_avail, avg(v) AS mean_v, quantile_disc(v, 0.5) AS med_v, avg(pct) AS mean_pct, count(*) FILTER (pct >= 0.75) / (SELECT n FROM tot) AS tq FROM p GROUP BY gene),
top AS (SELECT p_brand AS gene_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY 1 QUALIFY rank <= 100),
r AS (SELECT rank, gene_name, n_avail, (SELECT n FROM tot) AS n_total, n_avail / (SELECT n FROM tot) AS cov, mean_v, med_v, mean_pct, tq,
             0.2 * (n_avail / (SELECT n FROM tot)) + 0.5 * mean_pct + 0.3 * tq AS score FROM top LEFT JOIN st ON st.gene = upper(gene_name)),
l AS (SELECT *, CASE WHEN n_avail IS NULL THEN 'Not Found' WHEN score >= 0.75 THEN 'Strong GEO support' WHEN score >= 0.5 THEN 'Moderate GEO support' ELSE 'Limited GEO support' END AS level FROM r)
"""


@query("sco_cohort_support", _COHORT_SQL + """
SELECT CAST(rank AS INTEGER) AS rank, gene_name, CASE WHEN n_avail IS NULL THEN 'Not Found' ELSE 'Found in GEO cohort' END AS status, n_avail, n_total, round(cov, 6) AS coverage,
       round(ln(mean_v), 6) AS mean_value, round(ln(med_v), 6) AS median_value, round(mean_pct, 6) AS mean_percentile, round(tq, 6) AS top_quartile, round(score, 6) AS score, level FROM l""")
def sco_cohort_support(spark, sf):
    r = support.cohort_support(*_cohort(spark, sf))
    return r.select(
        "rank", "gene_name", F.col("geo_match_status").alias("status"), F.col("geo_num_samples_available").alias("n_avail"), F.col("geo_total_samples").alias("n_total"),
        r6("geo_coverage_rate").alias("coverage"), r6(F.log("geo_mean_expression")).alias("mean_value"), r6(F.log("geo_median_expression")).alias("median_value"),
        r6("geo_mean_percentile").alias("mean_percentile"), r6("geo_top_quartile_rate").alias("top_quartile"), r6("geo_support_score").alias("score"),
        F.col("geo_support_level").alias("level"),
    )


@query("sco_support_summary", _COHORT_SQL + "SELECT level AS geo_support_level, count(*) AS candidate_count, round(100.0e0 * count(*) / (SELECT count(*) FROM l), 6) AS candidate_percentage FROM l GROUP BY 1")
def sco_support_summary(spark, sf):
    s = support.support_summary(materialise(support.cohort_support(*_cohort(spark, sf)), "support"))
    return s.withColumn("candidate_percentage", r6("candidate_percentage"))


@query("sco_supported_top", _COHORT_SQL + "SELECT row_number() OVER (ORDER BY round(score, 12) DESC NULLS LAST, rank) AS geo_support_rank, gene_name, round(score, 6) AS score FROM l")
def sco_supported_top(spark, sf):
    s = support.supported_top_candidates(support.cohort_support(*_cohort(spark, sf)))
    return s.select("geo_support_rank", "gene_name", r6("geo_support_score").alias("score"))


@query("mlx_standardize", with_views("x_cluster", body="""
, s AS (SELECT avg(f1) AS m1, stddev_samp(f1) AS d1, avg(f2) AS m2, stddev_samp(f2) AS d2 FROM x_cluster)
SELECT vec_id, round((f1 - m1) / d1, 6) AS z1, round((f2 - m2) / d2, 6) AS z2 FROM x_cluster, s"""))
def mlx_standardize(spark, sf):
    z = ml.scale_features(x_cluster(spark, sf), ["f1", "f2"]).withColumn("z", vector_to_array("features"))
    return z.select("vec_id", r6(F.col("z")[0]).alias("z1"), r6(F.col("z")[1]).alias("z2"))


def _squares(a, b):
    """Sum of the products of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _silhouette_of(points):
    """Mean silhouette (squared distances) of points (v array, cluster_id), from sizes, sums and sums of squares per cluster."""
    cells = points.select("cluster_id", F.posexplode("v").alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum("x").alias("x"))
    sums = cells.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    sizes = points.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum(_squares("v", "v")).alias("squares"))
    every = sizes.join(sums, "cluster_id").agg(F.collect_list(F.struct("cluster_id", "n", "squares", "total")).alias("c")).scalar()
    away = F.transform("__c", lambda c: F.struct(
        c["cluster_id"].alias("cluster_id"), c["n"].alias("n"), (c["n"] * _squares(F.col("v"), F.col("v")) + c["squares"] - 2 * _squares(F.col("v"), c["total"])).alias("d")
    ))
    own = F.element_at(F.filter("__d", lambda c: c["cluster_id"] == F.col("cluster_id")), 1)
    other = F.array_min(F.transform(F.filter("__d", lambda c: c["cluster_id"] != F.col("cluster_id")), lambda c: c["d"] / c["n"]))
    a = own["d"] / (own["n"] - 1)
    s = F.when(own["n"] > 1, (other - a) / F.greatest(a, other)).otherwise(0.0)
    return points.withColumn("__c", every).withColumn("__d", away).agg(F.avg(s).alias("s"))


@query("mlx_select_k", "SELECT CAST(k AS INTEGER) AS k, count(*) AS n_points, true AS silhouette_agrees FROM embeddings, (SELECT unnest(range(2, 7)) AS k) GROUP BY k")
def mlx_select_k(spark, sf):
    """The silhouette of each fit agrees with one recomputed from its labels by sums."""
    stored = ml.stored_features(x_cluster(spark, sf), ["f1", "f2", "f3", "score"], ["vec_id"])
    scores = ml.select_k(stored, ks=range(2, 7))
    parts = None
    for k in range(2, 7):
        points = ml.cluster(stored, k).select(vector_to_array("features").alias("v"), "cluster_id")
        again = _silhouette_of(points).select(F.lit(k).alias("k"), "s", points.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_points"))
        parts = again if parts is None else parts.unionByName(again)
    return scores.join(parts, "k").select("k", "n_points", (F.abs(F.col("s") - F.col("silhouette_score")) < 1e-6).alias("silhouette_agrees"))


@query("mlx_kmeans", """
SELECT count(*) AS n_points, CAST(3 AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS not_at_nearest, true AS numbered_by_centre FROM embeddings""")
def mlx_kmeans(spark, sf):
    """Every point is in the cluster of the nearest mean (up to the fit's tolerance), and clusters are numbered by their means."""
    stored = ml.stored_features(x_cluster(spark, sf), ["f1", "f2", "f3", "score"], ["vec_id"])
    points = materialise(ml.cluster(stored, 3).select("vec_id", vector_to_array("features").alias("v"), "cluster_id"), "clusters")
    means = points.select("cluster_id", F.posexplode("v").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg("x").alias("x"))
    centres = means.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    listed = centres.agg(F.sort_array(F.collect_list(F.struct("cluster_id", "m"))).alias("c")).scalar()
    far = F.transform("__c", lambda c: F.aggregate(F.zip_with(F.col("v"), c["m"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    seen = points.withColumn("__c", listed).withColumn("__far", far)
    ordered = F.array_sort(F.transform("__c", lambda c: c["m"])) == F.transform("__c", lambda c: c["m"])
    return seen.agg(
        F.count(F.lit(1)).alias("n_points"), F.count_distinct("cluster_id").alias("n_clusters"),
        F.count_if(F.sqrt(F.get("__far", F.col("cluster_id"))) > F.sqrt(F.array_min("__far")) + 0.05).alias("not_at_nearest"), F.bool_and(ordered).alias("numbered_by_centre"),
    )


@query("mlx_silhouette", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, list_distance(a.v, b.v) ** 2 AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, la, lb, avg(d) AS d FROM d GROUP BY 1, 2, 3),
s AS (SELECT vec_id, max(d) FILTER (la = lb) AS a, min(d) FILTER (la <> lb) AS b FROM m GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s""")
def mlx_silhouette(spark, sf):
    rows = tab(spark, sf, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"), F.col("label").cast("double").alias("label"))
    value = ml.silhouette(rows, "v", "label")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(r6(F.lit(value)).alias("silhouette"))
