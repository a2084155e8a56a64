"""Labels, validity, choice of k, reports; with given labels where a clusterer has no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog import ctes as c
from panelforge.catalog.features import _brand
from panelforge.catalog.registry import query
from panelforge.functions.storage import cut
from panelforge.operators import features as ft
from panelforge.operators import kshape as ks
from panelforge.operators import labels as lb
from panelforge.operators import reporting as rp
from panelforge.operators import selection as se
from panelforge.operators import validity as va
from panelforge.operators import ward as wd
from panelforge.operators.cleaning import regime_flags
from panelforge.operators.stats import DAYS_OF_WEEK, MONTHS
from panelforge.plans import clustering as pc
from panelforge.sources import adapters as ad

B = c.brand(1999)
GIVEN = "labels AS (SELECT household_id, CAST(CASE WHEN household_id % 10 = 9 THEN -1 WHEN household_id % 10 = 8 THEN -3 WHEN household_id = 7 THEN NULL ELSE household_id % 3 END AS INTEGER) AS cluster FROM (SELECT DISTINCT household_id FROM panel))"
FULL = "labels AS (SELECT household_id, CAST(CASE WHEN household_id % 10 = 9 OR household_id = 25 THEN -1 WHEN household_id % 10 = 8 THEN -3 ELSE household_id % 3 END AS INTEGER) AS cluster FROM (SELECT DISTINCT household_id FROM panel))"
REG = "reg AS (SELECT * FROM labels WHERE cluster >= 0)"
ZP = f"{c.z()}, zp AS (SELECT cluster, date, avg(consumption) AS mean FROM z JOIN reg USING (household_id) GROUP BY 1, 2), rp AS (SELECT cluster, date, avg(consumption) AS mean FROM panel JOIN reg USING (household_id) GROUP BY 1, 2)"


def _given(spark, d, missing=True):
    """Labels by id: two special groups and one missing label, or, with none missing, a special group of 3 and one of 2."""
    i = F.col("household_id")
    label = F.when((i % 10 == 9) if missing else (i % 10 == 9) | (i == 25), -1).when(i % 10 == 8, -3)
    if missing:
        label = label.when(i == 7, None)
    return _brand(spark, d).select(i).distinct().withColumn("cluster", label.otherwise(i % 3).cast("int"))


@query("k6_special_labels", "household_id cluster", "", f"{c.ctes(c.supplier(1999), c.flags())} SELECT household_id, CAST(CASE WHEN all_zero_flag THEN -1 WHEN near_constant_flag THEN -2 ELSE -3 END AS INTEGER) AS cluster FROM flags WHERE degenerate_flag")
def k6(spark, d):
    return lb.special_labels(regime_flags(ad.supplier_panel(spark, d, 1999)))


@query("k7_cluster_sizes", "cluster n_households", "pct_households", f"{c.ctes(B, GIVEN, REG)} SELECT cluster, count(*) AS n_households, 100.0 * count(*) / sum(count(*)) OVER () AS pct_households FROM reg GROUP BY 1")
def k7(spark, d):
    return lb.sizes(_given(spark, d))


@query("k8_balance", "", "cluster_balance", f"{c.ctes(B, GIVEN, REG)} SELECT min(n) / max(n) AS cluster_balance FROM (SELECT count(*) AS n FROM reg GROUP BY cluster)")
def k8(spark, d):
    return lb.balance(_given(spark, d))


@query(
    "k9_columns_by_family",
    "family n",
    "",
    "SELECT * FROM (VALUES ('raw_level_features', CAST(0 AS BIGINT)), ('raw_profile_features', 0), ('normalized_shape_features', 15), ('energy_profile_features', 0), ('persistence_trend_features', 4), ('other_features', 10)) AS t(family, n)",
)
def k9(spark, d):
    return spark.createDataFrame(sorted(lb.columns_by_family([x for b in ft.WARD_BLOCKS.values() for x in b]).items()), "family string, n long")


KEYS = f"""{ZP}, okm AS (SELECT cluster, month(date) AS mo, avg(mean) AS m FROM rp GROUP BY 1, 2), okd AS (SELECT cluster, isodow(date) AS dw, avg(mean) AS m FROM rp GROUP BY 1, 2),
ok AS (SELECT cluster, a.seasonal_contrast, b.weekend_lift, b.weekly_routine, g.profile_range FROM
  (SELECT cluster, avg(m) FILTER (mo IN (12, 1, 2)) - avg(m) FILTER (mo IN (6, 7, 8)) AS seasonal_contrast FROM okm GROUP BY 1) a
  JOIN (SELECT cluster, avg(m) FILTER (dw >= 6) - avg(m) FILTER (dw < 6) AS weekend_lift, max(m) - min(m) AS weekly_routine FROM okd GROUP BY 1) b USING (cluster)
  JOIN (SELECT cluster, max(mean) - min(mean) AS profile_range FROM zp GROUP BY 1) g USING (cluster)),
rank AS (SELECT cluster, row_number() OVER (ORDER BY seasonal_contrast DESC, weekend_lift DESC, weekly_routine DESC, profile_range DESC, cluster) - 1 AS new FROM ok)"""


@query("k13_order_keys", "cluster", "seasonal_contrast weekend_lift weekly_routine profile_range", f"{c.ctes(B, GIVEN, REG, KEYS)} SELECT * FROM ok")
def k13a(spark, d):
    return lb.order_keys(_brand(spark, d), _given(spark, d))


@query("k13_ordered_labels", "household_id cluster", "", f"{c.ctes(B, FULL, REG, KEYS)} SELECT household_id, CAST(coalesce(new, labels.cluster) AS INTEGER) AS cluster FROM labels LEFT JOIN rank ON labels.cluster = rank.cluster")
def k13b(spark, d):
    return lb.ordered(_brand(spark, d), _given(spark, d, False))


#: Large special groups are clusters; the rest joins the nearest profile of all clusters, these included.
REASSIGNED = """sp AS (SELECT cluster, count(*) AS n FROM labels2 WHERE cluster < 0 GROUP BY 1),
kept AS (SELECT cluster, coalesce((SELECT max(cluster) FROM labels2), -1) + row_number() OVER (ORDER BY cluster) AS new FROM sp WHERE n >= 3),
whole AS (SELECT household_id, CAST(coalesce(new, labels2.cluster) AS INTEGER) AS cluster FROM labels2 LEFT JOIN kept ON kept.cluster = labels2.cluster),
near AS (SELECT cluster, date, avg(consumption) AS mean FROM z JOIN whole USING (household_id) WHERE cluster >= 0 GROUP BY 1, 2),
rest AS (SELECT household_id FROM whole WHERE cluster < 0),
dist AS (SELECT z.household_id, near.cluster, sqrt(sum(pow(z.consumption - near.mean, 2))) AS d FROM z JOIN rest USING (household_id) JOIN near USING (date) GROUP BY 1, 2),
final AS (SELECT household_id, cluster FROM whole WHERE cluster >= 0 UNION ALL
  SELECT household_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY d, cluster) AS r FROM dist) WHERE r = 1)"""
AS_GIVEN = "labels2 AS (SELECT * FROM labels)"
ORDERED = "labels2 AS (SELECT household_id, CAST(coalesce(new, labels.cluster) AS INTEGER) AS cluster FROM labels LEFT JOIN rank ON labels.cluster = rank.cluster)"


@query("k12_reassigned", "household_id cluster", "", f"{c.ctes(B, FULL, c.z(), AS_GIVEN, REASSIGNED)} SELECT household_id, cluster FROM final")
def k12(spark, d):
    return lb.reassign_special(_brand(spark, d), _given(spark, d, False), 3)


@query("k14_handoff_sizes", "n_households", "pct_households", f"{c.ctes(B, FULL, REG, KEYS, ORDERED, REASSIGNED)} SELECT count(*) AS n_households, 100.0 * count(*) / sum(count(*)) OVER () AS pct_households FROM final GROUP BY cluster")
def k14(spark, d):
    return lb.handoff(_brand(spark, d), _given(spark, d, False), 3)["sizes"]


@query("p1_p15_assignments", "household_id cluster", "", f"{c.ctes(B, GIVEN)} SELECT household_id, cluster FROM labels")
def p15(spark, d):
    return rp.assignment_table(_given(spark, d))


@query("p2_cluster_profiles", "cluster date", "mean", f"{c.ctes(B, GIVEN, REG, ZP)} SELECT * FROM rp")
def p2(spark, d):
    return lb.cluster_profiles(_brand(spark, d), _given(spark, d))


@query(
    "p4_assignment_summary",
    "n_total_labels n_valid_labels n_special_regime_labels n_regular_clusters_found n_unassigned_households min_cluster_size max_cluster_size",
    "",
    f"""{c.ctes(B, GIVEN, REG)} SELECT count(*) AS n_total_labels, count(*) FILTER (cluster >= 0) AS n_valid_labels, count(*) FILTER (cluster < 0) AS n_special_regime_labels, count(DISTINCT cluster) FILTER (cluster >= 0) AS n_regular_clusters_found,
  count(*) FILTER (cluster IS NULL) AS n_unassigned_households, (SELECT min(n) FROM (SELECT count(*) AS n FROM reg GROUP BY cluster)) AS min_cluster_size, (SELECT max(n) FROM (SELECT count(*) AS n FROM reg GROUP BY cluster)) AS max_cluster_size FROM labels""",
)
def p4(spark, d):
    return rp.assignment_summary(_given(spark, d))


@query(
    "p5_special_summary",
    "n_special_regime_households",
    "pct_special_regime_households_all_rows pct_special_regime_households_assigned_only",
    f"""{c.ctes(B, GIVEN)} SELECT count(*) FILTER (cluster < 0) AS n_special_regime_households, 100.0 * count(*) FILTER (cluster < 0) / count(*) AS pct_special_regime_households_all_rows,
  100.0 * count(*) FILTER (cluster < 0) / count(cluster) AS pct_special_regime_households_assigned_only FROM labels""",
)
def p5(spark, d):
    return rp.special_summary(_given(spark, d))


@query("p5_special_counts", "cluster n", "", f"{c.ctes(B, GIVEN)} SELECT cluster, count(*) AS n FROM labels WHERE cluster < 0 GROUP BY 1")
def p5b(spark, d):
    return rp.special_counts(_given(spark, d))


@query(
    "p6_level_dominance",
    "cluster",
    "cluster_raw_profile_mean cluster_raw_profile_std cluster_normalized_profile_mean cluster_normalized_profile_std",
    f"""{c.ctes(B, GIVEN, REG, ZP)} SELECT * FROM (SELECT cluster, avg(mean) AS cluster_raw_profile_mean, stddev_samp(mean) AS cluster_raw_profile_std FROM rp GROUP BY 1) a
JOIN (SELECT cluster, avg(mean) AS cluster_normalized_profile_mean, stddev_samp(mean) AS cluster_normalized_profile_std FROM zp GROUP BY 1) b USING (cluster)""",
)
def p6(spark, d):
    return rp.level_dominance(_brand(spark, d), _given(spark, d))


HM = "hm AS (SELECT household_id, avg(consumption) AS m FROM panel GROUP BY 1)"


@query("p7_household_means", "cluster", "mean median std min max", f"{c.ctes(B, GIVEN, REG, HM)} SELECT cluster, avg(m) AS mean, median(m) AS median, stddev_samp(m) AS std, min(m) AS min, max(m) AS max FROM hm JOIN reg USING (household_id) GROUP BY 1")
def p7(spark, d):
    return rp.household_means(_brand(spark, d), _given(spark, d))


@query("p8_normalised_profiles", "cluster date", "mean", f"{c.ctes(B, GIVEN, REG, ZP)} SELECT * FROM zp")
def p8(spark, d):
    from panelforge.operators.cleaning import z_rows

    return lb.cluster_profiles(z_rows(_brand(spark, d)), _given(spark, d))


_DOW = [f"dow_{x}" for x in DAYS_OF_WEEK]
_MON = [f"month_{x}" for x in MONTHS]


@query("p9_weekly_profiles", "cluster", " ".join(_DOW), f"{c.ctes(B, GIVEN, REG, c.weekdays('panel'))} SELECT cluster, " + ", ".join(f"avg(d) FILTER (dow = {i}) AS {x}" for i, x in enumerate(_DOW)) + " FROM dd JOIN reg USING (household_id) GROUP BY 1")
def p9a(spark, d):
    return rp.weekly_profiles(_brand(spark, d), _given(spark, d))


@query("p9_monthly_profiles", "cluster", " ".join(_MON), f"{c.ctes(B, GIVEN, REG, c.months('panel'))} SELECT cluster, " + ", ".join(f"avg(m) FILTER (month = {i + 1}) AS {x}" for i, x in enumerate(_MON)) + " FROM mm JOIN reg USING (household_id) GROUP BY 1")
def p9b(spark, d):
    return rp.monthly_profiles(_brand(spark, d), _given(spark, d))


@query("p10_mean_diagnostics", "cluster", "std zero_days zero_pct degenerate_flag", f"{c.ctes(B, GIVEN, REG, c.flags())} SELECT cluster, avg(std) AS std, avg(zero_days) AS zero_days, avg(zero_pct) AS zero_pct, avg(CAST(degenerate_flag AS INTEGER)) AS degenerate_flag FROM flags JOIN reg USING (household_id) GROUP BY 1")
def p10(spark, d):
    return rp.mean_columns(regime_flags(_brand(spark, d)), _given(spark, d))


@query("p11_mean_features", "cluster", "mean std zero_pct cv", f"{c.ctes(B, GIVEN, REG, c.stats())} SELECT cluster, avg(mean) AS mean, avg(std) AS std, avg(zero_pct) AS zero_pct, avg(cv) AS cv FROM stats JOIN reg USING (household_id) GROUP BY 1")
def p11(spark, d):
    return rp.mean_columns(ft.level_features(_brand(spark, d)), _given(spark, d))


@query(
    "p12_distinctive_features",
    "cluster rank feature feature_family",
    "cluster_mean overall_mean standardized_difference",
    f"""{c.ctes(B, GIVEN, REG, c.stats())}, u AS (SELECT household_id, cluster, feature, x FROM (SELECT household_id, cluster, mean, std, zero_pct, cv FROM stats JOIN reg USING (household_id)) UNPIVOT (x FOR feature IN (mean, std, zero_pct, cv))),
g AS (SELECT feature, avg(x) AS mu, stddev_samp(x) AS sd FROM u GROUP BY 1), e AS (SELECT cluster, feature, avg(x) AS cluster_mean, any_value(mu) AS overall_mean, (avg(x) - any_value(mu)) / nullif(any_value(sd), 0) AS standardized_difference FROM u JOIN g USING (feature) GROUP BY 1, 2)
SELECT * FROM (SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(abs(standardized_difference), 9) DESC NULLS LAST, feature) AS INTEGER) AS rank, feature, 'raw_level' AS feature_family, cluster_mean, overall_mean, standardized_difference FROM e) WHERE rank <= 3""",
)
def p12(spark, d):
    return rp.distinctive_features(ft.level_features(_brand(spark, d)), _given(spark, d), 3)


def _representatives(source: str) -> str:
    return f"""SELECT * FROM (SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(distance, 9), household_id) AS INTEGER) AS rank, household_id, distance FROM (
  SELECT r.cluster, s.household_id, sqrt(sum(pow(s.consumption - p.mean, 2))) AS distance FROM {source} s JOIN reg r USING (household_id) JOIN {'zp' if source == 'z' else 'rp'} p ON p.cluster = r.cluster AND p.date = s.date GROUP BY 1, 2)) WHERE rank <= 3"""


@query("p13_representatives", "cluster rank household_id", "distance", f"{c.ctes(B, GIVEN, REG, ZP)} {_representatives('panel')}")
def p13a(spark, d):
    return rp.representatives(_brand(spark, d), _given(spark, d))


@query("p13_representatives_normalised", "cluster rank household_id", "distance", f"{c.ctes(B, GIVEN, REG, ZP)} {_representatives('z')}")
def p13b(spark, d):
    return rp.representatives(_brand(spark, d), _given(spark, d), normalised=True)


@query(
    "p17_meaningfulness",
    "level_dominance_warning",
    "cluster_mean_spread normalized_shape_separation level_to_shape_ratio",
    f"""{c.ctes(B, GIVEN, REG, ZP, HM)}, sp AS (SELECT max(m) - min(m) AS cluster_mean_spread FROM (SELECT avg(m) AS m FROM hm JOIN reg USING (household_id) GROUP BY cluster)),
se AS (SELECT avg(d) AS normalized_shape_separation FROM (SELECT sqrt(sum(pow(a.mean - b.mean, 2))) AS d FROM zp a JOIN zp b ON a.date = b.date AND a.cluster < b.cluster GROUP BY a.cluster, b.cluster))
SELECT *, cluster_mean_spread / (normalized_shape_separation + 1e-6) AS level_to_shape_ratio, cluster_mean_spread / (normalized_shape_separation + 1e-6) > 3 AS level_dominance_warning FROM sp, se""",
)
def p17(spark, d):
    return rp.meaningfulness(_brand(spark, d), _given(spark, d))


def _vectors(spark, d):
    return ad.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))


EMB = "emb AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), cells AS (SELECT id, cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS p FROM emb)"
CENT = "cent AS (SELECT cluster, p, avg(x) AS c FROM cells GROUP BY 1, 2)"


@query(
    "v1_silhouette",
    "",
    "silhouette",
    f"""WITH {EMB}, pr AS (SELECT a.id, a.cluster, b.cluster AS o, list_distance(a.v, b.v) AS d FROM emb a JOIN emb b ON a.id <> b.id), m AS (SELECT id, cluster, o, avg(d) AS d FROM pr GROUP BY 1, 2, 3),
s AS (SELECT id, min(d) FILTER (o = cluster) AS a, min(d) FILTER (o <> cluster) AS b FROM m GROUP BY 1) SELECT avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM s""",
)
def v1(spark, d):
    return va.silhouette(_vectors(spark, d))


@query(
    "v1_simplified_silhouette",
    "",
    "silhouette",
    f"""WITH {EMB}, {CENT}, ds AS (SELECT id, cells.cluster, cent.cluster AS o, sqrt(sum(pow(x - c, 2))) AS d FROM cells JOIN cent USING (p) GROUP BY 1, 2, 3),
s AS (SELECT id, min(d) FILTER (o = cluster) AS a, min(d) FILTER (o <> cluster) AS b FROM ds GROUP BY 1) SELECT avg((b - a) / nullif(greatest(a, b), 0)) AS silhouette FROM s""",
)
def v1b(spark, d):
    return va.simplified_silhouettes(_vectors(spark, d))


@query(
    "v2_davies_bouldin",
    "",
    "davies_bouldin",
    f"""WITH {EMB}, {CENT}, sp AS (SELECT cluster, avg(d) AS s FROM (SELECT id, cluster, sqrt(sum(pow(x - c, 2))) AS d FROM cells JOIN cent USING (cluster, p) GROUP BY 1, 2) GROUP BY 1),
dd AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum(pow(a.c - b.c, 2))) AS d FROM cent a JOIN cent b ON a.p = b.p AND a.cluster <> b.cluster GROUP BY 1, 2)
SELECT avg(r) AS davies_bouldin FROM (SELECT i, max((x.s + y.s) / d) AS r FROM dd JOIN sp x ON x.cluster = i JOIN sp y ON y.cluster = j GROUP BY 1)""",
)
def v2(spark, d):
    return va.davies_bouldin(_vectors(spark, d))


@query(
    "v3_calinski_harabasz",
    "",
    "calinski_harabasz",
    f"""WITH {EMB}, {CENT}, g AS (SELECT p, avg(x) AS g FROM cells GROUP BY 1), n AS (SELECT cluster, count(*) AS n FROM emb GROUP BY 1),
w AS (SELECT sum(pow(x - c, 2)) AS w FROM cells JOIN cent USING (cluster, p)), b AS (SELECT sum(n * pow(c - g, 2)) AS b FROM cent JOIN g USING (p) JOIN n USING (cluster))
SELECT b * ((SELECT count(*) FROM emb) - (SELECT count(*) FROM n)) / (w * ((SELECT count(*) FROM n) - 1)) AS calinski_harabasz FROM w, b""",
    4,
)
def v3(spark, d):
    return va.calinski_harabasz(_vectors(spark, d))


ARI = """SELECT {by} CASE WHEN coalesce((sa + sb) / 2 - sa * sb / nullif(t * (t - 1) / 2, 0), 0) = 0 THEN 1 ELSE (sc - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)) END AS ari FROM x"""


@query(
    "v4_adjusted_rand",
    "",
    "ari",
    """WITH c AS (SELECT label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2),
x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS sc, (SELECT sum(n) FROM c) AS t, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS sb) """
    + ARI.format(by=""),
)
def v4(spark, d):
    return va.adjusted_rand(ad.table(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b")))


@query(
    "e4_stability",
    "run_i run_j",
    "ari",
    """WITH r AS (SELECT CAST(r AS INTEGER) AS run, vec_id AS id, (label * (r + 1)) % 5 AS cluster FROM embeddings, range(0, 4) t(r) WHERE vec_id % 5 <> r),
m AS (SELECT p.run AS run_i, q.run AS run_j, p.cluster AS a, q.cluster AS b, count(*) AS n FROM r p JOIN r q ON p.id = q.id AND p.run < q.run GROUP BY 1, 2, 3, 4),
x AS (SELECT run_i, run_j, max(sc) AS sc, max(t) AS t, max(sa) AS sa, max(sb) AS sb FROM (SELECT run_i, run_j, sum(n * (n - 1) / 2) AS sc, sum(n) AS t FROM m GROUP BY 1, 2)
  JOIN (SELECT run_i, run_j, sum(n * (n - 1) / 2) AS sa FROM (SELECT run_i, run_j, a, sum(n) AS n FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (run_i, run_j)
  JOIN (SELECT run_i, run_j, sum(n * (n - 1) / 2) AS sb FROM (SELECT run_i, run_j, b, sum(n) AS n FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (run_i, run_j) GROUP BY 1, 2) """
    + ARI.format(by="run_i, run_j,"),
)
def e4(spark, d):
    runs = ad.table(spark, d, "embeddings").withColumn("run", F.explode(F.array(*[F.lit(i) for i in range(4)]))).filter(F.col("vec_id") % 5 != F.col("run"))
    return va.stability(runs.select("run", F.col("vec_id").alias("id"), (F.col("label") * (F.col("run") + 1) % 5).alias("cluster")))


EVAL = """ev AS (SELECT CAST(k AS INTEGER) AS k, count(*) AS n_clusters_found, min(n) AS smallest_cluster, max(n) AS largest_cluster, min(n) / max(n) AS cluster_balance, 1.0 / k AS silhouette, 0.3 * k AS davies_bouldin,
  CASE WHEN k <> 5 THEN 100.0 / k END AS calinski_harabasz, 0.5 + 0.04 * k AS stability_mean, k % 4 = 0 AS level_dominance_warning
  FROM (SELECT k, (vec_id * vec_id) % k AS g, count(*) AS n FROM embeddings, range(2, 11) t(k) GROUP BY 1, 2) GROUP BY k)"""


def _evaluation(spark, d):
    """One row for each k from 2 to 10 over a labelling by residues, with given scores."""
    each = ad.table(spark, d, "embeddings").withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(10)))).groupBy("k", (F.col("vec_id") * F.col("vec_id") % F.col("k")).alias("g")).agg(F.count("*").alias("n"))
    k = F.col("k")
    return each.groupBy("k").agg(F.count("*").alias("n_clusters_found"), F.min("n").alias("smallest_cluster"), F.max("n").alias("largest_cluster"), (F.min("n") / F.max("n")).alias("cluster_balance")).withColumns(
        {"silhouette": 1.0 / k, "davies_bouldin": 0.3 * k, "calinski_harabasz": F.when(k != 5, 100.0 / k), "stability_mean": 0.5 + 0.04 * k, "level_dominance_warning": k % 4 == 0}
    )


def _score(x: str, higher: bool) -> str:
    top = f"{x} - min({x}) OVER ()" if higher else f"max({x}) OVER () - {x}"
    return f"CASE WHEN min({x}) OVER () IS NULL THEN NULL WHEN abs(max({x}) OVER () - min({x}) OVER ()) <= 1e-8 + 1e-5 * abs(min({x}) OVER ()) THEN 1.0 ELSE ({top}) / nullif(max({x}) OVER () - min({x}) OVER (), 0) END"


RANK = f"""sc AS (SELECT *, {', '.join(f'{_score(x, up)} AS s{i}' for i, (x, up) in enumerate(va.SCORES))} FROM ev),
rk AS (SELECT *, CAST({' + '.join(f'CAST(s{i} IS NOT NULL AS INTEGER)' for i in range(5))} AS INTEGER) AS n_available_components FROM sc),
ranked AS (SELECT *, ({' + '.join(f'coalesce(s{i}, 0)' for i in range(5))}) / n_available_components - CASE WHEN smallest_cluster < 60 THEN 0.25 ELSE 0 END - CASE WHEN smallest_cluster <= 1 THEN 0.35 ELSE 0 END
  - CASE WHEN cluster_balance < 0.1 THEN 0.25 ELSE 0 END - CASE WHEN level_dominance_warning THEN 0.2 ELSE 0 END - CASE WHEN n_available_components < 3 THEN 0.15 ELSE 0 END AS composite_score FROM rk)"""


@query("e5_k_ranking", "k n_available_components", "composite_score", f"WITH {EVAL}, {RANK} SELECT * FROM ranked")
def e5(spark, d):
    return va.rank_k(_evaluation(spark, d), 60)


@query("e6_k_shortlist", "k", "composite_score", f"WITH {EVAL}, {RANK} SELECT * FROM ranked WHERE smallest_cluster >= 60 AND cluster_balance >= 0.2 AND n_clusters_found = k")
def e6(spark, d):
    return va.shortlist(va.rank_k(_evaluation(spark, d), 60), 60)


@query("e7_best_k", "k", "", f"WITH {EVAL}, {RANK} SELECT k FROM ranked ORDER BY composite_score DESC, n_available_components DESC, k LIMIT 1")
def e7(spark, d):
    k, _ = va.best_k(va.rank_k(_evaluation(spark, d), 60))
    return spark.createDataFrame([(k,)], "k int")


@query("e8_size_diagnostics", "n_clusters smallest largest", "median_size", f"{c.ctes(B, GIVEN, REG)} SELECT count(*) AS n_clusters, min(n) AS smallest, max(n) AS largest, median(n) AS median_size FROM (SELECT count(*) AS n FROM reg GROUP BY cluster)")
def e8(spark, d):
    return va.size_diagnostics(_given(spark, d))


@query(
    "e3_evaluation_row",
    "method k n_households_regular_clusters n_clusters_found smallest_cluster largest_cluster has_small_clusters",
    "cluster_balance",
    "SELECT 'given' AS method, 10 AS k, CAST(sum(n) AS BIGINT) AS n_households_regular_clusters, count(*) AS n_clusters_found, min(n) AS smallest_cluster, max(n) AS largest_cluster, min(n) < 300 AS has_small_clusters, min(n) / max(n) AS cluster_balance FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)",
)
def e3(spark, d):
    return va.evaluation_row(_vectors(spark, d), "given", 10)


@query("k2_ward_labels", "household_id cluster", "")
def k2(spark, d):
    raw = cut(ft.ward_features(_brand(spark, d)))
    return lb.ordered(_brand(spark, d), wd.ward(se.fit_selection(raw).transform(raw)).labels(3))


@query("k4_kshape_labels", "household_id cluster", "")
def k4(spark, d):
    rows, _ = ks.kshape_input(_brand(spark, d))
    return ks.kshape(rows, 2)[0]


@query(
    "k3_kshape_sample",
    "household_id n_days",
    "",
    f"{c.ctes(B)} SELECT household_id, 365 AS n_days FROM (SELECT household_id, row_number() OVER (ORDER BY md5(household_id || '/42')) AS k FROM (SELECT DISTINCT household_id FROM panel)) WHERE k <= 12",
)
def k3(spark, d):
    rows, _ = ks.kshape_input(_brand(spark, d), 12)
    return rows.select("household_id", F.size("v").alias("n_days"))


@query("e4_ward_stability", "run_i run_j", "ari")
def e4w(spark, d):
    raw = cut(ft.ward_features(_brand(spark, d)))
    fitted = se.fit_selection(raw)
    matrix = cut(fitted.transform(raw))
    return pc.ward_stability(pc.FeatureInput(None, fitted, matrix, wd.ward(matrix)), 3).pairs


@query("e4_kshape_stability", "run_i run_j", "ari")
def e4k(spark, d):
    return pc.kshape_stability(_brand(spark, d), 2).pairs


@query("e1_minmax_scores", "k", "s0 s1 s2 s3 s4", f"WITH {EVAL}, {RANK} SELECT * FROM ranked")
def e1(spark, d):
    return _evaluation(spark, d).select("k", *[va.minmax_score(x, up).alias(f"s{i}") for i, (x, up) in enumerate(va.SCORES)])


@query("e2_regular_labels", "household_id cluster", "", f"{c.ctes(B, GIVEN, REG)} SELECT household_id, cluster FROM reg")
def e2(spark, d):
    return _given(spark, d).filter("cluster >= 0")


@query("p16_forecast_table", "household_id cluster", "", f"{c.ctes(B)} SELECT DISTINCT household_id, CAST(household_id % 3 AS INTEGER) AS cluster FROM panel")
def p16(spark, d):
    return rp.forecast_table(_brand(spark, d).select("household_id").distinct().withColumn("cluster", (F.col("household_id") % 3).cast("int")))


@query("k11_final_clustering", "household_id cluster", "")
def k11(spark, d):
    given = pc.feature_input(_brand(spark, d), exclude_zero_heavy=False)
    return pc.feature_ward(given, 3).labels


@query("k14_handoff_profiles", "cluster date", "mean", f"{c.ctes(B, FULL, REG, KEYS, ORDERED, REASSIGNED)} SELECT cluster, date, avg(consumption) AS mean FROM panel JOIN final USING (household_id) GROUP BY 1, 2")
def k14b(spark, d):
    return lb.handoff(_brand(spark, d), _given(spark, d, False), 3)["profiles"]
