"""Sources, validation, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog import ctes as c
from panelforge.catalog.registry import query
from panelforge.operators import cleaning as cl
from panelforge.plans import preparation
from panelforge.sources import adapters as ad
from panelforge.sources import panel as pn

KEY = "household_id date"


@query("s1_panel_scan", KEY, "consumption", f"{c.ctes(c.supplier(1999))} SELECT * FROM panel")
def s1(spark, d):
    return ad.supplier_panel(spark, d, 1999)


@query("s2_date_axis", "n_days first_day last_day n_missing_days", "", f"{c.ctes(c.supplier(1999))} SELECT count(DISTINCT date) AS n_days, min(date) AS first_day, max(date) AS last_day, CAST(max(date) - min(date) + 1 - count(DISTINCT date) AS BIGINT) AS n_missing_days FROM panel")
def s2(spark, d):
    return pn.date_axis(ad.supplier_panel(spark, d, 1999))


@query("s3_duplicate_keys", "l_orderkey l_linenumber n_rows", "", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def s3(spark, d):
    return pn.duplicate_keys(ad.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "s4_quality_profile",
    "n_households n_days n_missing n_negative n_zero n_duplicate",
    "min_value max_value",
    f"""{c.ctes(c.EVENT)} SELECT count(DISTINCT household_id) AS n_households, count(DISTINCT date) AS n_days, count(*) FILTER (consumption IS NULL) AS n_missing, count(*) FILTER (consumption < 0) AS n_negative,
  count(*) FILTER (consumption = 0) AS n_zero, count(*) - count(DISTINCT (household_id, date)) AS n_duplicate, min(consumption) AS min_value, max(consumption) AS max_value FROM panel""",
)
def s4(spark, d):
    return pn.quality_profile(ad.event_panel(spark, d))


@query(
    "s5_id_alignment",
    "household_id only_in",
    "",
    """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01'), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-20')
SELECT k AS household_id, 'train' AS only_in FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'test' FROM b WHERE k NOT IN (SELECT k FROM a)""",
)
def s5(spark, d):
    items = ad.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("household_id"), "l_shipdate")
    return pn.id_differences(items.filter("l_shipdate < timestamp'1995-02-01'"), items.filter("l_shipdate >= timestamp'2001-10-20'"))


@query("s6_assignments", "household_id cluster", "", "SELECT CAST(s_suppkey AS BIGINT) AS household_id, CAST(s_suppkey % 4 AS INTEGER) AS cluster FROM supplier")
def s6(spark, d):
    text = ad.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("household_id"), F.concat((F.col("s_suppkey") % 4).cast("string"), F.lit(".0")).alias("cluster"))
    return pn.parse_assignments(text)


@query(
    "s7_label_intersection",
    "household_id cluster",
    "",
    f"{c.ctes(c.supplier(1999))} SELECT DISTINCT household_id, CAST(household_id % 3 AS INTEGER) AS cluster FROM panel WHERE household_id IN (SELECT c_custkey * 2 FROM customer)",
)
def s7(spark, d):
    labels = ad.table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("household_id")).withColumn("cluster", (F.col("household_id") % 3).cast("int"))
    return labels.join(ad.supplier_panel(spark, d, 1999).select("household_id").distinct(), "household_id", "left_semi")


_W = "OVER (PARTITION BY household_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_V = "OVER (PARTITION BY household_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
FFILL = f"SELECT household_id, date, coalesce(last_value(consumption IGNORE NULLS) {_W}, first_value(consumption IGNORE NULLS) {_V}) AS consumption FROM panel"


def interpolated(source: str) -> str:
    return f"""SELECT household_id, date, coalesce(consumption, v0 + (v1 - v0) * (i - i0) / nullif(i1 - i0, 0), v0, v1) AS consumption FROM (
  SELECT *, last_value(consumption IGNORE NULLS) {_W} AS v0, first_value(consumption IGNORE NULLS) {_V} AS v1, last_value(pos IGNORE NULLS) {_W} AS i0, first_value(pos IGNORE NULLS) {_V} AS i1
  FROM (SELECT *, CASE WHEN consumption IS NOT NULL THEN i END AS pos FROM (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY date) AS i FROM {source})))"""


@query("c1_impute_ffill", KEY, "consumption", f"{c.ctes(c.EVENT)} {FFILL}")
def c1(spark, d):
    return cl.impute(ad.event_panel(spark, d), "forward_fill")


@query("c2_impute_interpolate", KEY, "consumption", f"{c.ctes(c.EVENT)} {interpolated('panel')}")
def c2(spark, d):
    return cl.impute(ad.event_panel(spark, d), "interpolate")


@query("c3_impute_mean", KEY, "consumption", f"{c.ctes(c.EVENT)} SELECT household_id, date, coalesce(consumption, avg(consumption) OVER (PARTITION BY household_id)) AS consumption FROM panel")
def c3(spark, d):
    return cl.impute(ad.event_panel(spark, d), "mean")


def _balances(spark, d):
    """Account balances in key order as one series for each nation: negative readings."""
    return ad.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("household_id"), F.date_add(F.lit("2023-01-01").cast("date"), F.col("c_custkey").cast("int")).alias("date"), F.col("c_acctbal").alias("consumption"))


_BAL = "bal AS (SELECT CAST(c_nationkey AS BIGINT) AS household_id, DATE '2023-01-01' + CAST(c_custkey AS INTEGER) AS date, c_acctbal AS consumption FROM customer)"


@query("c5_negatives_set_zero", KEY, "consumption", f"WITH {_BAL} SELECT household_id, date, greatest(consumption, 0) AS consumption FROM bal")
def c5a(spark, d):
    return cl.fix_negatives(_balances(spark, d), "set_zero")


@query("c5_negatives_abs", KEY, "consumption", f"WITH {_BAL} SELECT household_id, date, abs(consumption) AS consumption FROM bal")
def c5b(spark, d):
    return cl.fix_negatives(_balances(spark, d), "abs")


@query("c5_negatives_remove", KEY, "consumption", f"WITH {_BAL}, kept AS (SELECT household_id, date, CASE WHEN consumption >= 0 THEN consumption END AS consumption FROM bal) {interpolated('kept')}")
def c5c(spark, d):
    return cl.fix_negatives(_balances(spark, d), "remove")


@query("c6_znorm_rows", KEY, "consumption", f"{c.ctes(c.brand(1999), c.z())} SELECT * FROM z")
def c6(spark, d):
    return cl.z_rows(ad.brand_panel(spark, d, 1999))


@query("c7_standard_by_day", KEY, "consumption", f"{c.ctes(c.brand(1999))} SELECT household_id, date, (consumption - avg(consumption) OVER (PARTITION BY date)) / (stddev_pop(consumption) OVER (PARTITION BY date) + 1e-10) AS consumption FROM panel")
def c7a(spark, d):
    return cl.normalise(ad.brand_panel(spark, d, 1999), "standard", "date")


@query("c7_minmax_rows", KEY, "consumption", f"{c.ctes(c.brand(1999))} SELECT household_id, date, (consumption - min(consumption) OVER w) / (max(consumption) OVER w - min(consumption) OVER w + 1e-10) AS consumption FROM panel WINDOW w AS (PARTITION BY household_id)")
def c7b(spark, d):
    return cl.normalise(ad.brand_panel(spark, d, 1999), "minmax")


@query("c8_log1p", KEY, "consumption", f"WITH {_BAL} SELECT household_id, date, ln(1 + greatest(consumption, 0)) AS consumption FROM bal")
def c8(spark, d):
    return cl.transform(_balances(spark, d), "log1p")


@query(
    "c9_cleaning_summary",
    "missing_before missing_after negative_before negative_after zero_before zero_after",
    "",
    f"""WITH {_BAL}, new AS (SELECT greatest(consumption, 0) AS v FROM bal) SELECT
  (SELECT count(*) FILTER (consumption IS NULL) FROM bal) AS missing_before, (SELECT count(*) FILTER (v IS NULL) FROM new) AS missing_after,
  (SELECT count(*) FILTER (consumption < 0) FROM bal) AS negative_before, (SELECT count(*) FILTER (v < 0) FROM new) AS negative_after,
  (SELECT count(*) FILTER (consumption = 0) FROM bal) AS zero_before, (SELECT count(*) FILTER (v = 0) FROM new) AS zero_after""",
)
def c9(spark, d):
    raw = _balances(spark, d)
    return cl.cleaning_summary(raw, cl.fix_negatives(raw))


_FLAGS = "household_id all_zero_flag near_constant_flag zero_heavy_flag regime_label degenerate_flag zero_days"


@query("c10_regime_flags", _FLAGS, "std zero_pct", f"{c.ctes(c.supplier(1999), c.flags())} SELECT * FROM flags")
def c10(spark, d):
    return cl.regime_flags(ad.supplier_panel(spark, d, 1999))


@query("c11_regime_split", "household_id part n_days", "", f"{c.ctes(c.supplier(1999), c.flags())} SELECT household_id, CASE WHEN degenerate_flag THEN 'excluded' ELSE 'regular' END AS part, count(*) AS n_days FROM panel JOIN flags USING (household_id) GROUP BY 1, 2")
def c11(spark, d):
    panel = ad.supplier_panel(spark, d, 1999)
    regular, out = cl.split_regular(panel, cl.regime_flags(panel))
    both = regular.withColumn("part", F.lit("regular")).unionByName(out.withColumn("part", F.lit("excluded")))
    return both.groupBy("household_id", "part").agg(F.count("*").alias("n_days"))


@query("c12_prepared_regular", KEY, "consumption", f"{c.ctes(c.EVENT)}, filled AS ({interpolated('panel')}),{c.flags('filled')} SELECT household_id, date, ln(1 + greatest(consumption, 0)) AS consumption FROM filled WHERE household_id IN (SELECT household_id FROM flags WHERE NOT degenerate_flag)")
def c12(spark, d):
    return preparation.prepare(ad.event_panel(spark, d), transform="log1p").regular


@query("c13_prepared_kshape", KEY, "consumption", f"{c.ctes(c.brand(1999), c.flags())}, regular AS (SELECT * FROM panel WHERE household_id IN (SELECT household_id FROM flags WHERE NOT degenerate_flag)),{c.z('regular')} SELECT * FROM z")
def c13(spark, d):
    return preparation.for_method(ad.brand_panel(spark, d, 1999), "kshape").regular


@query("c14_id_split", "household_id part", "", f"{c.ctes(c.supplier(1999), c.flags())} SELECT household_id, CASE WHEN degenerate_flag THEN 'special' ELSE 'main' END AS part FROM flags")
def c14(spark, d):
    return cl.split_ids(ad.supplier_panel(spark, d, 1999))
