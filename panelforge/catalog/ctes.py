"""Common table expressions of the SQL twins: the panels and what is derived from them."""

from __future__ import annotations


def supplier(year: int, name: str = "panel") -> str:
    return f"""
{name}_cal AS (SELECT CAST(unnest(generate_series(DATE '{year}-01-01', DATE '{year}-12-31', INTERVAL 1 DAY)) AS DATE) AS date),
{name}_q AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS v FROM lineitem WHERE year(l_shipdate) = {year} GROUP BY 1, 2),
{name} AS (SELECT CAST(s.s_suppkey AS BIGINT) AS household_id, c.date, coalesce(q.v, 0.0) AS consumption
  FROM supplier s CROSS JOIN {name}_cal c LEFT JOIN {name}_q q ON q.l_suppkey = s.s_suppkey AND q.d = c.date)"""


def brand(year: int, name: str = "panel") -> str:
    return f"""
{name}_cal AS (SELECT CAST(unnest(generate_series(DATE '{year}-01-01', DATE '{year}-12-31', INTERVAL 1 DAY)) AS DATE) AS date),
{name}_ids AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS household_id FROM part),
{name}_q AS (SELECT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS id, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = {year} GROUP BY 1, 2),
{name} AS (SELECT i.household_id, c.date, coalesce(q.v, 0.0) AS consumption
  FROM {name}_ids i CROSS JOIN {name}_cal c LEFT JOIN {name}_q q ON q.id = i.household_id AND q.d = c.date)"""


EVENT = """
panel_cal AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS date),
panel_q AS (SELECT user_id, CAST(ts AS DATE) AS d, sum(value) AS v FROM events GROUP BY 1, 2),
panel AS (SELECT i.user_id AS household_id, c.date, q.v AS consumption
  FROM (SELECT DISTINCT user_id FROM events) i CROSS JOIN panel_cal c LEFT JOIN panel_q q ON q.user_id = i.user_id AND q.d = c.date)"""


def z(source: str = "panel", name: str = "z") -> str:
    return f"""
{name} AS (SELECT household_id, date, CASE WHEN consumption IS NULL THEN NULL WHEN sd < 1e-10 THEN 0.0 ELSE (consumption - mu) / (sd + 1e-10) END AS consumption
  FROM (SELECT *, avg(consumption) OVER (PARTITION BY household_id) AS mu, stddev_pop(consumption) OVER (PARTITION BY household_id) AS sd FROM {source}))"""


def acf(source: str, lags: tuple[int, ...], name: str = "acf") -> str:
    lagged = ", ".join(f"lag(consumption, {k}) OVER (PARTITION BY household_id ORDER BY date) AS l{k}" for k in lags)
    columns = ", ".join(corr(f"l{k}", "consumption") + f" AS autocorr_lag_{k}" for k in lags)
    return f"""
{name} AS (SELECT household_id, {columns} FROM (SELECT *, {lagged} FROM {source}) GROUP BY household_id)"""


def corr(x: str, y: str) -> str:
    both = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
    sx, sy = f"stddev_pop({x}) {both}", f"stddev_pop({y}) {both}"
    return f"CASE WHEN {sx} >= 1e-10 AND {sy} >= 1e-10 THEN covar_pop({x}, {y}) / ({sx} * {sy}) END"


def stats(source: str = "panel", name: str = "stats") -> str:
    return f"""
{name}_m AS (SELECT *, avg(consumption) OVER (PARTITION BY household_id) AS mu FROM {source}),
{name} AS (SELECT household_id, avg(consumption) AS mean, median(consumption) AS median, stddev_samp(consumption) AS std, min(consumption) AS min, max(consumption) AS max,
  max(consumption) - min(consumption) AS range, quantile_cont(consumption, 0.25) AS q25, quantile_cont(consumption, 0.75) AS q75,
  CASE WHEN abs(avg(consumption)) >= 1e-8 THEN stddev_samp(consumption) / abs(avg(consumption)) END AS cv,
  avg(pow(consumption - mu, 3)) / nullif(pow(avg(pow(consumption - mu, 2)), 1.5), 0) AS skew,
  avg(pow(consumption - mu, 4)) / nullif(pow(avg(pow(consumption - mu, 2)), 2), 0) - 3 AS kurtosis,
  count(*) FILTER (consumption = 0) AS zero_days, 100.0 * count(*) FILTER (consumption = 0) / count(*) AS zero_pct
  FROM {name}_m GROUP BY household_id)"""


def flags(source: str = "panel", name: str = "flags", pct: float = 75.0, std: float = 0.1) -> str:
    return f"""
{name}_a AS (SELECT household_id, coalesce(sum(abs(consumption)), 0) AS mass, stddev_samp(consumption) AS std, count(*) FILTER (consumption = 0) AS zero_days,
  100.0 * count(*) FILTER (consumption = 0) / count(*) AS zero_pct FROM {source} GROUP BY household_id),
{name} AS (SELECT household_id, r = 'all_zero' AS all_zero_flag, r = 'near_constant' AS near_constant_flag, r = 'zero_heavy' AS zero_heavy_flag, r AS regime_label, r <> 'regular' AS degenerate_flag,
  std, zero_days, zero_pct FROM (SELECT *, CASE WHEN mass <= 1e-12 THEN 'all_zero' WHEN std <= {std} THEN 'near_constant' WHEN zero_pct >= {pct} THEN 'zero_heavy' ELSE 'regular' END AS r FROM {name}_a))"""


def months(source: str, name: str = "mm") -> str:
    """household_id, month, m."""
    return f"""
{name} AS (SELECT household_id, month(date) AS month, avg(consumption) AS m FROM {source} GROUP BY 1, 2)"""


def weekdays(source: str, name: str = "dd") -> str:
    """household_id, dow (Monday 0), d."""
    return f"""
{name} AS (SELECT household_id, isodow(date) - 1 AS dow, avg(consumption) AS d FROM {source} GROUP BY 1, 2)"""


def trend(source: str, name: str = "trend") -> str:
    return f"""
{name}_t AS (SELECT *, CAST(row_number() OVER (PARTITION BY household_id ORDER BY date) - 1 AS DOUBLE) AS t FROM {source}),
{name} AS (SELECT household_id, CASE WHEN stddev_pop(consumption) < 1e-10 THEN 0.0 ELSE regr_slope(consumption, t) END AS trend_slope,
  CASE WHEN stddev_pop(consumption) < 1e-10 THEN 0.0 ELSE regr_slope(consumption, t) / (stddev_pop(consumption) + 1e-10) END AS trend_slope_normalized,
  CASE WHEN stddev_pop(consumption) < 1e-10 THEN 0.0 ELSE regr_r2(consumption, t) END AS r_squared, count(consumption) AS n FROM {name}_t GROUP BY household_id)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts)
