"""Queries: the numbers behind diagnostic views, and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.steps import DAY, MONTH
from panelweave.operators import diagnostics as D
from panelweave.operators import splits
from panelweave.operators import stl as L
from panelweave.operators.panel import MONEY_SCALE, bucket_sum
from panelweave.operators.per_series import level_smoothing
from panelweave.plans.panels import brand_month, lazy, regular, shipments
from panelweave.plans.registry import query, rounded
from panelweave.plans.twins import HORIZON, twin


@query(
    "ts_summary",
    """SELECT count(*) AS n_obs, min(date) AS start, max(date) AS "end", min(d) AS diff_minimum, quantile_cont(d, 0.25) AS diff_q1,
  quantile_cont(d, 0.5) AS diff_median, round(avg(d), 6) AS diff_mean, quantile_cont(d, 0.75) AS diff_q3, max(d) AS diff_maximum
  FROM (SELECT date, (date_diff('day', lag(date) OVER (ORDER BY date), date) * 86400)::DOUBLE AS d
        FROM (SELECT l_shipdate::DATE AS date FROM lineitem))""",
)
def ts_summary(spark, sf):
    return rounded(D.ts_summary(shipments(spark, sf), "l_shipdate"), 6, "diff_mean")


@query(
    "series_overview",
    twin("pm", """SELECT id, date, value FROM pm UNION ALL
  SELECT 'all', date_trunc('month', l_shipdate)::DATE, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM lineitem GROUP BY 2"""),
)
def series_overview(spark, sf):
    total = bucket_sum(shipments(spark, sf), [], "l_shipdate", "l_extendedprice", scale=MONEY_SCALE).select(F.lit("all").alias("id"), "date", "value")
    return brand_month(spark, sf).unionByName(total)


@query(
    "trend_smooth",
    twin("ps_full", """SELECT id, date, round(value, 6) AS value, round(avg(value) OVER
  (PARTITION BY id ORDER BY date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), 6) AS smooth FROM ps_full"""),
)
def trend_smooth(spark, sf):
    return rounded(D.trend_smooth(lazy(spark, sf, "PS")), 6, "value", "smooth")


@query(
    "seasonal_boxplot",
    twin("ps_full", """SELECT id, feature, bucket, round(min(value), 6) AS lower, round(quantile_cont(value, 0.25), 6) AS q1,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS upper, count(*) AS n
  FROM (SELECT id, value, 'month' AS feature, month(date) AS bucket FROM ps_full
        UNION ALL SELECT id, value, 'quarter', quarter(date) FROM ps_full
        UNION ALL SELECT id, value, 'year', year(date) FROM ps_full) GROUP BY 1, 2, 3"""),
)
def seasonal_boxplot(spark, sf):
    return rounded(D.seasonal_boxplot(lazy(spark, sf, "PS")), 6, "lower", "q1", "median", "q3", "upper")


_ACF = """SELECT a.id, k.lag AS lag, sum(a.x * b.x) / max(v.ss) AS acf, 2.0 / sqrt(max(v.n)) AS band
  FROM (SELECT unnest(range(0, 61)) AS lag) k CROSS JOIN
  (SELECT id, pos, value - avg(value) OVER (PARTITION BY id) AS x FROM pt_full) a JOIN
  (SELECT id, pos, value - avg(value) OVER (PARTITION BY id) AS x FROM pt_full) b ON b.id = a.id AND b.pos = a.pos - k.lag
  JOIN (SELECT id, var_pop(value) * count(*) AS ss, count(*) AS n FROM pt_full GROUP BY id) v ON v.id = a.id GROUP BY 1, 2"""


@query("acf", twin("pt_full", f"SELECT id, lag, round(acf, 8) AS acf, round(band, 8) AS band FROM ({_ACF})"))
def acf(spark, sf):
    return rounded(D.acf(lazy(spark, sf, "PT")), 8, "acf", "band")


_EARLIER = "coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[{}])), 0)"


@query("pacf", "WITH RECURSIVE " + twin("pt_full", f""", start AS (SELECT id, list(acf ORDER BY lag) AS r FROM ({_ACF}) GROUP BY id),
  run AS (SELECT id, r, 0::BIGINT AS k, []::DOUBLE[] AS phi, NULL::DOUBLE AS pacf FROM start
    UNION ALL SELECT id, r, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - v * phi[k + 1 - j]), [v]), v
    FROM (SELECT *, (r[k + 2] - {_EARLIER.format('k + 2 - j')}) / (1 - {_EARLIER.format('j + 1')}) AS v FROM run WHERE k < len(r) - 1))
  SELECT id, k AS lag, round(pacf, 7) AS pacf FROM run WHERE k > 0""").removeprefix("WITH "))
def pacf(spark, sf):
    return rounded(D.pacf(lazy(spark, sf, "PT")), 7, "pacf")


MONTH_CELL = "month(date)"
TREND_12 = """CASE WHEN count(*) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) = 12
   AND count(*) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING) = 12 THEN
  (avg(value) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)
   + avg(value) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 2 END"""
_TREND_7 = """CASE WHEN count(*) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7
  THEN avg(value) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END"""


def decompose_sql(panel: str, trend: str, cell: str) -> str:
    return f"""SELECT t.id, t.date, t.value, t.trend, s.season, t.value - t.trend - s.season AS remainder, t.value - s.season AS seasadj
  FROM (SELECT id, date, value, {cell} AS cell, {trend} AS trend FROM {panel}) t
  JOIN (SELECT id, cell, m - avg(m) OVER (PARTITION BY id) AS season FROM
        (SELECT id, cell, avg(value - trend) AS m FROM (SELECT id, {cell} AS cell, value, {trend} AS trend FROM {panel}) GROUP BY 1, 2)) s
    ON s.id = t.id AND s.cell = t.cell"""


@query("decompose", twin("ps_full", f"""SELECT id, date, round(value, 6) AS value, round(trend, 6) AS trend, round(season / value, 9) AS season_share,
  round(remainder / value, 9) AS remainder_share, round(seasadj / value, 9) AS seasadj_share FROM ({decompose_sql('ps_full', TREND_12, MONTH_CELL)})"""))
def decompose(spark, sf):
    parts = D.decompose(lazy(spark, sf, "PS"))
    shares = [F.round(F.col(c) / F.col("value"), 9).alias(f"{c}_share") for c in ("season", "remainder", "seasadj")]
    return rounded(parts.select("id", "date", "value", "trend", *shares), 6, "value", "trend")


def loess_sql(source: str, span: int) -> str:
    """Local linear regression of ``y`` over ``pos`` (from 0) in each id of ``n`` rows."""
    return f"""SELECT id, t AS pos, CASE WHEN sxx / sw - (sx / sw) ** 2 > (0.001 * (n - 1)) ** 2
    THEN sy / sw - (sxy / sw - sx / sw * sy / sw) / (sxx / sw - (sx / sw) ** 2) * sx / sw ELSE sy / sw END AS fit
  FROM (SELECT id, t, any_value(n) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy
    FROM (SELECT a.id, a.t, a.n, b.y, (b.pos - a.t)::DOUBLE AS x, CASE WHEN abs(b.pos - a.t) / a.reach <= 0.001 THEN 1
            WHEN abs(b.pos - a.t) / a.reach > 0.999 THEN 0 ELSE (1 - (abs(b.pos - a.t) / a.reach) ** 3) ** 3 END AS w
      FROM (SELECT id, t, n, low, high, (greatest(t - low, high - t) + greatest({span} - n, 0) // 2)::DOUBLE AS reach
            FROM (SELECT id, t, n, low, least(low + {span} - 1, n - 1) AS high
                  FROM (SELECT id, pos AS t, n, greatest(0, least(pos - {(span - 1) // 2}, n - {span})) AS low FROM {source}))) a
      JOIN {source} b ON b.id = a.id AND b.pos BETWEEN a.low AND a.high) GROUP BY id, t)"""


@query("trend_loess", twin("ps_full", f""", src AS (SELECT id, date, pos - 1 AS pos, value AS y, count(*) OVER (PARTITION BY id) AS n FROM ps_full)
  SELECT s.id, s.date, round(s.y, 6) AS value, round(f.fit, 4) AS smooth FROM src s JOIN ({loess_sql('src', 13)}) f ON f.id = s.id AND f.pos = s.pos"""))
def trend_loess(spark, sf):
    """Each series smoothed by local regression over 13 months."""
    return rounded(rounded(L.loess(lazy(spark, sf, "PS"), 13), 6, "value"), 4, "smooth")


@query("stl_pass", twin("ps_full", f""",
  src AS (SELECT id, date, pos - 1 AS pos, value, count(*) OVER (PARTITION BY id) AS n FROM ps_full QUALIFY count(*) OVER (PARTITION BY id) >= 24),
  cyc AS (SELECT id, pos % 12 AS k, avg(value) AS m FROM src GROUP BY 1, 2),
  ext AS (SELECT e.id, e.i, c.m FROM (SELECT id, unnest(range(-12, n + 12)) AS i FROM (SELECT id, max(n) AS n FROM src GROUP BY id)) e
    JOIN cyc c ON c.id = e.id AND c.k = (e.i + 12) % 12),
  one AS (SELECT id, i, avg(m) OVER w AS m FROM ext WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) QUALIFY count(*) OVER w = 12),
  two AS (SELECT id, i, avg(m) OVER w AS m FROM one WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) QUALIFY count(*) OVER w = 12),
  low AS (SELECT id, i + 12 AS pos, avg(m) OVER w AS y, count(*) OVER (PARTITION BY id) - 2 AS n FROM two
    WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) QUALIFY count(*) OVER w = 3),
  cut AS (SELECT s.id, s.pos, s.n, s.date, s.value, c.m - f.fit AS season FROM src s JOIN cyc c ON c.id = s.id AND c.k = s.pos % 12
    JOIN ({loess_sql('low', 13)}) f ON f.id = s.id AND f.pos = s.pos),
  adj AS (SELECT id, pos, n, value - season AS y FROM cut)
  SELECT c.id, c.date, round(c.value, 6) AS value, round(f.fit / c.value, 8) AS trend_share,
    round(avg(c.season) OVER (PARTITION BY c.id, c.pos % 12) / c.value, 8) AS season_share
  FROM cut c JOIN ({loess_sql('adj', 19)}) f ON f.id = c.id AND f.pos = c.pos"""))
def stl_pass(spark, sf):
    """One pass of the decomposition by local regression, the season the same in every cycle."""
    parts = L.stl(lazy(spark, sf, "PS"), inner=1, outer=0).filter("trend is not null")
    shares = [F.round(F.col(c) / F.col("value"), 8).alias(f"{c}_share") for c in ("trend", "season")]
    return rounded(parts.select("id", "date", "value", *shares), 6, "value")


@query("decompose_robust")
def decompose_robust(spark, sf):
    """Decomposition by local regression with points far off weighed down."""
    return L.stl(lazy(spark, sf, "PS"))


@query("anomalies", twin("pd_full", f"""SELECT id, date, round(remainder, 6) AS remainder, round(lo, 6) AS lo, round(hi, 6) AS hi,
  coalesce((remainder < lo OR remainder > hi) AND rn <= 0.2 * n, false) AS is_anomaly FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY greatest(lo - remainder, remainder - hi) DESC NULLS LAST, date) AS rn,
     count(remainder) OVER (PARTITION BY id) AS n FROM
   (SELECT r.*, q.q1 - 3 * (q.q3 - q.q1) AS lo, q.q3 + 3 * (q.q3 - q.q1) AS hi
    FROM ({decompose_sql('pd_full', _TREND_7, "(date_diff('day', DATE '1970-01-01', date) % 7)")}) r
    JOIN (SELECT id, quantile_cont(remainder, 0.25) AS q1, quantile_cont(remainder, 0.75) AS q3
          FROM ({decompose_sql('pd_full', _TREND_7, "(date_diff('day', DATE '1970-01-01', date) % 7)")}) GROUP BY id) q ON q.id = r.id))"""))
def anomalies(spark, sf):
    found = D.anomalies(lazy(spark, sf, "PD"), DAY, 7)
    return rounded(found.select("id", "date", "remainder", "lo", "hi", "is_anomaly"), 6, "remainder", "lo", "hi")


_REST = f"""SELECT id, date, value, r - median(r) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS rest
  FROM (SELECT id, date, value, a - (regr_intercept(a, pos) OVER (PARTITION BY id) + regr_slope(a, pos) OVER (PARTITION BY id) * pos) AS r FROM
  (SELECT id, date, value, pos, value - median(off) OVER (PARTITION BY id, cell) AS a FROM
   (SELECT id, date, value, row_number() OVER (PARTITION BY id ORDER BY date) AS pos, {MONTH_CELL} AS cell,
      value - {TREND_12} AS off FROM ps_train)))"""
_FLAGGED = f"""SELECT r.id, r.date, r.value AS value_raw, NOT (r.rest BETWEEN q.q1 - 3 * (q.q3 - q.q1) AND q.q3 + 3 * (q.q3 - q.q1)) AS is_cleaned,
  row_number() OVER (PARTITION BY r.id ORDER BY r.date) AS pos FROM ({_REST}) r
  JOIN (SELECT id, quantile_cont(rest, 0.25) AS q1, quantile_cont(rest, 0.75) AS q3 FROM ({_REST}) GROUP BY id) q ON q.id = r.id"""


@query("outlier_clean", twin("ps_train", f"""SELECT e.id, e.date, round(e.value_raw, 6) AS value_raw, e.is_cleaned,
  round(CASE WHEN NOT e.is_cleaned THEN e.value_raw WHEN l.value_raw IS NULL THEN r.value_raw WHEN r.value_raw IS NULL THEN l.value_raw
    ELSE l.value_raw + (r.value_raw - l.value_raw) * (e.pos - e.lp) / (e.rp - e.lp) END, 6) AS value
  FROM (SELECT *, max(CASE WHEN NOT is_cleaned THEN pos END) OVER (PARTITION BY id ORDER BY pos) AS lp,
          min(CASE WHEN NOT is_cleaned THEN pos END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rp
        FROM ({_FLAGGED})) e
  LEFT JOIN ({_FLAGGED}) l ON l.id = e.id AND l.pos = e.lp LEFT JOIN ({_FLAGGED}) r ON r.id = e.id AND r.pos = e.rp"""))
def outlier_clean(spark, sf):
    train = splits.train_rows(regular(spark, sf, "PS"), HORIZON)
    return rounded(D.outlier_clean(train), 6, "value", "value_raw").select("id", "date", "value", "value_raw", "is_cleaned")


@query("fc_level_smoothing", "WITH RECURSIVE " + twin("pm_tail steps", """,
  pts AS (SELECT id, value, n_rows - rn + 1 AS pos, n_rows, last_date FROM pm_tail),
  rates AS (SELECT unnest(range(1, 20)) * 0.05::DOUBLE AS raw),
  run AS (SELECT id, round(raw, 2) AS alpha, 1::BIGINT AS pos, value AS level, 0::DOUBLE AS sse FROM pts CROSS JOIN rates WHERE pos = 1
    UNION ALL SELECT r.id, r.alpha, p.pos, r.alpha * p.value + (1 - r.alpha) * r.level, r.sse + (p.value - r.level) * (p.value - r.level)
    FROM run r JOIN pts p ON p.id = r.id AND p.pos = r.pos + 1)
  SELECT b.id, 'level_smoothing' AS model_id, step, (l.last_date + to_months(step::INTEGER))::DATE AS date, round(b.level, 5) AS prediction, b.alpha
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sse, alpha) AS pick FROM run r
        WHERE pos = (SELECT max(n_rows) FROM pts p WHERE p.id = r.id)) b
  JOIN (SELECT DISTINCT id, last_date FROM pts) l ON l.id = b.id CROSS JOIN steps WHERE pick = 1""").removeprefix("WITH "))
def fc_level_smoothing(spark, sf):
    train = splits.train_rows(regular(spark, sf, "PM"), HORIZON)
    return rounded(level_smoothing(train, HORIZON, MONTH), 5, "prediction").drop("sse")
