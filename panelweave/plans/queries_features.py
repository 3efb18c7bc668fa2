"""Queries: feature engineering and scalar functions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelweave.functions.calendar import CALENDAR_LABELS, CALENDAR_NUMERIC, with_calendar
from panelweave.functions.labels import matches, numbered_label, recode, with_unique_label
from panelweave.functions.steps import MONTH
from panelweave.operators import features as X
from panelweave.operators import global_ml as G
from panelweave.operators import splits
from panelweave.operators.panel import regular_panel
from panelweave.operators.ranking import display_rank
from panelweave.plans.panels import brand_month, regular, supplier_month, user_day
from panelweave.plans.registry import big, query, rounded
from panelweave.plans.twins import HORIZON, twin
from panelweave.session import materialize
from panelweave.sources.tables import read_table

_CALENDAR_SQL = """date_diff('day', DATE '1970-01-01', date) * 86400 AS date_index_num,
  year(date) AS date_year, CASE WHEN month(date) <= 6 THEN 1 ELSE 2 END::BIGINT AS date_half,
  quarter(date) AS date_quarter, month(date) AS date_month, day(date) AS date_day,
  dayofweek(date) + 1 AS date_wday_sun1, day(date) AS date_mday,
  date_diff('day', date_trunc('quarter', date)::DATE, date) + 1 AS date_qday, dayofyear(date) AS date_yday,
  (5 + day(date) + dayofweek(date_trunc('month', date)) + 1) // 7 AS date_mweek,
  (dayofyear(date) - 1) // 7 + 1 AS date_week, ((dayofyear(date) - 1) // 7 + 1) % 2 AS date_week2,
  ((dayofyear(date) - 1) // 7 + 1) % 3 AS date_week3, ((dayofyear(date) - 1) // 7 + 1) % 4 AS date_week4,
  day(date) // 7 + 1 AS date_mday7, monthname(date) AS date_month_lbl, dayname(date) AS date_wday_lbl"""
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("feat_date_only", twin("ps", "SELECT date, value FROM ps"))
def feat_date_only(spark, sf):
    return supplier_month(spark, sf).select("date", "value")


def _lagged(spark, sf, lags=range(1, 13)):
    full = regular_panel(supplier_month(spark, sf)).select("id", "date", "value")
    return X.lag_features(full, lags)


@query("feat_no_lag", twin("ps_full", "SELECT id, date, round(value, 6) AS value FROM ps_full"))
def feat_no_lag(spark, sf):
    return rounded(X.drop_like(_lagged(spark, sf), starts_with=["value_lag"]), 6, "value")


@query("drop_by_pattern", twin("ps_full", """SELECT id, date, round(avg(l12) OVER
  (PARTITION BY id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS value_lag12_roll_12
  FROM (SELECT id, date, lag(value, 12) OVER (PARTITION BY id ORDER BY date) AS l12 FROM ps_full)"""))
def drop_by_pattern(spark, sf):
    lagged = _lagged(spark, sf).withColumnRenamed("value_lag12_roll_12", "kept")
    left = X.drop_like(lagged, contains=["lag"]).drop("value").withColumnRenamed("kept", "value_lag12_roll_12")
    return rounded(left, 6, "value_lag12_roll_12")


def _assembled(spark, sf, spec: G.FeatureSet):
    """Predictors as a regressor sees them (levels of the series, varying columns, scaled index
    and year): every entry of the assembled vector under its name."""
    train = splits.train_rows(regular(spark, sf, "PM"), HORIZON)
    table = materialize(G.feature_table(train, spec), f"features_{spec.name}")
    model = G.unfitted(table, spec, spec.name)
    vectors = model.vectors(table).select("id", "date", vector_to_array("features").alias("entries"))
    names = [*G.LEVELS, *model.columns]
    return vectors.select("id", "date", *[F.round(F.get("entries", F.lit(i)), 6).alias(n) for i, n in enumerate(names)])


_LAGS = range(1, 25)
_CAL_COLUMNS = ("date_half", "date_quarter", "date_month", "date_wday_sun1", "date_qday", "date_yday", "date_week", "date_week2", "date_week3", "date_week4")


def _assembled_sql(lags: bool, calendar: bool) -> str:
    """Every predictor; constant calendar columns (day, week of month) are left out."""
    by_id, by_date = "OVER (PARTITION BY id)", "OVER (PARTITION BY id ORDER BY date{})"
    rows = "SELECT id, date, value FROM pm_train"
    shown = {
        "id_mean": f"avg(value) {by_id}",
        "id_spread": f"coalesce(stddev_samp(value) {by_id}, 0)",
        "id_recent": f"avg(value) FILTER (WHERE newest <= 12) {by_id}",
    }
    if lags:
        lagged = ", ".join(f"lag(value, {k}) {by_date.format('')} AS value_lag{k}" for k in _LAGS)
        roll = f"avg(value_lag12) {by_date.format(' ROWS BETWEEN 11 PRECEDING AND CURRENT ROW')} AS value_lag12_roll_12"
        rows = f"SELECT * FROM (SELECT *, {roll} FROM (SELECT *, {lagged} FROM ({rows}))) WHERE value_lag24 IS NOT NULL"
        shown |= {c: c for c in (*(f"value_lag{k}" for k in _LAGS), "value_lag12_roll_12")}
    if calendar:
        shown |= {c: f"{c}::DOUBLE" for c in _CAL_COLUMNS}
        shown |= {f"date_month_is_{k}": f"(date_month = {k})::INT::DOUBLE" for k in range(1, 13)}
        shown |= {f"date_wday_is_{k}": f"(date_wday_sun1 = {k})::INT::DOUBLE" for k in range(1, 8)}
        shown |= {c: f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()" for c in ("date_index_num", "date_year")}
    entries = ", ".join(f"round({sql}, 6) AS {name}" for name, sql in shown.items())
    return twin(
        "pm_train",
        f"""SELECT id, date, {entries} FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS newest, {_CALENDAR_SQL} FROM ({rows}))""",
    )


@query("feat_lag", _assembled_sql(True, False))
def feat_lag(spark, sf):
    return _assembled(spark, sf, G.lag_set())


@query("feat_calendar", _assembled_sql(False, True))
def feat_calendar(spark, sf):
    return _assembled(spark, sf, G.calendar_set())


@query("feat_hybrid", _assembled_sql(True, True))
def feat_hybrid(spark, sf):
    return _assembled(spark, sf, G.hybrid_set())


@query("calendar_signature", twin("pd", f"SELECT id, date, value, {_CALENDAR_SQL} FROM pd"))
def calendar_signature(spark, sf):
    return with_calendar(user_day(spark, sf)).select("id", "date", "value", *CALENDAR_NUMERIC, *CALENDAR_LABELS)


@query(
    "one_hot_sparse",
    """SELECT l_orderkey, l_linenumber, level, 1::BIGINT AS cell FROM lineitem
  JOIN (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) - 1 AS level FROM (SELECT DISTINCT l_suppkey FROM lineitem)) USING (l_suppkey)""",
)
def one_hot_sparse(spark, sf):
    """Suppliers as indicator cells: as many levels as there are suppliers."""
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return X.one_hot_sparse(lines, "l_suppkey", X.level_index(lines, "l_suppkey"), ["l_orderkey", "l_linenumber"])


@query(
    "one_hot",
    "SELECT event_id, event_type, "
    + ", ".join(f"(event_type = '{t}')::BIGINT AS event_type_{t}" for t in EVENT_TYPES)
    + " FROM events",
)
def one_hot(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "event_type")
    return X.one_hot(events, "event_type", X.category_levels(events, "event_type"))


@query(
    "normalize",
    twin(
        "ps_scale",
        """SELECT id, date, round((idx - (SELECT avg(idx) FROM ps_scale)) / (SELECT stddev_samp(idx) FROM ps_scale), 8) AS date_index_num,
  round((yr - (SELECT avg(yr) FROM ps_scale)) / (SELECT stddev_samp(yr) FROM ps_scale), 8) AS date_year FROM
  (SELECT id, date, date_diff('day', DATE '1970-01-01', date) * 86400 AS idx, year(date) AS yr FROM ps_full)""",
    ),
)
def normalize(spark, sf):
    panel = with_calendar(regular(spark, sf, "PS"))
    scaled = X.normalize(panel, ["date_index_num", "date_year"], splits.train_rows(panel, HORIZON))
    return rounded(scaled.select("id", "date", "date_index_num", "date_year"), 8, "date_index_num", "date_year")


@query("drop_zero_variance", twin("ps_full", """SELECT 'date_year' AS "column", min(year(date)) = max(year(date)) AS is_constant FROM ps_full
  UNION ALL SELECT 'date_month', min(month(date)) = max(month(date)) FROM ps_full
  UNION ALL SELECT 'date_day', min(day(date)) = max(day(date)) FROM ps_full
  UNION ALL SELECT 'date_mweek', true UNION ALL SELECT 'value', min(value) = max(value) FROM ps_full"""))
def drop_zero_variance(spark, sf):
    panel = with_calendar(regular_panel(supplier_month(spark, sf)))
    return X.variance_report(panel, ["date_year", "date_month", "date_day", "date_mweek", "value"])


# --- scalar functions -----------------------------------------------------------


@query(
    "scalar_strings",
    """SELECT p_brand || ' [' || n::VARCHAR || ']' AS label, regexp_matches(p_name, 'RING|BOLT', 'i') AS is_fastener,
  CASE p_type WHEN 'PROMO' THEN 'Promotion' WHEN 'STANDARD' THEN 'Normal' ELSE p_type END AS type_name,
  p_name || CASE WHEN k = 0 THEN '' ELSE '.' || k::VARCHAR END AS unique_name
  FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_type) - 1 AS k FROM
        (SELECT p_name, p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2, 3))""",
)
def scalar_strings(spark, sf):
    """Over the distinct (name, brand, type) of all parts: numbering a name runs over its few variants."""
    variants = read_table(spark, sf, "part").groupBy("p_name", "p_brand", "p_type").agg(F.count("*").alias("n"))
    unique = with_unique_label(variants, "p_name", "unique_name", [F.col("p_brand"), F.col("p_type")])
    return unique.select(
        numbered_label(F.col("p_brand"), F.col("n")).alias("label"),
        matches(F.col("p_name"), "RING|BOLT").alias("is_fastener"),
        recode(F.col("p_type"), {"PROMO": "Promotion", "STANDARD": "Normal"}).alias("type_name"),
        "unique_name",
    )


@query(
    "scalar_math",
    """SELECT l_orderkey, l_linenumber, abs(l_discount - l_tax) AS gap, round(l_extendedprice / 7, 3) AS share,
  least(l_quantity, l_extendedprice / 1000) AS smaller,
  round(100 * (l_discount - l_tax) / nullif(l_discount, 0), 6) AS change_pct,
  l_quantity * 1.12::DOUBLE AS axis_limit FROM lineitem""",
)
def scalar_math(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    gap = F.col("l_discount") - F.col("l_tax")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        F.abs(gap).alias("gap"),
        F.round(F.col("l_extendedprice") / 7, 3).alias("share"),
        F.least(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("smaller"),
        F.round(F.try_divide(gap * 100, F.col("l_discount")), 6).alias("change_pct"),
        (F.col("l_quantity") * 1.12).alias("axis_limit"),
    )


@query(
    "scalar_dates",
    """SELECT o_orderkey, o_orderdate::DATE AS day, date_trunc('month', o_orderdate)::DATE AS month_start,
  (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS next_month,
  (date_trunc('month', o_orderdate) + INTERVAL 60 MONTH)::DATE AS in_60_months, date_trunc('quarter', o_orderdate)::DATE AS quarter_start,
  date_trunc('week', o_orderdate)::DATE AS week_start FROM orders""",
)
def scalar_dates(spark, sf):
    day = F.to_date("o_orderdate")
    start = MONTH.floor(F.col("o_orderdate"))
    return read_table(spark, sf, "orders").select(
        "o_orderkey",
        day.alias("day"),
        start.alias("month_start"),
        MONTH.add(start, 1).alias("next_month"),
        MONTH.add(start, 60).alias("in_60_months"),
        F.trunc(day, "quarter").alias("quarter_start"),
        F.trunc(day, "week").alias("week_start"),
    )


@query(
    "ordered_labels",
    twin(
        "pm",
        """SELECT id, total, row_number() OVER (ORDER BY total DESC, id) AS display_rank
  FROM (SELECT id, round(sum(value), 2) AS total FROM pm GROUP BY id)""",
    ),
)
def ordered_labels(spark, sf):
    totals = brand_month(spark, sf).groupBy("id").agg(F.round(F.sum("value"), 2).alias("total"))
    ranked = display_rank(totals.withColumn("_minus", -F.col("total")), "_minus", "id")
    return ranked.select("id", "total", big(F.col("display_rank")).alias("display_rank"))
