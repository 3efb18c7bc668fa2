"""Queries: scans, projections, predicates, reshaping, aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.labels import classify, matches
from panelweave.functions.steps import DAY
from panelweave.operators import panel as P
from panelweave.operators import splits
from panelweave.operators.baselines import forecast_calendar
from panelweave.operators.features import future_rows, lag_features, add_lags, add_rolling_mean, prepared_rows
from panelweave.operators.ranking import count_sorted, first_present
from panelweave.plans.panels import EVENT_RULES, brand_month, lazy, part_month, regular, shipments, supplier_month, user_day
from panelweave.plans.registry import query, rounded
from panelweave.plans.twins import HORIZON, twin
from panelweave.session import materialize
from panelweave.sources.tables import cast_date, read_table

START = "1997-01-01"
END = "1999-12-31"
CATEGORY_SQL = """CASE WHEN regexp_matches(event_type, 'click|view', 'i') THEN 'engagement'
  WHEN regexp_matches(event_type, 'purchase|signup', 'i') THEN 'conversion' ELSE 'Other' END"""
WATCHED = ("Brand#1", "Brand#5", "Brand#11", "Brand#17", "Brand#23")
_WATCHED_SQL = ", ".join(f"'{b}'" for b in WATCHED)


def classified_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their category; rows of no category dropped."""
    events = read_table(spark, sf, "events").select("user_id", "ts", "event_type", "value")
    labelled = events.withColumn("category", classify(F.col("event_type"), EVENT_RULES))
    return labelled.filter(F.col("category") != "Other")


# --- scans, projections, predicates -------------------------------------------


@query(
    "scan_raw",
    """SELECT l_shipdate::DATE AS date, l_suppkey::VARCHAR AS msn, l_returnflag AS description,
  l_linestatus AS unit, l_extendedprice AS value FROM lineitem""",
)
def scan_raw(spark, sf):
    return read_table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        F.col("l_suppkey").cast("string").alias("msn"),
        F.col("l_returnflag").alias("description"),
        F.col("l_linestatus").alias("unit"),
        F.col("l_extendedprice").alias("value"),
    )


@query("cast_date", "SELECT o_orderkey, o_orderdate::DATE AS date, o_totalprice FROM orders")
def cast_date_query(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return cast_date(orders, "o_orderdate").select("o_orderkey", "date", "o_totalprice")


@query(
    "filter_by_time",
    f"""SELECT l_suppkey, l_shipdate::DATE AS date, l_extendedprice AS value FROM lineitem
  WHERE l_shipdate::DATE BETWEEN DATE '{START}' AND DATE '{END}'""",
)
def filter_by_time(spark, sf):
    lines = read_table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    kept = P.filter_by_time(lines, "l_shipdate", START, END)
    return kept.select("l_suppkey", F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("value"))


@query(
    "project_columns",
    "SELECT p_brand AS description, p_partkey AS series, p_retailprice * 2 AS doubled FROM part",
)
def project_columns(spark, sf):
    part = read_table(spark, sf, "part").drop("p_name", "p_size", "p_type")
    return part.select(
        F.col("p_brand").alias("description"), F.col("p_partkey").alias("series"), (F.col("p_retailprice") * 2).alias("doubled")
    )


@query(
    "rename_columns",
    twin("pm", "SELECT id AS description, date AS period, value AS amount FROM pm"),
)
def rename_columns(spark, sf):
    return brand_month(spark, sf).withColumnsRenamed({"id": "description", "date": "period", "value": "amount"})


@query("classify_regex", f"SELECT event_id, event_type, {CATEGORY_SQL} AS category FROM events")
def classify_regex(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "event_type")
    return events.withColumn("category", classify(F.col("event_type"), EVENT_RULES))


@query(
    "filter_other",
    f"SELECT * FROM (SELECT user_id, ts::DATE AS date, {CATEGORY_SQL} AS category, value FROM events) WHERE category <> 'Other'",
)
def filter_other(spark, sf):
    return classified_events(spark, sf).select("user_id", F.to_date("ts").alias("date"), "category", "value")


@query("filter_in_list", twin("pm", f"SELECT id, date, value FROM pm WHERE id IN ({_WATCHED_SQL})"))
def filter_in_list(spark, sf):
    watched = read_table(spark, sf, "part").filter(F.col("p_brand").isin(*WATCHED))
    return part_month(spark, sf, "p_brand", watched)


@query(
    "filter_null_split",
    twin(
        "ps_pad",
        """SELECT CASE WHEN value IS NULL THEN 'future' ELSE 'known' END AS part, id, count(*) AS n,
  min(date) AS first_date, max(date) AS last_date
  FROM (SELECT id, date, value FROM ps_pad
        UNION ALL SELECT id, (d + to_months(k::INTEGER))::DATE, NULL
          FROM (SELECT id, max(date) AS d FROM ps_pad GROUP BY id) CROSS JOIN (SELECT unnest(range(1, 13)) AS k))
  GROUP BY 1, 2""",
    ),
)
def filter_null_split(spark, sf):
    extended = P.extend(P.pad(supplier_month(spark, sf)), HORIZON)
    part = F.when(F.col("value").isNull(), "future").otherwise("known")
    return extended.groupBy(part.alias("part"), "id").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "drop_na_rows",
    twin(
        "pd_pad",
        """SELECT id, date, value, value_lag1 FROM
  (SELECT id, date, value, lag(value) OVER (PARTITION BY id ORDER BY date) AS value_lag1 FROM pd_pad)
  WHERE value IS NOT NULL AND value_lag1 IS NOT NULL""",
    ),
)
def drop_na_rows(spark, sf):
    padded = P.pad(user_day(spark, sf), DAY).select("id", "date", "value")
    return add_lags(padded, [1]).na.drop("any")


@query("zero_to_null", "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS value FROM lineitem")
def zero_to_null(spark, sf):
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("value"))
    return P.zero_to_null(lines)


@query(
    "filter_not_regex",
    "SELECT event_id, event_type, value FROM events WHERE NOT regexp_matches(event_type, 'CLICK|ERROR', 'i')",
)
def filter_not_regex(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "event_type", "value")
    return events.filter(~matches(F.col("event_type"), "CLICK|ERROR"))


@query(
    "filter_before_split",
    twin("ps_cut", "SELECT id, date, value FROM ps_full WHERE date < (SELECT cut FROM ps_cut)"),
)
def filter_before_split(spark, sf):
    return splits.train_rows(regular(spark, sf, "PS"), HORIZON)


@query("equals_filter", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def equals_filter(spark, sf):
    orders = read_table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return orders.select("o_orderkey", "o_custkey", "o_totalprice")


@query("probe_column", twin("ps", "SELECT id, date, value AS prediction FROM ps"))
def probe_column(spark, sf):
    outside = supplier_month(spark, sf).withColumnRenamed("value", "0.5")
    found = first_present(outside, ("predictions", "prediction", "0.5"))
    return outside.withColumnRenamed(found, "prediction")


# --- reshaping ----------------------------------------------------------------


@query(
    "bucket_sum_total",
    """SELECT date_trunc('month', l_shipdate)::DATE AS date, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value
  FROM lineitem GROUP BY 1""",
)
def bucket_sum_total(spark, sf):
    return P.bucket_sum(shipments(spark, sf), [], "l_shipdate", "l_extendedprice", scale=P.MONEY_SCALE)


@query(
    "bucket_sum_category",
    f"""SELECT category, date, sum(value::DECIMAL(18,2))::DOUBLE AS value
  FROM (SELECT {CATEGORY_SQL} AS category, ts::DATE AS date, value FROM events) WHERE category <> 'Other' GROUP BY 1, 2""",
)
def bucket_sum_category(spark, sf):
    return P.bucket_sum(classified_events(spark, sf), [F.col("category")], "ts", "value", DAY, P.MONEY_SCALE)


@query("bucket_sum_series", twin("ps", "SELECT id, date, value FROM ps"))
def bucket_sum_series(spark, sf):
    return supplier_month(spark, sf)


@query("pad_by_time", twin("pd_pad", "SELECT id, date, coalesce(value, 0) AS value, is_padded FROM pd_pad"))
def pad_by_time(spark, sf):
    return P.pad(user_day(spark, sf), DAY, fill=0.0)


@query(
    "impute_linear",
    twin("pd_full", "SELECT id, date, round(value, 8) AS value, is_padded, is_imputed FROM pd_full"),
)
def impute_linear(spark, sf):
    return rounded(P.regular_panel(user_day(spark, sf), DAY), 8, "value")


@query(
    "future_frame",
    twin(
        "ps_full",
        f"""SELECT id, date, value, false AS is_future FROM ps_full
  UNION ALL SELECT id, (d + to_months(k::INTEGER))::DATE, NULL, true
  FROM (SELECT id, max(date) AS d FROM ps_full GROUP BY id) CROSS JOIN (SELECT unnest(range(1, {HORIZON + 1})) AS k)""",
    ),
)
def future_frame(spark, sf):
    return P.extend(lazy(spark, sf, "PS"), HORIZON)


_LAGS_SQL = ", ".join(f"lag(value, {k}) OVER (PARTITION BY id ORDER BY date) AS value_lag{k}" for k in range(1, 25))
_EXTENDED_SQL = f"""(SELECT id, date, value FROM ps_full UNION ALL SELECT id, (d + to_months(k::INTEGER))::DATE, NULL
  FROM (SELECT id, max(date) AS d FROM ps_full GROUP BY id) CROSS JOIN (SELECT unnest(range(1, 25)) AS k))"""
_ROLL_SQL = "avg(value_lag12) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


def _extended(spark: SparkSession, sf: str) -> DataFrame:
    return P.extend(lazy(spark, sf, "PS"), 24).drop("is_future")


@query("lags_1_to_h", twin("ps_full", f"SELECT id, date, value, {_LAGS_SQL} FROM {_EXTENDED_SQL}"))
def lags_1_to_h(spark, sf):
    return add_lags(_extended(spark, sf))


@query(
    "rolling_mean_lag",
    twin(
        "ps_full",
        f"""SELECT id, date, round({_ROLL_SQL}, 6) AS value_lag12_roll_12,
  round(avg(value_lag12) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), 6) AS centred
  FROM (SELECT id, date, lag(value, 12) OVER (PARTITION BY id ORDER BY date) AS value_lag12 FROM {_EXTENDED_SQL})""",
    ),
)
def rolling_mean_lag(spark, sf):
    lagged = add_lags(_extended(spark, sf), [12])
    centred = add_rolling_mean(lagged, before=6, after=5).withColumnRenamed("value_lag12_roll_12", "centred")
    both = add_rolling_mean(centred)
    return rounded(both.select("id", "date", "value_lag12_roll_12", "centred"), 6, "value_lag12_roll_12", "centred")


@query(
    "prepared_and_future",
    twin(
        "ps_full",
        f"""SELECT id, part, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM
  (SELECT *, CASE WHEN value IS NULL THEN 'future' ELSE 'prepared' END AS part,
     {" AND ".join(f"value_lag{k} IS NOT NULL" for k in range(1, 25))} AS complete FROM
   (SELECT id, date, value, {_LAGS_SQL} FROM {_EXTENDED_SQL}))
  WHERE part = 'future' OR complete GROUP BY id, part""",
    ),
)
def prepared_and_future(spark, sf):
    features = materialize(lag_features(_extended(spark, sf)), "features")
    parts = prepared_rows(features).withColumn("part", F.lit("prepared")).unionByName(
        future_rows(features).withColumn("part", F.lit("future"))
    )
    return parts.groupBy("id", "part").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "time_split",
    twin("ps_cut", "SELECT id, date, value, CASE WHEN date < (SELECT cut FROM ps_cut) THEN 'train' ELSE 'test' END AS role FROM ps_full"),
)
def time_split(spark, sf):
    return splits.time_split(regular(spark, sf, "PS"), HORIZON)


_PLAN = {"initial": 24, "assess": 12, "skip": 12, "slice_limit": 4}
_PLAN_SQL = """(SELECT j + 1 AS slice_id, min(date) AS train_start,
  max(CASE WHEN rn <= n - 12 - j * 12 THEN date END) AS train_end,
  min(CASE WHEN rn > n - 12 - j * 12 THEN date END) AS test_start,
  max(CASE WHEN rn <= n - j * 12 THEN date END) AS test_end
  FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n
        FROM (SELECT DISTINCT date FROM {train})) CROSS JOIN (SELECT unnest(range(0, 4)) AS j)
  WHERE n - 12 - j * 12 >= 24 GROUP BY j)"""


def plan_sql(train: str) -> str:
    return _PLAN_SQL.format(train=train)


def rolling_plan(train: DataFrame) -> DataFrame:
    """The 24/12/12 plan that fits the length of the test panels."""
    return splits.cv_plan(train, **_PLAN)


@query("cv_plan", twin("ps_train", f"SELECT * FROM {plan_sql('ps_train')}"))
def cv_plan(spark, sf):
    return rolling_plan(splits.train_rows(regular(spark, sf, "PS"), HORIZON))


@query(
    "cv_plan_long",
    twin(
        "ps_train",
        f"""SELECT slice_id, CASE WHEN date <= train_end THEN 'training' ELSE 'testing' END AS role, id, date, value
  FROM ps_train JOIN {plan_sql('ps_train')} ON date BETWEEN train_start AND test_end""",
    ),
)
def cv_plan_long(spark, sf):
    train = splits.train_rows(regular(spark, sf, "PS"), HORIZON)
    return splits.cv_rows(train, rolling_plan(train))


@query("panel_tail", twin("ps_tail", "SELECT id, date, value FROM ps_tail WHERE rn <= 24"))
def panel_tail(spark, sf):
    return splits.panel_tail(splits.train_rows(regular(spark, sf, "PS"), HORIZON), 24)


@query(
    "nest_series",
    twin(
        "ps_full",
        f"""SELECT id, count(*) FILTER (WHERE NOT f) AS n_actual, count(*) FILTER (WHERE f) AS n_future,
  max(date) FILTER (WHERE NOT f) AS last_actual, min(date) FILTER (WHERE f) AS first_future,
  string_agg(CASE WHEN NOT f THEN date::VARCHAR END, ',' ORDER BY date) AS actual_dates
  FROM (SELECT id, date, value IS NULL AS f FROM (SELECT id, date, value FROM ps_full
    UNION ALL SELECT id, (d + to_months(k::INTEGER))::DATE, NULL
    FROM (SELECT id, max(date) AS d FROM ps_full GROUP BY id) CROSS JOIN (SELECT unnest(range(1, {HORIZON + 1})) AS k)))
  GROUP BY id""",
    ),
)
def nest_series(spark, sf):
    nested = splits.nest_series(P.extend(lazy(spark, sf, "PS"), HORIZON), HORIZON)
    return nested.select(
        "id",
        F.size("actual_data").cast("bigint").alias("n_actual"),
        F.size("future_data").cast("bigint").alias("n_future"),
        F.get("actual_data", F.size("actual_data") - 1)["date"].alias("last_actual"),
        F.get("future_data", F.lit(0))["date"].alias("first_future"),
        F.array_join(F.transform("actual_data", lambda p: p["date"].cast("string")), ",").alias("actual_dates"),
    )


@query(
    "split_nested",
    twin(
        "ps_full",
        f"""SELECT id, CASE WHEN rn <= {HORIZON} THEN 'test' ELSE 'train' END AS role, date, value
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS rn FROM ps_full)""",
    ),
)
def split_nested(spark, sf):
    nested = splits.nest_series(P.extend(lazy(spark, sf, "PS"), HORIZON), HORIZON)
    return splits.split_nested(nested, HORIZON)


@query(
    "context_truth",
    twin(
        "ps_train ps_test",
        "SELECT 'context' AS part, id, date, value FROM ps_train UNION ALL SELECT 'truth', id, date, value FROM ps_test",
    ),
)
def context_truth(spark, sf):
    context, truth = splits.context_and_truth(regular(spark, sf, "PS"), HORIZON)
    return context.withColumn("part", F.lit("context")).unionByName(truth.withColumn("part", F.lit("truth")))


@query(
    "forecast_calendar",
    twin(
        "ps_tail",
        """SELECT id, (last_date + to_months((25 - rn)::INTEGER))::DATE AS date, 25 - rn AS step, value AS prediction
  FROM ps_tail WHERE rn <= 24 AND n_rows >= 24""",
    ),
)
def forecast_calendar_query(spark, sf):
    tail = splits.panel_tail(splits.train_rows(regular(spark, sf, "PS"), HORIZON), 24)
    points = F.sort_array(F.collect_list(F.struct("date", "value")))
    arrays = tail.groupBy("id").agg(
        F.max("date").alias("last_date"), F.transform(points, lambda p: p["value"]).alias("predictions")
    )
    return forecast_calendar(arrays.filter(F.size("predictions") >= 24))


@query(
    "pivot_long",
    """SELECT l_orderkey, l_linenumber, name, amount FROM
  (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax FROM lineitem)
  UNPIVOT (amount FOR name IN (l_quantity, l_extendedprice, l_tax))""",
)
def pivot_long(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    return lines.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_tax"], "name", "amount")


# --- aggregations -------------------------------------------------------------


@query("count_by_key", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_key(spark, sf):
    return read_table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("count_sorted", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1")
def count_sorted_query(spark, sf):
    return count_sorted(read_table(spark, sf, "orders"), "o_orderpriority")


@query("group_extent", twin("pm", "SELECT id, count(*) AS n, min(date) AS start, max(date) AS \"end\" FROM pm GROUP BY id"))
def group_extent(spark, sf):
    return brand_month(spark, sf).groupBy("id").agg(
        F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("end")
    )


@query(
    "holdout_extent",
    twin("ps_test", "SELECT min(date) AS start, max(date) AS \"end\", count(DISTINCT date) AS n_dates FROM ps_test"),
)
def holdout_extent(spark, sf):
    return splits.test_rows(regular(spark, sf, "PS"), HORIZON).agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count_distinct("date").alias("n_dates")
    )


@query("distinct_keys", "SELECT DISTINCT l_suppkey, date_trunc('month', l_shipdate)::DATE AS date FROM lineitem")
def distinct_keys(spark, sf):
    return shipments(spark, sf).select("l_suppkey", F.trunc(F.to_date("l_shipdate"), "month").alias("date")).distinct()


@query("conditional_count", "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) AS n FROM lineitem")
def conditional_count(spark, sf):
    return read_table(spark, sf, "lineitem").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("n")
    )


@query(
    "scalar_extreme",
    "SELECT min(l_shipdate)::DATE AS first_date, max(l_shipdate)::DATE AS last_date, max(l_orderkey) AS last_order FROM lineitem",
)
def scalar_extreme(spark, sf):
    return read_table(spark, sf, "lineitem").agg(
        F.to_date(F.min("l_shipdate")).alias("first_date"),
        F.to_date(F.max("l_shipdate")).alias("last_date"),
        F.max("l_orderkey").alias("last_order"),
    )


@query(
    "hierarchy_levels",
    """SELECT r_name, n_name, l_suppkey::VARCHAR AS id, date, sum(v)::DOUBLE AS value,
  (3 - grouping(r_name) - grouping(n_name) - grouping(l_suppkey))::BIGINT AS level
  FROM (SELECT r_name, n_name, l_suppkey, date_trunc('month', l_shipdate)::DATE AS date, l_extendedprice::DECIMAL(18,2) AS v
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey)
  GROUP BY GROUPING SETS ((date), (date, r_name), (date, r_name, n_name), (date, r_name, n_name, l_suppkey))""",
)
def hierarchy_levels(spark, sf):
    nation = read_table(spark, sf, "nation").join(
        read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    places = read_table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("id"), "n_name", "r_name"
    )
    leaf = supplier_month(spark, sf).join(places, "id")
    return P.hierarchy_levels(leaf, ["r_name", "n_name"], scale=P.MONEY_SCALE)


@query(
    "dup_period_check",
    """SELECT l_suppkey::VARCHAR AS id, date_trunc('month', l_shipdate)::DATE AS date, count(*) AS n_rows,
  count(*) FILTER (WHERE l_discount = 0) AS n_zero FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def dup_period_check(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    return P.duplicate_periods(lines, [F.col("l_suppkey").cast("string").alias("id")], "l_shipdate", "l_discount")
