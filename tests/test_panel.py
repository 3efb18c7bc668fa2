from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelweave.functions.steps import DAY, MONTH, QUARTER, WEEK
from panelweave.operators import panel as P
from tests.conftest import month

GAPS = {"a": {0: 1, 2: 3, 6: 7, 7: 8}, "b": {3: 5, 4: 6}}


def test_pad_is_per_id(make_panel, values_of):
    padded = P.pad(make_panel(GAPS))
    assert values_of(padded) == {"a": [1, None, 3, None, None, None, 7, 8], "b": [5, 6]}
    assert values_of(padded, "is_padded")["a"] == [False, True, False, True, True, True, False, False]


def test_pad_is_idempotent(make_panel, values_of):
    once = P.pad(make_panel(GAPS))
    twice = P.pad(once.drop("is_padded"))
    assert values_of(once) == values_of(twice)


def test_pad_fill_only_on_new_rows(make_panel, values_of):
    assert values_of(P.pad(make_panel({"a": {0: None, 2: 4}}), fill=0.0)) == {"a": [None, 0, 4]}


def test_pad_keeps_rows_of_a_repeated_period(spark):
    rows = [("a", month(0), 1.0), ("a", month(0), 2.0), ("a", month(2), 3.0)]
    padded = P.pad(spark.createDataFrame(rows, "id string, date date, value double"))
    assert sorted(r["value"] or 0 for r in padded.collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("freq,n", [(DAY, 8), (WEEK, 3), (QUARTER, 4)])
def test_other_frequencies(spark, freq, n):
    start = F.lit("2021-01-01").cast("date") if freq is not WEEK else F.lit("2021-01-04").cast("date")
    ends = spark.range(1).select(
        F.explode(F.array(start, freq.add(start, n - 1))).alias("date"), F.lit("a").alias("id"), F.lit(1.0).alias("value")
    )
    assert P.pad(ends, freq).count() == n


def test_impute_interior_is_linear_in_rows(make_panel, values_of):
    full = P.regular_panel(make_panel(GAPS))
    assert values_of(full)["a"] == [1, 2, 3, 4, 5, 6, 7, 8]


def test_impute_edges(make_panel, values_of):
    series = {"lead": [None, None, 3, 4], "trail": [1, 2, None], "none": [None, None], "one": [5]}
    out = P.impute_linear(make_panel(series))
    assert values_of(out) == {"lead": [3, 3, 3, 4], "trail": [1, 2, 2], "none": [None, None], "one": [5]}
    assert values_of(out, "is_imputed")["none"] == [False, False]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=12))
def test_imputed_values_lie_between_neighbours(make_panel, values_of, raw):
    out = values_of(P.impute_linear(make_panel({"a": raw})))["a"]
    known = [v for v in raw if v is not None]
    for i, v in enumerate(out):
        if not known:
            assert v is None
        elif raw[i] is None:
            left = [x for x in raw[:i] if x is not None][-1:] or known[:1]
            right = [x for x in raw[i:] if x is not None][:1] or known[-1:]
            assert min(left + right) - 1e-9 <= v <= max(left + right) + 1e-9
        else:
            assert v == raw[i]


def test_zero_is_missing_on_and_off(make_panel, values_of):
    zeros = make_panel({"a": {0: 2, 1: 0, 3: 8}})
    assert values_of(P.regular_panel(zeros))["a"] == [2, 0, 4, 8]
    assert values_of(P.regular_panel(zeros, zero_is_missing=True))["a"] == [2, 4, 6, 8]


def test_duplicate_periods_are_summed_and_reported(spark, values_of):
    rows = [("a", month(0), 1.25), ("a", month(0), 0.0), ("a", month(1), 4.0)]
    raw = spark.createDataFrame(rows, "k string, d date, v double")
    assert values_of(P.bucket_sum(raw, [F.col("k").alias("id")], "d", "v")) == {"a": [1.25, 4.0]}
    found = P.duplicate_periods(raw, [F.col("k").alias("id")], "d", "v").collect()
    assert [(r["id"], r["n_rows"], r["n_zero"]) for r in found] == [("a", 2, 1)]


def test_bucket_sum_is_exact_for_cents(spark):
    raw = spark.range(1000).select(F.lit("a").alias("id"), F.lit("2020-05-17").cast("date").alias("d"), F.lit(0.1).alias("v"))
    assert P.bucket_sum(raw, [F.col("id")], "d", "v", scale=2).first()["value"] == 100.0


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_sum_by_attribute_with_small_and_large_dimension(spark, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    facts = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"),
        F.add_months(F.lit("2020-01-15").cast("date"), (F.col("id") % 5).cast("int")).alias("d"),
        (F.col("id") / 100).alias("v"),
    )
    dim = spark.range(7).select(F.col("id").alias("pk"), F.concat(F.lit("g"), F.col("id") % 2).alias("g"))
    want = {
        (r["g"], r["m"]): r["s"]
        for r in facts.join(dim, facts.k == dim.pk).groupBy("g", F.trunc("d", "month").alias("m")).agg(F.round(F.sum("v"), 2).alias("s")).collect()
    }
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        out = P.bucket_sum_by_attribute(facts, dim, ("k", "pk"), "g", "d", "v", scale=2)
        text = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in text) == (limit != "-1")
        assert {(r["id"], r["date"]): r["value"] for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_extend_appends_after_each_ids_own_end(make_panel):
    out = P.extend(make_panel({"a": [1, 2], "b": [1, 2, 3]}), 2)
    future = {(r["id"], r["date"]) for r in out.filter("is_future").collect()}
    assert future == {("a", month(2)), ("a", month(3)), ("b", month(3)), ("b", month(4))}
    assert out.filter("is_future and value is not null").count() == 0
    assert out.count() == 9


def test_filter_by_time_is_inclusive(make_panel):
    panel = make_panel({"a": [1, 2, 3, 4]})
    assert P.filter_by_time(panel, "date", "2010-02-01").count() == 3
    assert P.filter_by_time(panel, "date", "2010-02-01", "2010-03-01").count() == 2


def test_hierarchy_totals_agree(spark, make_panel):
    leaf = make_panel({"a": [1, 2], "b": [3, 4]}).withColumn("group", F.lit("g"))
    rows = P.hierarchy_levels(leaf, ["group"]).groupBy("level").agg(F.sum("value").alias("s"), F.count("*").alias("n")).collect()
    assert {(r["level"], r["s"], r["n"]) for r in rows} == {(0, 10.0, 2), (1, 10.0, 2), (2, 10.0, 4)}


def test_pad_impute_extend_lag_take_one_exchange(spark, make_panel):
    from panelweave.operators.features import lag_features

    plan = lag_features(P.extend(P.regular_panel(make_panel(GAPS)), 3), range(1, 13))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_bucketed_table_needs_no_exchange(make_panel):
    from panelweave.operators.features import lag_features
    from panelweave.operators.splits import panel_tail
    from panelweave.session import materialize_by

    stored = materialize_by(make_panel({"a": range(30), "b": range(30)}), "stored")
    for plan in (lag_features(stored, range(1, 13)), panel_tail(stored, 3), stored.groupBy("id").agg(F.max("date"))):
        assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    assert stored.count() == 60


def test_freq_between(spark):
    row = spark.range(1).select(
        MONTH.between(F.lit("2010-01-01").cast("date"), F.lit("2011-03-01").cast("date")).alias("m"),
        DAY.between(F.lit("2010-01-01").cast("date"), F.lit("2010-01-31").cast("date")).alias("d"),
    ).first()
    assert (row["m"], row["d"]) == (14, 30)


def test_sums_keep_every_decimal(spark, values_of):
    import datetime as dt

    raw = spark.createDataFrame([("a", dt.date(2020, 1, 1), 0.123456), ("a", dt.date(2020, 2, 1), 0.004321)], "k string, d date, v double")
    assert values_of(P.bucket_sum(raw, [F.col("k").alias("id")], "d", "v")) == {"a": [0.123456, 0.004321]}
    leaf = P.bucket_sum(raw, [F.col("k").alias("id")], "d", "v").withColumn("g", F.lit("x"))
    got = {r["value"] for r in P.hierarchy_levels(leaf, ["g"]).filter("level = 2").collect()}
    assert got == {0.123456, 0.004321}


def test_nan_makes_the_sum_nan(spark):
    import math

    raw = spark.createDataFrame([("a", 1.25), ("a", float("nan")), ("b", float("inf")), ("b", 1.0), ("c", None), ("c", 0.1)], "k string, v double")
    for scale in (None, 2):
        got = {r["k"]: r["s"] for r in raw.groupBy("k").agg(P.exact_sum(F.col("v"), scale).alias("s")).collect()}
        assert math.isnan(got["a"]) and got["b"] == math.inf and got["c"] == 0.1


def test_weeks_before_the_epoch_have_their_own_index(spark):
    from panelweave.functions.steps import WEEK

    days = spark.sql("SELECT explode(sequence(date '1969-11-03', date '1970-02-02', interval 7 day)) AS d")
    got = [r[0] for r in days.select(WEEK.between(F.lit("1970-01-01").cast("date"), F.col("d")).alias("i")).orderBy("d").collect()]
    assert got == list(range(got[0], got[0] + len(got)))
