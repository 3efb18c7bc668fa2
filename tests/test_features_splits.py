from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelweave.functions.labels import PRODUCTION_RULES, classify, with_unique_label
from panelweave.operators import features as X
from panelweave.operators import splits
from panelweave.operators.panel import extend
from tests.conftest import month

LINE = {"a": [10 + 2 * t for t in range(48)], "b": [100 - t for t in range(48)]}


def test_lag_k_of_a_line(make_panel):
    rows = X.add_lags(make_panel(LINE), [1, 5]).filter("id = 'a' and value_lag5 is not null").collect()
    assert len(rows) == 43
    assert all(r["value_lag1"] == r["value"] - 2 and r["value_lag5"] == r["value"] - 10 for r in rows)


def test_rolling_mean_looks_back_only_and_is_partial(make_panel):
    out = X.lag_features(make_panel(LINE), [12]).filter("id = 'a'").orderBy("date").collect()
    assert out[11]["value_lag12_roll_12"] is None
    assert out[12]["value_lag12_roll_12"] == 10
    assert out[13]["value_lag12_roll_12"] == 11
    assert out[40]["value_lag12_roll_12"] == sum(10 + 2 * t for t in range(17, 29)) / 12


def test_no_feature_of_a_row_reads_later_values(make_panel, values_of):
    panel = make_panel(LINE)
    cut = month(30)
    changed = panel.withColumn("value", F.when(F.col("date") >= F.lit(cut), -999.0).otherwise(F.col("value")))
    names = [f"value_lag{k}" for k in range(1, 13)] + ["value_lag12_roll_12"]
    before = X.lag_features(panel, range(1, 13)).filter(F.col("date") <= F.lit(cut)).select("id", "date", *names)
    after = X.lag_features(changed, range(1, 13)).filter(F.col("date") <= F.lit(cut)).select("id", "date", *names)
    assert before.exceptAll(after).count() == 0


def test_prepared_drops_first_lags_and_future_keeps_horizon(make_panel):
    lagged = X.lag_features(extend(make_panel(LINE), 24).drop("is_future"))
    assert X.prepared_rows(lagged).count() == 2 * (48 - 24)
    assert X.future_rows(lagged).count() == 2 * 24


def test_one_hot_unseen_level_is_all_zero(spark):
    df = spark.createDataFrame([("x",), ("z",), (None,)], "c string")
    rows = X.one_hot(df, "c", ["x", "y"]).collect()
    assert [(r["c_x"], r["c_y"]) for r in rows] == [(1, 0), (0, 0), (0, 0)]


def test_category_levels_refuses_wide_columns(spark):
    with pytest.raises(ValueError, match="more than 5"):
        X.category_levels(spark.range(10).select(F.col("id").cast("string").alias("c")), "c", limit=5)


def test_normalize_uses_training_statistics(make_panel):
    train, test = make_panel({"a": [1, 2, 3]}), make_panel({"a": [5]})
    assert X.normalize(test, ["value"], train).first()["value"] == 3.0


def test_constant_columns(make_panel):
    panel = make_panel({"a": [1, 2]}).withColumn("k", F.lit(7))
    assert X.varying_columns(panel, ["value", "k"]) == ["value"]


def test_first_matching_rule_wins(spark):
    names = ["Nuclear Electric", "Solar", "natural GAS plant", "Tidal"]
    df = spark.createDataFrame([(n,) for n in names], "d string").withColumn("c", classify(F.col("d"), PRODUCTION_RULES))
    found = {r["d"]: r["c"].split()[0] for r in df.collect()}
    assert found == {"Nuclear Electric": "Fossil", "Solar": "Renewable", "natural GAS plant": "Fossil", "Tidal": "Other"}


def test_unique_labels(spark):
    df = spark.createDataFrame([(1, "m"), (2, "m"), (3, "n"), (4, "m")], "k int, d string")
    rows = with_unique_label(df, "d", "u", [F.col("k")]).orderBy("k").collect()
    assert [r["u"] for r in rows] == ["m", "m.1", "n", "m.2"]


def test_split_is_disjoint_complete_and_by_panel_dates(make_panel):
    panel = make_panel({"a": list(range(40)), "short": list(range(30))})
    train, test = splits.train_rows(panel, 12), splits.test_rows(panel, 12)
    assert train.count() + test.count() == panel.count()
    assert train.join(test, ["id", "date"]).count() == 0
    assert test.filter("id = 'short'").count() == 2
    assert test.agg(F.count_distinct("date")).first()[0] == 12


def test_split_refuses_a_short_panel(make_panel):
    with pytest.raises(Exception, match="fewer than 12"):
        splits.train_rows(make_panel({"a": [1, 2]}), 12).collect()


@pytest.mark.parametrize("plan,origins", [((60, 24, 6, 10), [61]), ((48, 12, 12, 4), [73, 61, 49]), ((48, 12, 12, 2), [73, 61])])
def test_plan_origins_on_85_dates(make_panel, plan, origins):
    rows = splits.cv_plan(make_panel({"a": list(range(85))}), *plan).orderBy("slice_id").collect()
    assert [r["train_end"] for r in rows] == [month(n - 1) for n in origins]
    assert all(r["train_start"] == month(0) for r in rows)
    assert [r["test_start"] for r in rows] == [month(n) for n in origins]
    assert [r["test_end"] for r in rows] == [month(n + plan[1] - 1) for n in origins]


def test_sliding_plan_keeps_initial_length(make_panel):
    rows = splits.cv_plan(make_panel({"a": list(range(85))}), 48, 12, 12, 4, cumulative=False).collect()
    assert {(r["train_start"], r["train_end"]) for r in rows} == {(month(n - 48), month(n - 1)) for n in (73, 61, 49)}


def test_cv_rows_roles(make_panel):
    panel = make_panel({"a": list(range(85))})
    rows = splits.cv_rows(panel, splits.cv_plan(panel, 48, 12, 12, 4)).groupBy("slice_id", "role").count().collect()
    assert {(r["slice_id"], r["role"], r["count"]) for r in rows} == {
        (1, "training", 73), (2, "training", 61), (3, "training", 49), (1, "testing", 12), (2, "testing", 12), (3, "testing", 12),
    }


def test_nest_and_split(make_panel):
    nested = splits.nest_series(extend(make_panel({"a": list(range(10))}), 3), 3)
    row = nested.first()
    assert len(row["actual_data"]) == 10 and [p["value"] for p in row["future_data"]] == [None] * 3
    roles = splits.split_nested(nested, 4).groupBy("role").count().collect()
    assert {(r["role"], r["count"]) for r in roles} == {("train", 6), ("test", 4)}


def test_panel_tail(make_panel, values_of):
    assert values_of(splits.panel_tail(make_panel({"a": [1, 2, 3], "b": [4]}), 2)) == {"a": [2, 3], "b": [4]}


def test_sparse_levels(spark):
    rows = [(i, [None, "b", "a", "zz", "a"][i % 5]) for i in range(400)] + [(1000 + i, f"u{i:04d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, c string")
    levels = X.level_index(df, "c")
    got = {r.c: r.level for r in levels.collect()}
    assert got == {v: i for i, v in enumerate(sorted({c for _, c in rows if c is not None}))}
    cells = X.one_hot_sparse(df.union(spark.createDataFrame([(9, "new")], "k long, c string")), "c", levels, ["k"])
    assert sorted(tuple(r) for r in cells.collect()) == sorted((k, got[c], 1) for k, c in rows if c is not None)
    assert X.level_index(df.limit(0), "c").count() == 0
