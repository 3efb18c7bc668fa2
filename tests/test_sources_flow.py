from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import global_ml as G
from panelweave.functions.labels import PRODUCTION_RULES, classify
from panelweave.plans.benchmark import BenchmarkConfig, panel_from_raw, run_benchmark
from panelweave.session import materialize, new_path, work_dir
from panelweave.sources import sinks
from panelweave.sources import tables as T


def test_handover_round_trip(spark, make_panel):
    path = new_path(spark, "handover")
    panel = make_panel({"a": [1.5, 2.25], "b": [1 / 3, None]})
    sinks.write_handover(panel, path)
    assert T.read_context(spark, path).exceptAll(panel).count() == 0


def test_missing_and_empty_inputs_are_refused(spark, make_panel):
    with pytest.raises(T.MissingInputError, match="not found"):
        T.require_input(spark, new_path(spark, "absent"), T.PANEL_SCHEMA)
    path = new_path(spark, "empty")
    sinks.write_handover(make_panel({"a": [1]}).filter("id = 'x'"), path)
    with pytest.raises(T.MissingInputError, match="no rows"):
        T.require_input(spark, path, T.PANEL_SCHEMA)


def test_accuracy_runs_are_kept_side_by_side(spark):
    path = new_path(spark, "accuracy")
    board = spark.createDataFrame([("m", 1.0)], "model_id string, rmse double")
    for run in ("one", "two", "one"):
        sinks.write_accuracy(board, path, run)
    assert sorted(r["run_id"] for r in spark.read.parquet(path).collect()) == ["one", "two"]


def test_work_dir_follows_the_cluster_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert work_dir(spark).startswith(named)
    assert new_path(spark, "x") != new_path(spark, "x")


def test_stored_model_predicts_the_same(spark, make_panel):
    rng = np.random.default_rng(0)
    train = make_panel({k: list(rng.normal(10, 1, 48) + np.arange(48)) for k in "ab"})
    spec = G.hybrid_set(12)
    table = materialize(G.feature_table(train, spec), "features")
    model = G.fit_global(table, spec, G.leaf_boosting(3, 0.3, 2), "m")
    path = new_path(spark, "model")
    sinks.save_model(model, path)
    again = G.load_global(spark, path)(table).select("id", "date", F.col("prediction").alias("p"))
    both = G.score_rows(model, table).join(again, ["id", "date"])
    assert both.filter(F.abs(F.col("p") - F.col("prediction")) > 1e-9).count() == 0 and both.count() == 72


def test_whole_benchmark(spark, make_panel):
    rng = np.random.default_rng(1)
    series = {k: [100 + 2 * t + 20 * np.sin(t * np.pi / 6) + rng.normal(0, 2) for t in range(72)] for k in ("a", "b", "c")}
    series["b"] = {t: v for t, v in enumerate(series["b"]) if t != 10}
    panel = make_panel(series)
    cfg = BenchmarkConfig(
        horizon=6, lags=12, plan={"initial": 30, "assess": 6, "skip": 6, "slice_limit": 2},
        trees=3, tuning_trees=2, tuning_grid=((1, 0.1), (2, 0.3)),
    )
    outside = panel.select("id", "date", F.col("value").alias("0.5"))
    run = run_benchmark(panel, cfg, {"outside": outside})
    board = {r["model_id"]: r["rmse"] for r in run.tables["final_benchmark"].collect()}
    assert board["outside"] == 0
    assert {"ensemble_mean", "ensemble_median", "ensemble_weighted", "ensemble_stacked", "leaf_boosting_tuned"} <= set(board)
    statistical = {f"panel_{m}" for m in ("exp_smoothing", "decomp_smoothing", "harmonic", "autoregression", "harmonic_boosted", "autoregression_boosted")}
    assert statistical <= set(board) and len(board) == 3 + 6 + 12 + 1 + 4 + 1
    assert run.tables["missing_forecasts"].count() == 0
    assert run.tables["global_vs_local"].count() == 3
    assert run.tables["local_future_forecast"].filter("key = 'prediction'").count() == 3 * 6
    assert run.tables["global_future_forecast"].filter("key = 'prediction'").count() == 3 * 6
    for name in ("local_future_forecast", "global_future_forecast"):
        ahead = run.tables[name].filter("key = 'prediction'")
        assert ahead.filter("lo <= value and value <= hi").count() == 3 * 6
        assert spark.read.parquet(f"{run.path}/{name}").count() == 3 * 6
    assert spark.read.parquet(f"{run.path}/accuracy_by_series").count() == run.tables["series_accuracy"].count()
    hybrid = run.tables["hybrid_accuracy"].first()
    assert hybrid["n"] == 18 and hybrid["rmse"] <= run.tables["best_global"].first()["rmse"] + 1e-9
    assert run.tables["calibrated"].groupBy("model_id").count().select("count").distinct().count() == 1
    assert spark.read.parquet(f"{run.path}/accuracy").filter("run_id = 'ensembles'").count() == 4


def test_panel_from_raw_rows(spark):
    made = [("2020-01-05", "CLETPUS", "Coal", "GWh", 1.2345), ("2020-01-20", "CLETPUS", "Coal", "GWh", 2.0), ("2020-02-01", "WYETPUS", "Wind", "GWh", 4.0),
            ("2020-03-01", "WYETPUS", "Wind", "GWh", None), (None, "WYETPUS", "Wind", "GWh", 8.0)]
    raw = spark.createDataFrame(made, "day string, msn string, description string, unit string, value double")
    raw = raw.select(F.col("day").cast("date").alias("date"), "msn", "description", "unit", "value")
    assert raw.schema == spark.createDataFrame([], T.RAW_SCHEMA).schema
    one = panel_from_raw(raw, F.col("description")).collect()
    assert sorted((r["id"], str(r["date"]), r["value"]) for r in one) == [("Coal", "2020-01-01", 1.2345 + 2.0), ("Wind", "2020-02-01", 4.0)]
    by_kind = panel_from_raw(raw, classify(F.col("description"), PRODUCTION_RULES), until="2020-01-31").collect()
    assert [(r["id"], r["value"]) for r in by_kind] == [("Fossil Fuels Production", 1.2345 + 2.0)]
