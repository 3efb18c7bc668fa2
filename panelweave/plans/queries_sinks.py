"""Queries: sources and sinks, each written below the shared work folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import global_ml as G
from panelweave.operators import per_series as U
from panelweave.operators import scoring as S
from panelweave.operators import splits
from panelweave.operators.baselines import baseline_forecasts
from panelweave.plans.panels import regular, supplier_month
from panelweave.plans.queries_models import SMALL_GRID, WINDOW_METRICS_SQL, _stored_train, window_scores
from panelweave.plans.queries_scoring import (
    _GVL, _GVL_ROUNDED, GVL_PLACES, WINDOWS, _round_by, calibrated, comparison, rounded_metrics, rounded_sql, train_test,
)
from panelweave.plans.registry import query, rounded
from panelweave.plans.twins import HORIZON, twin
from panelweave.session import materialize, new_path
from panelweave.sources import sinks
from panelweave.sources.tables import PANEL_SCHEMA, MissingInputError, read_context, read_csv, require_input


@query("scan_csv", twin("ps", "SELECT id, date, value FROM ps"))
def scan_csv(spark, sf):
    path = new_path(spark, "panel_csv")
    sinks.write_handover(supplier_month(spark, sf), path)
    return read_csv(spark, path, PANEL_SCHEMA)


@query("scan_context", twin("ps_train", "SELECT id, date, value FROM ps_train"))
def scan_context(spark, sf):
    path = new_path(spark, "context_csv")
    sinks.write_handover(splits.train_rows(regular(spark, sf, "PS"), HORIZON), path)
    return read_context(spark, path)


@query("missing_input_check", twin("ps", """SELECT 'present' AS input, count(*) AS n FROM ps
  UNION ALL SELECT 'absent', NULL UNION ALL SELECT 'empty', NULL"""))
def missing_input_check(spark, sf):
    """Rows of a delivered file, and the two refusals: no file, and a file without rows."""
    present, absent, empty = (new_path(spark, k) for k in ("present", "absent", "empty"))
    panel = supplier_month(spark, sf)
    sinks.write_handover(panel, present)
    sinks.write_handover(panel.filter(F.col("value") < 0), empty)
    counted = require_input(spark, present, PANEL_SCHEMA).agg(F.lit("present").alias("input"), F.count("*").alias("n"))
    for name, path in (("absent", absent), ("empty", empty)):
        try:
            n = require_input(spark, path, PANEL_SCHEMA).agg(F.count("*").alias("n"))
        except MissingInputError:
            n = spark.range(1).select(F.lit(None).cast("bigint").alias("n"))
        counted = counted.unionByName(n.select(F.lit(name).alias("input"), "n"))
    return counted


@query("sink_accuracy", twin("ps_acc", f"SELECT model_id, {rounded_sql()}, n, n_zero_actual, 'first' AS run_id FROM ps_acc"))
def sink_accuracy(spark, sf):
    path = new_path(spark, "accuracy")
    sinks.write_accuracy(S.accuracy_pooled(calibrated(spark, sf)), path, "first")
    return rounded_metrics(spark.read.parquet(path))


@query("sink_comparison", twin("ps_acc ps_acc_id", f"SELECT {_GVL_ROUNDED} FROM ({_GVL})"))
def sink_comparison(spark, sf):
    path = new_path(spark, "comparison")
    table = comparison(spark, sf)
    sinks.write_comparison(table, path)
    return _round_by(read_csv(spark, path, table.schema.simpleString()[7:-1].replace(":", " ")), GVL_PLACES)


@query("sink_forecasts", twin("ps_fc", "SELECT id, model_id, step, date, round(prediction, 6) AS prediction FROM ps_fc"))
def sink_forecasts(spark, sf):
    path = new_path(spark, "forecasts")
    train, _ = train_test(spark, sf)
    sinks.write_forecasts(baseline_forecasts(train, HORIZON, windows=WINDOWS), path)
    return rounded(spark.read.parquet(path), 6, "prediction")


@query("sink_context_truth", twin("ps_train ps_test", """SELECT 'context' AS part, id, date, value FROM ps_train
  UNION ALL SELECT 'truth', id, date, value FROM ps_test"""))
def sink_context_truth(spark, sf):
    context, truth = splits.context_and_truth(regular(spark, sf, "PS"), HORIZON)
    paths = {"context": new_path(spark, "context"), "truth": new_path(spark, "truth")}
    sinks.write_handover(context, paths["context"])
    sinks.write_handover(truth, paths["truth"])
    parts = [read_csv(spark, p, PANEL_SCHEMA).withColumn("part", F.lit(k)) for k, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query(
    "sink_tuning",
    twin(
        "ps_train steps",
        f"""SELECT config, "window", metric, round(mean, 4) AS mean, n, round(std_err, 4) AS std_err, config = (SELECT config FROM
  ({WINDOW_METRICS_SQL}) WHERE metric = 'rmse' ORDER BY mean, config LIMIT 1) AS chosen FROM ({WINDOW_METRICS_SQL})""",
    ),
)
def sink_tuning(spark, sf):
    """Tuning scores and the chosen point, written and read back side by side."""
    path = new_path(spark, "tuning")
    metrics = materialize(G.tune_metrics(window_scores(spark, sf), ["window"]), "metrics")
    sinks.write_tuning(metrics, G.select_best(metrics, params=["window"]), path)
    results = read_csv(spark, f"{path}/results", "config string, window bigint, metric string, mean double, n bigint, std_err double")
    best = read_csv(spark, f"{path}/best", "window bigint, config string").select("config").scalar()
    return rounded(results, 4, "mean", "std_err").withColumn("chosen", F.col("config") == best)


@query("save_model")
def save_model(spark, sf):
    """A stored global model, loaded and applied; and the stored parameters of the per-series models."""
    train, _ = _stored_train(spark, sf)
    spec = G.hybrid_set()
    table = materialize(G.feature_table(train, spec), "features_hybrid")
    path = new_path(spark, "model")
    sinks.save_model(G.fit_global(table, spec, G.leaf_boosting(5, 0.1, SMALL_GRID[0][0]), "stored"), path)
    fitted = G.load_global(spark, path)(table).select("id", "date", "value", "prediction")
    params = new_path(spark, "series_models")
    sinks.save_series_models(U.fit_per_series(train, HORIZON), params)
    chosen = spark.read.parquet(params).groupBy("id").agg(F.count("*").alias("n_series_models"))
    return fitted.join(chosen, "id")
