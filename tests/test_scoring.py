from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions.quantiles import exact_quantiles
from panelweave.operators import compare as C
from panelweave.operators import ensembles as E
from panelweave.operators import ranking as R
from panelweave.operators import scoring as S
from panelweave.operators.baselines import baseline_forecasts, seasonal_naive_forecast
from panelweave.sources.external import external_forecasts
from tests.conftest import month

# Published by-series errors of two outside models (rmse, mae, mape) and the pooled values they must give.
OUTSIDE_RMSE = (0.040394, 0.237969, 0.456473, 0.00105828, 0.0145828, 0.22963, 0.0313742, 0.0184965, 0.0126836, 0.0360145)
OTHER_RMSE = (0.0431691, 0.282008, 0.525125, 0.000809114, 0.014998, 0.310674, 0.0414326, 0.0240741, 0.0154037, 0.0344959)
# Published global and local errors of ten series.
GLOBAL_RMSE = (0.0142278, 0.135772, 0.123538, 0.00143545, 0.0181393, 0.184024, 0.0186258, 0.0195729, 0.00471659, 0.0173391)
LOCAL_RMSE = (0.00928322, 0.108868, 0.245784, 0.00114221, 0.0200042, 0.392908, 0.0495641, 0.0194, 0.00658418, 0.0215348)
IMPROVEMENT = (34.7529, 19.816, -98.954, 20.4287, -10.281, -113.509, -166.105, 0.883069, -39.5962, -24.1979)


def calibrated(spark, rows):
    return spark.createDataFrame(
        [(m, i, month(t), float(a), float(p), float(a) - float(p)) for m, i, t, a, p in rows],
        "model_id string, id string, date date, actual double, prediction double, residual double",
    )


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(7)
    rows = [
        (m, i, t, a, a + rng.normal(0, 2))
        for m in ("m1", "m2") for i in "abc" for t, a in enumerate(rng.normal(50, 10, 24))
    ]
    return calibrated(spark, rows), rows


def test_metrics_against_numpy(noisy):
    df, rows = noisy
    for r in S.accuracy_by_series(df).collect():
        a = np.array([x[3] for x in rows if (x[0], x[1]) == (r["model_id"], r["id"])])
        p = np.array([x[4] for x in rows if (x[0], x[1]) == (r["model_id"], r["id"])])
        assert r["rmse"] == pytest.approx(np.sqrt(((a - p) ** 2).mean()))
        assert r["mae"] == pytest.approx(abs(a - p).mean())
        assert r["mape"] == pytest.approx(100 * abs((a - p) / a).mean())
        assert r["smape"] == pytest.approx(100 * (abs(a - p) / ((abs(a) + abs(p)) / 2)).mean())
        assert r["mase"] == pytest.approx(abs(a - p).mean() / abs(np.diff(a)).mean())
        assert r["rsq"] == pytest.approx(np.corrcoef(a, p)[0, 1] ** 2)


def test_pooled_from_series_equals_pooled_from_rows(noisy):
    df, rows = noisy
    for r in S.accuracy_pooled(df).collect():
        a = np.array([x[3] for x in rows if x[0] == r["model_id"]])
        p = np.array([x[4] for x in rows if x[0] == r["model_id"]])
        assert r["rmse"] == pytest.approx(np.sqrt(((a - p) ** 2).mean()))
        assert r["rsq"] == pytest.approx(np.corrcoef(a, p)[0, 1] ** 2)
        assert r["n"] == 72


def test_zero_actual_is_skipped_and_counted(spark):
    r = S.accuracy_by_series(calibrated(spark, [("m", "a", 0, 0, 1), ("m", "a", 1, 4, 5)])).first()
    assert r["mape"] == 25.0 and r["n_zero_actual"] == 1 and r["n"] == 2


def test_constant_side_has_no_rsq_or_mase(spark):
    r = S.accuracy_by_series(calibrated(spark, [("m", "a", t, 5, t) for t in range(4)])).first()
    assert r["rsq"] is None and r["mase"] is None


def test_pooled_rmse_is_root_mean_square_of_equal_series():
    assert np.sqrt(np.mean(np.square(OUTSIDE_RMSE))) == pytest.approx(0.179543, abs=1e-6)
    assert np.sqrt(np.mean(np.square(OTHER_RMSE))) == pytest.approx(0.213920, abs=1e-6)


def scores(spark, rmses, model_id="m"):
    rows = [(f"s{i}", model_id, v, v, v) for i, v in enumerate(rmses)]
    return spark.createDataFrame(rows, "id string, model_id string, rmse double, mae double, mape double")


def test_global_vs_local_recomputes(spark):
    out = C.global_vs_local(scores(spark, GLOBAL_RMSE), scores(spark, LOCAL_RMSE, "own")).orderBy("id").collect()
    assert [r["rmse_improvement_pct"] for r in out] == pytest.approx(list(IMPROVEMENT), rel=2e-3)
    assert {w: sum(r["winner"] == w for r in out) for w in ("Global", "Series-Specific")} == {"Global": 6, "Series-Specific": 4}


def test_two_model_winner_counts(spark):
    both = C.two_model_winner(scores(spark, OUTSIDE_RMSE), scores(spark, OTHER_RMSE), "one", "two")
    counted = R.count_sorted(both, "winner").collect()
    assert [(r["winner"], r["n"]) for r in counted] == [("one", 8), ("two", 2)]


def test_tie_and_zero_global(spark):
    out = C.global_vs_local(scores(spark, [0.0]), scores(spark, [0.0], "own")).first()
    assert out["winner"] == "Tie" and out["rmse_improvement_pct"] is None


def test_hybrid_policy_takes_the_better(spark):
    out = C.hybrid_policy(scores(spark, [1.0, 2.0], "g"), scores(spark, [1.0, 1.5], "l")).orderBy("id").collect()
    assert [(r["model_id"], r["rmse"]) for r in out] == [("g", 1.0), ("l", 1.5)]


def test_ties(spark):
    board = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "model_id string, rmse double")
    assert {r["model_id"] for r in R.top_k_ties(board, "rmse", 1).collect()} == {"a", "b"}
    assert [r["model_id"] for r in R.top_1(board, "rmse").collect()] == ["a"]
    assert [r["model_id"] for r in R.head_n(board, "rmse", 2).collect()] == ["a", "b"]


def test_union_keeps_absent_columns_null(spark):
    a = spark.createDataFrame([("m", 1.0)], "model_id string, rmse double")
    b = spark.createDataFrame([("n", 2.0, 3.0)], "model_id string, rmse double, mase double")
    rows = R.union_benchmarks([a, b]).orderBy("model_id").collect()
    assert [r["mase"] for r in rows] == [None, 3.0]


def test_pure_season_has_no_error(make_panel):
    wave = [10 + (t % 12) for t in range(48)]
    train, test = make_panel({"a": wave[:36]}), make_panel({"a": dict(enumerate(wave)) and {t: wave[t] for t in range(36, 48)}})
    r = S.accuracy_by_series(S.calibrate(seasonal_naive_forecast(train, 12), test)).first()
    assert r["rmse"] == 0 and r["n"] == 12


def test_season_repeats_beyond_one_cycle(make_panel):
    ahead = seasonal_naive_forecast(make_panel({"a": list(range(24))}), 24).orderBy("step").collect()
    assert [r["prediction"] for r in ahead] == [12 + j % 12 for j in range(24)]
    assert ahead[0]["date"] == month(24) and ahead[-1]["date"] == month(47)


def test_short_series_has_no_seasonal_forecast_and_is_reported(make_panel):
    train, test = make_panel({"a": list(range(5))}), make_panel({"a": {5: 1, 6: 2}})
    ahead = baseline_forecasts(train, 2, windows=(3,))
    assert {r["model_id"] for r in ahead.collect()} == {"rolling_mean_3"}
    gone = S.missing_forecasts(test, ahead, ["rolling_mean_3", "seasonal_naive_12"])
    assert {(r["model_id"], r["date"]) for r in gone.collect()} == {("seasonal_naive_12", month(5)), ("seasonal_naive_12", month(6))}


@pytest.fixture(scope="module")
def members(spark):
    rows = [("p", "a", 0, 10, 8), ("q", "a", 0, 10, 12), ("r", "a", 0, 10, 20), ("p", "a", 1, 10, 8), ("q", "a", 1, 10, 10)]
    board = spark.createDataFrame([("p", 1.0), ("q", 2.0), ("r", 3.0)], "model_id string, rmse double")
    return calibrated(spark, rows), board


@pytest.mark.parametrize("how,first,partial", [("mean", 40 / 3, 9.0), ("median", 12.0, 9.0), ("weighted", (3 * 8 + 2 * 12 + 20) / 6, 44 / 5)])
def test_ensembles(members, how, first, partial):
    df, board = members
    strict = [r["prediction"] for r in E.combine(df, board, how).orderBy("date").collect()]
    assert strict[0] == pytest.approx(first) and strict[1] is None
    loose = [r["prediction"] for r in E.combine(df, board, how, allow_partial=True).orderBy("date").collect()]
    assert loose == pytest.approx([first, partial])


def test_weights_follow_rank_and_sum_to_one(members):
    got = {r["model_id"]: r["weight"] for r in E.ensemble_weights(members[1]).collect()}
    assert got == pytest.approx({"p": 3 / 6, "q": 2 / 6, "r": 1 / 6})


def test_mean_of_one_member_is_the_member(spark, noisy):
    one = noisy[0].filter("model_id = 'm1'")
    board = spark.createDataFrame([("m1", 1.0)], "model_id string, rmse double")
    joined = E.combine(one, board, "mean").withColumnRenamed("prediction", "e").join(one, ["id", "date"])
    assert joined.filter(F.abs(F.col("e") - F.col("prediction")) > 1e-9).count() == 0


def test_unstackable_families_are_left_out(spark):
    board = spark.createDataFrame([("1", "DeepAR", 0.1), ("2", "GLMNET", 0.2), ("3", "SNAIVE", 0.3)], "model_id string, model_desc string, rmse double")
    assert [r["model_id"] for r in E.stack_base(board).orderBy("rmse").collect()] == ["2", "3"]


def test_quantile_coverage(spark):
    rows = [("m", "a", t, t, 5) for t in range(10)]
    df = calibrated(spark, rows).withColumn("lo", F.lit(2.0)).withColumn("hi", F.lit(6.0))
    assert S.coverage(df).first()["coverage"] == 0.5


def test_interval_by_id(spark):
    df = calibrated(spark, [("m", "a", t, 10 + t, 10) for t in range(21)])
    row = S.forecast_interval(df.select("model_id", "id", "date", "prediction"), df).first()
    assert row["hi"] - row["prediction"] == pytest.approx(19.0)


@pytest.mark.parametrize("cuts,few", [(2, False), (64, True)])
def test_exact_quantiles_match_numpy(spark, cuts, few):
    rng = np.random.default_rng(3)
    hot = np.concatenate([np.full(400, 5.0), rng.normal(0, 10, 800)])
    cold = rng.normal(0, 1, 7)
    data = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("one", 2.0), ("hot", None)]
    df = spark.createDataFrame(data, "g string, v double")
    out = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.95, 1.0], ["a", "b", "c", "d"], cuts, few).collect()}
    for name, values in (("hot", hot), ("cold", cold), ("one", np.array([2.0]))):
        want = np.quantile(values, [0.0, 0.25, 0.95, 1.0])
        assert [out[name][k] for k in "abcd"] == pytest.approx(list(want))


def test_rowwise_step_chains_dates(make_panel):
    series = {"a": [1, 5, 2], "b": [4, 4, 9], "c": [0, 7, 7]}
    flat = [series[k][t] for t in range(3) for k in "abc"]
    got = S.mase_rowwise(make_panel(series)).first()["naive_step"]
    assert got == pytest.approx(np.abs(np.diff(flat)).mean())


def test_backtest_summary_is_mean_over_slices(spark):
    rows = [("m", "a", t, 0, 1 if t < 2 else 3) for t in range(4)]
    df = calibrated(spark, rows).withColumn("slice_id", F.when(F.col("prediction") == 1, 1).otherwise(2))
    out = {r["metric"]: r for r in S.backtest_accuracy(df).collect()}
    assert (out["rmse"]["mean"], out["rmse"]["n"], out["rmse"]["std_err"]) == (2.0, 2, pytest.approx(1.0))


def test_external_column_probe(spark):
    base = spark.createDataFrame([("a", "2020-01-01", 1.0, 2.0, 3.0)], "id string, date string, `0.1` double, `0.5` double, `0.9` double")
    row = external_forecasts(base, "out").first()
    assert (row["prediction"], row["lo"], row["hi"]) == (2.0, 1.0, 3.0)
    both = base.withColumn("prediction", F.lit(9.0))
    assert external_forecasts(both, "out").first()["prediction"] == 9.0
    with pytest.raises(ValueError, match="none of"):
        external_forecasts(base.drop("0.5"), "out")


def test_pooled_rsq_of_large_values(spark):
    import datetime as dt
    import random

    draw = random.Random(5)
    rows = []
    for s in range(20):
        for i in range(24):
            actual = 1e8 + draw.gauss(0, 10)
            rows.append(("m", f"s{s}", dt.date(2020 + i // 12, i % 12 + 1, 1), actual, actual + draw.gauss(0, 0.3)))
    calibrated = spark.createDataFrame(rows, "model_id string, id string, date date, actual double, prediction double")
    got = S.accuracy_pooled(calibrated).first()["rsq"]
    a, p = [r[3] - 1e8 for r in rows], [r[4] - 1e8 for r in rows]
    n, ma, mp = len(a), sum(a) / len(a), sum(p) / len(p)
    cov = sum((x - ma) * (y - mp) for x, y in zip(a, p)) / n
    want = cov**2 / (sum((x - ma) ** 2 for x in a) / n) / (sum((y - mp) ** 2 for y in p) / n)
    assert got <= 1 and abs(got - want) < 1e-6
