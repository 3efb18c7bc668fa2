"""One Spark ML regressor for all series: feature sets, recursion, tuning, stacking."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.calendar import CALENDAR_NUMERIC, SCALED_COLUMNS, calendar_columns
from panelweave.functions.steps import MONTH, Freq
from panelweave.operators.boosting import Binned, BoostedTrees, Boosting, Cut, block_errors
from panelweave.operators.features import ROLL_PERIOD, ROLL_SOURCE_LAG, lag_features, prepared_rows
from panelweave.operators.forest import NODES_IN_PLAN, Forest, RandomForest
from panelweave.operators.panel import by_time
from panelweave.operators.scoring import metric_summary
from panelweave.session import materialize, side_by_side

SEED = 123
LEVELS = ("id_mean", "id_spread", "id_recent")
LEVEL_SEASON = 12  # newest rows of a series whose mean is ``id_recent``
STEPS_PER_WRITE = 6
PROFILED_AT_ONCE = 8  # columns
MONTH_LABELS = tuple(range(1, 13))
WEEKDAY_LABELS = tuple(range(1, 8))


# --- estimators, with the parameters of the benchmark they re-express ---------


def elastic_net(penalty: float = 0.01, mixture: float = 0.99, **params) -> LinearRegression:
    return LinearRegression(
        featuresCol="features", labelCol="value", regParam=penalty, elasticNetParam=mixture, **params
    )


def gradient_boosting(
    trees: int = 500, learn_rate: float = 0.05, depth: int = 8, min_n: int = 5, loss_reduction: float = 0.001, penalty: float = 1.0
) -> Boosting:
    """Second-order boosting, trees grown by depth."""
    return Boosting(trees, learn_rate, depth, min_n, loss_reduction, penalty)


def leaf_boosting(trees: int = 500, learn_rate: float = 0.05, depth: int = 6, min_n: int = 5, leaves: int = 31) -> Boosting:
    """Second-order boosting, trees grown leaf by leaf, best gain first; no penalty."""
    return Boosting(trees, learn_rate, depth, min_n, penalty=0.0, leaves=leaves)


def series_boosting(trees: int = 200, learn_rate: float = 0.05, depth: int = 5, min_n: int = 5) -> Boosting:
    """Smaller boosting for a panel of one or few series."""
    return gradient_boosting(trees, learn_rate, depth, min_n, 0.0)


def random_forest(trees: int = 500, min_n: int = 5, depth: int = 12) -> RandomForest:
    """Bagged trees, a third of the predictors at each cut."""
    return RandomForest(trees, min_n, depth, seed=SEED)


# --- features -----------------------------------------------------------------


@dataclass(frozen=True)
class FeatureSet:
    """Which predictors a model sees."""

    name: str
    lags: int = 24
    use_lags: bool = True
    use_calendar: bool = True

    @property
    def lag_numbers(self) -> range:
        return range(1, self.lags + 1)

    @property
    def rolls(self) -> bool:
        return self.use_lags and self.lags >= ROLL_SOURCE_LAG

    @property
    def tail_length(self) -> int:
        """How much of a series the predictors of one step reach back."""
        return max(self.lags, ROLL_SOURCE_LAG + ROLL_PERIOD - 1 if self.rolls else 0)


def lag_set(lags: int = 24) -> FeatureSet:
    return FeatureSet("lag", lags, True, False)


def calendar_set() -> FeatureSet:
    return FeatureSet("calendar", 0, False, True)


def hybrid_set(lags: int = 24) -> FeatureSet:
    return FeatureSet("hybrid", lags, True, True)


def _calendar_predictors(date: Column | None = None) -> dict[str, Column]:
    """Calendar integers plus 0/1 columns for month and weekday names."""
    date = F.col("date") if date is None else date
    cols = {n: c.cast("double") for n, c in calendar_columns(date).items() if n in CALENDAR_NUMERIC}
    cols |= {f"date_month_is_{k}": (F.month(date) == k).cast("double") for k in MONTH_LABELS}
    cols |= {f"date_wday_is_{k}": (F.dayofweek(date) == k).cast("double") for k in WEEKDAY_LABELS}
    return cols


def feature_table(panel: DataFrame, spec: FeatureSet) -> DataFrame:
    """Known rows with all predictors of ``spec`` present."""
    df = panel.select("id", "date", "value")
    if spec.use_lags:
        df = lag_features(df, spec.lag_numbers) if spec.rolls else _plain_lags(df, spec)
    df = prepared_rows(df)
    return df.withColumns(_calendar_predictors()) if spec.use_calendar else df


def _plain_lags(df: DataFrame, spec: FeatureSet) -> DataFrame:
    return df.withColumns({f"value_lag{k}": F.lag("value", k).over(by_time()) for k in spec.lag_numbers})


def predictor_columns(spec: FeatureSet) -> list[str]:
    cols = []
    if spec.use_lags:
        cols += [f"value_lag{k}" for k in spec.lag_numbers]
        if spec.rolls:
            cols.append(f"value_lag{ROLL_SOURCE_LAG}_roll_{ROLL_PERIOD}")
    if spec.use_calendar:
        cols += list(_calendar_predictors())
    return cols


@dataclass(frozen=True)
class Profile:
    """What fitting needs to know about the training rows; each column is read once."""

    columns: list[str]
    scaling: dict[str, tuple[float, float]]


def profile(features: DataFrame, spec: FeatureSet) -> Profile:
    """Varying predictors, and mean and deviation of the scaled ones."""
    names = predictor_columns(spec)
    scaled = [c for c in SCALED_COLUMNS if c in names]
    wanted = [(F.min(c) < F.max(c)).alias(f"v_{c}") for c in names]
    wanted += [f(c).alias(f"{kind}_{c}") for c in scaled for kind, f in (("m", F.avg), ("s", F.stddev_samp))]
    # A few at a time: one aggregation of them all is a function too long for the JVM to compile.
    groups = [wanted[i : i + PROFILED_AT_ONCE] for i in range(0, len(wanted), PROFILED_AT_ONCE)]
    row = {k: v for found in side_by_side(lambda some: features.agg(*some).first(), groups) for k, v in found.asDict().items()}
    columns = [c for c in names if row[f"v_{c}"]]
    scaling = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in scaled if c in columns}
    return Profile(columns, scaling)


def series_levels(features: DataFrame, season: int = LEVEL_SEASON) -> DataFrame:
    """What tells one series from another, one row per id: mean, deviation and newest-season mean of its rows.

    Three numbers at any number of series, and those of one series do not depend on
    the others. The list folded per id is bounded by the calendar.
    """
    newest = F.slice(F.sort_array(F.collect_list(F.struct("date", "value")), asc=False), 1, season)
    recent = F.aggregate(newest, F.lit(0.0), lambda s, p: s + p["value"]) / F.size(newest)
    spread = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    return features.groupBy("id").agg(F.avg("value").alias("id_mean"), spread.alias("id_spread"), recent.alias("id_recent"))


@dataclass
class GlobalModel:
    """A fitted regressor with everything needed to build its predictors again.

    A series without levels, unseen in training, takes their means.
    """

    model_id: str
    spec: FeatureSet
    levels: DataFrame
    common: dict[str, float]
    columns: list[str]
    scaling: dict[str, tuple[float, float]]
    regressor: Model | BoostedTrees | None = None
    assembler: VectorAssembler = field(init=False)

    def __post_init__(self):
        self.assembler = VectorAssembler(inputCols=[*LEVELS, *self.columns], outputCol="features")

    def with_levels(self, df: DataFrame) -> DataFrame:
        known = df.join(self.levels, "id", "left")
        return known.withColumns({c: F.coalesce(c, F.lit(m)) for c, m in self.common.items()})

    def vectors(self, df: DataFrame) -> DataFrame:
        """Rows with all predictors of the set, scaled and assembled as ``features``."""
        scaled = self.with_levels(df).withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.scaling.items()})
        return self.assembler.transform(scaled)

    def predict(self, df: DataFrame) -> DataFrame:
        """Predictions for rows that carry the predictors."""
        return self.regressor.transform(self.vectors(df))

    def save(self, path: str) -> None:
        """The levels as a table; scaling, assembler and regressor as a Spark ML pipeline directory, boosted trees as a table."""
        fill = [SQLTransformer(statement=f"SELECT *, coalesce({c}, {m!r}D) AS {c}_known FROM __THIS__") for c, m in self.common.items()]
        scale = [
            SQLTransformer(statement=f"SELECT *, ({c} - {m!r}D) / {s!r}D AS {c}_scaled FROM __THIS__")
            for c, (m, s) in self.scaling.items()
        ]
        inputs = [*[f"{c}_known" for c in LEVELS], *[f"{c}_scaled" if c in self.scaling else c for c in self.columns]]
        stages = [*fill, *scale, VectorAssembler(inputCols=inputs, outputCol="features")]
        self.levels.write.mode("overwrite").parquet(f"{path}/levels")
        if isinstance(self.regressor, BoostedTrees):
            self.regressor.save(self.levels.sparkSession, f"{path}/trees")
        else:
            stages.append(self.regressor)
        PipelineModel(stages=stages).write().overwrite().save(f"{path}/pipeline")


def load_global(spark: SparkSession, path: str) -> Callable[[DataFrame], DataFrame]:
    """A stored model as a function from rows with predictors to rows with ``prediction``."""
    levels, pipeline = spark.read.parquet(f"{path}/levels"), PipelineModel.load(f"{path}/pipeline")
    assembled = lambda rows: pipeline.transform(rows.join(levels, "id", "left"))
    if not isinstance(pipeline.stages[-1], VectorAssembler):
        return assembled
    trees = _walkable(BoostedTrees.load(spark, f"{path}/trees"))
    return lambda rows: trees.transform(assembled(rows))


def _walkable(model: Model | BoostedTrees) -> Model | BoostedTrees:
    """Boosted trees of too many nodes for a plan as a forest, which gives the same sums."""
    if not isinstance(model, BoostedTrees) or sum(len(tree.feature) for tree in model.trees) <= NODES_IN_PLAN:
        return model
    return Forest(model.base, model.trees, model.depth, model.n_features)


def unfitted(features: DataFrame, spec: FeatureSet, model_id: str) -> GlobalModel:
    """All of a model but its regressor."""
    seen = profile(features, spec)
    levels = materialize(series_levels(features), "levels")
    row = levels.agg(*[F.avg(c).alias(c) for c in LEVELS]).first()
    return GlobalModel(model_id, spec, levels, {c: row[c] or 0.0 for c in LEVELS}, seen.columns, seen.scaling)


def fit_global(features: DataFrame, spec: FeatureSet, estimator: Estimator, model_id: str) -> GlobalModel:
    """Fit one regressor on all series; constant predictors dropped, index and year scaled on train."""
    model = unfitted(features, spec, model_id)
    model.regressor = _walkable(estimator.fit(model.vectors(features).select("value", "features")))
    return model


def score_rows(model: GlobalModel, features: DataFrame) -> DataFrame:
    """Predictions on rows whose predictors are already known."""
    return model.predict(features).select(
        "id", "date", F.lit(model.model_id).alias("model_id"), "prediction"
    )


# --- forecasting --------------------------------------------------------------


def series_tails(train: DataFrame, length: int) -> DataFrame:
    """One row per id: last date and the newest values, newest first, so ``tail[k-1]`` is lag k."""
    ranked = train.select("id", "date", "value", F.row_number().over(by_time(newest_first=True)).alias("_rn"))
    recent = F.sort_array(F.collect_list(F.struct("_rn", "value")))
    return (
        ranked.filter(F.col("_rn") <= length)
        .groupBy("id")
        .agg(F.max("date").alias("last_date"), F.transform(recent, lambda p: p["value"]).alias("tail"))
    )


def _roll(tail: Column) -> Column:
    """Mean of the lagged window, over as much of it as the tail holds."""
    window = F.slice(tail, F.lit(ROLL_SOURCE_LAG), F.lit(ROLL_PERIOD))
    return F.aggregate(window, F.lit(0.0), lambda s, v: s + v) / F.size(window)


def _tail_predictors(model: GlobalModel, tail: Column) -> Column:
    """The lag and rolling predictors of one step, as expressions over the tail."""
    spec = model.spec
    lags = [k for k in spec.lag_numbers if f"value_lag{k}" in model.columns]
    values = F.slice(tail, 1, spec.lags) if len(lags) == spec.lags else F.array(*[F.get(tail, F.lit(k - 1)) for k in lags])
    rolls = f"value_lag{ROLL_SOURCE_LAG}_roll_{ROLL_PERIOD}" in model.columns
    return F.concat(values, F.array(_roll(tail))) if rolls else values


def _calendar_steps(model: GlobalModel, horizon: int, freq: Freq) -> Column:
    """Scaled calendar predictors of every step ahead: an array of arrays, built once per series."""

    def one_step(j: Column) -> Column:
        exprs = _calendar_predictors(freq.add(F.col("last_date"), j))
        parts = []
        for name in model.columns:
            if name in exprs:
                mean, sd = model.scaling.get(name, (0.0, 1.0))
                parts.append((exprs[name] - F.lit(mean)) / F.lit(sd))
        return F.array(*parts) if parts else F.array().cast("array<double>")

    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), one_step)


def recursive_forecast(
    model: GlobalModel, train: DataFrame, horizon: int, freq: Freq = MONTH, steps_per_write: int = STEPS_PER_WRITE
) -> DataFrame:
    """Predict one step for every id, put it in front of the tail, repeat.

    The state is one row per id and no step shuffles. A linear model and boosted
    trees need no loop: their steps are a fold over the tail inside one projection.
    Forests chain their transforms; every few steps the state is written, so the plan
    stays short and a lost executor does not replay the whole chain. Series too
    short for the lags have no forecast (``missing_forecasts`` shows them).
    """
    spec = model.spec
    if not spec.use_lags:
        return direct_forecast(model, train, horizon, freq)
    tails = series_tails(train, spec.tail_length).filter(F.size("tail") >= spec.lags)
    state = model.with_levels(tails).withColumn("calendar", _calendar_steps(model, horizon, freq))
    if isinstance(model.regressor, LinearRegressionModel):
        done = _linear_path(model, state)
    elif isinstance(model.regressor, BoostedTrees) and not isinstance(model.regressor, Forest):
        done = _boosted_path(model, state)
    else:
        done = _chained_path(model, state, horizon, steps_per_write)
    return done.select("id", "last_date", F.posexplode("path").alias("_pos", "prediction")).select(
        "id",
        F.lit(model.model_id).alias("model_id"),
        (F.col("_pos") + 1).cast("bigint").alias("step"),
        freq.add(F.col("last_date"), F.col("_pos") + 1).alias("date"),
        "prediction",
    )


def _chained_path(model: GlobalModel, state: DataFrame, horizon: int, steps_per_write: int) -> DataFrame:
    keep = model.spec.tail_length
    assembler = VectorAssembler(inputCols=[*LEVELS, "dense"], outputCol="features")
    state = state.withColumn("path", F.array().cast("array<double>"))
    newest = F.array("prediction")
    for step in range(1, horizon + 1):
        dense = F.concat(_tail_predictors(model, F.col("tail")), F.get("calendar", F.lit(step - 1)))
        ahead = assembler.transform(state.withColumn("dense", array_to_vector(dense)))
        state = model.regressor.transform(ahead).select(
            "id", *LEVELS, "last_date", "calendar",
            F.slice(F.concat(newest, "tail"), 1, keep).alias("tail"),
            F.concat("path", newest).alias("path"),
        )
        if step % steps_per_write == 0 and step < horizon:
            state = materialize(state, "recursion")
    return state


def _boosted_path(model: GlobalModel, state: DataFrame) -> DataFrame:
    """The trees are constants of the projection; a step walks them with the tail as it stands."""
    keep = model.spec.tail_length

    def advance(acc: Column, step: Column) -> Column:
        known = F.concat(F.array(*LEVELS), _tail_predictors(model, acc["tail"]), step)
        return F.get(
            F.transform(
                F.array(model.regressor.value_of(known)),
                lambda v: F.struct(
                    F.slice(F.concat(F.array(v), acc["tail"]), 1, keep).alias("tail"), F.concat(acc["path"], F.array(v)).alias("path")
                ),
            ),
            F.lit(0),
        )

    start = F.struct(F.col("tail").alias("tail"), F.array().cast("array<double>").alias("path"))
    return state.select("id", "last_date", F.aggregate("calendar", start, advance)["path"].alias("path"))


def _linear_path(model: GlobalModel, state: DataFrame) -> DataFrame:
    """Intercept and level part from the model itself, the steps as a fold of dot products."""
    keep = model.spec.tail_length
    weights = model.regressor.coefficients.toArray()
    weights = weights[len(weights) - len(model.columns) :]
    n_tail = sum(c.startswith("value_lag") for c in model.columns)
    zeros = array_to_vector(F.array(*[F.lit(0.0)] * len(model.columns)))
    base = VectorAssembler(inputCols=[*LEVELS, "dense"], outputCol="features").transform(state.withColumn("dense", zeros))
    based = model.regressor.transform(base)

    def dot(values: Column, coefficients) -> Column:
        if not len(coefficients):
            return F.lit(0.0)
        fixed = F.array(*[F.lit(float(c)) for c in coefficients])
        return F.aggregate(F.zip_with(values, fixed, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def advance(acc: Column, step: Column) -> Column:
        value = F.col("prediction") + dot(_tail_predictors(model, acc["tail"]), weights[:n_tail]) + dot(step, weights[n_tail:])
        newest = F.array(value)
        return F.struct(
            F.slice(F.concat(newest, acc["tail"]), 1, keep).alias("tail"), F.concat(acc["path"], newest).alias("path")
        )

    start = F.struct(F.col("tail").alias("tail"), F.array().cast("array<double>").alias("path"))
    return based.select("id", "last_date", F.aggregate("calendar", start, advance)["path"].alias("path"))


def future_calendar(train: DataFrame, horizon: int, freq: Freq = MONTH) -> DataFrame:
    """The next ``horizon`` periods of every id."""
    return (
        train.groupBy("id")
        .agg(F.max("date").alias("_last"))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select("id", F.col("step").cast("bigint").alias("step"), freq.add(F.col("_last"), F.col("step")).alias("date"))
    )


def direct_forecast(model: GlobalModel, train: DataFrame, horizon: int, freq: Freq = MONTH) -> DataFrame:
    """All steps at once, for feature sets without lags."""
    ahead = future_calendar(train, horizon, freq).withColumns(_calendar_predictors())
    return model.predict(ahead).select(
        "id", F.lit(model.model_id).alias("model_id"), "step", "date", "prediction"
    )


def residual_boost(
    train: DataFrame,
    base: DataFrame,
    horizon: int,
    estimator: Estimator,
    model_id: str,
    freq: Freq = MONTH,
) -> DataFrame:
    """Base forecast plus boosted calendar model of its in-sample residuals.

    ``base`` holds ``(id, step, date, prediction)`` with fitted rows at step <= 0.
    """
    spec = calendar_set()
    fitted = base.filter((F.col("step") <= 0) & F.col("prediction").isNotNull())
    residual = fitted.join(train.select("id", "date", F.col("value").alias("_y")), ["id", "date"]).select(
        "id", "date", (F.col("_y") - F.col("prediction")).alias("value")
    )
    features = materialize(feature_table(residual, spec), "residuals")
    model = fit_global(features, spec, estimator, model_id)
    extra = direct_forecast(model, train, horizon, freq).select("id", "date", F.col("prediction").alias("_extra"))
    ahead = base.filter((F.col("step") > 0) & F.col("prediction").isNotNull())
    return ahead.join(extra, ["id", "date"]).select(
        "id", F.lit(model_id).alias("model_id"), "step", "date", (F.col("prediction") + F.col("_extra")).alias("prediction")
    )


# --- tuning -------------------------------------------------------------------

# Tree depth and learning rate pairs of the tuning grid.
TUNING_GRID = (
    (1, 0.01),
    (3, 0.31622776601683794),
    (6, 0.001),
    (9, 0.0316227766016838),
    (12, 0.00316227766016838),
    (15, 0.1),
)
TUNING_TREES = 300


def space_filling(
    n: int, depths: tuple[int, int] = (1, 15), rates: tuple[float, float] = (0.001, 10**-0.5), tries: int = 200, seed: int = SEED
) -> list[tuple[int, float]]:
    """Latin hypercube of ``n`` (depth, rate) points, the rate on a log scale: of ``tries`` designs the one whose closest points are farthest apart."""
    draw = np.random.default_rng(seed)
    cells = (np.arange(n) + 0.5) / n
    designs = [np.column_stack([draw.permutation(cells), draw.permutation(cells)]) for _ in range(tries)]

    def closest(points: np.ndarray) -> float:
        gap = ((points[:, None] - points[None]) ** 2).sum(axis=2)
        return gap[~np.eye(len(points), dtype=bool)].min() if n > 1 else 0.0

    best = max(designs, key=closest)
    low, high = np.log10(rates[0]), np.log10(rates[1])
    points = [(int(round(depths[0] + a * (depths[1] - depths[0]))), float(10 ** (low + b * (high - low)))) for a, b in best]
    return sorted(points)


@dataclass(frozen=True)
class _Slices:
    """What does not depend on a grid point, worked out once a slice: binned training and test rows, the cuts of a first tree."""

    cuts: list
    binned: list[Binned]
    tests: list[DataFrame]
    firsts: list[dict[int, Cut] | None]  # none where a task grows the whole ensemble

    @staticmethod
    def of(features: DataFrame, plan: DataFrame, spec: FeatureSet, depth: int, parallelism: int) -> "_Slices":
        cuts = plan.orderBy("slice_id").collect()

        def begun(cut) -> tuple[Binned, DataFrame, dict[int, Cut]]:
            train, test = (features.filter(F.col("date").between(F.lit(cut[f"{part}_start"]), F.lit(cut[f"{part}_end"]))) for part in ("train", "test"))
            blank, learner = unfitted(train, spec, "tuning"), leaf_boosting(depth=depth)
            binned = learner.prepare(blank.vectors(train).select("value", "features"))
            paired = blank.vectors(test).select("id", "date", "features").join(test.select("id", "date", "value"), ["id", "date"])
            return binned, materialize(binned.pack(paired), "tuning_test"), None if learner.in_one_task(binned) else learner.first_cuts(binned)

        ready = side_by_side(begun, cuts, parallelism)
        return _Slices(cuts, *(list(part) for part in (zip(*ready) if ready else ([], [], []))))

    def scores(self, points: Sequence[tuple[int, tuple[int, float]]], trees: int, parallelism: int) -> DataFrame:
        """Scores of numbered grid points on every slice; the points of a slice are judged in one pass over its test rows."""
        tasks = [(at, depth, rate) for at in range(len(self.cuts)) for _, (depth, rate) in points]

        def fit(task: tuple[int, int, float]) -> BoostedTrees:
            at, depth, rate = task
            return leaf_boosting(trees, rate, depth).fit_binned(self.binned[at], self.firsts[at])

        if None in self.firsts:  # a fit is a task then, and every core may have one
            parallelism = max(parallelism, self.tests[0].sparkSession.sparkContext.defaultParallelism)
        fitted = side_by_side(fit, tasks, parallelism)
        about = [
            F.struct(F.lit(f"config_{i}").alias("config"), F.lit(depth).cast("bigint").alias("tree_depth"), F.lit(float(rate)).alias("learn_rate"))
            for i, (depth, rate) in points
        ]

        def judged(at: int) -> DataFrame:
            errors = block_errors(fitted[at * len(points) : (at + 1) * len(points)], self.tests[at], self.binned[at])
            mean = lambda c: F.try_divide(F.sum(c), F.sum("n"))
            scored = errors.groupBy("model").agg(mean("absolute").alias("mae"), F.sqrt(mean("squared")).alias("rmse"))
            return scored.withColumn("point", F.get(F.array(*about), F.col("model"))).select(
                "point.*", F.lit(self.cuts[at]["slice_id"]).cast("bigint").alias("slice_id"), "mae", "rmse"
            )

        return reduce(DataFrame.unionByName, map(judged, range(len(self.cuts))))


def tune_grid(
    features: DataFrame,
    plan: DataFrame,
    spec: FeatureSet,
    grid: Sequence[tuple[int, float]] = TUNING_GRID,
    trees: int = TUNING_TREES,
    parallelism: int = 4,
) -> DataFrame:
    """Rolling-origin scores of every grid point: ``(config, tree_depth, learn_rate, slice_id, mae, rmse)``.

    ``features`` is read a few times per slice, so pass a written table. A few fits run
    side by side on the cluster; scores stay distributed until the last row.
    """
    slices = _Slices.of(features, plan, spec, max(depth for depth, _ in grid), parallelism)
    return slices.scores(list(enumerate(grid, 1)), trees, parallelism)


def tune_halving(
    features: DataFrame,
    plan: DataFrame,
    spec: FeatureSet,
    grid: Sequence[tuple[int, float]] = TUNING_GRID,
    trees: int = TUNING_TREES,
    share: int = 3,
    parallelism: int = 4,
) -> DataFrame:
    """Successive halving: all points with few trees, the best of them with ``share`` times as many, until one round has ``trees``.

    Rows as of :func:`tune_grid`, with ``round`` and ``trees``; points are judged by their mean RMSE over
    the slices. The last round holds the finalists at full size.
    """
    slices = _Slices.of(features, plan, spec, max(depth for depth, _ in grid), parallelism)
    open_ = list(enumerate(grid, 1))
    rounds = max(1, math.ceil(math.log(len(open_), share)) if len(open_) > 1 else 1)
    parts = []
    for number in range(rounds):
        budget = max(1, trees // share ** (rounds - 1 - number))
        scored = slices.scores(open_, budget, parallelism)
        scored = materialize(scored.withColumns({"round": F.lit(number + 1).cast("bigint"), "trees": F.lit(budget).cast("bigint")}), "halving")
        parts.append(scored)
        order = [r["config"] for r in scored.groupBy("config").agg(F.avg("rmse").alias("mean")).orderBy("mean", "config").collect()]
        kept = set(order[: max(1, math.ceil(len(open_) / share))])
        open_ = [(i, point) for i, point in open_ if f"config_{i}" in kept]
    return reduce(DataFrame.unionByName, parts)


def tune_metrics(per_slice: DataFrame, params: Sequence[str] = ("tree_depth", "learn_rate")) -> DataFrame:
    """Mean, count and standard error per grid point and metric."""
    return metric_summary(per_slice, ["config", *params])


def show_best(metrics: DataFrame, metric: str = "rmse", n: int = 5) -> DataFrame:
    """The n best grid points."""
    return metrics.filter(F.col("metric") == metric).orderBy("mean", "config").limit(n)


def select_best(metrics: DataFrame, metric: str = "rmse", params: Sequence[str] = ("tree_depth", "learn_rate")) -> DataFrame:
    """The best grid point."""
    return show_best(metrics, metric, 1).select(*params, "config")


def finalize_and_fit(
    features: DataFrame, best: DataFrame, spec: FeatureSet, trees: int = TUNING_TREES, model_id: str = "leaf_boosting_tuned"
) -> GlobalModel:
    """Fit on all training rows with the chosen parameters."""
    row = best.first()
    return fit_global(features, spec, leaf_boosting(trees, row["learn_rate"], row["tree_depth"]), model_id)


# --- stacking -----------------------------------------------------------------

STACK_GRID = ((0.001, 0.01, 0.1), (0.05, 0.95))
STACK_FOLDS = 4


def wide_members(forecasts: DataFrame, models: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per ``keys`` with a vector of the members' predictions; incomplete rows left out."""
    wide = forecasts.groupBy(*keys).pivot("model_id", list(models)).agg(F.first("prediction"))
    complete = wide.na.drop("any", subset=list(models))
    return complete.withColumn("features", array_to_vector(F.array(*[F.col(f"`{m}`") for m in models])))


def time_folds(rows: DataFrame, blocks: int = STACK_FOLDS) -> DataFrame:
    """Adds ``fold`` (from 0): the slice of a row, or its block of consecutive dates where all rows are of one slice.

    Rows of one date never lie in two folds of the same slice. The slices and dates collected are bounded by the calendar.
    """
    slices = sorted(r["slice_id"] for r in rows.select("slice_id").distinct().collect())
    if len(slices) > 1:
        return rows.withColumn("fold", F.array_position(F.array(*map(F.lit, slices)), F.col("slice_id")).cast("int") - 1)
    dates = sorted(r["date"] for r in rows.select("date").distinct().collect())
    blocks = max(2, min(blocks, len(dates)))
    starts = [dates[len(dates) * i // blocks] for i in range(1, blocks)]
    return rows.withColumn("fold", sum((F.col("date") >= F.lit(d)).cast("int") for d in starts))


def fit_stack(out_of_sample: DataFrame, models: Sequence[str], folds: int = STACK_FOLDS):
    """Elastic-net meta model on out-of-sample member predictions ``(slice_id, id, date, model_id, prediction, actual)``.

    Its penalty is chosen by leaving out one block of time after another, so no row is judged by a fit that saw its slice.
    """
    wide = wide_members(out_of_sample, models, ["slice_id", "id", "date", "actual"])
    rows = materialize(time_folds(wide, folds).select("features", F.col("actual").alias("value"), "fold"), "stack_rows")
    n_folds = (rows.agg(F.max("fold")).first()[0] or 0) + 1
    base = LinearRegression(featuresCol="features", labelCol="value")
    grid = ParamGridBuilder().addGrid(base.regParam, STACK_GRID[0]).addGrid(base.elasticNetParam, STACK_GRID[1]).build()
    judge = RegressionEvaluator(labelCol="value", metricName="rmse")
    tuner = CrossValidator(estimator=base, estimatorParamMaps=grid, evaluator=judge, numFolds=n_folds, foldCol="fold", parallelism=4)
    return tuner.fit(rows).bestModel


def stacked_forecast(meta, forecasts: DataFrame, models: Sequence[str], model_id: str = "ensemble_stacked") -> DataFrame:
    """Meta model over the members' forecasts."""
    wide = wide_members(forecasts, models, ["id", "date"])
    return meta.transform(wide).select("id", "date", F.lit(model_id).alias("model_id"), "prediction")
