"""Exact quantiles of groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    cuts: int = 64,
    few_groups: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``by``, without gathering a group.

    Equal values are first folded to counts on the map side. Each group is then
    cut into value ranges (bounds from a mergeable sketch, whose error only
    shifts the bounds), ranks are running counts inside a range plus the total
    of the ranges below, and only the rows holding a wanted rank go on. The
    ranks are exact. Bounds and offsets are one row per group and per range: with
    ``few_groups`` (models, say) they are broadcast, as a shuffle on such keys
    would be all skew; with many groups they are ordinary joins on spread keys.
    """
    by = list(by)
    small = F.broadcast if few_groups else (lambda table: table)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    grid = [i / cuts for i in range(1, cuts)]
    bounds = counted.groupBy(*by).agg(F.percentile_approx("_v", grid, 1000).alias("_cuts"))
    ranged = counted.join(small(bounds), by).select(
        *by, "_v", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_range")
    )
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = (
        ranged.groupBy(*by, "_range")
        .agg(F.sum("_n").alias("_in_range"))
        .select(
            *by,
            "_range",
            F.coalesce(F.sum("_in_range").over(below), F.lit(0)).alias("_offset"),
            F.sum("_in_range").over(whole).alias("_total"),
        )
    )
    running = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        ranged.join(small(offsets), [*by, "_range"])
        .withColumn("_last", F.col("_offset") + F.sum("_n").over(running) - 1)
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
    )
    picks = []
    for p, name in zip(probs, names):
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = rank.between(F.col("_first"), F.col("_last"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{side}"))
        picks.append(F.max(spot - F.floor(spot)).alias(f"_{name}_w"))
    return ranked.groupBy(*by).agg(*picks).select(
        *by,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n)
            for n in names
        ],
    )
