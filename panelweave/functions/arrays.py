"""Small linear algebra over array columns, evaluated row by row in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(values: Sequence[float] = ()) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values).cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def upto(first: Column, last: Column) -> Column:
    """The integers from ``first`` to ``last``; none if there are none."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def lagged_difference(values: Column, lag: int) -> Column:
    """Each value minus the one ``lag`` places before it."""
    n = F.greatest(F.size(values) - lag, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(lag + 1), n), F.slice(values, F.lit(1), n), lambda a, b: a - b)


def outer_sums(rows: Column, row: Callable[[Column], Column], width: int) -> Column:
    """Sums of all products of two entries of ``row(t)`` over ``rows``, flattened row by row."""

    def add(acc: Column, t: Column) -> Column:
        products = lambda x: F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
        return bind(row(t), lambda x: F.zip_with(acc, products(x), lambda s, v: s + v))

    return F.aggregate(rows, F.array_repeat(F.lit(0.0), width * width), add)


def normal_equations(sums: Column, width: int) -> Column:
    """Rows ``[x'x | x'y]`` from the outer sums of ``[x, y]``."""
    rows = F.sequence(F.lit(0), F.lit(width - 2))
    return bind(sums, lambda flat: F.transform(rows, lambda i: F.slice(flat, i * width + 1, F.lit(width))))


def restricted(equations: Column, keep: Column) -> Column:
    """Normal equations of the predictors kept (1) only; the coefficients of the others come out as 0."""


    def kept(used: Column) -> Column:
        def row(line: Column, i: Column) -> Column:
            own = F.transform(line, lambda v, j: F.when(F.coalesce(F.get(used, j), F.lit(1)) == 1, v).otherwise(F.lit(0.0)))
            unit = F.transform(line, lambda v, j: F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0)))
            return F.when(F.get(used, i) == 1, own).otherwise(unit)

        return F.transform(equations, row)

    return bind(keep, kept)


def solve(equations: Column, unknowns: int) -> Column:
    """The solution of symmetric positive equations ``[a | b]`` by elimination; null entries if they are singular."""

    def eliminate(rows: Column, k: Column) -> Column:
        head = F.get(F.get(rows, k), k)
        scaled = F.transform(F.get(rows, k), lambda v: F.when(F.abs(head) > 1e-12, v / head))

        def each(pivot: Column) -> Column:
            return F.transform(
                rows,
                lambda line, i: F.when(i == k, pivot).otherwise(F.zip_with(line, pivot, lambda a, b: a - F.get(line, k) * b)),
            )

        return bind(scaled, each)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(unknowns - 1)), equations, eliminate)
    return F.transform(done, lambda line: F.get(line, F.lit(unknowns)))


def stationary(coefficients: Column) -> Column:
    """Whether the autoregression with these coefficients dies out: all its partial autocorrelations lie within one."""

    def down(state: Column, k: Column) -> Column:
        last = F.get(state["a"], k - 1)
        rest = F.slice(state["a"], F.lit(1), k - 1)
        lower = F.zip_with(rest, F.reverse(rest), lambda a, b: F.try_divide(a + last * b, 1.0 - last * last))
        return F.struct((state["ok"] & (F.abs(last) < 1.0)).alias("ok"), lower.alias("a"))

    def fold(a: Column) -> Column:
        start = F.struct(F.lit(True).alias("ok"), a.alias("a"))
        steps = F.when(F.size(a) > 0, F.sequence(F.size(a), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.aggregate(steps, start, down)["ok"], F.lit(False))

    return bind(coefficients, fold)
