"""Text rules: first-match classification, labels, recoding, unique names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Category rules for production series, first match wins.
PRODUCTION_RULES = (
    ("Coal|Oil|Gas|Nuclear", "Fossil Fuels Production"),
    ("Geo|Hydro|Solar|Wind|Biomass", "Renewable Energy Production"),
)

# Name patterns of the model families, case-sensitive.
FAMILY_PATTERNS = {
    "ml": "GLMNET|XGBOOST|LIGHTGBM|RANDOMFOREST|KERNLAB",
    "classical": "SNAIVE|WINDOW|ETS|TBATS|ARIMA|NNETAR|NNAR|SEASONAL DECOMP",
    "deep": "DEEPAR|DEEPSTATE|GP",
}

# Families that cannot be refitted on rolling slices, any case.
UNSTACKABLE_PATTERN = "DEEPAR|DEEPSTATE|GP FORECASTER"


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Substring regex test."""
    return text.rlike(f"(?i){pattern}" if ignore_case else pattern)


def classify(text: Column, rules: Sequence[tuple[str, str]], other: str = "Other") -> Column:
    """Label of the first rule whose pattern occurs in ``text``."""
    ordered = [(matches(text, pattern), F.lit(label)) for pattern, label in rules]
    chain = reduce(lambda acc, r: acc.when(*r), ordered[1:], F.when(*ordered[0]))
    return chain.otherwise(F.lit(other))


def recode(col: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep the rest."""
    pairs = [(col == k, F.lit(v)) for k, v in mapping.items()]
    chain = reduce(lambda acc, p: acc.when(*p), pairs[1:], F.when(*pairs[0]))
    return chain.otherwise(col)


def numbered_label(desc: Column, number: Column) -> Column:
    """``desc [number]``."""
    return F.concat(desc, F.lit(" ["), number.cast("string"), F.lit("]"))


def with_unique_label(df: DataFrame, source: str, target: str, order_by: Sequence[Column]) -> DataFrame:
    """Second and later rows of a repeated label get ``.1``, ``.2``, …

    For leaderboards: one row per model, so the rows behind a label are few.
    """
    nth = F.row_number().over(Window.partitionBy(source).orderBy(*order_by)) - 1
    return df.withColumn(
        target, F.when(nth == 0, F.col(source)).otherwise(F.concat(source, F.lit("."), nth.cast("string")))
    )
