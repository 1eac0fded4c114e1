"""Comparison of feature vectors that two paths gave for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6
#: The share of rows (percent) that may differ.
ALLOWED_PERCENT = 0.5
STRUCTURE_RANGE = (45, 54)


def _away(a: Column, b: Column, tolerance: float) -> Column:
    bad = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b) | (F.abs(a - b) > tolerance)
    return F.coalesce(bad, F.lit(True))


def mismatches(left: str, right: str, tolerance: float = TOLERANCE) -> Column:
    """array<boolean>: which elements differ; NaN, null and a missing element do."""
    return F.zip_with(left, right, lambda a, b: _away(a.cast("double"), b.cast("double"), tolerance))


def masked(column: str, first: int = STRUCTURE_RANGE[0], last: int = STRUCTURE_RANGE[1]) -> Column:
    """The vector with the elements first to last set to zero."""
    return F.transform(column, lambda x, i: F.when(i.between(first, last), 0.0).otherwise(x))


def row_parity(df: DataFrame, key: str, left: str, right: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, n_mismatch, max_diff, mismatch) of each row."""
    largest = F.coalesce(F.array_max(F.zip_with(left, right, lambda a, b: F.abs(a - b))), F.lit(0.0))
    count = F.size(F.filter(mismatches(left, right, tolerance), lambda x: x))
    return df.select(key, count.alias("n_mismatch"), largest.alias("max_diff"), (count > 0).alias("mismatch"))


def parity(df: DataFrame, left: str, right: str, tolerance: float = TOLERANCE, allowed: float = ALLOWED_PERCENT) -> DataFrame:
    """One row: rows compared, rows that differ, their share, the largest difference, whether it passes."""
    bad = F.exists(mismatches(left, right, tolerance), lambda x: x)
    largest = F.array_max(F.zip_with(left, right, lambda a, b: F.abs(a - b)))
    total, wrong = F.count(F.lit(1)), F.count_if(bad)
    percent = F.coalesce(F.try_divide(wrong * 100.0, total.cast("double")), F.lit(0.0))
    return df.agg(total.alias("rows"), wrong.alias("mismatched_rows"), percent.alias("mismatch_pct"), F.coalesce(F.max(largest), F.lit(0.0)).alias("max_diff"), (percent < allowed).alias("passed"))


def mismatch_by_feature(df: DataFrame, left: str, right: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(position, n) for each element that differs somewhere."""
    at = F.posexplode(mismatches(left, right, tolerance)).alias("position", "bad")
    return df.select(at).where("bad").groupBy("position").agg(F.count(F.lit(1)).alias("n"))


def group_of(position: Column) -> Column:
    """The block of the vector that a position lies in."""
    return (
        F.when(position.between(*STRUCTURE_RANGE), "structure").when(position < 78, "base")
        .when(position < 95, "historical").otherwise("tfidf")
    )


def mismatch_by_group(df: DataFrame, left: str, right: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(block, n): differing elements of each block."""
    found = mismatch_by_feature(df, left, right, tolerance)
    return found.groupBy(group_of(F.col("position")).alias("block")).agg(F.sum("n").alias("n"))


def worst_features(df: DataFrame, left: str, right: str, k: int = 10, tolerance: float = TOLERANCE) -> DataFrame:
    """The k elements that differ most often."""
    return mismatch_by_feature(df, left, right, tolerance).orderBy(F.desc("n"), "position").limit(k)


def report(summary: DataFrame) -> str:
    """A line of the summary row."""
    r = summary.first()
    return f"{'PASSED' if r['passed'] else 'FAILED'}: {r['mismatched_rows']} of {r['rows']} rows differ ({r['mismatch_pct']:.3f} %), by {r['max_diff']:.3g} at most"
