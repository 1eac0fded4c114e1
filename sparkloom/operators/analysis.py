"""Profiles of a labelled log, each in one pass over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.sampling import quantile

RESOURCE_ERRORS = (
    "EXCEEDED_TIME_LIMIT", "EXCEEDED_CPU_LIMIT", "EXCEEDED_SCAN_LIMIT", "EXCEEDED_MEMORY_LIMIT",
    "EXCEEDED_SPLIT_LIMIT", "EXCEEDED_NODE_LIMIT", "EXCEEDED_OUTPUT_SIZE_LIMIT", "EXCEEDED_OUTPUT_POSITIONS_LIMIT",
)


def _percent(part, whole):
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole.cast("double")), F.lit(0.0))


def _heavy():
    return F.count_if(F.col("is_heavy") == 1)


def basic_profile(df: DataFrame) -> DataFrame:
    """Counts, and the range and mean of CPU and memory, for the columns that are there."""
    cells = [F.count(F.lit(1)).alias("total")]
    if "is_heavy" in df.columns:
        cells += [_heavy().alias("heavy"), F.count_if(F.col("is_heavy") == 0).alias("small")]
    for column, short in (("cpu_time_seconds", "cpu"), ("memory_gb", "mem")):
        if column in df.columns:
            cells += [f(column).alias(f"{short}_{n}") for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))]
    return df.agg(*cells)


def quantile_profile(df: DataFrame, columns: tuple[str, ...] = ("cpu_time_seconds", "memory_gb"), exact: bool = False) -> DataFrame:
    """The 50th to 99th percentiles of several columns in one pass."""
    return df.agg(*[quantile(c, p / 100, exact).alias(f"{c}_p{p}") for c in columns if c in df.columns for p in (50, 75, 90, 95, 99)])


def query_types(df: DataFrame) -> DataFrame:
    """Counts of each query type, its share, and the share of its heavy queries if they are labelled."""
    kind = F.coalesce("queryType", F.lit("NULL")).alias("queryType")
    total = F.sum("total").over(W.partitionBy())  # a row for each type
    labelled = "is_heavy" in df.columns
    cells = [F.count(F.lit(1)).alias("total"), *([_heavy().alias("heavy")] if labelled else [])]
    out = df.groupBy(kind).agg(*cells).withColumn("pct", _percent(F.col("total"), total))
    return out.withColumn("heavy_pct", _percent(F.col("heavy"), F.col("total"))) if labelled else out


def resource_errors(df: DataFrame, kinds: tuple[str, ...] = RESOURCE_ERRORS) -> DataFrame:
    """Counts of each resource error, its share among them, and the share of heavy queries."""
    out = df.where(F.col("errorName").isin(*kinds)).groupBy("errorName").agg(F.count(F.lit(1)).alias("total"), _heavy().alias("heavy"))
    all_errors = F.sum("total").over(W.partitionBy())
    return out.withColumn("pct_of_errors", _percent(F.col("total"), all_errors)).withColumn("heavy_pct", _percent(F.col("heavy"), F.col("total")))


def error_rate(df: DataFrame, kinds: tuple[str, ...] = RESOURCE_ERRORS) -> DataFrame:
    """Resource errors among all queries, in percent."""
    errors, total = F.count_if(F.col("errorName").isin(*kinds)), F.count(F.lit(1))
    return df.agg(total.alias("total"), errors.alias("errors"), _percent(errors, total).alias("error_rate"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a step removed, in all and by label."""
    counted = lambda df, n: df.agg(F.count(F.lit(1)).alias(f"total_{n}"), _heavy().alias(f"heavy_{n}"), F.count_if(F.col("is_heavy") == 0).alias(f"small_{n}"))
    both = counted(before, "before").crossJoin(counted(after, "after"))  # one row each
    for kind in ("total", "heavy", "small"):
        removed = F.col(f"{kind}_before") - F.col(f"{kind}_after")
        both = both.withColumn(f"{kind}_removed", removed).withColumn(f"{kind}_removed_pct", _percent(removed, F.col(f"{kind}_before")))
    return both


def quick_stats(df: DataFrame) -> DataFrame:
    """Totals, the share of heavy queries, and small to heavy."""
    heavy, total = _heavy(), F.count(F.lit(1))
    small = F.count_if(F.col("is_heavy") == 0)
    ratio = F.coalesce(F.try_divide(small.cast("double"), heavy.cast("double")), F.lit(0.0))
    return df.agg(total.alias("total"), heavy.alias("heavy"), small.alias("small"), _percent(heavy, total).alias("heavy_pct"), ratio.alias("small_to_heavy"))


def top_types(df: DataFrame, k: int = 25) -> DataFrame:
    """The k most frequent query types."""
    return query_types(df).orderBy(F.desc("total"), "queryType").limit(k)


def heaviest_types(df: DataFrame, k: int = 25, least: int = 100) -> DataFrame:
    """The k types with the greatest share of heavy queries, of those with enough queries."""
    return query_types(df).where(F.col("total") >= least).orderBy(F.desc("heavy_pct"), "queryType").limit(k)


def top_errors(df: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent resource errors."""
    return resource_errors(df).orderBy(F.desc("total"), "errorName").limit(k)


def daily_counts(df: DataFrame, date: str = "queryDate") -> DataFrame:
    """Queries of each day, in order."""
    return df.groupBy(date).agg(F.count(F.lit(1)).alias("n")).orderBy(date)


def class_distribution(df: DataFrame) -> DataFrame:
    """Counts of each class, with the weight that balances heavy queries."""
    counts = df.groupBy("is_heavy").agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy()  # a row for each class
    of = lambda k: F.sum(F.when(F.col("is_heavy") == k, F.col("n")).otherwise(0)).over(whole)
    return counts.withColumn("scale_pos_weight", F.coalesce(F.try_divide(of(0).cast("double"), of(1).cast("double")), F.lit(1.0)))


def statement_category():
    """The first word of a query: the category that a filter before prediction works on."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract("query", r"^\s*(?:--[^\n]*\n\s*)*([A-Za-z]+)", 1)), F.lit("")), F.lit("NONE"))


def zero_cost_categories(df: DataFrame, safe_below: float = 1.0, category=None) -> DataFrame:
    """Totals and heavy rate (percent) of each category; safe where the rate is below the limit."""
    by = (statement_category() if category is None else category).alias("category")
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), _heavy().alias("heavy"))
    return out.withColumn("heavy_rate", _percent(F.col("heavy"), F.col("total"))).withColumn("safe", F.col("heavy_rate") < safe_below).orderBy("heavy_rate", "category")


def zero_cost_safety(df: DataFrame, safe: list[str], category=None) -> DataFrame:
    """Whether the safe categories hold no heavy query, and what share of all queries they cover."""
    inside = (statement_category() if category is None else category).isin(*safe)
    covered, total, heavy = F.count_if(inside), F.count(F.lit(1)), F.count_if(inside & (F.col("is_heavy") == 1))
    return df.agg(total.alias("total"), covered.alias("covered"), heavy.alias("heavy_in_safe"), _percent(covered, total).alias("coverage_pct"), (heavy == 0).alias("is_safe"))


def summary(df: DataFrame) -> dict:
    """What quick_stats says of a labelled frame, under the names that reports use."""
    row = quick_stats(df).first()
    return {
        "total_queries": row["total"], "heavy_queries": row["heavy"], "small_queries": row["small"],
        "heavy_percentage": row["heavy_pct"], "small_to_heavy_ratio": row["small_to_heavy"],
    }


def comparison_report(before: DataFrame, after: DataFrame, name: str = "step") -> str:
    """A text about what a step removed; it warns where heavy queries lose five points more than all do."""
    row = compare(before, after).first()
    lines = [f"== {name}"]
    for kind in ("total", "heavy", "small"):
        lines.append(f"{kind}: {row[f'{kind}_before']} to {row[f'{kind}_after']}, {row[f'{kind}_removed']} removed ({row[f'{kind}_removed_pct']:.1f} %)")
    if row["heavy_removed_pct"] > row["total_removed_pct"] + 5:
        lines.append("warning: heavy queries are removed out of proportion")
    balance = [f"{row[f'small_{t}'] / row[f'heavy_{t}']:.2f}" if row[f"heavy_{t}"] else "none" for t in ("before", "after")]
    return "\n".join([*lines, f"small to heavy: {balance[0]} to {balance[1]}"])


def report(df: DataFrame) -> str:
    """A text of the profiles."""
    parts = [("overview", quick_stats(df)), ("query types", top_types(df)), ("heaviest types", heaviest_types(df)), ("resource errors", top_errors(df))]
    lines = []
    for title, table in parts:
        lines.append(f"== {title}")
        lines += ["  ".join(f"{k}={round(v, 3) if isinstance(v, float) else v}" for k, v in r.asDict().items()) for r in table.collect()]
    return "\n".join(lines)
