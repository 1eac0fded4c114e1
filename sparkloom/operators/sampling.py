"""Sampling towards the decision boundary; samples depend on keys, never on partitioning."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.text import free_name, stable_bucket

BUCKETS = 1_000_000


def unit_hash(key: str = "queryId", seed: str = "42") -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return stable_bucket(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), BUCKETS) / float(BUCKETS)


def hash_sample(df: DataFrame, fraction: float, key: str = "queryId", seed: str = "42") -> DataFrame:
    """The rows whose key falls below the fraction."""
    return df.where(unit_hash(key, seed) < fraction)


def with_distance(df: DataFrame, cpu_seconds: float = 300.0, memory_gb: float = 10.0) -> DataFrame:
    """df with cpu_distance, memory_distance and the lesser of them, boundary_distance."""
    relative = lambda c, t: F.abs(F.col(c) - F.lit(float(t))) / F.lit(float(t))
    df = df.withColumns({"cpu_distance": relative("cpu_time_seconds", cpu_seconds), "memory_distance": relative("memory_gb", memory_gb)})
    return df.withColumn("boundary_distance", F.least("cpu_distance", "memory_distance"))


def with_probability(df: DataFrame, guarantee: float = 0.5, boost: float = 2.0, least: float = 0.05) -> DataFrame:
    """df with sampling_probability: 1 close to the boundary, then falling from boost to least."""
    d = F.col("boundary_distance")
    falling = boost - (boost - least) * F.least(d, F.lit(1.0))
    return df.withColumn("sampling_probability", F.when(d < guarantee, 1.0).otherwise(falling))


def class_counts(df: DataFrame, label: str = "is_heavy") -> tuple[int, int]:
    """(heavy, small) in one pass."""
    row = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    return row[0], row[1]


def boundary_sample(df: DataFrame, ratio: float = 5.0, label: str = "is_heavy", honour_guarantee: bool = False, **options) -> DataFrame:
    """All heavy rows, and small rows kept with probability * base fraction.

    honour_guarantee keeps every small row within the guaranteed distance, whatever the fraction.
    """
    heavy, small = class_counts(df, label)
    fraction = int(heavy * ratio) / small if small else 1.0
    rows = with_probability(with_distance(df.where(F.col(label) == 0)), **options)
    probability = F.col("sampling_probability") * fraction
    if honour_guarantee:
        probability = F.when(F.col("sampling_probability") == 1.0, 1.0).otherwise(probability)
    kept = rows.where(unit_hash() <= probability).select(*df.columns)
    return df.where(F.col(label) == 1).unionByName(kept, allowMissingColumns=True)


def adjust(all_small: DataFrame, sampled: DataFrame, target: int, tolerance: float = 0.05) -> DataFrame:
    """The sample brought near its target: rows are added from the remainder, or dropped, by hash."""
    current = sampled.count()
    difference = target - current
    if target <= 0 or abs(difference) < target * tolerance:
        return sampled
    if abs(difference) > 0.2 * target:
        logging.getLogger(__name__).warning("the sample is adjusted by %.1f %% of its target", 100 * abs(difference) / target)
    if difference > 0:
        rest = all_small.join(sampled.select("queryId"), "queryId", "left_anti")
        left = rest.count()
        more = hash_sample(rest, min(difference / left, 1.0) if left else 0.0, seed="43")
        return sampled.unionByName(more, allowMissingColumns=True)
    return hash_sample(sampled, target / current, seed="44")


def exact_ratio_sample(df: DataFrame, ratio: float = 5.0, label: str = "is_heavy", **options) -> DataFrame:
    """All heavy rows and exactly int(heavy * ratio) small ones (or all, where there are fewer).

    Small rows are taken by ascending hash / probability. A first pass over a histogram of the
    hashes (a bounded number of buckets) finds the bucket in which the last row lies, and only
    that bucket's rows are ranked, so no task orders the whole class.
    """
    heavy, _ = class_counts(df, label)
    target = int(heavy * ratio)
    rows = with_probability(with_distance(df.where(F.col(label) == 0)), **options)
    weight = unit_hash() / F.greatest(F.col("sampling_probability"), F.lit(1e-9))
    own, bucket, rank = (free_name(rows.columns, n) for n in ("_weight", "_bucket", "_rank"))
    rows = rows.withColumn(own, weight).withColumn(bucket, F.least(F.floor(F.col(own) * 10_000), F.lit(1_000_000)))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    histogram = rows.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    reached = histogram.select("bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    last = reached.where(f"before < {target} and before + n >= {target}").first()
    small = rows.where(F.lit(True)) if last is None and target > 0 else rows.where(F.lit(False))
    if last is not None:
        edge = rows.where(F.col(bucket) == last["bucket"])
        taken = edge.withColumn(rank, F.row_number().over(W.orderBy(own, "queryId"))).where(F.col(rank) <= target - last["before"]).drop(rank)
        small = rows.where(F.col(bucket) < last["bucket"]).unionByName(taken)
    return df.where(F.col(label) == 1).unionByName(small.select(*df.columns), allowMissingColumns=True)


def remainder(all_rows: DataFrame, sampled: DataFrame, key: str = "queryId") -> DataFrame:
    """The rows that a sample left out."""
    return all_rows.join(sampled.select(key), key, "left_anti")


def distance_histogram(df: DataFrame, distance: str = "boundary_distance") -> DataFrame:
    """Rows in [0, 0.2), [0.2, 0.5), [0.5, 1), [1, 2) and [2, inf), in one pass."""
    d = F.col(distance)
    bucket = F.when(d < 0.2, "0.0-0.2").when(d < 0.5, "0.2-0.5").when(d < 1.0, "0.5-1.0").when(d < 2.0, "1.0-2.0").otherwise("2.0+")
    return df.where(d.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def distance_summary(df: DataFrame, distance: str = "boundary_distance", exact: bool = False) -> DataFrame:
    """Minimum, mean, median, 90th percentile and maximum."""
    q = lambda p: quantile(distance, p, exact)
    d = F.col(distance)
    return df.agg(F.min(d).alias("d_min"), F.avg(d).alias("d_mean"), q(0.5).alias("d_p50"), q(0.9).alias("d_p90"), F.max(d).alias("d_max"))


def quantile(column: str, p: float, exact: bool = False, accuracy: int = 10_000) -> Column:
    """A value of the column: the first whose rank reaches p (exact), or one of bounded rank error."""
    if exact:
        return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)")
    return F.percentile_approx(column, p, accuracy)
