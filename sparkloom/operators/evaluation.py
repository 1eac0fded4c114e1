"""Evaluation at a threshold, threshold search, release checks."""

from __future__ import annotations

import json

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COST_FN = 100.0
COST_FP = 1.0
#: Ranges of scores that running sums are made in, one task each.
RANGES = 256
# Targets: name, comparison, value, whether missing it is critical (fixed values).
TARGETS = (
    ("recall", ">=", 0.98, True),
    ("fnr", "<=", 0.02, True),
    ("f1", ">=", 0.85, False),
    ("roc_auc", ">=", 0.90, False),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def predicted(threshold, score: str = "score") -> Column:
    """1.0 where the score reaches the threshold."""
    return F.when(F.col(score) >= threshold, 1.0).otherwise(0.0)


def confusion(df: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "is_heavy") -> DataFrame:
    """tp, fp, fn and tn in one row."""
    yes, hit = F.col(label) == 1, F.col(score) >= threshold
    return df.agg(
        F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"),
        F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn"),
    )


def derived(counts: DataFrame) -> DataFrame:
    """recall, precision, f1, fnr and fpr of confusion counts; 0 / 0 is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "recall": _ratio(tp, tp + fn), "precision": _ratio(tp, tp + fp), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "fnr": _ratio(fn, fn + tp), "fpr": _ratio(fp, fp + tn),
    })


def score_counts(df: DataFrame, score: str = "score", label: str = "is_heavy") -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def binned_scores(df: DataFrame, bins: int | None = 10_000, score: str = "score", label: str = "is_heavy") -> DataFrame:
    """As score_counts over scores rounded down to a grid, which bounds what windows order."""
    grid = df if bins is None else df.withColumn(score, F.floor(F.col(score) * bins) / float(bins))
    return score_counts(grid, score, label)


def cumulated(counts: DataFrame, ranges: int = RANGES) -> DataFrame:
    """counts (score, pos, neg) with what lies below each score (pos_below, neg_below) and in all (pos_all, neg_all).

    A sketch cuts the scores into ranges of about equal numbers; sums run within each range, and
    a table of one row for each range gives what the ranges before it hold. So no task orders more
    than a range, however many distinct scores there are. Null scores come first, NaN last.
    """
    shares = [k / ranges for k in range(1, ranges)]
    cuts = counts.where(~F.isnan("score")).select(F.percentile_approx("score", shares, 100 * ranges)).first()[0] if shares else None
    inner = sorted({float(x) for x in cuts or [] if abs(x) != float("inf")}) or [0.0]
    bounds = [float("-inf"), *inner, float("inf")]
    value = F.col("score").cast("double")
    placed = Bucketizer(splits=bounds, inputCol="value", outputCol="bucket", handleInvalid="keep").transform(counts.withColumn("value", F.coalesce(value, F.lit(float("-inf")))))
    placed = placed.select("score", "pos", "neg", F.col("bucket").cast("int").alias("bucket"))
    before, whole = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    sums = placed.groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))  # a row for each range
    sums = sums.select(
        "bucket", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"),
        F.sum("p").over(whole).alias("pos_all"), F.sum("n").over(whole).alias("neg_all"),
    )
    inside = W.partitionBy("bucket").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    below = lambda c, start: (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(start)).alias(f"{c}_below")
    return placed.join(F.broadcast(sums), "bucket").select("score", "pos", "neg", below("pos", "p"), below("neg", "n"), "pos_all", "neg_all")


def roc_auc(df: DataFrame, score: str = "score", label: str = "is_heavy", bins: int | None = None) -> DataFrame:
    """The probability that a positive outranks a negative, ties counting half."""
    counts = cumulated(binned_scores(df, bins, score, label))
    ranked = counts.select("pos", "neg", (F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("wins"))
    return ranked.agg(_ratio(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def pr_auc(df: DataFrame, score: str = "score", label: str = "is_heavy", bins: int | None = None) -> DataFrame:
    """Average precision: the precision at each distinct score, weighted by the positives it brings."""
    counts = cumulated(binned_scores(df, bins, score, label))
    hits, false = F.col("pos_all") - F.col("pos_below"), F.col("neg_all") - F.col("neg_below")
    return counts.agg(F.coalesce(F.sum(F.col("pos") * _ratio(hits, hits + false)) / F.nullif(F.sum("pos"), F.lit(0)), F.lit(0.0)).alias("pr_auc"))


def sweep(df: DataFrame, cost_fn: float = COST_FN, cost_fp: float = COST_FP, score: str = "score", label: str = "is_heavy", bins: int | None = None) -> DataFrame:
    """(threshold, fn, fp, cost) at every distinct score."""
    counts = cumulated(binned_scores(df, bins, score, label))
    table = counts.select(F.col("score").alias("threshold"), F.col("pos_below").alias("fn"), (F.col("neg_all") - F.col("neg_below")).alias("fp"))
    return table.withColumn("cost", F.col("fn") * F.lit(cost_fn) + F.col("fp") * F.lit(cost_fp))


def best_threshold(df: DataFrame, **options) -> DataFrame:
    """The cheapest threshold of the sweep, the lowest of equals."""
    return sweep(df, **options).orderBy("cost", "threshold").limit(1)


def grid(df: DataFrame, low: int = 10, high: int = 88, step: int = 2, cost_fn: float = COST_FN, cost_fp: float = COST_FP, score: str = "score", label: str = "is_heavy") -> DataFrame:
    """(threshold, tp, fp, fn, cost) at each grid point (in hundredths), in one pass over the scores.

    A score is counted at the last grid point that it reaches; running sums do the rest.
    """
    spark = df.sparkSession
    yes, slot = F.col(label) == 1, F.floor((F.col(score) * 100 - low) / step + F.lit(1e-9))
    last = (high - low) // step
    counts = df.groupBy(F.greatest(F.lit(-1), F.least(slot, F.lit(last))).cast("int").alias("k")).agg(F.count_if(yes).alias("pos"), F.count_if(~yes).alias("neg"))
    points = spark.range(-1, last + 1).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left").na.fill(0, ["pos", "neg"])
    upper = W.orderBy("k").rowsBetween(W.currentRow, W.unboundedFollowing)  # a row for each grid point
    lower = W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    table = points.select("k", F.sum("pos").over(upper).alias("tp"), F.sum("neg").over(upper).alias("fp"), F.coalesce(F.sum("pos").over(lower), F.lit(0)).alias("fn"))
    threshold = ((F.col("k") * step + low) / 100.0).alias("threshold")
    return table.where("k >= 0").select(threshold, "tp", "fp", "fn", (F.col("fn") * F.lit(cost_fn) + F.col("fp") * F.lit(cost_fp)).alias("cost"))


def sensitivity(points: DataFrame, around: float, width: float = 0.05) -> DataFrame:
    """The grid points within a width of a threshold, with the cost relative to the cheapest."""
    near = points.where(F.abs(F.col("threshold") - around) <= width + 1e-9)
    return near.withColumn("relative_cost", _ratio(F.col("cost"), F.min("cost").over(W.partitionBy())))  # a few rows


def nearest(points: DataFrame, to: float = 0.5) -> DataFrame:
    """The grid point nearest to a threshold, the lower of two."""
    return points.orderBy(F.abs(F.col("threshold") - to), "threshold").limit(1)


def evaluate(df: DataFrame, threshold: float, **options) -> DataFrame:
    """Confusion counts, derived metrics and AUC in one row."""
    return derived(confusion(df, threshold, **options)).crossJoin(roc_auc(df, **options))  # one row each


def compliance(metrics: DataFrame, targets=TARGETS) -> DataFrame:
    """(requirement, target, actual, critical, status) for each target; a metric that is missing fails.

    Missing a critical target is FAILED, another one WARNING.
    """
    spark = metrics.sparkSession
    rules = spark.createDataFrame([(n, c, float(v), k) for n, c, v, k in targets], "requirement string, comparison string, target double, critical boolean")
    known = [n for n, *_ in targets if n in metrics.columns]
    actual = F.coalesce(*[F.when(F.col("requirement") == n, F.col(n).cast("double")) for n in known]) if known else F.lit(None).cast("double")
    met = F.when(F.col("comparison") == ">=", F.col("actual") >= F.col("target")).otherwise(F.col("actual") <= F.col("target"))
    status = F.when(met, "PASSED").when(F.col("critical"), "FAILED").otherwise("WARNING")
    return rules.crossJoin(metrics.limit(1)).select("requirement", "comparison", "target", actual.alias("actual"), "critical").withColumn("status", status)


def overall_status(checks: DataFrame, strict: bool = True) -> str:
    """FAILED, WARNING or PASSED, whichever is worst; unless strict, targets that are not critical may be missed."""
    seen = {r[0] for r in checks.select("status").distinct().collect()}
    return next((s for s in (("FAILED", "WARNING") if strict else ("FAILED",)) if s in seen), "PASSED")


def compliance_report(checks: DataFrame, form: str = "text", strict: bool = True) -> str:
    """The checks as text or JSON."""
    rows = [r.asDict() for r in checks.orderBy("requirement").collect()]
    if form == "json":
        return json.dumps({"overall": overall_status(checks, strict), "checks": rows}, sort_keys=True)
    shown = lambda v: "missing" if v is None else f"{v:.4f}"
    return "\n".join([f"overall: {overall_status(checks, strict)}", *[f"{r['status']:8} {r['requirement']} {r['comparison']} {r['target']:.4f}: {shown(r['actual'])}" for r in rows]])


def require_release(checks: DataFrame) -> None:
    """An error where a critical target is missed."""
    failed = [r[0] for r in checks.where("critical and status = 'FAILED'").select("requirement").collect()]
    if failed:
        raise ValueError(f"critical targets are missed: {sorted(failed)}")


def distribution_guard(train: DataFrame, val: DataFrame, expected: float = 36.0, tolerance: float = 10.0, least_gap: float = 1.0) -> dict:
    """Small-to-heavy ratios of two splits; an error where validation looks sampled like training."""
    from sparkloom.operators.analysis import quick_stats

    ratios = {n: quick_stats(df).first()["small_to_heavy"] for n, df in (("train", train), ("val", val))}
    if abs(ratios["val"] - ratios["train"]) < least_gap:
        raise ValueError(f"validation has the ratio of the sampled training split: {ratios}")
    return ratios | {"warning": abs(ratios["val"] - expected) > tolerance}
