"""Labelling, filtering, deduplication, splits and request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.text import free_name
from sparkloom.functions.text import strip as strip_text

CPU_SECONDS = 300.0
MEMORY_GB = 10.0
HEAVY_ERRORS = ("EXCEEDED_TIME_LIMIT", "EXCEEDED_SCAN_LIMIT", "EXCEEDED_CPU_LIMIT")
EXCLUDED_TYPES = ("DATA_DEFINITION", "DESCRIBE", "EXPLAIN")
GIB = float(1024**3)


def with_labels(
    df: DataFrame, cpu_seconds: float | None = None, memory_gb: float | None = None, errors: tuple[str, ...] | None = None
) -> DataFrame:
    """df with cpu_time_seconds, memory_gb and is_heavy.

    Missing counters are 0. Heavy: CPU at or above its threshold, memory above its threshold, or
    one of the errors. Thresholds of None take the defaults; a threshold of 0 is 0.
    """
    cpu_limit = CPU_SECONDS if cpu_seconds is None else cpu_seconds
    memory_limit = MEMORY_GB if memory_gb is None else memory_gb
    errors = HEAVY_ERRORS if errors is None else errors
    cpu = F.coalesce(F.col("cpuTime") / F.lit(1000.0), F.lit(0.0))
    memory = F.coalesce(F.col("peakUserMemoryBytes") / F.lit(GIB), F.lit(0.0))
    heavy = (cpu >= cpu_limit) | (memory > memory_limit) | F.coalesce(F.col("errorName").isin(*errors), F.lit(False))
    return df.withColumns({"cpu_time_seconds": cpu, "memory_gb": memory, "is_heavy": F.when(heavy, 1).otherwise(0)})


def filter_queries(
    df: DataFrame, require_non_curated: bool = True, excluded_types: tuple[str, ...] = EXCLUDED_TYPES
) -> DataFrame:
    """Rows of non-curated clients, of types that are not excluded, with a query that is not blank.

    Null clients and null types are dropped, as three-valued logic has it.
    """
    if require_non_curated:
        df = df.where(F.col("clientInfo").contains("NON-CURATED"))
    if excluded_types:
        df = df.where(~F.col("queryType").isin(*excluded_types))
    return df.where(F.length(F.trim("query")) > 0)


def first_of(df: DataFrame, key: str = "queryId", order: tuple[str, ...] = ("createTime",)) -> DataFrame:
    """The first row of each key by `order`; what is left to ties is settled by a hash of the row."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order, F.xxhash64(*df.columns)))
    name = free_name(df.columns, "_rank")
    return df.withColumn(name, rank).where(F.col(name) == 1).drop(name)


def with_date_parts(df: DataFrame) -> DataFrame:
    """df with queryDate and hour of createTime."""
    return df.withColumns({"queryDate": F.to_date("createTime"), "hour": F.hour("createTime")})


def split_column(end: Column, val_days: int = 7, test_days: int = 7, start: Column | None = None) -> Column:
    """'train', 'val' or 'test' by queryDate; null outside [start, end]. The end day belongs to test."""
    test_from = F.date_sub(end, test_days)
    val_from = F.date_sub(end, test_days + val_days)
    day = F.col("queryDate")
    inside = day <= end
    if start is not None:
        inside = inside & (day >= start)
    return F.when(inside & (day >= test_from), "test").when(inside & (day >= val_from), "val").when(inside, "train")


def time_splits(df: DataFrame, start: str, end: str, val_days: int = 7, test_days: int = 7) -> dict[str, DataFrame]:
    """The three splits of a frame with queryDate."""
    split = split_column(F.lit(end).cast("date"), val_days, test_days, F.lit(start).cast("date"))
    return {n: df.where(split == n) for n in ("train", "val", "test")}


def check_requests(df: DataFrame, max_length: int = 1_000_000) -> DataFrame:
    """df with normalised fields and the array of what is wrong with each request.

    user is lower-cased and stripped; blank catalogs and schemas become null; a missing hour is
    left null for the caller's clock. An hour of 0 stays 0.
    """
    q = F.col("query")
    problems = F.array_compact(F.array(
        F.when(q.isNull() | ~q.rlike(r"\S"), "query is blank"),
        F.when(F.length(q) > max_length, "query is too long"),
        F.when(~F.col("hour").between(0, 23), "hour is out of range"),
        F.when(F.length("clientInfo") > 500, "clientInfo is too long"),
    ))
    strip = lambda c: strip_text(F.col(c))
    return df.withColumns({
        "user": F.lower(strip("user")),
        "catalog": F.when(F.col("catalog") != "", strip("catalog")),
        "schema": F.when(F.col("schema") != "", strip("schema")),
        "clientInfo": strip("clientInfo"),
        "problems": problems,
    })


def check_session_properties(column: str = "sessionProperties") -> Column:
    """What is wrong with a map<string,string> of session properties; null where nothing is."""
    pairs = F.map_entries(F.coalesce(F.col(column), F.create_map().cast("map<string,string>")))
    size = F.aggregate(pairs, F.lit(0), lambda a, e: a + F.length(e["key"]) + F.coalesce(F.length(e["value"]), F.lit(4)) + 8)
    return F.when(F.exists(pairs, lambda e: F.length(e["key"]) > 100), "property key is too long").when(size > 10_000, "properties are too large")
