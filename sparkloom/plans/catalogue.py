"""The queries over the query log, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import features as feats
from sparkloom.functions import structure, text
from sparkloom.functions.registry import FeatureSpec, base_names
from sparkloom.functions.text import normalise_sql, stable_bucket
from sparkloom.operators import analysis, etl, evaluation, parity, sampling, statistics, tfidf, training
from sparkloom.plans import oracles as O
from sparkloom.plans import pipeline
from sparkloom.sources import query_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CPU, _MEM = "cpu_time_seconds", "memory_gb"


def register(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log.derive(spark, sf_dir)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.with_labels(log(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed score for each query: a hash, raised where the query is heavy."""
    score = F.least(stable_bucket(F.col("queryId"), 1000) / 1000.0 + 0.3 * F.col("is_heavy"), F.lit(1.0))
    return labelled(spark, sf_dir).select("queryId", "is_heavy", score.alias("score"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """df with doubles rounded, so the order of sums does not show."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scratch(spark: SparkSession, name: str) -> str:
    """A folder below the shared checkpoint folder; a local one only where that is unset, on one machine."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp()
    return f"{base.rstrip('/')}/sparkloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def training_days(df: DataFrame) -> DataFrame:
    """The rows of the days that come before validation and test."""
    return df.where(F.col("createTime") < F.lit("2024-01-16").cast("timestamp"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each catalog over the labelled and filtered log."""
    return rounded(statistics.catalog_stats(etl.filter_queries(labelled(spark, sf_dir))))


# --- sources, labels, filters, splits


@register(O.query("SELECT queryId, user, cpuTime FROM query_log WHERE createTime >= TIMESTAMP '2024-01-05' AND createTime < TIMESTAMP '2024-01-12'"))
def scan_range(spark, sf_dir):
    df = log(spark, sf_dir)
    at = F.col("createTime")
    return df.where((at >= F.lit("2024-01-05").cast("timestamp")) & (at < F.lit("2024-01-12").cast("timestamp"))).select("queryId", "user", "cpuTime")


@register(O.query("SELECT queryId, round(cpu_time_seconds, 6) AS cpu_time_seconds, round(memory_gb, 6) AS memory_gb, is_heavy FROM labelled"))
def label_rule(spark, sf_dir):
    return rounded(labelled(spark, sf_dir).select("queryId", _CPU, _MEM, "is_heavy"))


@register(O.query("SELECT is_heavy, count(*) AS n, round((SELECT count(*) FILTER (is_heavy = 0) / count(*) FILTER (is_heavy = 1)::DOUBLE FROM labelled), 6) AS scale_pos_weight FROM labelled GROUP BY is_heavy"))
def label_distribution(spark, sf_dir):
    return rounded(analysis.class_distribution(labelled(spark, sf_dir)))


@register(O.query("SELECT queryId, query, is_heavy FROM filtered", O.FILTERED))
def filter_chain(spark, sf_dir):
    return etl.filter_queries(labelled(spark, sf_dir)).select("queryId", "query", "is_heavy")


@register(O.query("""SELECT queryId, createTime, cpuTime FROM (SELECT *, row_number() OVER (PARTITION BY queryId ORDER BY createTime) AS r FROM
  (SELECT queryId, createTime, cpuTime FROM query_log UNION ALL SELECT queryId, createTime - INTERVAL 1 HOUR, cpuTime + 1 FROM query_log WHERE CAST(queryId AS BIGINT) % 3 = 0)) WHERE r = 1"""))
def dedup_first(spark, sf_dir):
    df = log(spark, sf_dir).select("queryId", "createTime", "cpuTime")
    copies = df.where(F.col("queryId").cast("bigint") % 3 == 0).select(
        "queryId", (F.col("createTime") - F.expr("INTERVAL 1 HOUR")).alias("createTime"), (F.col("cpuTime") + 1).alias("cpuTime")
    )
    return etl.first_of(df.unionByName(copies))


@register(O.query("""SELECT split, count(*) AS n, CAST(sum(is_heavy) AS BIGINT) AS heavy FROM (SELECT is_heavy, CASE WHEN d > DATE '2024-01-31' THEN NULL
  WHEN d >= DATE '2024-01-24' THEN 'test' WHEN d >= DATE '2024-01-17' THEN 'val' ELSE 'train' END AS split FROM (SELECT *, CAST(createTime AS DATE) AS d FROM labelled)) WHERE split IS NOT NULL GROUP BY split"""))
def time_split_counts(spark, sf_dir):
    df = etl.with_date_parts(labelled(spark, sf_dir))
    marked = df.withColumn("split", etl.split_column(F.lit("2024-01-31").cast("date")))
    return marked.where("split is not null").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("is_heavy").cast("bigint").alias("heavy"))


@register(O.query("SELECT CAST(createTime AS DATE) AS queryDate, count(*) AS n FROM query_log GROUP BY 1"))
def daily_counts(spark, sf_dir):
    return analysis.daily_counts(etl.with_date_parts(log(spark, sf_dir)))


@register(O.query("SELECT hour, count(*) AS n FROM query_log GROUP BY hour"))
def hourly_counts(spark, sf_dir):
    return etl.with_date_parts(log(spark, sf_dir)).groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


@register(O.query("SELECT queryId, query, is_heavy FROM labelled WHERE is_heavy = 1"))
def partitioned_roundtrip(spark, sf_dir):
    """Written by class and read with a filter that prunes to one folder."""
    path = scratch(spark, "by-class")
    query_log.write_partitioned(labelled(spark, sf_dir).select("queryId", "query", "is_heavy"), path)
    return spark.read.parquet(path).where("is_heavy = 1").select("queryId", "query", "is_heavy")


@register(O.query("SELECT queryId, is_heavy FROM labelled"))
def checkpoint_roundtrip(spark, sf_dir):
    store = query_log.Checkpoints(spark, scratch(spark, "checkpoints"))
    store.save(labelled(spark, sf_dir).select("queryId", "is_heavy"), "labelled", force=True)
    return store.load("labelled")


@register(O.query("SELECT queryId, query FROM query_log"))
def plain_roundtrip(spark, sf_dir):
    path = scratch(spark, "plain")
    query_log.write_plain(log(spark, sf_dir).select("queryId", "query"), path)
    return spark.read.parquet(path)


@register("SELECT 'SELECT 1' AS query, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'SELECT 2', 2")
def in_memory(spark, sf_dir):
    return spark.createDataFrame([("SELECT 1", 1), ("SELECT 2", 2)], "query string, n bigint")


@register(O.query(f"""SELECT queryId, lower({O.strip('"user"')}) AS "user", CASE WHEN catalog <> '' THEN {O.strip('catalog')} END AS catalog,
  CASE WHEN schema <> '' THEN {O.strip('schema')} END AS schema, {O.strip('clientInfo')} AS "clientInfo",
  concat_ws(', ', CASE WHEN query IS NULL OR NOT regexp_matches(query, '\\S') THEN 'query is blank' END, CASE WHEN length(query) > 1000000 THEN 'query is too long' END,
    CASE WHEN hour NOT BETWEEN 0 AND 23 THEN 'hour is out of range' END, CASE WHEN length(clientInfo) > 500 THEN 'clientInfo is too long' END) AS problems FROM query_log"""))
def validate_requests(spark, sf_dir):
    df = etl.check_requests(log(spark, sf_dir))
    return df.select("queryId", "user", "catalog", "schema", "clientInfo", F.array_join("problems", ", ").alias("problems"))


# --- sampling


@register(O.query("SELECT queryId, round(cpu_distance, 6) AS cpu_distance, round(memory_distance, 6) AS memory_distance, round(boundary_distance, 6) AS boundary_distance FROM distances", O.DISTANCES))
def boundary_distance(spark, sf_dir):
    df = sampling.with_distance(labelled(spark, sf_dir))
    return rounded(df.select("queryId", "cpu_distance", "memory_distance", "boundary_distance"))


@register(O.query("SELECT queryId, round(sampling_probability, 6) AS sampling_probability FROM probabilities", O.DISTANCES, O.PROBABILITIES))
def sampling_prob(spark, sf_dir):
    return rounded(sampling.with_probability(sampling.with_distance(labelled(spark, sf_dir))).select("queryId", "sampling_probability"))


@register(O.query("""SELECT CASE WHEN boundary_distance < 0.2 THEN '0.0-0.2' WHEN boundary_distance < 0.5 THEN '0.2-0.5' WHEN boundary_distance < 1 THEN '0.5-1.0'
  WHEN boundary_distance < 2 THEN '1.0-2.0' ELSE '2.0+' END AS bucket, count(*) AS n FROM distances GROUP BY 1""", O.DISTANCES))
def distance_histogram(spark, sf_dir):
    return sampling.distance_histogram(sampling.with_distance(labelled(spark, sf_dir)))


@register(O.query("""SELECT round(min(boundary_distance), 6) AS d_min, round(avg(boundary_distance), 6) AS d_mean, round(quantile_disc(boundary_distance, 0.5), 6) AS d_p50,
  round(quantile_disc(boundary_distance, 0.9), 6) AS d_p90, round(max(boundary_distance), 6) AS d_max FROM distances""", O.DISTANCES))
def distance_summary(spark, sf_dir):
    return rounded(sampling.distance_summary(sampling.with_distance(labelled(spark, sf_dir)), exact=True))


_SAMPLED = f"""counts AS (SELECT count(*) FILTER (is_heavy = 1) AS h, count(*) FILTER (is_heavy = 0) AS s FROM labelled),
sampled AS (SELECT queryId, is_heavy FROM labelled WHERE is_heavy = 1 UNION ALL SELECT queryId, is_heavy FROM probabilities, counts
  WHERE is_heavy = 0 AND {O.UNIT} <= sampling_probability * (CAST(floor(h * 5.0) AS BIGINT) / s::DOUBLE))"""


@register(O.query("SELECT queryId, is_heavy FROM sampled", O.DISTANCES, O.PROBABILITIES, _SAMPLED))
def hash_sample(spark, sf_dir):
    return sampling.boundary_sample(labelled(spark, sf_dir)).select("queryId", "is_heavy")


@register(O.query(f"SELECT queryId FROM query_log WHERE {O.UNIT} < 0.1"))
def fraction_sample(spark, sf_dir):
    return sampling.hash_sample(log(spark, sf_dir), 0.1).select("queryId")


@register(O.query("SELECT queryId FROM labelled WHERE is_heavy = 0 AND queryId NOT IN (SELECT queryId FROM sampled)", O.DISTANCES, O.PROBABILITIES, _SAMPLED))
def sample_remainder_anti(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return sampling.remainder(df.where("is_heavy = 0"), sampling.boundary_sample(df)).select("queryId")


@register(O.query(f"""SELECT queryId, is_heavy FROM labelled WHERE is_heavy = 1 UNION ALL SELECT queryId, is_heavy FROM (SELECT queryId, is_heavy,
  row_number() OVER (ORDER BY {O.UNIT} / greatest(sampling_probability, 1e-9::DOUBLE), queryId) AS r FROM probabilities WHERE is_heavy = 0)
  WHERE r <= (SELECT 5 * count(*) FILTER (is_heavy = 1) FROM labelled)""", O.DISTANCES, O.PROBABILITIES))
def exact_ratio_sample(spark, sf_dir):
    return sampling.exact_ratio_sample(labelled(spark, sf_dir)).select("queryId", "is_heavy")


_ADJUSTED = f"""small AS (SELECT queryId, is_heavy, {O.unit(42)} AS u42, {O.unit(43)} AS u43, {O.unit(44)} AS u44 FROM labelled WHERE is_heavy = 0),
goal AS (SELECT (SELECT 5 * count(*) FROM labelled WHERE is_heavy = 1) AS target, (SELECT count(*) FROM small WHERE u42 < {{0}}) AS have, (SELECT count(*) FROM small WHERE u42 >= {{0}}) AS rest)"""
_KEPT = """SELECT queryId, is_heavy FROM small, goal WHERE CASE WHEN target <= 0 OR abs(target - have) < target * 0.05::DOUBLE THEN u42 < {0}
  WHEN target > have THEN u42 < {0} OR u43 < least((target - have) / nullif(rest, 0)::DOUBLE, 1) ELSE u42 < {0} AND u44 < target / have::DOUBLE END"""


@register(O.query(_KEPT.format("0.9::DOUBLE"), _ADJUSTED.format("0.9::DOUBLE")))
def shrunk_sample(spark, sf_dir):
    """As adjusted_sample, from a sample that is too large."""
    df = labelled(spark, sf_dir)
    heavy, _ = sampling.class_counts(df)
    small = df.where("is_heavy = 0")
    return sampling.adjust(small, sampling.hash_sample(small, 0.9), 5 * heavy).select("queryId", "is_heavy")


@register(O.query(_KEPT.format("0.05::DOUBLE"), _ADJUSTED.format("0.05::DOUBLE")))
def adjusted_sample(spark, sf_dir):
    df = labelled(spark, sf_dir)
    heavy, _ = sampling.class_counts(df)
    small = df.where("is_heavy = 0")
    return sampling.adjust(small, sampling.hash_sample(small, 0.05), 5 * heavy).select("queryId", "is_heavy")


# --- statistics and historical features


@register(O.stats_sql("user"))
def user_stats(spark, sf_dir):
    return rounded(statistics.user_stats(labelled(spark, sf_dir), exact=True))


@register(O.stats_sql("catalog"))
def catalog_stats(spark, sf_dir):
    return rounded(statistics.catalog_stats(labelled(spark, sf_dir), exact=True))


@register(O.stats_sql("schema"))
def schema_stats(spark, sf_dir):
    return rounded(statistics.schema_stats(labelled(spark, sf_dir), exact=True))


@register(O.query("SELECT count(*) AS total_queries, count(*) FILTER (is_heavy = 1) AS heavy_queries, round(avg(CAST(is_heavy AS DOUBLE)), 6) AS overall_heavy_rate FROM labelled"))
def overall_stats(spark, sf_dir):
    return rounded(statistics.overall_stats(labelled(spark, sf_dir)))


@register(O.stats_sql("catalog"))
def catalog_stats_approx(spark, sf_dir):
    """By sketches, which are exact while a group has fewer values than the sketch's accuracy."""
    return rounded(statistics.catalog_stats(labelled(spark, sf_dir)))


@register(O.historical_sql())
def historical_features(spark, sf_dir):
    """Features of all queries by the statistics of the training days."""
    df = labelled(spark, sf_dir)
    stats = statistics.compute(training_days(df), exact=True)
    return rounded(statistics.with_historical(df, stats).select("queryId", *pipeline.HISTORICAL_NAMES), 10)


# --- base features, one query for each group


def _group(name: str):
    def run(spark, sf_dir):
        return rounded(feats.group_columns(log(spark, sf_dir), name, ["queryId"]))

    run.__name__ = f"feat_{name}"
    return run


for _name in feats.GROUPS:
    register(O.group_sql(_name))(_group(_name))


@register(O.query(
    "SELECT queryId, CAST(78 AS INTEGER) AS n_features, CASE WHEN regexp_matches(q, '\\S') THEN round("
    + " + ".join(f"({O.FEATURES[n]})" for n in base_names()) + ", 6) ELSE 0.0::DOUBLE END AS total FROM staged", O.STAGED))
def feature_vector(spark, sf_dir):
    """The whole vector: its length and the sum of its elements."""
    df = feats.with_features(log(spark, sf_dir))
    return df.select("queryId", F.size("features").alias("n_features"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register(O.query(f"SELECT queryId, round({O.FEATURES['query_length']}, 6) AS query_length, round({O.FEATURES['join_count']}, 6) AS join_count FROM staged WHERE regexp_matches(q, '\\S')", O.STAGED))
def pruned_features(spark, sf_dir):
    """Two features picked by a specification; the others are never computed."""
    spec = FeatureSpec.default()
    for name in spec.all_names():
        if name not in ("query_length", "join_count"):
            spec.disable_feature(name)
    df = feats.with_features(log(spark, sf_dir).where(feats.valid_query()), spec.active_names())
    return df.select("queryId", F.col("features")[0].alias("query_length"), F.col("features")[1].alias("join_count"))


@register(O.structure_sql())
def structure_metrics(spark, sf_dir):
    """What gives each statement its structure; depth is checked with the features."""
    cells = structure.structure_metrics(F.col("query"))
    return log(spark, sf_dir).select("queryId", *[c.alias(n) for n, c in cells.items() if n != "depth"])


@register(O.query("SELECT queryId, contains(upper(query), 'JOIN') AS joins, contains(query, 'select') AS lower_select, CAST(len(regexp_extract_all(query, 'l_[a-z]+', 0, 'i')) AS INTEGER) AS line_columns FROM query_log"))
def text_search(spark, sf_dir):
    """A keyword in either case, one as it stands, and matches of a pattern."""
    q = F.col("query")
    cells = text.has_keyword(q, "join").alias("joins"), text.has_keyword(q, "select", True).alias("lower_select"), text.count_pattern(q, "l_[a-z]+").alias("line_columns")
    return log(spark, sf_dir).select("queryId", *cells)


# --- analysis


@register(O.query("""SELECT count(*) AS total, count(*) FILTER (is_heavy = 1) AS heavy, count(*) FILTER (is_heavy = 0) AS small,
  round(min(cpu_time_seconds), 6) AS cpu_min, round(avg(cpu_time_seconds), 6) AS cpu_avg, round(max(cpu_time_seconds), 6) AS cpu_max,
  round(min(memory_gb), 6) AS mem_min, round(avg(memory_gb), 6) AS mem_avg, round(max(memory_gb), 6) AS mem_max FROM labelled"""))
def profile_basic(spark, sf_dir):
    return rounded(analysis.basic_profile(labelled(spark, sf_dir)))


@register(O.query("SELECT " + ", ".join(f"round(quantile_disc({c}, {p / 100}), 6) AS {c}_p{p}" for c in (_CPU, _MEM) for p in (50, 75, 90, 95, 99)) + " FROM labelled"))
def profile_quantiles(spark, sf_dir):
    return rounded(analysis.quantile_profile(labelled(spark, sf_dir), exact=True))


_TYPES = """types AS (SELECT coalesce(queryType, 'NULL') AS queryType, count(*) AS total, count(*) FILTER (is_heavy = 1) AS heavy FROM labelled GROUP BY 1)"""
_TYPE_ROWS = "SELECT queryType, total, heavy, round(total * 100 / (SELECT sum(total) FROM types)::DOUBLE, 6) AS pct, round(heavy * 100 / total::DOUBLE, 6) AS heavy_pct FROM types"


@register(O.query(_TYPE_ROWS, _TYPES))
def querytype_breakdown(spark, sf_dir):
    return rounded(analysis.query_types(labelled(spark, sf_dir)))


@register(O.query("SELECT coalesce(queryType, 'NULL') AS queryType, count(*) AS total, round(count(*) * 100 / (SELECT count(*) FROM query_log)::DOUBLE, 6) AS pct FROM query_log GROUP BY 1"))
def querytype_counts(spark, sf_dir):
    return rounded(analysis.query_types(log(spark, sf_dir)))


@register(O.query(_TYPE_ROWS + " ORDER BY total DESC, queryType LIMIT 2", _TYPES))
def top_query_types(spark, sf_dir):
    return rounded(analysis.top_types(labelled(spark, sf_dir), 2))


@register(O.query(_TYPE_ROWS + " WHERE total >= 100 ORDER BY heavy * 100 / total::DOUBLE DESC, queryType LIMIT 2", _TYPES))
def heaviest_query_types(spark, sf_dir):
    return rounded(analysis.heaviest_types(labelled(spark, sf_dir), 2))


_ERRORS = f"errors AS (SELECT errorName, count(*) AS total, count(*) FILTER (is_heavy = 1) AS heavy FROM labelled WHERE errorName IN ({O.ERRORS}) GROUP BY 1)"
_ERROR_ROWS = "SELECT errorName, total, heavy, round(total * 100 / (SELECT sum(total) FROM errors)::DOUBLE, 6) AS pct_of_errors, round(heavy * 100 / total::DOUBLE, 6) AS heavy_pct FROM errors"


@register(O.query(_ERROR_ROWS, _ERRORS))
def error_breakdown(spark, sf_dir):
    return rounded(analysis.resource_errors(labelled(spark, sf_dir)))


@register(O.query(_ERROR_ROWS + " ORDER BY total DESC, errorName LIMIT 1", _ERRORS))
def top_errors(spark, sf_dir):
    return rounded(analysis.top_errors(labelled(spark, sf_dir), 1))


@register(O.query(f"SELECT count(*) AS total, count(*) FILTER (errorName IN ({O.ERRORS})) AS errors, round(count(*) FILTER (errorName IN ({O.ERRORS})) * 100 / count(*)::DOUBLE, 6) AS error_rate FROM query_log"))
def error_rate(spark, sf_dir):
    return rounded(analysis.error_rate(log(spark, sf_dir)))


_COUNTS = "SELECT count(*) AS total, count(*) FILTER (is_heavy = 1) AS heavy, count(*) FILTER (is_heavy = 0) AS small FROM "


@register(O.query("SELECT " + ", ".join(f"b.{k} AS {k}_before, a.{k} AS {k}_after, b.{k} - a.{k} AS {k}_removed, round((b.{k} - a.{k}) * 100 / b.{k}::DOUBLE, 6) AS {k}_removed_pct" for k in ("total", "heavy", "small")) + f" FROM ({_COUNTS}labelled) b, ({_COUNTS}filtered) a", O.FILTERED))
def compare_before_after(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return rounded(analysis.compare(df, etl.filter_queries(df)))


@register(O.query("SELECT count(*) AS total, count(*) FILTER (is_heavy = 1) AS heavy, count(*) FILTER (is_heavy = 0) AS small, round(count(*) FILTER (is_heavy = 1) * 100 / count(*)::DOUBLE, 6) AS heavy_pct, round(count(*) FILTER (is_heavy = 0) / count(*) FILTER (is_heavy = 1)::DOUBLE, 6) AS small_to_heavy FROM labelled"))
def quick_stats(spark, sf_dir):
    return rounded(analysis.quick_stats(labelled(spark, sf_dir)))


_CATEGORY = "coalesce(nullif(upper(regexp_extract(query, '^\\s*(?:--[^\\n]*\\n\\s*)*([A-Za-z]+)', 1)), ''), 'NONE')"


@register(O.query(f"SELECT category, total, heavy, round(heavy * 100 / total::DOUBLE, 6) AS heavy_rate, heavy * 100 / total::DOUBLE < 8 AS safe FROM (SELECT {_CATEGORY} AS category, count(*) AS total, count(*) FILTER (is_heavy = 1) AS heavy FROM labelled GROUP BY 1)"))
def zero_cost_categories(spark, sf_dir):
    return rounded(analysis.zero_cost_categories(labelled(spark, sf_dir), safe_below=8.0))


@register(O.query(f"SELECT count(*) AS total, count(*) FILTER (c IN ('USE', 'DESCRIBE')) AS covered, count(*) FILTER (c IN ('USE', 'DESCRIBE') AND is_heavy = 1) AS heavy_in_safe, round(count(*) FILTER (c IN ('USE', 'DESCRIBE')) * 100 / count(*)::DOUBLE, 6) AS coverage_pct, count(*) FILTER (c IN ('USE', 'DESCRIBE') AND is_heavy = 1) = 0 AS is_safe FROM (SELECT *, {_CATEGORY} AS c FROM labelled)"))
def zero_cost_safety(spark, sf_dir):
    return rounded(analysis.zero_cost_safety(labelled(spark, sf_dir), ["USE", "DESCRIBE"]))


# --- parsers and helpers

_NAMES = "list_sort(list_distinct(list_concat(regexp_extract_all(query, 'FROM\\s+([a-zA-Z0-9_.]+)', 1, 'i'), regexp_extract_all(query, 'JOIN\\s+([a-zA-Z0-9_.]+)', 1, 'i'))))"
_THREE = "([a-zA-Z0-9_]+)\\.([a-zA-Z0-9_]+)\\.([a-zA-Z0-9_]+)"
_USE = "'USE\\s+([a-zA-Z0-9_]+)\\.([a-zA-Z0-9_]+)'"


@register(O.query(f"SELECT queryId, array_to_string({_NAMES}, ',') AS tables FROM query_log"))
def table_names(spark, sf_dir):
    return log(spark, sf_dir).select("queryId", F.array_join(text.table_names(F.col("query")), ",").alias("tables"))


@register(O.query(f"SELECT queryId, array_to_string(regexp_extract_all(query, '{_THREE}'), ',') AS three, array_to_string(regexp_extract_all(regexp_replace(query, '{_THREE}', '', 'g'), '(?:FROM|JOIN)\\s+([a-zA-Z0-9_]+)\\.([a-zA-Z0-9_]+)', 0, 'i'), ',') AS two FROM query_log"))
def qualified_names(spark, sf_dir):
    q = F.col("query")
    return log(spark, sf_dir).select("queryId", F.array_join(text.three_part_names(q), ",").alias("three"), F.array_join(text.two_part_names(q), ",").alias("two"))


@register(O.query("SELECT queryId, w AS where_text, array_to_string(regexp_extract_all(w, 'IN\\s*\\(([^)]+)\\)', 1, 'i'), '|') AS in_lists FROM staged", O.STAGED))
def where_clauses(spark, sf_dir):
    w = text.where_body(F.col("query"))
    return log(spark, sf_dir).select("queryId", w.alias("where_text"), F.array_join(text.in_lists(w), "|").alias("in_lists"))


@register(O.query(f"SELECT queryId, nullif(regexp_extract(query, {_USE}, 1, 'i'), '') AS use_catalog, nullif(CASE WHEN regexp_extract(query, {_USE}, 0, 'i') <> '' THEN regexp_extract(query, {_USE}, 2, 'i') ELSE regexp_extract(query, 'USE\\s+([a-zA-Z0-9_]+)(?:\\s|$|;)', 1, 'i') END, '') AS use_schema FROM query_log"))
def use_statements(spark, sf_dir):
    catalog, schema = text.use_names(F.col("query"))
    return log(spark, sf_dir).select("queryId", catalog.alias("use_catalog"), schema.alias("use_schema"))


@register(O.query("SELECT queryId, round(coalesce(cpuTime / nullif(peakUserMemoryBytes, 0)::DOUBLE, 0), 6) AS divided, round(least(cpuTime / 300000.0::DOUBLE, 1), 6) AS cut, greatest(1, least(12, hour)) AS clamped FROM query_log"))
def scalar_helpers(spark, sf_dir):
    cells = [text.safe_divide(F.col("cpuTime"), F.col("peakUserMemoryBytes")).alias("divided"), text.at_most_one(F.col("cpuTime"), 300_000).alias("cut"), text.clamp(F.col("hour"), 1, 12).alias("clamped")]
    return rounded(log(spark, sf_dir).select("queryId", *cells))


@register(O.query("SELECT queryId, query FROM query_log ORDER BY CAST(queryId AS BIGINT) LIMIT 10"))
def first_rows(spark, sf_dir):
    return log(spark, sf_dir).orderBy(F.col("queryId").cast("bigint")).limit(10).select("queryId", "query")


@register(O.query("SELECT queryId, is_heavy, NULL::VARCHAR AS note FROM labelled WHERE is_heavy = 1 UNION ALL SELECT queryId, is_heavy, 'small' FROM labelled WHERE is_heavy = 0"))
def union_by_name(spark, sf_dir):
    df = labelled(spark, sf_dir).select("queryId", "is_heavy")
    small = df.where("is_heavy = 0").select(F.lit("small").alias("note"), "is_heavy", "queryId")
    return df.where("is_heavy = 1").unionByName(small, allowMissingColumns=True)


_VALID = "WHERE regexp_matches(q, '\\S')"
_CELLS = ", ".join(O.r10(O.FEATURES[n], n) for n in base_names())


@register(O.query(f"SELECT b.*, h.* EXCLUDE (queryId) FROM (SELECT queryId, {_CELLS} FROM staged {_VALID}) b JOIN (SELECT * FROM ({O.historical_sql(rows='true')})) h USING (queryId)", O.STAGED))
def concatenated_vectors(spark, sf_dir):
    """78 base and 17 historical features, each read off one array."""
    df = labelled(spark, sf_dir)
    done = pipeline.featurised(df.where(feats.valid_query()), statistics.compute(training_days(df), exact=True))
    return rounded(done.select("queryId", *[F.col("features")[i].alias(n) for i, n in enumerate(pipeline.feature_names())]), 10)


_SPLIT = "CASE WHEN CAST(createTime AS DATE) >= DATE '2024-01-23' THEN 'test' WHEN CAST(createTime AS DATE) >= DATE '2024-01-16' THEN 'val' ELSE 'train' END"


@register(O.query(f"SELECT {_SPLIT} AS split, queryId, query, hour, round(cpu_time_seconds, 6) AS cpu_time_seconds, is_heavy, CAST(16 AS INTEGER) AS n_columns FROM labelled WHERE CAST(createTime AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'"))
def split_roundtrip(spark, sf_dir):
    """The three splits, written with their columns to folders of their own and read back."""
    base = scratch(spark, "splits")
    query_log.write_splits(etl.time_splits(etl.with_date_parts(labelled(spark, sf_dir)), "2024-01-01", "2024-01-30"), base)
    found = None
    for name, df in query_log.read_splits(spark, base).items():
        rows = df.select(F.lit(name).alias("split"), "queryId", "query", "hour", "cpu_time_seconds", "is_heavy", F.lit(len(df.columns)).alias("n_columns"))
        found = rows if found is None else found.union(rows)
    return rounded(found)


@register(O.query("SELECT count(*) AS rows, count(*) FILTER (is_heavy = 1) AS heavy FROM labelled"))
def statistics_document(spark, sf_dir):
    """What the statistics say once they went through their JSON document: the sums over all users."""
    stats = statistics.compute(labelled(spark, sf_dir), exact=True)
    read = statistics.from_document(spark, statistics.to_document(stats))
    return read["user"].agg(F.sum("query_count").alias("rows"), F.sum(F.round(F.col("query_count") * F.col("heavy_rate")).cast("bigint")).alias("heavy"))


@register(O.query("""SELECT round(sum(p * precision) / sum(p), 6) AS pr_auc FROM (SELECT count(*) FILTER (is_heavy = 1) AS p,
  (SELECT count(*) FILTER (is_heavy = 1) / count(*)::DOUBLE FROM scores b WHERE b.score >= a.score) AS precision FROM scores a GROUP BY score)""", O.SCORES))
def pr_auc(spark, sf_dir):
    return rounded(evaluation.pr_auc(scores(spark, sf_dir)))


# --- text and TF-IDF


@register(O.query(f"SELECT queryId, {O.normalised('query')} AS normalised FROM query_log"))
def sql_normalize(spark, sf_dir):
    return log(spark, sf_dir).select("queryId", normalise_sql(F.col("query")).alias("normalised"))


@register(O.query(f"SELECT queryId, array_to_string({O.tokens('query')}, ' ') AS tokens FROM query_log"))
def tokens(spark, sf_dir):
    return log(spark, sf_dir).select("queryId", F.array_join(tfidf.tokens(), " ").alias("tokens"))


@register(O.query(f"SELECT queryId, array_to_string(list_filter({O.tokens('query')}, lambda t: t NOT IN ({O.KEYWORDS})), ' ') AS tokens FROM query_log"))
def keyword_filtered(spark, sf_dir):
    return log(spark, sf_dir).select("queryId", F.array_join(tfidf.tokens(drop_keywords=True), " ").alias("tokens"))


@register(O.query(f"SELECT term, count(*) AS df FROM ({O.terms_sql('query_log', 'queryId', 'query', True, False)}) GROUP BY term"))
def doc_freq(spark, sf_dir):
    return tfidf.document_frequency(log(spark, sf_dir))


@register(f"SELECT term, count(*) AS df FROM ({O.terms_sql('documents', 'doc_id', 'text', False, False)}) GROUP BY term")
def doc_freq_documents(spark, sf_dir):
    return tfidf.document_frequency(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", normalise=False)


_CHOSEN = f"""n AS (SELECT count(*) AS n FROM query_log), terms AS ({O.terms_sql('query_log', 'queryId', 'query', True, True)}),
chosen AS (SELECT term, count(*) AS df, ln((any_value(n.n) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS idf FROM terms, n GROUP BY term
  HAVING count(*) >= 10 AND count(*) <= 0.8 * any_value(n.n) ORDER BY df DESC, term LIMIT 250)"""


@register(O.query("SELECT term, df, round(idf, 6) AS idf FROM chosen", _CHOSEN))
def idf_weights(spark, sf_dir):
    return rounded(tfidf.chosen_terms(log(spark, sf_dir), min_df=10, drop_keywords=True))


@register(O.query("SELECT k AS queryId, term, round(coalesce(idf / nullif(sqrt(sum(idf * idf) OVER (PARTITION BY k)), 0), 0), 6) AS weight FROM terms JOIN chosen USING (term)", _CHOSEN))
def tfidf_l2(spark, sf_dir):
    return rounded(tfidf.unit_weights(log(spark, sf_dir), "queryId", min_df=10, drop_keywords=True))


_WEIGHED = "weighed AS (SELECT k AS queryId, term, coalesce(idf / nullif(sqrt(sum(idf * idf) OVER (PARTITION BY k)), 0), 0) AS weight FROM terms JOIN chosen USING (term))"


@register(O.query("SELECT queryId, term, round(weight, 6) AS weight FROM weighed WHERE weight > 0", _CHOSEN, _WEIGHED))
def tfidf_vectors(spark, sf_dir):
    """The same weights by the fitted ML pipeline, one row for each that is not zero."""
    df = log(spark, sf_dir)
    fitted = tfidf.SqlTfidf(min_df=10).fit(df)
    rows = fitted.transform(df).select("queryId", F.posexplode("tfidf").alias("at", "weight")).where("weight > 0")
    return rounded(rows.select("queryId", F.get(F.array(*map(F.lit, fitted.vocabulary)), F.col("at")).alias("term"), "weight"))


@register(O.query("SELECT queryId, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY queryId ORDER BY weight DESC, term) AS r FROM weighed WHERE weight > 0) WHERE r <= 5", _CHOSEN, _WEIGHED))
def tfidf_top_terms(spark, sf_dir):
    df = log(spark, sf_dir)
    return rounded(tfidf.SqlTfidf(min_df=10).fit(df).top_terms(df, "queryId", 5))


# --- evaluation


@register(O.query("SELECT count(*) FILTER (is_heavy = 1 AND score >= 0.5) AS tp, count(*) FILTER (is_heavy = 0 AND score >= 0.5) AS fp, count(*) FILTER (is_heavy = 1 AND score < 0.5) AS fn, count(*) FILTER (is_heavy = 0 AND score < 0.5) AS tn FROM scores", O.SCORES))
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(scores(spark, sf_dir))


_MATRIX = "matrix AS (SELECT count(*) FILTER (is_heavy = 1 AND score >= 0.5) AS tp, count(*) FILTER (is_heavy = 0 AND score >= 0.5) AS fp, count(*) FILTER (is_heavy = 1 AND score < 0.5) AS fn, count(*) FILTER (is_heavy = 0 AND score < 0.5) AS tn FROM scores)"
_METRICS = "metric AS (SELECT *, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(fn / (fn + tp)::DOUBLE, 6) AS fnr, round(fp / (fp + tn)::DOUBLE, 6) AS fpr FROM matrix)"
_AUC = "auc AS (SELECT round((sum(r) FILTER (is_heavy = 1) - count(*) FILTER (is_heavy = 1) * (count(*) FILTER (is_heavy = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (is_heavy = 1) * count(*) FILTER (is_heavy = 0))::DOUBLE, 6) AS roc_auc FROM (SELECT is_heavy, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scores))"


@register(O.query("SELECT * FROM metric", O.SCORES, _MATRIX, _METRICS))
def metrics(spark, sf_dir):
    return rounded(evaluation.derived(evaluation.confusion(scores(spark, sf_dir))))


@register(O.query("SELECT roc_auc FROM auc", O.SCORES, _AUC))
def roc_auc(spark, sf_dir):
    return rounded(evaluation.roc_auc(scores(spark, sf_dir)))


@register(O.query("SELECT metric.*, auc.roc_auc FROM metric, auc", O.SCORES, _MATRIX, _METRICS, _AUC))
def evaluate(spark, sf_dir):
    return rounded(evaluation.evaluate(scores(spark, sf_dir), 0.5))


_SWEEP = "sweep AS (SELECT t.score AS threshold, (SELECT count(*) FROM scores s WHERE s.is_heavy = 1 AND s.score < t.score) AS fn, (SELECT count(*) FROM scores s WHERE s.is_heavy = 0 AND s.score >= t.score) AS fp FROM (SELECT DISTINCT score FROM scores) t)"


@register(O.query("SELECT round(threshold, 6) AS threshold, fn, fp, fn * 100.0::DOUBLE + fp AS cost FROM sweep ORDER BY fn * 100.0::DOUBLE + fp, sweep.threshold LIMIT 1", O.SCORES, _SWEEP))
def threshold_exact(spark, sf_dir):
    return rounded(evaluation.best_threshold(scores(spark, sf_dir)))


@register(O.query("SELECT round(threshold, 6) AS threshold, fn, fp, fn * 100.0::DOUBLE + fp AS cost FROM sweep", O.SCORES, _SWEEP))
def threshold_sweep(spark, sf_dir):
    return rounded(evaluation.sweep(scores(spark, sf_dir)))


_GRID = """grid AS (SELECT t / 100.0::DOUBLE AS threshold, count(*) FILTER (is_heavy = 1 AND round(score * 1000) >= t * 10) AS tp, count(*) FILTER (is_heavy = 0 AND round(score * 1000) >= t * 10) AS fp,
  count(*) FILTER (is_heavy = 1 AND round(score * 1000) < t * 10) AS fn FROM scores, (SELECT unnest(range(10, 89, 2)) AS t) GROUP BY t)"""


@register(O.query("SELECT round(threshold, 6) AS threshold, tp, fp, fn, fn * 100.0::DOUBLE + fp AS cost FROM grid", O.SCORES, _GRID))
def threshold_grid(spark, sf_dir):
    return rounded(evaluation.grid(scores(spark, sf_dir)))


@register(O.query("SELECT round(threshold, 6) AS threshold, tp, fp, fn, fn * 100.0::DOUBLE + fp AS cost, round((fn * 100.0::DOUBLE + fp) / min(fn * 100.0::DOUBLE + fp) OVER (), 6) AS relative_cost FROM grid WHERE abs(threshold - 0.3) <= 0.05 + 1e-9", O.SCORES, _GRID))
def threshold_sensitivity(spark, sf_dir):
    return rounded(evaluation.sensitivity(evaluation.grid(scores(spark, sf_dir)), 0.3))


@register(O.query("SELECT round(threshold, 6) AS threshold, tp, fp, fn, fn * 100.0::DOUBLE + fp AS cost FROM grid ORDER BY abs(grid.threshold - 0.5), grid.threshold LIMIT 1", O.SCORES, _GRID))
def threshold_nearest(spark, sf_dir):
    return rounded(evaluation.nearest(evaluation.grid(scores(spark, sf_dir))))


@register(O.query("SELECT queryId, CASE WHEN score >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM scores", O.SCORES))
def predictions(spark, sf_dir):
    return scores(spark, sf_dir).select("queryId", evaluation.predicted(0.5).alias("prediction"))


@register(O.query("""SELECT r.requirement, r.comparison, r.target, round(r.actual, 6) AS actual, r.critical,
  CASE WHEN CASE WHEN comparison = '>=' THEN actual >= target ELSE actual <= target END THEN 'PASSED' WHEN critical THEN 'FAILED' ELSE 'WARNING' END AS status FROM (
  SELECT 'recall' AS requirement, '>=' AS comparison, 0.98::DOUBLE AS target, recall AS actual, true AS critical FROM metric UNION ALL SELECT 'fnr', '<=', 0.02, fnr, true FROM metric
  UNION ALL SELECT 'f1', '>=', 0.85, f1, false FROM metric UNION ALL SELECT 'roc_auc', '>=', 0.9, roc_auc, false FROM auc) r""", O.SCORES, _MATRIX, _METRICS, _AUC))
def compliance(spark, sf_dir):
    return rounded(evaluation.compliance(evaluation.evaluate(scores(spark, sf_dir), 0.5)))


# --- parity


def _two_paths(spark, sf_dir):
    """Vectors of the whole builder, and a copy of them that differs in known places."""
    df = feats.with_features(log(spark, sf_dir), output="left")
    n = F.col("queryId").cast("bigint")
    off = F.transform("left", lambda x, i: F.when((i == 3) & (n % 10 == 0), x + 1.0).when((i == 47) & (n % 4 == 0), x + 0.5).otherwise(x))
    return df.select("queryId", "left", off.alias("right"))


_PARITY = "ids AS (SELECT queryId, CAST(queryId AS BIGINT) AS n FROM query_log)"
_ROWS = "SELECT queryId, CAST((n % 10 = 0)::INT + (n % 4 = 0)::INT AS INTEGER) AS n_mismatch, CASE WHEN n % 10 = 0 THEN 1.0::DOUBLE WHEN n % 4 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS max_diff, n % 10 = 0 OR n % 4 = 0 AS mismatch FROM ids"


@register(O.query(_ROWS, _PARITY))
def parity_diff(spark, sf_dir):
    return rounded(parity.row_parity(_two_paths(spark, sf_dir), "queryId", "left", "right"))


@register(O.query("SELECT count(*) AS rows, count(*) FILTER (mismatch) AS mismatched_rows, round(count(*) FILTER (mismatch) * 100 / count(*)::DOUBLE, 6) AS mismatch_pct, max(max_diff) AS max_diff, count(*) FILTER (mismatch) * 100 / count(*)::DOUBLE < 0.5 AS passed FROM (" + _ROWS + ")", _PARITY))
def parity_summary(spark, sf_dir):
    return rounded(parity.parity(_two_paths(spark, sf_dir), "left", "right"))


@register(O.query("SELECT count(*) AS rows, count(*) FILTER (n % 10 = 0) AS mismatched_rows, round(count(*) FILTER (n % 10 = 0) * 100 / count(*)::DOUBLE, 6) AS mismatch_pct, 1.0::DOUBLE AS max_diff, count(*) FILTER (n % 10 = 0) * 100 / count(*)::DOUBLE < 0.5 AS passed FROM ids", _PARITY))
def parity_masked(spark, sf_dir):
    df = _two_paths(spark, sf_dir).withColumns({"left": parity.masked("left"), "right": parity.masked("right")})
    return rounded(parity.parity(df, "left", "right"))


@register(O.query("SELECT CAST(3 AS INTEGER) AS position, count(*) FILTER (n % 10 = 0) AS n FROM ids UNION ALL SELECT 47, count(*) FILTER (n % 4 = 0) FROM ids", _PARITY))
def mismatch_by_feature(spark, sf_dir):
    return parity.mismatch_by_feature(_two_paths(spark, sf_dir), "left", "right")


@register(O.query("SELECT 'base' AS block, count(*) FILTER (n % 10 = 0) AS n FROM ids UNION ALL SELECT 'structure', count(*) FILTER (n % 4 = 0) FROM ids", _PARITY))
def mismatch_by_group(spark, sf_dir):
    return parity.mismatch_by_group(_two_paths(spark, sf_dir), "left", "right")


# --- training


def _ready(spark, sf_dir):
    """Features of all valid queries by the statistics of the training days."""
    df = labelled(spark, sf_dir).where(feats.valid_query())
    return pipeline.featurised(df, statistics.compute(training_days(df))).select("queryId", "createTime", "is_heavy", "features")


@register()
def gbt_scores(spark, sf_dir):
    """Scores of all queries by a model that is fitted on the training days."""
    df = _ready(spark, sf_dir)
    model = training.fit(training_days(df), rounds=10, depth=4)
    return training.scored(model, df).select("queryId", "is_heavy", "score")


@register(O.query(f"SELECT queryId, CAST({O.bucket(chr(34) + 'k' + chr(34), 5)} AS INTEGER) AS fold FROM (SELECT queryId, concat(is_heavy, ':', queryId) AS k FROM labelled)"))
def cv_folds(spark, sf_dir):
    return training.with_folds(labelled(spark, sf_dir)).select("queryId", "fold")


@register()
def importance(spark, sf_dir):
    model = training.fit(training_days(_ready(spark, sf_dir)), rounds=5, depth=3)
    return spark.createDataFrame(training.importance(model, pipeline.feature_names()), "feature string, importance double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
