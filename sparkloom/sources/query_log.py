"""The query log: schema, readers, writers, checkpoints, and a derivation from `events`."""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

SCHEMA = StructType([
    StructField("queryId", StringType()),
    StructField("query", StringType()),
    StructField("createTime", TimestampType()),
    StructField("user", StringType()),
    StructField("catalog", StringType()),
    StructField("schema", StringType()),
    StructField("clientInfo", StringType()),
    StructField("cpuTime", LongType()),
    StructField("peakUserMemoryBytes", LongType()),
    StructField("errorName", StringType()),
    StructField("queryType", StringType()),
    StructField("hour", IntegerType()),
])

REQUIRED = (
    "queryId", "query", "user", "catalog", "schema", "cpuTime", "peakUserMemoryBytes",
    "errorName", "queryType", "createTime", "endTime", "clientInfo",
)

# The columns of written splits: of labelled rows, and of rows with features (fixed values).
SPLIT_COLUMNS = [
    "queryId", "query", "createTime", "endTime", "user", "catalog", "schema", "clientInfo", "queryDate", "hour", "cpuTime",
    "peakUserMemoryBytes", "totalBytes", "queryType", "errorName", "sessionproperties", "cpu_time_seconds", "memory_gb", "is_heavy",
]
FEATURE_COLUMNS = ["queryId", "query", "user", "catalog", "schema", "queryDate", "hour", "is_heavy", "cpu_time_seconds", "memory_gb", "features"]

#: A query log out of the `events` table, in SQL that Spark and DuckDB both take.
DERIVE_SQL = """
SELECT CAST(event_id AS STRING) AS queryId,
  CASE CAST(event_id % 12 AS INT)
   WHEN 0 THEN concat('SELECT * FROM t', CAST(user_id % 9 AS STRING), ' LIMIT ', CAST(event_id % 500 AS STRING))
   WHEN 1 THEN concat('select a, COUNT(*) from s', CAST(user_id % 5 AS STRING), '.orders where d >= ', chr(39), '2024-01-', CAST(10 + event_id % 18 AS STRING), chr(39), ' AND x IN (1, 2, ', CAST(event_id AS STRING), ') group by a, b having COUNT(*) > 5 order by a')
   WHEN 2 THEN concat('SELECT o.id, SUM(o.v), AVG(o.v) FROM hive.sales.orders o LEFT JOIN pg.crm.users u ON o.uid = u.id INNER JOIN dim', CAST(user_id % 7 AS STRING), ' d ON d.k = o.k WHERE o.v BETWEEN 1 AND ', CAST(event_id % 100 AS STRING), ' OR u.name LIKE ', chr(39), '%x%', chr(39))
   WHEN 3 THEN concat('WITH c AS (SELECT id, ROW_NUMBER() OVER (PARTITION BY g ORDER BY ts ROWS UNBOUNDED PRECEDING) rn FROM e), d AS (SELECT DISTINCT id FROM c) SELECT MAX(id), MIN(id) FROM d WHERE id NOT IN (SELECT id FROM f', CAST(user_id % 4 AS STRING), ')')
   WHEN 4 THEN concat('INSERT INTO tgt SELECT * FROM (SELECT a FROM x UNION ALL SELECT a FROM y) z WHERE a = ', CAST(event_id AS STRING))
   WHEN 5 THEN concat('CREATE TABLE n', CAST(event_id AS STRING), ' AS SELECT a FROM src EXCEPT SELECT a FROM old INTERSECT SELECT a FROM b')
   WHEN 6 THEN concat('DELETE FROM t WHERE ts < ', chr(39), '2024-01-05 10:20:30', chr(39), ' AND EXISTS (SELECT 1 FROM u)')
   WHEN 7 THEN concat('UPDATE t SET a = CASE WHEN b > 1 THEN COALESCE(c, 0) ELSE NULLIF(d, 1) END WHERE id = ', CAST(event_id AS STRING), ';')
   WHEN 8 THEN concat('-- note', chr(10), 'SELECT a /* c */', chr(10), 'FROM l CROSS JOIN m FULL OUTER JOIN k ON 1 = 1', chr(10), 'LIMIT 10 OFFSET ', CAST(event_id % 50 AS STRING))
   WHEN 9 THEN concat('USE hive.s', CAST(user_id % 3 AS STRING), '; SELECT "q", ((a + (b)) * 2) FROM w;')
   WHEN 10 THEN concat('DESCRIBE hive.sales.t', CAST(user_id % 6 AS STRING))
   ELSE '   ' END AS query,
  CAST(ts AS TIMESTAMP) AS createTime,
  concat('user', CAST(user_id AS STRING)) AS user,
  CASE CAST(event_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'hive' WHEN 3 THEN 'iceberg' ELSE 'pg' END AS catalog,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('s', CAST(event_id % 7 AS STRING)) END AS schema,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'CURATED-BI' ELSE 'NON-CURATED jdbc' END AS clientInfo,
  CAST(CASE WHEN event_id % 101 = 0 THEN NULL ELSE round(value * 1000) END AS BIGINT) AS cpuTime,
  CAST(CASE WHEN event_id % 103 = 0 THEN NULL ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) * 115343360 END AS BIGINT) AS peakUserMemoryBytes,
  CASE WHEN event_id % 97 = 0 THEN 'EXCEEDED_TIME_LIMIT' WHEN event_id % 89 = 0 THEN 'EXCEEDED_MEMORY_LIMIT' WHEN event_id % 83 = 0 THEN 'SYNTAX_ERROR' ELSE NULL END AS errorName,
  CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'click' THEN 'SELECT' WHEN 'purchase' THEN 'INSERT' WHEN 'signup' THEN 'DESCRIBE' ELSE NULL END AS queryType,
  CAST(hour(ts) AS INT) AS hour
FROM {events}
"""


def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log derived from the events of a folder."""
    return spark.sql(DERIVE_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def read_log(
    spark: SparkSession, path: str, start: str, end: str, sample_fraction: float | None = None, schema: StructType | None = None
) -> DataFrame:
    """The rows of a Parquet log with start <= createTime < end; the range reaches the scan.

    A fraction between 0 and 1 keeps rows by a hash of queryId, so the sample does not depend on
    how the rows are partitioned.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    at = F.col("createTime")
    df = reader.parquet(path).where((at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp")))
    if sample_fraction is not None and 0 < sample_fraction < 1:
        from sparkloom.operators.sampling import hash_sample

        df = hash_sample(df, sample_fraction)
    return df


def read_splits(spark: SparkSession, base: str, names: tuple[str, ...] = ("train", "val", "test")) -> dict[str, DataFrame]:
    """The splits written below a folder."""
    return {n: spark.read.parquet(f"{base}/{n}") for n in names}


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def write_splits(splits: dict[str, DataFrame], base: str, columns: list[str] = SPLIT_COLUMNS, by: tuple[str, ...] = ("is_heavy",)) -> None:
    """Each split in a folder of its own, with the given columns in their order; those that a log lacks are left out."""
    for name, df in splits.items():
        kept = df.select(*[c for c in columns if c in df.columns])
        write_partitioned(kept, f"{base}/{name}", by) if by else write_plain(kept, f"{base}/{name}")


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("is_heavy",)) -> None:
    """Parquet in one folder for each value of `by`."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_plain(df: DataFrame, path: str) -> None:
    """Parquet."""
    df.write.mode("overwrite").parquet(path)


class Checkpoints:
    """Named Parquet checkpoints below a folder, with metadata beside them."""

    def __init__(self, spark: SparkSession, base: str, enabled: bool = True, retention_days: int = 7):
        self.spark, self.base, self.enabled, self.retention_days = spark, base.rstrip("/"), enabled, retention_days

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.base)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def save(self, df: DataFrame, name: str, force: bool = False) -> DataFrame:
        """df written and read again; an existing checkpoint is read unless forced."""
        if not self.enabled:
            return df
        if not force:
            found = self.load(name)
            if found is not None:
                return found
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def load(self, name: str) -> DataFrame | None:
        """The checkpoint, or None."""
        try:
            return self.spark.read.parquet(self.path(name))
        except AnalysisException:
            return None

    def exists(self, name: str) -> bool:
        return self.load(name) is not None

    def names(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.base)):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path(self.base)) if s.isDirectory())

    def info(self, name: str) -> dict | None:
        """Rows, columns, and the time of the last change; None where there is no checkpoint."""
        df = self.load(name)
        if df is None:
            return None
        fs, path = self._fs()
        changed = fs.getFileStatus(path(self.path(name))).getModificationTime() / 1000
        return {"name": name, "path": self.path(name), "columns": df.columns, "rows": df.count(), "modified": datetime.fromtimestamp(changed, timezone.utc).isoformat()}

    def expired(self, now: float | None = None) -> list[str]:
        """Checkpoints older than the retention; deleting them is left to the caller."""
        fs, path = self._fs()
        limit = ((now or time.time()) - 86_400 * self.retention_days) * 1000
        return [n for n in self.names() if fs.getFileStatus(path(self.path(n))).getModificationTime() < limit]

    def drop(self, name: str) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path(name)), True)

    def describe(self) -> str:
        return json.dumps([self.info(n) for n in self.names()], sort_keys=True)
