"""Shared plumbing: the scratch folder, written intermediate tables, global ranks, files."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bitmaps that tell scans which rows to look at have 2**LEAST_BITS to 2**MOST_BITS bits, by the number of keys.
LEAST_BITS, MOST_BITS = 20, 30

_LOCAL_BASE: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, the folder that driver and executors share.

    Only where that setting is absent in a session on one machine (as in tests) a local folder
    takes its place; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL_BASE.get("dir") or _LOCAL_BASE.setdefault("dir", tempfile.mkdtemp(prefix="sparkloom-"))
    return f"{base.rstrip('/')}/sparkloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the scratch folder and reads it back: lineage is cut, and a lost
    executor costs no more than the tasks that it ran."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As materialise, with the path, for tables that are dropped once they are consumed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path on whatever file system holds it."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Intermediate tables of one computation, below one folder, dropped when they are consumed."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._folder, self._paths = spark, scratch_path(spark, name), {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back; a name that is used again replaces the older table afterwards."""
        path = f"{self._folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.drop(name)
        self._paths[name] = path
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self._paths:
                drop_path(self._spark, self._paths.pop(name))

    def close(self) -> None:
        drop_path(self._spark, self._folder)


def bits_for(keys: int) -> int:
    """The logarithm of a bitmap's size: 16 bits for each key at least, up to 2**MOST_BITS (128 MB) in all.

    Beyond some 10^8 keys a bitmap lets more rows through than it must; what passes is always decided by a join.
    """
    return max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(16 * keys + 1))))


def bitmap(places: DataFrame, size: int) -> bytes:
    """2**size bits, set at the places (column `bit`, from 1 to 2**size)."""
    import numpy as np

    rows = places.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((1 << size) // 8, dtype=np.uint8)
    for bucket, bits in rows.collect():  # at most 2**size / 32768 rows of 4 kB
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(bits), dtype=np.uint8)
    return out.tobytes()


_HELD: dict = {}


def held(key, make):
    """What make() gives, once for each Python worker and key. A worker holds one such thing at a time, as
    it outlives its stage and would else pile up the tables of all operators that it has served."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def tidy(run):
    """run, over Arrow batches; when a task ends its worker gives what it has freed back to the system.

    Workers outlive their tasks, and allocators keep what is freed: idle ones would hold the peak of all
    stages that they have served beside those at work.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def trim() -> None:
    """Gives freed memory of this process back to the system, where its allocators can do so."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def sliced(batches, rows: int = 500):
    """Arrow batches cut into slices, so that what is made of one at a time stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a path or of a URI with a scheme."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = os.path.abspath(uri)
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when it is whole.

    Each attempt of a task writes to a name of its own and then renames, so a retried or
    speculative attempt can never leave a half-written file behind the final name.
    """

    def __init__(self, uri: str):
        self._fs, self._path = filesystem(uri)
        self._temp = f"{self._path}.{uuid.uuid4().hex}.tmp"
        self._fs.create_dir(os.path.dirname(self._path), recursive=True)
        self._out = self._fs.open_output_stream(self._temp, compression=None)

    def write(self, data) -> None:
        self._out.write(data)

    def commit(self) -> None:
        self._out.close()
        self._fs.move(self._temp, self._path)


def global_positions(df: DataFrame, order: list, name: str, position: str = "position") -> DataFrame:
    """Adds each row's place (from 0) in the total order of df by `order`.

    A range shuffle sorts the rows over all partitions; one small table holds the number of
    rows of each partition (its size is the number of partitions, whatever the rows), and its
    running sum turns places within partitions into global ones. No task sees more than a range.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    table = materialise(ranged, name)
    part = F.shiftright("_mid", 33)
    counts = table.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        table.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(position, F.col("_offset") + F.col("_mid").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_offset", "_mid")
    )
