"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked there. The fractional rank
(2 * rank + 1) / (2 * rows of the source) spreads every source evenly over 0 to 1, so the order
by fractional rank mixes the sources in proportion everywhere, and cutting it into stretches
gives shards that all match the mixture. The law that holds is `rows`: the shards' row counts
are at most one apart. Rows are dealt singly, so groups of equal texts are not kept together.

Both orders come from range shuffles of narrow rows (no texts), in which a hot source is spread
over as many ranges as it needs; ranks follow from the sizes of the ranges.

Defined results: a null source is a source of its own; a null text counts 8 bytes and has the
crc32 of no bytes; repeated rows are dealt each for itself, ties in the shuffle broken by id,
crc32 and size; fewer rows than shards leave shards empty; an empty table gives an empty table.
Only the id, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import global_positions, materialise

LAW = "rows"
ROW_BYTES = 8


def assign(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, size, text_crc32, shard, slot) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("mixed", F.xxhash64(F.lit(seed), "id"))
    within = ["source", "mixed", "id", "text_crc32", "size"]
    ranked = global_positions(narrow, within, "shard-within")
    # One row for each source; null is a source, so it is joined under a key of its own.
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    ranked = ranked.withColumn("key", key)
    sources = materialise(
        ranked.groupBy("key").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("rows")), "shard-sources"
    )
    placed = ranked.join(sources, "key").select(
        "id", "source", "size", "text_crc32", "position",
        ((2 * (F.col("position") - F.col("first")) + 1) / (2.0 * F.col("rows"))).alias("fraction"),
    )
    mixed = global_positions(placed.withColumnRenamed("position", "tie"), ["fraction", "tie"], "shard-mixed")
    total = max(1, sources.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    # Shard k begins at the place ceil(k * total / shards).
    shard = F.expr(f"(position * {shards}L) div {total}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (
        mixed.withColumn("shard", shard.cast("bigint"))
        .withColumn("slot", (F.col("position") - first).cast("bigint"))
        .select("id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
    )


def write_shards(docs: DataFrame, folder: str, **options) -> DataFrame:
    """Writes the rows of docs into one folder for each shard; returns assign()'s rows.

    Each file holds a stretch of slots, in order. Rows with equal id and text are alike, so any of them may take any of their slots; they are
    told apart by a number within their copies.
    """
    from pyspark.sql import Window as W

    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    dealt = materialise(assign(docs, **options), "shard-dealt")
    copy = lambda keys, by: F.row_number().over(W.partitionBy(*keys).orderBy(by))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("by"),
    ).withColumn("copy", copy(["id", "source", "crc"], "by"))
    places = dealt.withColumn("copy", copy(["id", "source", "text_crc32"], "slot"))
    same = [F.col(f"r.{a}").eqNullSafe(F.col(f"p.{b}")) for a, b in (("id", "id"), ("source", "source"), ("crc", "text_crc32"), ("copy", "copy"))]
    out = rows.alias("r").join(places.alias("p"), same).select("p.shard", "p.slot", "r.row")
    # Ranges of (shard, slot), so that a shard of any size is written by as many tasks as it needs.
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return dealt
