"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from sparkloom.llm import decontam, exact, quality, secrets, sentpiece, sharding, simhash, tokens, urls, warc

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of documents that are labelled good and not toxic."""
    return _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, written and read back."""
    docs = _table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    found = tokens.tokens_roundtrip(docs, public_tokenizers.path(BYTE_BPE))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of each page."""
    return urls.judge(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written as archives and read back."""
    found = warc.archives_roundtrip(_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each document and of its edited text."""
    return exact.fingerprints(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of each document."""
    found = sharding.assign(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit(sharding.LAW).alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, and whether they decode to the text."""
    found = sentpiece.roundtrip(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))
    return found.withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents and what the classifier decides."""
    found = quality.classify(_table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return found.withColumnRenamed("id", "doc_id")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", spans.alias("spans"))


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_tokens": op2_tokens,
        "op3_urls": op3_urls,
        "op4_warc": op4_warc,
        "op5_fingerprints": op5_fingerprints,
        "op6_sharding": op6_sharding,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_quality": op8_quality,
        "op9_secrets": op9_secrets,
        "op10_decontamination": op10_decontamination,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4_SQL = """
SELECT page_id, size AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN size >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 1000 AND page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, body, CAST(octet_length(encode(body)) AS BIGINT) AS size, max(page_id) OVER (PARTITION BY body) AS last
  FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))
"""

OP10_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item_id, 10 AS n, array_to_string(w[i:i + 9], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM items WHERE len(w) >= 10)
  UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM items WHERE len(w) BETWEEN 1 AND 9),
docs AS (SELECT doc_id, {_WORDS} AS w, string_split_regex({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS g FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows)),
hits AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM places) JOIN windows USING (n, gram)),
touched AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM hits),
words AS (SELECT doc_id, count(*) AS n_hit FROM touched GROUP BY doc_id),
runs AS (SELECT doc_id, min(place) AS lo, max(place) AS hi FROM (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM touched) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, lo, length(array_to_string(g[1:lo], '')) + length(array_to_string(w[1:lo - 1], '')) AS s, length(array_to_string(g[1:hi], '')) + length(array_to_string(w[1:hi], '')) AS e FROM runs JOIN docs USING (doc_id)),
spans AS (SELECT doc_id, string_agg(s || ':' || e, ',' ORDER BY lo) AS spans FROM cuts GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN spans USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Hashes, crc32, vocabularies and trained models keep SQL from expressing the others."""
    return {"op4_warc": OP4_SQL, "op10_decontamination": OP10_SQL}
