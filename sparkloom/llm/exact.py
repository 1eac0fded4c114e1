"""Document fingerprints: a canonical exact digest.

The canonical form of a text is NFKC, case-folded, NFKC again, its white space runs folded into
single spaces and its ends trimmed. The fingerprint is the 128-bit XXH3 of its UTF-8 bytes.
Texts of one digest are compared byte by byte: of each digest that occurs more than once
the least and the greatest form are found, so copies collapse before the shuffle, and differ
where digests collide. Where a
digest stands for several forms, the first in byte order keeps it and the others get their
SHA-256 as a suffix; so fingerprints, those of edited texts among them, are equal if and only if
canonical forms are.

Which digests repeat is told to the scan by a bitmap whose size follows their number, up to 128 MB;
what passes it by chance is only grouped in vain.

Each document also meets the next one by ascending id. Texts are shuffled once, compressed, into
ranges of ids; the last document of a range waits for the first of the next.

Defined results: a null text is an empty one; equal ids are ordered by a 64-bit hash of the
text; null ids come first; the document after the last is the first; an empty table gives an
empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bitmap, bits_for, materialise, sliced

_PAIR_SCHEMA = (
    "kind int, part int, id bigint, ztext binary, n_chars bigint, edited_sha256 string, digest string, "
    "edited_digest string, form_sha binary, edited_form_sha binary, near_edited double, near_next double"
)


def canonical(text: str) -> bytes:
    """The canonical form, as UTF-8."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest_of(form: bytes, bits: int = 128) -> str:
    """The hex digest of a canonical form; fewer bits serve to test collisions."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(form)[: bits // 4]


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(rows: list, bits: int):
    """Values of one document (id, ztext, text, form) and the text and form of the next."""
    (number, text, form), (following, next_form) = rows
    other = edited(text, following)
    other_form = canonical(other)
    return {
        "kind": 0, "id": number, "n_chars": len(text),
        "edited_sha256": hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
        "digest": digest_of(form, bits), "edited_digest": digest_of(other_form, bits),
        "form_sha": hashlib.sha256(form).digest(), "edited_form_sha": hashlib.sha256(other_form).digest(),
        "near_edited": float(form == other_form), "near_next": float(form == next_form),
    }


def _batch(rows: list):
    import pyarrow as pa

    schema = pa.schema([
        ("kind", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("ztext", pa.binary()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
        ("digest", pa.string()), ("edited_digest", pa.string()), ("form_sha", pa.binary()), ("edited_form_sha", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def paired(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """One row for each document, with its digest and what the next document makes of it."""
    import pyarrow as pa

    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = picked.select("id", F.xxhash64("text").alias("tie"), "text")

    def pack(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(3).compress
        for batch in sliced(batches):
            packed = [squeeze(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "tie", "ztext"])

    def meet(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        part, held, first = TaskContext.get().partitionId(), None, True
        for batch in sliced(batches):
            rows = []
            for number, ztext in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                text = unpack(ztext).decode("utf-8", "surrogatepass")
                form = canonical(text)
                if first:
                    rows.append({"kind": 1, "part": part, "id": number, "ztext": ztext})
                    first = False
                if held:
                    rows.append(_pairs([held[:3], (text, form)], bits))
                held = (number, text, form, ztext)
            yield _batch(rows)
        if held:
            yield _batch([{"kind": 2, "part": part, "id": held[0], "ztext": held[3]}])

    def close(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for number, mine, after in zip(*(c.to_pylist() for c in batch.columns)):
                text, following = (unpack(z).decode("utf-8", "surrogatepass") for z in (mine, after))
                rows.append(_pairs([(number, text, canonical(text)), (following, canonical(following))], bits))
            yield _batch(rows)

    ranged = picked.mapInArrow(pack, "id bigint, tie bigint, ztext binary").repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "ztext")
    met = materialise(ranged.mapInArrow(meet, _PAIR_SCHEMA), "exact-pairs")
    heads = met.where("kind = 1").select(F.col("part").alias("next_part"), F.col("ztext").alias("after"))
    # The ranges that hold rows: a list of task numbers, whatever the rows.
    parts = sorted(r[0] for r in heads.select("next_part").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    ends = met.where("kind = 2").join(follows, "part").join(heads, "next_part").select("id", "ztext", "after")
    whole = met.where("kind = 0").unionByName(ends.mapInArrow(close, _PAIR_SCHEMA))
    return whole.drop("kind", "part", "ztext")


def collisions(docs: DataFrame, pairs: DataFrame, text_col: str, bits: int) -> DataFrame:
    """(digest, first_sha): of each digest that stands for several forms the form that keeps it.

    That is the first one in byte order of the documents' forms, found by comparing bytes; where
    only edited texts clash, with a document or with each other, their SHA-256 tell.
    """
    import pyarrow as pa

    each = pairs.select("digest", "form_sha", F.lit(0).alias("kind")).union(pairs.select("edited_digest", "edited_form_sha", F.lit(1)))
    groups = each.groupBy("digest").agg(
        F.count(F.when(F.col("kind") == 0, 1)).alias("n"), F.min(F.struct("kind", "form_sha")).alias("first"),
        F.min("form_sha").alias("lo"), F.max("form_sha").alias("hi"),
    )
    groups = materialise(groups.where("n > 1 or lo <> hi"), "exact-groups")
    repeated = groups.where("n > 1")
    size = bits_for(repeated.count())
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint").bitwiseAND((1 << size) - 1) + 1
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(repeated.select(place.alias("bit")), size))

    def forms(batches):
        import numpy as np

        marks, mask = np.frombuffer(sent.value, dtype=np.uint8), (1 << size) - 1
        for batch in sliced(batches):
            found = [(digest_of(f, bits), f) for f in (canonical(t or "") for t in batch.column(0).to_pylist())]
            places = [int(d[:8], 16) & mask for d, _ in found]
            found = [x for x, p in zip(found, places) if marks[p // 8] >> (p % 8) & 1]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.string()), pa.array([f for _, f in found], pa.binary())], ["digest", "form"])

    met = docs.select(text_col).mapInArrow(forms, "digest string, form binary").groupBy("digest").agg(F.min("form").alias("lo"), F.max("form").alias("hi"))
    by_bytes = met.where("lo <> hi").select("digest", F.unhex(F.sha2("lo", 256)).alias("least_sha"))
    clashes = groups.where("lo <> hi").join(materialise(by_bytes, "exact-bytes"), "digest", "left")
    return materialise(clashes.select("digest", F.coalesce("least_sha", "first.form_sha").alias("first_sha")), "exact-collisions")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""
    pairs = paired(docs, id_col, text_col, bits)
    clashes = collisions(docs, pairs, text_col, bits)

    def named(rows: DataFrame, digest: str, form_sha: str, name: str) -> DataFrame:
        first = clashes.select(F.col("digest").alias(digest), "first_sha")
        own = F.when(F.col("first_sha") != F.col(form_sha), F.concat_ws("-", digest, F.lower(F.hex(form_sha)))).otherwise(F.col(digest))
        return rows.join(first, digest, "left").withColumn(name, own).drop("first_sha")

    if clashes.isEmpty():
        done = pairs.withColumn("fingerprint", F.col("digest")).withColumn("edited_fingerprint", F.col("edited_digest"))
    else:
        done = named(named(pairs, "digest", "form_sha", "fingerprint"), "edited_digest", "edited_form_sha", "edited_fingerprint")
    return done.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
