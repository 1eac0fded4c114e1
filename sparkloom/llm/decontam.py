"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z is lower-cased. Each window of
`window` consecutive words of a benchmark item (an item of fewer words, but not none, is one
window) is a pattern; one automaton over all patterns scans each document once. Words keep
their places in the original text, so hits come back as code point spans.

The automaton is sent to every task, so one holds about `slice_bytes` of benchmark text; a larger
benchmark is dealt by a hash into as many slices as it needs, each with an automaton of its own,
and the documents pass through one after the other, with what they have hit so far.

Defined results: a null or empty text has no words and no hits; items with a null text or no
words match nothing; repeated items count once per item_id; null item_ids are left out of the
items that are named, their windows still hit; an empty benchmark leaves every document clean.
Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, held, materialise, sliced

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

SCHEMA = (
    "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
    "spans array<struct<start:int,end:int>>"
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(items, window: int) -> dict[bytes, set]:
    """Each pattern with the ids of the items that hold it. items: (item_id, text)."""
    found: dict[bytes, set] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(0, len(words) - window) + 1 if words else 0):
            found.setdefault(b" ".join(words[i : i + window]), set()).add(item)
    return found


class Scanner:
    """The automaton and what its patterns stand for."""

    def __init__(self, items, window: int):
        import ahocorasick

        patterns = windows_of(items, window)
        self._automaton = ahocorasick.Automaton()
        for pattern, ids in patterns.items():
            # Latin-1 gives each UTF-8 byte one character, so offsets are byte offsets.
            self._automaton.add_word(f" {pattern.decode('latin-1')} ", (len(pattern), pattern.count(b" ") + 1, ids))
        self._live = bool(patterns)
        if self._live:
            self._automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(number of words, merged word ranges that are hit, ids of the items found)."""
        words = words_of(text)
        if not words or not self._live:
            return len(words), [], set()
        line = f" {b' '.join(words).decode('latin-1')} "
        found = list(self._automaton.iter(line))
        if not found:
            return len(words), [], set()
        import numpy as np

        starts = np.cumsum([1] + [len(w) + 1 for w in words[:-1]])
        items: set = set()
        ranges = []
        for end, (size, count, ids) in found:
            first = int(np.searchsorted(starts, end - size))
            ranges.append((first, first + count))
            items |= ids
        return len(words), merged_ranges(ranges), items


def merged_ranges(ranges) -> list[tuple[int, int]]:
    """Ranges that touch as one, in order."""
    merged: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [tuple(r) for r in merged]


def verdict(text: str | None, n_words: int, ranges: list[tuple[int, int]], items: set) -> tuple:
    """The values of SCHEMA."""
    spans = []
    if ranges:
        places = [m.span() for m in _WORD.finditer(text)]
        spans = [{"start": places[lo][0], "end": places[hi - 1][1]} for lo, hi in ranges]
    named = sorted(str(i) for i in items if i is not None)
    digest = hashlib.sha256(",".join(named).encode()).hexdigest()
    hit = sum(hi - lo for lo, hi in ranges)
    return n_words, hit, len(named), digest, hit > 0, spans


def benchmark_slices(benchmark: DataFrame, slice_bytes: int = 64 << 20):
    """The items, as (number of slices, a function that collects the items of one)."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))

    def collected(k: int) -> list:
        own = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        return [(r[0], r[1]) for r in own.collect()]  # about slice_bytes

    return slices, collected


def _sent(spark, items: list, window: int) -> tuple:
    """(broadcast items, their key)."""
    key = hashlib.sha256(repr((window, items)).encode("utf-8", "surrogatepass")).hexdigest()
    return spark.sparkContext.broadcast(items), key


def _scanner(key: str, items, window: int) -> Scanner:
    """One automaton for each Python worker, however many tasks it runs."""
    return held(("scanner", key), lambda: Scanner(items, window))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 10,
    slice_bytes: int = 64 << 20,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for each row of docs."""
    import pyarrow as pa

    spark = docs.sparkSession
    slices, collected = benchmark_slices(benchmark, slice_bytes)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), spans_type]
    names = ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]

    def judged(batch, rows):
        columns = list(zip(*(verdict(t, *r) for t, r in zip(batch.column(1).to_pylist(), rows)))) or [[]] * 6
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names)

    if slices == 1:
        sent, key = _sent(spark, collected(0), window)

        def run(batches):
            scanner = _scanner(key, sent.value, window)
            for batch in sliced(batches):
                yield judged(batch, [scanner.scan(t) for t in batch.column(1).to_pylist()])

        return picked.mapInArrow(run, f"id {kind}, {SCHEMA}")

    keep = Scratch(spark, "decontam")
    rows = picked.select("id", "text", F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<array<int>>").alias("ranges"), F.array().cast("array<string>").alias("items"))
    for k in range(slices):
        sent, key = _sent(spark, collected(k), window)

        def add(batches, sent=sent, key=key):
            scanner = _scanner(key, sent.value, window)
            for batch in sliced(batches):
                found = [scanner.scan(t) for t in batch.column(1).to_pylist()]
                ranges = [merged_ranges([*map(tuple, old), *new]) for old, (_, new, _) in zip(batch.column(3).to_pylist(), found)]
                items = [sorted({*old, *(str(i) for i in new if i is not None)}) for old, (_, _, new) in zip(batch.column(4).to_pylist(), found)]
                columns = [batch.column(0), batch.column(1), pa.array([n for n, _, _ in found], pa.int64()), pa.array(ranges, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text", "n_words", "ranges", "items"])

        rows = keep(rows.mapInArrow(add, rows.schema), "rows")

    def finish(batches):
        for batch in sliced(batches):
            yield judged(batch, [(n, [tuple(r) for r in ranges], set(items)) for n, ranges, items in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))])

    done = materialise(rows.mapInArrow(finish, f"id {kind}, {SCHEMA}"), "decontam")
    keep.close()
    return done


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = 10,
    slice_bytes: int = 64 << 20,
) -> DataFrame:
    """The rows of docs, with all their columns, that no window of the benchmark occurs in.

    One pass for each slice of the benchmark, without a shuffle: the scan decides each row where it lies.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    slices, collected = benchmark_slices(benchmark, slice_bytes)
    at = docs.columns.index(text_col)
    for k in range(slices):
        sent, key = _sent(spark, collected(k), window)

        def run(batches, sent=sent, key=key):
            scanner = _scanner(key, sent.value, window)
            for batch in sliced(batches):
                yield batch.filter(pa.array([not scanner.scan(t)[1] for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if k + 1 < slices:  # one automaton at a time is in memory
            docs = materialise(docs, "decontam-clean")
    return docs
