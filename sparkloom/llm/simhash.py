"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected groups.

A document's words are the runs between ASCII white space of its text with A-Z lower-cased;
its features are the XXH64 hashes of word shingles, repeats included. Documents whose 64-bit
fingerprints differ in at most `max_bits` bits are linked; a group is a connected component.

Cut the 64 bits into `blocks` blocks: two fingerprints that differ in at most d bits agree on
at least blocks - d whole blocks, so they share a key in at least one of the C(blocks, d)
tables that keep that many blocks. With 6 blocks and 3 bits that is 20 tables whose keys hold
31 bits at least, so chance meetings stay rare far beyond a billion distinct fingerprints.

No bucket is ever expanded into its pairs. First each text is compared with the one bucket
pivot that it shares most keys with; those links, connected, settle nearly all. Then the ends
of components that still share a bucket are compared, and at last what lies outside a bucket's
largest component with what lies in others. Pairs within one component cannot change the
result, so nothing is lost.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other;
exact copies and repeated rows share a fingerprint and so a group; a null id never becomes a
group's id unless the group has no other; an empty table gives an empty table. Only the id and
text columns are read, so further columns may have any names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, materialise, sliced

_CHUNK = 8192
#: Edges that one task joins up by itself.
_TASK_EDGES = 1 << 19


def _fingerprint(data: bytes, width: int, seed: int) -> int:
    import numpy as np
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, last, _CHUNK):
        hi = min(last, lo + _CHUNK)
        hashes = np.fromiter(
            (digest(b" ".join(words[i : i + width]), seed) for i in range(lo, hi)), "<u8", hi - lo
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((ones * 2 > last).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row, as a signed long."""
    import pyarrow as pa

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in sliced(batches):
            fps = [_fingerprint(t or b"", shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    id_type = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {id_type}, fp bigint")


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """The masks of the tables, as signed 64-bit integers."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(kept) for kept in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _stars(u, v):
    """(node, least node of its component) of edges given as arrays, for each node that is not the least itself."""
    import numpy as np

    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        # Roots with a lesser neighbour are hooked to their least one, and paths cut short.
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(above := root[root], root):
            root = above
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (u, v) with the same components: in each task those that it reads become stars.

    A task takes up what it has found once more with every `_TASK_EDGES` new edges, so it holds these
    and an edge for each of its nodes at most.
    """
    import pyarrow as pa

    def run(batches):
        import numpy as np

        parts, found = [], None
        for batch in batches:
            parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(p[0]) for p in parts) >= _TASK_EDGES:
                found = _stars(*map(np.concatenate, zip(*parts, *([found] if found else []))))
                parts = []
        if parts:
            found = _stars(*map(np.concatenate, zip(*parts, *([found] if found else []))))
        if found:
            for lo in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in found], ["u", "v"])

    return edges.coalesce(tasks).mapInArrow(run, edges.schema)


def connected(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (u, v), root being the smallest node reachable.

    First each task turns `_TASK_EDGES` or so of the edges into stars. Where one task holds all, these
    are the result; else alternating large-star and small-star steps go on, each a grouped minimum with
    map-side combination and a join. Minima are written before they are joined, so both sides of each
    join are plain exchanges and the adaptive planner can split a hub's rows. Each round's
    tables replace those of the round before.
    """
    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "cc-edges")
    tasks = max(1, -(-now.count() // _TASK_EDGES))
    now = keep(_contracted(now, tasks), "cc-edges")
    mark = None
    while tasks > 1:
        sign = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if sign == mark or sign[0] == 0:
            break
        mark = sign
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")), "cc-large")
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        large = keep(large, "cc-starred")
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
    keep.drop("cc-large", "cc-starred", "cc-small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def hamming_pairs(max_bits: int):
    """A check of pairs (u, v) of fingerprints themselves."""
    return lambda pairs: pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)


def _with_roots(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(node, root) of the components of edges (u, v), roots included."""
    roots = connected(edges, keep)
    return keep(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")


def _placed(members: DataFrame, roots: DataFrame, keep: Scratch) -> DataFrame:
    """(bucket, node, comp) of members (bucket, node)."""
    placed = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp"))
    return keep(placed, "placed")


def _mixed(placed: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """((bucket, comp, low, high), (bucket, main, low, high)) of the buckets with several components:
    the least and greatest node of each component, and those of the largest one."""
    sizes = placed.groupBy("bucket", "comp").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"))
    sizes = keep(sizes, "sizes")
    largest = F.max_by(F.struct("comp", "low", "high"), F.struct("n", "comp")).alias("main")
    mixed = sizes.groupBy("bucket").agg(largest, F.count(F.lit(1)).alias("comps")).where("comps > 1")
    return sizes, keep(mixed.select("bucket", F.col("main.comp").alias("main"), F.col("main.low").alias("main_low"), F.col("main.high").alias("main_high")), "mixed")


def near_components(nodes: DataFrame, max_bits: int, blocks: int, check, keep: Scratch) -> DataFrame:
    """(node, root) for the nodes that have a neighbour; root names the component.

    nodes: (node, fp): a distinct long and the node's fingerprint.
    check: keeps those of distinct pairs (u, v) that are links.

    Pairs whose link would change nothing are never made: first each node meets the pivot (the
    least node of a bucket) that it shares most buckets with; then in buckets that still hold
    several components the ends of each meet those of the largest; at last, in the buckets that
    are left, what lies outside the largest component meets what lies in other components.
    """
    masks = block_masks(max_bits, blocks)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(m)) for i, m in enumerate(masks)])
    keyed = nodes.select("node", F.explode(keys).alias("bucket"))
    buckets = keep(
        keyed.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "buckets",
    )
    members = keep(keyed.join(buckets, "bucket"), "members")
    keep.drop("buckets")
    shared = members.where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy(F.col("node").alias("u")).agg(F.max_by("pivot", F.struct("n", "pivot")).alias("v"))
    stars = keep(check(best.select("u", "v")), "star-links")
    placed = _placed(members, _with_roots(stars, keep), keep)

    sizes, mixed = _mixed(placed, keep)
    if mixed.isEmpty():
        return _with_roots(stars, keep)
    ends = sizes.join(mixed, "bucket").where("comp <> main")
    near = F.max(F.struct("low", "main_high")).alias("near"), F.min(F.struct("high", "main_low")).alias("far")
    ends = keep(ends.groupBy("comp", "main").agg(*near), "ends")
    tried = ends.select(F.col("near.low").alias("u"), F.col("near.main_high").alias("v")).union(ends.select("far.high", "far.main_low"))
    links = keep(stars.union(check(tried.distinct())), "links")
    roots = _with_roots(links, keep)

    placed = _placed(members, roots, keep)
    _, mixed = _mixed(placed, keep)
    if mixed.isEmpty():
        return roots
    inside = keep(placed.join(mixed.select("bucket", "main"), "bucket"), "inside")
    stray = inside.where("comp <> main").select("bucket", F.col("node").alias("node2"), F.col("comp").alias("comp2"))
    met = inside.join(stray, "bucket").where("comp <> comp2").where("comp = main or node < node2")  # of two strays one order
    last = check(met.select(F.col("node").alias("u"), F.col("node2").alias("v")).distinct())
    return _with_roots(links.union(last), keep)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 3,
    blocks: int = 6,
    seed: int = 42,
) -> DataFrame:
    """(id, fp, component_id) for each row; component_id is the smallest id of its group."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-prints")
    keep = Scratch(docs.sparkSession, "simhash")
    classes = keep(prints.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = near_components(classes.select("node", F.col("node").alias("fp")), max_bits, blocks, hamming_pairs(max_bits), keep)
    # Only classes of several rows, or with a neighbour, need a name other than their own.
    grouped = classes.join(roots, "node", "left").where("n > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"), "least")
    grouped = keep(grouped, "grouped")
    least = keep(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = materialise(grouped.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "simhash-named")
    keep.close()
    return prints.join(named, "fp", "left").select("id", "fp", F.coalesce("component_id", "id").alias("component_id"))


def hex_fingerprint(column) -> "F.Column":
    """16 lower-case hex digits of the unsigned fingerprint."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")
