"""Near copies: SimHash blocks first, then an exact join of word shingles for what they cannot reach.

Two texts are linked when their sets of word shingles have a Jaccard similarity of `similarity`
or more; a group is a connected component of links. Words are the runs between ASCII white space
of the text with A-Z lower-cased; a text of fewer words than a shingle is one shingle.

Candidates come in two steps, and shingles decide on all of them.

1. Stars. Fingerprints of the shingle sets meet by pigeonhole blocks and Hamming distance, as in
   `simhash`; besides, texts meet by the shingles of their prefixes (below). In either way a text
   is only compared with the one pivot that it shares most keys with. That collapses crowds.
2. The rest. Shingles have one order, and two similar texts share a shingle among the first
   `size - ceil(similarity * size) + 1` of each, whatever the order; so texts that share a prefix
   shingle are candidates and no link is lost, whatever the kind of edit. The order puts rare ones
   first, as they bring together little else. Any order that is the same for all texts will do, so
   not all shingles need to be counted: first come those with a low hash (a share of `_LOW`) that
   few texts hold, by their number of texts; then those with a high hash; last the frequent ones
   with a low hash. A prefix is a fifth of a text, so most texts never get beyond the first class,
   and the high hashes are counted over those texts alone that do (crowds, and short texts by
   chance). Shingles of one text alone never meet anything and are dropped where they are counted,
   so most texts have no prefix left.

   Pairs that stars have joined already are not made; of the others, places in the prefixes bound
   what two texts can share, and parities of 1,024 bins of their shingles bound from below how much
   they differ. Both bounds are sound.

So a crowd of near copies meets its pivot, not itself. What is left is those members below the
similarity with the pivot that the bounds allow to be similar to another member.

Texts are known by 128-bit digests of their words, and in the join by one half of it; halves that
clash (none are expected below 10^9 texts) are replaced by the other half.

Defined results: null, empty and blank texts are copies of each other; exact copies and repeated
rows are one text; a null id never becomes a group's id unless the group has no other; an empty
table gives an empty table. Only the id and text columns are read, and columns of any name come
back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from sparkloom.llm.common import Scratch, bitmap, bits_for, materialise, sliced, tidy, trim
from sparkloom.llm.simhash import block_masks, connected

#: Shingles that one range of the join holds in memory, and bins of the parities.
_RANGE, _BINS = 2_000_000, 1024
#: The share of hashes that are low, and how many texts hold a rare one at most.
_LOW, _RARE = 0.35, 16
_LOW_END = int(_LOW * (1 << 64))
_PACKED, _PACKED_TEXTS = 2_000_000, 60_000
_MOST_TASKS = 10_000
_MOST_CLASHES = 1_000_000
_KNOWN_WORDS = 1_000_000
_EPS = 1e-9


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; words are hashed once."""

    def __init__(self, width: int):
        self._width, self._known = width, {}

    def words(self, text: bytes | None) -> list[bytes]:
        return (text or b"").lower().split()

    def __call__(self, words: list[bytes]):
        import numpy as np
        import xxhash

        known = self._known
        if len(known) > _KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 11)
        each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self._width, len(words))
        last = len(words) - width + 1
        mixed = np.full(last, 0x2545F4914F6CDD1D + width, np.uint64)
        for i in range(width):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + each[i : i + last]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return np.unique(mixed ^ (mixed >> np.uint64(31)))


def set_fingerprint(shingles) -> int:
    """The 64-bit SimHash of a set of hashes, signed."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for lo in range(0, len(shingles), 8192):
        part = shingles[lo : lo + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<i8")[0])


def _node_of(digest: bytes, clashing, bits: int) -> int:
    """A text's number: the low half of its digest, or the high one where the low one clashes."""
    low = int.from_bytes(digest[:8], "big", signed=True) >> (64 - bits)
    return int.from_bytes(digest[8:], "big", signed=True) if low in clashing else low


def texts_table(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int = 64) -> DataFrame:
    """(id, words, node, size, low, fp) of each row: the digest of its words, its number, the number of its
    shingles and of those with a low hash, and their fingerprint."""
    import pyarrow as pa

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        import xxhash

        cut = Shingler(shingle)
        for batch in sliced(batches):
            keys, sizes, lows, prints = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = cut.words(text)
                found = cut(words)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sizes.append(len(found))
                lows.append(_lows(found))
                prints.append(set_fingerprint(found))
            nodes = [_node_of(k, (), bits) for k in keys]
            columns = [batch.column(0), pa.array(keys, pa.binary()), *(pa.array(x, pa.int64()) for x in (nodes, sizes, lows, prints))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "words", "node", "size", "low", "fp"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(tidy(run), f"id {kind}, words binary, node bigint, size bigint, low bigint, fp bigint")


def _lows(shingles) -> int:
    """How many of sorted hashes are low."""
    import numpy as np

    return int(np.searchsorted(shingles, np.uint64(_LOW_END)))


def _half(words: str) -> Column:
    """The high half of a digest as a number, as _node_of has it."""
    return F.conv(F.hex(F.substring(words, 9, 8)), 16, -10).cast("bigint")


class Texts:
    """The texts of a frame by number: each one's words are known by their digest."""

    def __init__(self, docs: DataFrame, text_col: str, shingle: int, clashing: frozenset, bits: int):
        self.spark = docs.sparkSession
        self._texts = docs.select(F.col(text_col).cast("binary").alias("text"))
        self._shingle, self._clashing, self._bits = shingle, clashing, bits

    def marks(self, nodes: DataFrame):
        """A bitmap of nodes (node): (broadcast, size)."""
        size = bits_for(nodes.count())
        place = F.col("node").bitwiseAND((1 << size) - 1) + 1
        return self.spark.sparkContext.broadcast(bitmap(nodes.select(place.alias("bit")), size)), size

    def map(self, work, schema: str, marks=None) -> DataFrame:
        """work, over an iterator of (node, function that gives the shingles) of the texts, those alone that marks may mean."""
        shingle, clashing, bits = self._shingle, self._clashing, self._bits

        def run(batches):
            import numpy as np
            import xxhash

            cut = Shingler(shingle)
            seen, size = (np.frombuffer(marks[0].value, np.uint8), marks[1]) if marks else (None, 0)

            def each():
                for batch in sliced(batches):
                    for text in batch.column(0).to_pylist():
                        words = cut.words(text)
                        node = _node_of(xxhash.xxh3_128_digest(b" ".join(words)), clashing, bits)
                        place = node & ((1 << size) - 1)
                        if seen is None or seen[place >> 3] >> (place & 7) & 1:
                            yield node, lambda words=words: cut(words)

            return work(each())

        return self._texts.mapInArrow(tidy(run), schema)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, size, tokens, bits) of the wanted nodes: their shingles, and parities of how many fall in each bin."""
        import pyarrow as pa

        def work(each):
            import numpy as np

            held: list = []

            def flush():
                nodes, tokens, bits = zip(*held)
                columns = [pa.array(nodes, pa.int64()), pa.array([len(t) for t in tokens], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (tokens, bits))]
                return pa.RecordBatch.from_arrays(columns, ["node", "size", "tokens", "bits"])

            for node, shingles in each:
                tokens = shingles()
                bins = np.bincount((tokens & np.uint64(_BINS - 1)).astype(np.int64), minlength=_BINS)
                held.append((node, tokens.view(np.int64), np.packbits((bins & 1).astype(np.uint8)).view("<i8")))
                if len(held) == 200:
                    yield flush()
                    held.clear()
            if held:
                yield flush()

        found = self.map(work, "node bigint, size bigint, tokens array<bigint>, bits array<bigint>", self.marks(wanted))
        return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])

    def shared(self, low: bool, total: int, marks=None) -> DataFrame:
        """(node, token, df): the low or the high shingles that several of the texts hold, df being how many.

        Each task packs its shingles by range; ranges are sorted within their tasks, and one range at a
        time is counted. Copies of a text fall together by its number.
        """
        import pyarrow as pa

        ranges = max(1, -(-total // _RANGE))
        tasks = min(ranges, _MOST_TASKS)
        names = ["range", "nodes", "places", "tokens"]

        def pack(each):
            import numpy as np

            held, waiting, seen = 0, [], set()
            start, width = (0, _LOW_END) if low else (_LOW_END, (1 << 64) - _LOW_END)

            def flush():
                nodes = np.array([n for n, _ in waiting], np.int64)
                tokens = np.concatenate([x for _, x in waiting])
                owner = np.repeat(np.arange(len(waiting)), [len(x) for _, x in waiting])
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                at = np.minimum((tokens - np.uint64(start)) // np.uint64(width // ranges + 1), np.uint64(ranges - 1))
                starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
                rows = []
                for lo, hi in zip(starts, [*starts[1:], len(at)]):
                    own, places = np.unique(owner[lo:hi], return_inverse=True)
                    rows.append((int(at[lo]), nodes[own].tobytes(), places.astype("<u2").tobytes(), tokens[lo:hi].tobytes()))
                for lo in range(0, len(rows), 256):
                    columns = list(zip(*rows[lo : lo + 256]))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)

            for node, shingles in each:
                if node not in seen:
                    seen.add(node)
                    tokens = shingles()
                    cut = _lows(tokens)
                    waiting.append((node, tokens[:cut] if low else tokens[cut:]))
                    held += len(waiting[-1][1])
                    if held >= _PACKED or len(waiting) >= _PACKED_TEXTS:
                        yield from flush()
                        held, waiting, seen = 0, [], set()
            if waiting:
                yield from flush()

        def count(batches):
            import numpy as np

            def flush(held):
                rows = [(np.frombuffer(n, "<i8"), np.frombuffer(p, "<u2"), np.frombuffer(t, "<u8")) for n, p, t in held]
                tokens, nodes = np.concatenate([r[2] for r in rows]), np.concatenate([r[0][r[1]] for r in rows])
                order = np.lexsort((nodes, tokens))
                tokens, nodes = tokens[order], nodes[order]
                once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])])
                tokens, nodes = tokens[once], nodes[once]
                starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
                df = np.diff(np.append(starts, len(tokens)))
                df = np.repeat(df, df)
                several = df > 1
                tokens, nodes, df = tokens[several].view(np.int64), nodes[several], df[several]
                for lo in range(0, len(tokens), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 50_000]) for x in (nodes, tokens, df)], ["node", "token", "df"])

            now, held = None, []
            for batch in sliced(batches):
                for at, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if at != now and held:
                        yield from flush(held)
                        held = []
                    now = at
                    held.append(row)
            if held:
                yield from flush(held)

        packed = self.map(pack, "range int, nodes binary, places binary, tokens binary", marks)
        place = F.floor(F.col("range").cast("bigint") * tasks / ranges).cast("int")
        return packed.repartitionById(tasks, place).sortWithinPartitions("range").mapInArrow(tidy(count), "node bigint, token bigint, df bigint")


def prefixes(texts: Texts, classes: DataFrame, similarity: float, keep: Scratch) -> DataFrame:
    """(node, size, token, pos): the shared shingles of each text's prefix, with their place in its order."""
    total = classes.agg(F.coalesce(F.sum("low"), F.lit(0))).first()[0]
    of = lambda rows: rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    none = F.array().cast("array<bigint>")
    chosen = lambda keeps: F.coalesce(F.filter("t", keeps)["token"], none)
    low = classes.select("node", "size", "low").join(of(texts.shared(True, total)), "node", "left").select(
        "node", "size", "low", (F.col("size") - F.ceil(F.col("size") * similarity - _EPS) + 1).cast("int").alias("prefix"),
        chosen(lambda x: x["df"] <= _RARE).alias("rare"), chosen(lambda x: x["df"] > _RARE).alias("frequent"),
    )
    # Places: low ones of this text alone, rare ones, high ones of it alone, shared high ones, frequent ones.
    alone, first = F.col("low") - F.size("rare") - F.size("frequent"), F.col("low") - F.size("frequent")
    low = keep(low.where((alone < F.col("prefix")) | (first < F.col("prefix"))), "prefix-low")
    beyond = low.where(first < F.col("prefix"))
    more = beyond.agg(F.coalesce(F.sum(F.col("size") - F.col("low")), F.lit(0))).first()[0]
    every = low.withColumn("high", none)
    if more:
        high = of(texts.shared(False, more, texts.marks(beyond.select("node")))).select("node", F.col("t")["token"].alias("high"))
        every = low.join(high, "node", "left").withColumn("high", F.coalesce("high", none))
    placed = lambda tokens, start: F.transform(tokens, lambda x, i: F.struct(x.alias("token"), (start + i).cast("bigint").alias("pos")))
    after = F.col("size") - F.col("low")
    order = F.concat(placed("rare", alone), placed("high", first + after - F.size("high")), placed("frequent", first + after))
    kept = every.select("node", "size", F.explode(F.filter(order, lambda x: x["pos"] < F.col("prefix"))).alias("x"))
    return keep(kept.select("node", "size", "x.token", "x.pos"), "prefixes")


def _common_needed(similarity: float, both: Column) -> Column:
    """How many shingles two texts of so many shingles together must share."""
    return F.ceil(both * (similarity / (1 + similarity)) - _EPS)


def _may_share(similarity: float, a: str, b: str) -> Column:
    """Whether the sizes and the places of a shared shingle in two prefixes allow a link."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    left = F.least(size_a - F.col(f"{a}.pos"), size_b - F.col(f"{b}.pos"))
    return left >= _common_needed(similarity, size_a + size_b)


def _best(pairs: DataFrame, kind: int) -> DataFrame:
    """(u, v, kind): of the pairs (u, v), one row for each key, each u with the v that it shares most keys with."""
    shared = pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("u").agg(F.max_by("v", F.struct("n", "v")).alias("v")).select("u", "v", F.lit(kind).alias("kind"))


def block_stars(classes: DataFrame, max_bits: int, blocks: int, keep: Scratch) -> DataFrame:
    """(u, v, kind): each text with the pivot whose fingerprint differs in at most max_bits bits and shares most blocks."""
    masks = block_masks(max_bits, blocks)
    keyed = classes.select("node", "fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(m)) for i, m in enumerate(masks)])).alias("bucket"))
    pivot = F.min(F.struct("node", "fp")).alias("pivot")
    pivots = keep(keyed.groupBy("bucket").agg(pivot, F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "pivot"), "block-pivots")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot.fp"))) <= max_bits
    met = keyed.join(pivots, "bucket").where((F.col("node") != F.col("pivot.node")) & close)
    return _best(met.select(F.col("node").alias("u"), F.col("pivot.node").alias("v")), 0)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v, ...) whose shingle sets are similar; pairs without sets are not."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    met = pairs.join(side("u"), "u").join(side("v"), "v")
    common, both = F.size(F.array_intersect("tokens_u", "tokens_v")), F.col("size_u") + F.col("size_v")
    return met.where(common >= similarity * (both - common) - _EPS).select(*pairs.columns)


def unlike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) without those that parities show to differ in too much."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))
    met = pairs.join(side("u"), "u").join(side("v"), "v")
    differ = F.aggregate(F.zip_with("bits_u", "bits_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda x, y: x + y)
    both = F.col("size_u") + F.col("size_v")
    return met.where(differ <= both - 2 * _common_needed(similarity, both)).select("u", "v")


def similar_links(texts: Texts, classes: DataFrame, keep: Scratch, similarity: float, max_bits: int, blocks: int) -> DataFrame:
    """(u, v): links whose components are those of all links."""
    members = prefixes(texts, classes, similarity, keep)
    central = F.min(F.struct((F.col("pos") / F.col("size")).alias("depth"), "node", "size", "pos"))
    buckets = keep(members.groupBy("token").agg(central.alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "pivot.node", "pivot.size", "pivot.pos"), "buckets")
    members = keep(members.join(buckets.select("token"), "token", "left_semi"), "members")
    # Only texts that share a prefix shingle can have links; their sets are made once.
    sets = keep(texts.sets(keep(members.select("node").distinct(), "wanted")), "sets")
    keep.drop("prefix-low", "prefixes")
    met = members.alias("m").join(buckets.alias("p"), "token").where((F.col("m.node") != F.col("p.node")) & _may_share(similarity, "m", "p"))
    tried = block_stars(classes, max_bits, blocks, keep).union(_best(met.select(F.col("m.node").alias("u"), F.col("p.node").alias("v")), 1))
    stars = keep(verified(keep(tried, "tried"), sets, similarity), "stars")

    # A text's label is the pivot that it is linked to, over up to four links.
    label = keep(stars.groupBy(F.col("u").alias("node")).agg(F.max_by("v", F.struct("kind", "v")).alias("label")), "labels")
    for _ in range(2):
        after = label.select(F.col("node").alias("label"), F.col("label").alias("next"))
        label = keep(label.join(after, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
    placed = members.join(label, "node", "left")
    placed = keep(placed.select("token", "node", "size", "pos", F.coalesce("label", "node").alias("label")), "placed")
    counted = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counted.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    inside = keep(placed.join(mixed.select("token", "main"), "token"), "inside")
    stray = inside.where("label <> main").alias("a")
    other = (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    pairs = stray.join(inside.alias("b"), (F.col("a.token") == F.col("b.token")) & other & _may_share(similarity, "a", "b"))
    pairs = pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
    rest = keep(unlike(keep(pairs, "rest"), sets, similarity), "rest")
    return stars.select("u", "v").union(verified(rest, sets, similarity))


def similar_classes(
    docs: DataFrame, keep: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
    max_bits: int = 3, blocks: int = 6, node_bits: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """((id, words) of each row, (words, node, least, n, root) of each text); root is null for a text without a link.

    node_bits: fewer bits serve to test clashing numbers.
    """
    rows = keep(texts_table(docs, id_col, text_col, shingle, node_bits), "texts")
    classes = rows.groupBy("words").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("node", "size", "low", "fp")])
    classes = keep(classes, "classes")
    clashes = classes.groupBy("node").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("node")
    clashing = frozenset(r[0] for r in clashes.limit(_MOST_CLASHES).collect())  # n * n / 2**65 of n texts are expected
    if clashing:
        moved = F.col("node").isin(*clashing)
        classes = keep(classes.withColumn("node", F.when(moved, _half("words")).otherwise(F.col("node"))), "classes-moved")
        if classes.groupBy("node").count().where("count > 1").limit(1).count():
            raise ValueError("texts cannot be told apart by either half of their digests")
    texts = Texts(docs, text_col, shingle, clashing, node_bits)
    links = keep(similar_links(texts, classes, keep, similarity, max_bits, blocks), "links")
    roots = connected(links, keep)
    roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    return rows, keep(classes.join(roots, "node", "left"), "grouped")


def _least_of(classes: DataFrame) -> DataFrame:
    """(group, first): of each group the row that stays, the one of the smallest id."""
    first = F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "words")).alias("first")
    return classes.groupBy(F.coalesce("root", "node").alias("group")).agg(first)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, component_id) for each row: groups of texts whose sets of word shingles are similar."""
    keep = Scratch(docs.sparkSession, "similar")
    rows, classes = similar_classes(docs, keep, id_col, text_col, **options)
    named = classes.withColumn("group", F.coalesce("root", "node")).join(_least_of(classes), "group")
    found = rows.join(named.select("words", F.col("first.least").alias("component_id")), "words", "left").select("id", "component_id")
    found = materialise(found, "similar-groups")
    keep.close()
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without near copies: of each group the row with the smallest id.

    Rows with a null id stay only where their group has no other id. A row is known by its id and
    its words, so different texts under one id, or without one, are documents of their own;
    repeated rows (same id and words) count as one document, of which one row stays.

    Rows whose text is alone are let through where they lie; a bitmap of the other texts tells
    which rows are shuffled to meet the decision.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    keep = Scratch(spark, "similar")
    rows, classes = similar_classes(docs, keep, id_col, text_col, **options)
    key = lambda i, words: F.concat(F.hex(words), F.coalesce(F.concat(F.lit(":"), i.cast("string")), F.lit("")))
    touched = classes.where("n > 1 or root is not null")
    staying = _least_of(touched).select(key(F.col("first.least"), F.col("first.words")).alias("key"))
    gone = rows.join(touched.select("words"), "words", "left_semi").select(key(F.col("id"), F.col("words")).alias("key")).distinct()
    gone = materialise(gone.join(staying, "key", "left_anti"), "similar-gone")
    size = bits_for(touched.count())
    place = F.conv(F.substring(F.hex("words"), 1, 8), 16, 10).cast("bigint").bitwiseAND((1 << size) - 1)
    sent = spark.sparkContext.broadcast(bitmap(touched.select((place + 1).alias("bit")), size))
    def touching(texts):
        import numpy as np
        import xxhash

        marks = np.frombuffer(sent.value, np.uint8)

        def digest(text):
            found = xxhash.xxh3_128_digest(b" ".join((text or b"").lower().split()))
            at = int.from_bytes(found[:4], "big") & ((1 << size) - 1)
            return found if marks[at >> 3] >> (at & 7) & 1 else None

        for column in texts:
            yield pa.array([digest(t.as_py()) for t in column], pa.binary())
        trim()

    # Python is given the text alone and returns a digest, or null; rows wait beside it. Not deterministic: evaluated once.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = F.arrow_udf(touching, "binary", ArrowUDFType.SCALAR_ITER).asNondeterministic()
    given = docs.select(row, marked(F.col(text_col).cast("binary")).alias("words"))
    decided = given.where("words is not null").select("row", key(F.col(f"row.`{id_col}`"), F.col("words")).alias("key"))
    decided = decided.join(gone, "key", "left_anti").dropDuplicates(["key"])
    keep.close()  # what is left to run needs `gone` and the bitmap alone
    return given.where("words is null").select("row.*").union(decided.select("row.*"))
