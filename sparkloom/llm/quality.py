"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of characters.

The model is trained on all trusted text: n-grams of up to `ORDER` code points as they stand, no
classes and no folding, so its tables grow with the text and know every script. Counts are summed
in each task, shuffled by n-gram and joined, sharded, with the statistics of their contexts:
discounts come from the counts of counts, lower orders from continuation counts. Below the last
order each of the code points is as likely as any other.

Scores come from joins of counts as well. A character costs -log p of the longest n-gram that the
model holds, and the backing-off weights of the longer contexts that it holds. Of the most
frequent n-grams and contexts (`head` at most) each worker has a copy and adds their terms in
place; occurrences of others that a bitmap does not rule out are summed for each row, shuffled by
key and joined with the sharded table, and the joined terms are summed by row. Costs are integers
(millionths of a nat), so sums do not depend on their order.

The mean cost of a character strays the less the longer a text is, so a document's score is its
negative log-likelihood beyond that of as much trusted text of its language, for each square root
of its length (with `prior` characters more), in hundredths of a nat. It is rejected when its score
is above its language's threshold: the `quantile` of the scores of the language's trusted
documents, or 0 if that is greater. Trusted documents are held against a model of the half of the
trusted texts that they are not in (equal texts share a half). Quantiles are exact: they are read
off a histogram of hundredths. Counts are kept for both halves, so three models come from one count.

Defined results: a null or empty text has a score of 0 and stays; a null
language is one of its own, named ''; languages without trusted text take the mean and the threshold
of all trusted documents; without any trusted text everything stays and scores are null; repeated rows
count as often as they occur; labels with null ids match nothing; U+0000 counts as U+0001, the
mark in front of texts. Only the id, text and language columns are read, and columns of any name
come back unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from sparkloom.llm.common import Scratch, bitmap, bits_for, held, materialise, sliced, tidy

ORDER = 5
QUANTILE = 0.999
PRIOR = 40
HEAD = 1 << 20
#: Code points in all; the scale of costs; the models: of all trusted text and of either half.
_POINTS, _MICRO, _MODELS = 0x110000, 1_000_000, (0, 1, 2)
_MARK = 1
#: Characters that are worked on at a time: when scoring, and when counting.
_PIECE, _COUNTED = 1 << 19, 1 << 21
#: Odd multipliers, one for each place of an n-gram.
_PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def batches_of(texts: list[str], order: int, most: int = _PIECE):
    """(codes, places, owner) of parts of about `most` characters: code points with what stands in front,
    the places of the part's own characters, and the number of the text that each belongs to."""
    import numpy as np

    parts, owners, held = [], [], 0

    def joined():
        codes = np.concatenate(parts)
        sizes = np.array([len(p) - order + 1 for p in parts])
        starts = np.cumsum(sizes + order - 1) - sizes
        places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return codes, places, np.repeat(np.array(owners), sizes)

    for number, text in enumerate(texts):
        if not text:
            continue
        points = np.maximum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), _MARK)
        points = np.concatenate([np.full(order - 1, _MARK, np.uint32), points])
        for lo in range(0, len(points) - order + 1, most):
            parts.append(points[lo : lo + most + order - 1])
            owners.append(number)
            held += len(parts[-1])
            if held >= most:
                yield joined()
                parts, owners, held = [], [], 0
    if parts:
        yield joined()


def sum_of(codes, order: int):
    """The last of sums_of."""
    import numpy as np

    wide = codes.astype(np.uint64)
    out = wide * np.uint64(_PLACES[0])
    for k in range(1, order):
        out[k:] += wide[:-k] * np.uint64(_PLACES[k])
    return out


def sums_of(codes, order: int) -> list:
    """For k from 0 to order: a number for the k code points up to each place (wrong where fewer stand in front)."""
    import numpy as np

    wide = codes.astype(np.uint64)
    out = [np.zeros(len(wide), np.uint64)]
    for k in range(order):
        shifted = wide if k == 0 else np.concatenate([np.zeros(k, np.uint64), wide[:-k]])
        out.append(out[-1] + shifted * np.uint64(_PLACES[k]))
    return out


def mixed(sums, k: int, context: bool):
    """Keys of n-grams of k code points, or of contexts before a k-th one."""
    import numpy as np

    x = sums ^ np.uint64(0x2545F4914F6CDD1D * (2 * k + context) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def half_of(text: str) -> int:
    """Which half of the trusted texts a text falls in."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 5) & 1


def _trusted_place(column, kind: str, size: int):
    return F.xxhash64(column.cast(kind)).bitwiseAND((1 << size) - 1)


def trusted_texts(docs: DataFrame, trusted: DataFrame, marks, size: int, id_col: str, text_col: str) -> DataFrame:
    """(packed): the compressed texts of trusted rows; a bitmap of their ids spares most others the shuffle."""
    import pyarrow as pa

    kind = trusted.schema["id"].dataType.simpleString()
    picked = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text"), _trusted_place(F.col(id_col), kind, size).alias("place"))

    def run(batches):
        import numpy as np
        import zstandard

        pack, seen = zstandard.ZstdCompressor(3).compress, np.frombuffer(marks.value, np.uint8)
        for batch in sliced(batches):
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            packed = [pack(t.encode("utf-8", "surrogatepass")) if t else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "packed"])

    made = picked.mapInArrow(tidy(run), f"id {kind}, packed binary").where("packed is not null")
    # One plan for every size: both sides are shuffled, however few the trusted are.
    return made.join(trusted.hint("merge"), "id", "left_semi").select("packed")


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n1, n2) over rows of compressed texts: summed in each task, then by n-gram; how often it occurs in either half."""
    import pyarrow as pa

    def run(batches):
        import numpy as np
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        waiting: tuple[list, list] = ([], [])

        def flush(half):
            for codes, places, _ in batches_of(waiting[half], order, _COUNTED):
                keys = sum_of(codes, order)[places]
                _, first, n = np.unique(keys, return_index=True, return_counts=True)
                windows = np.ascontiguousarray(codes[places[first][:, None] + np.arange(1 - order, 1)], "<u4")
                grams = windows.view(f"<U{order}").ravel()
                zero = np.zeros(len(n), np.int64)
                for lo in range(0, len(n), 50_000):
                    part = slice(lo, lo + 50_000)
                    own = [zero[part], n[part].astype(np.int64)][:: 1 if half else -1]
                    yield pa.RecordBatch.from_arrays([pa.array(grams[part].tolist(), pa.string()), *map(pa.array, own)], ["gram", "n1", "n2"])
            waiting[half].clear()

        chars = [0, 0]
        for batch in sliced(batches):
            for packed in batch.column(0).to_pylist():
                text = unpack(packed).decode("utf-8", "surrogatepass")
                half = half_of(text)
                waiting[half].append(text)
                chars[half] += len(text)
                if chars[half] >= _COUNTED:
                    yield from flush(half)
                    chars[half] = 0
        for half in (0, 1):
            yield from flush(half)

    made = texts.select("packed").mapInArrow(tidy(run), "gram string, n1 bigint, n2 bigint")
    return made.groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney smoothing; 0.5, 1 and 1.5 where counts are too few."""
    n = [counts_of_counts.get(k, 0) for k in range(5)]
    if min(n[1:5]) == 0:
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05 * k), float(k)) for k in (1, 2, 3))


def _keyed(table: DataFrame, k: int, context: bool) -> DataFrame:
    """(key, n, full..., more...) of a table whose first column is the n-gram or context."""
    import pyarrow as pa

    size = k - context
    rest = [f"{c}{m}" for c in ("full", "more") for m in _MODELS]

    def run(batches):
        import numpy as np

        for batch in batches:
            codes = np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
            sums = sum_of(codes, size)[size - 1 :: size]
            yield pa.RecordBatch.from_arrays([pa.array(mixed(sums, k, context).view(np.int64)), *batch.columns[1:]], ["key", "n", *rest])

    return table.toDF("gram", "n", *rest).mapInArrow(run, "key bigint, n bigint, " + ", ".join(f"{c} int" for c in rest))


def train(counts: DataFrame, keep: Scratch, order: int = ORDER) -> tuple[DataFrame, list[float]]:
    """(terms, fresh) of (gram, n1, n2). terms: (key, n, full0.., more0..), sharded.

    Of an n-gram fullM is -log p under model M, null where that has not seen it, and moreM what is
    added to its cost as one that is backed off; of a context both are the weight of backing off.
    fresh: the cost of a character that a model has never seen.
    """
    counted = {order: counts.select("gram", (F.col("n1") + F.col("n2")).alias("n0"), "n1", "n2")}
    for k in range(order - 1, 0, -1):  # continuation counts: how many different characters stand before
        kinds = [F.count(F.when(F.col(f"n{m}") > 0, 1)).alias(f"n{m}") for m in _MODELS]
        counted[k] = keep(counted[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(*kinds), f"order-{k}")
    sizes = None
    for k, table in counted.items():
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.least(f"n{m}", F.lit(5)).alias("n")) for m in _MODELS])).alias("x")
        rows = table.select(F.lit(k).alias("k"), each)
        sizes = rows if sizes is None else sizes.union(rows)
    found: dict = {}
    for r in sizes.where("x.n > 0").groupBy("k", "x.m", "x.n").agg(F.count(F.lit(1)).alias("rows")).collect():  # 15 * order rows at most
        found.setdefault((r["k"], r["m"]), {})[r["n"]] = r["rows"]

    def cut(k: int, m: int):
        d1, d2, d3 = discounts(found.get((k, m), {}))
        n = F.col(f"n{m}")
        return F.when(n == 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3)

    micro = lambda p: F.round(-F.log(p) * _MICRO).cast("int")
    sums = [x for m in _MODELS for x in (F.sum(f"n{m}").alias(f"total{m}"), F.sum(cut(1, m)).alias(f"taken{m}"))]
    whole = counted[1].agg(*sums).first()
    left = [whole[f"taken{m}"] / whole[f"total{m}"] if whole[f"total{m}"] else 1.0 for m in _MODELS]
    fresh = [round(_MICRO * (math.log(_POINTS) - math.log(x))) for x in left]
    shares = [((F.col(f"n{m}") - cut(1, m)) / (whole[f"total{m}"] or 1) + left[m] / _POINTS) for m in _MODELS]
    probs = counted[1].select("gram", "n0", *[F.when(F.col(f"n{m}") > 0, shares[m]).alias(f"p{m}") for m in _MODELS])
    probs = keep(probs, "shares-1")
    full = [micro(F.col(f"p{m}")) for m in _MODELS]
    terms = _keyed(probs.select("gram", "n0", *full, *[x - fresh[m] for m, x in enumerate(full)]), 1, False)
    for k in range(2, order + 1):
        context = F.substring("gram", 1, k - 1).alias("context")
        sums = [x for m in _MODELS for x in (F.sum(f"n{m}").alias(f"total{m}"), F.sum(cut(k, m)).alias(f"taken{m}"))]
        contexts = counted[k].groupBy(context).agg(*sums)
        weight = [F.when(F.col(f"total{m}") > 0, F.col(f"taken{m}") / F.nullif(F.col(f"total{m}"), F.lit(0))).alias(f"left{m}") for m in _MODELS]
        contexts = keep(contexts.select("context", *[f"total{m}" for m in _MODELS], *weight), f"contexts-{k}")
        lower = probs.select(F.col("gram").alias("tail"), *[F.col(f"p{m}").alias(f"lower{m}") for m in _MODELS])
        joint = counted[k].select("*", context, F.substring("gram", 2, k - 1).alias("tail")).join(contexts, "context").join(lower, "tail")
        share = [(F.col(f"n{m}") - cut(k, m)) / F.nullif(F.col(f"total{m}"), F.lit(0)) + F.col(f"left{m}") * F.col(f"lower{m}") for m in _MODELS]
        columns = [F.when(F.col(f"n{m}") > 0, share[m]).alias(f"p{m}") for m in _MODELS]
        probs = keep(joint.select("gram", "n0", *columns, *[f"left{m}" for m in _MODELS], *[f"lower{m}" for m in _MODELS]), f"shares-{k}")
        full = [micro(F.col(f"p{m}")) for m in _MODELS]
        more = [x - micro(F.col(f"left{m}")) - micro(F.col(f"lower{m}")) for m, x in enumerate(full)]
        off = [micro(F.col(f"left{m}")) for m in _MODELS]
        terms = terms.union(_keyed(probs.select("gram", "n0", *full, *more), k, False))
        terms = terms.union(_keyed(contexts.select("context", "total0", *off, *off), k, True))
    return keep(terms, "terms"), fresh


def head_of(terms: DataFrame, most: int):
    """(keys, full0, full1, full2) of the most frequent terms, `most` at most, sorted by key; -1 stands for null."""
    import numpy as np

    step = F.floor(F.log2(F.greatest("n", F.lit(1))) * 8)
    sizes = {r[0]: r[1] for r in terms.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()}  # 8 * 63 rows at most
    least, held = max(sizes, default=0) + 1, 0
    for at in sorted(sizes, reverse=True):
        if held + sizes[at] > most:
            break
        least, held = at, held + sizes[at]
    found = terms.where(step >= least).select("key", *[F.coalesce(f"full{m}", F.lit(-1)).alias(f"full{m}") for m in _MODELS]).toArrow()
    keys = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], *[found.column(m + 1).to_numpy().astype(np.int32)[order] for m in _MODELS]


class Scorer:
    """Costs of texts under the head of a model, and what the rest of its terms may add."""

    def __init__(self, head, fresh, marks: bytes, size: int, order: int):
        import numpy as np

        self._keys, *self._full = head
        self._fresh, self._size, self._order = fresh, size, order
        self._marks = np.frombuffer(marks, np.uint8)
        bits = max(1, len(self._keys).bit_length())
        self._shift = np.uint64(64 - bits)
        self._starts = np.searchsorted(self._keys >> self._shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def _find(self, keys):
        """The place of each key in the head, or -1."""
        import numpy as np

        found = np.full(len(keys), -1, np.int32)
        box = (keys >> self._shift).astype(np.int64)
        at, end = self._starts[box], self._starts[box + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            here = at[live]
            same = self._keys[here] == keys[live]
            found[live[same]] = here[same]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return found

    def _outside(self, keys):
        import numpy as np

        place = keys & np.uint64((1 << self._size) - 1)
        return (self._marks[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def __call__(self, texts: list[str], model: int):
        """(cost of each text, [(text, key, times)] of terms that may be in the table and are not in the head)."""
        import numpy as np

        costs, rest = np.zeros(len(texts), np.int64), []
        full = self._full[model]
        for codes, places, owner in batches_of(texts, self._order):
            sums = sums_of(codes, self._order)
            live = np.arange(len(places))
            spent = np.zeros(len(places), np.int64)
            for k in range(self._order, 0, -1):
                for context in ((False, True) if k > 1 else (False,)):
                    at = places[live]
                    keys = mixed(sums[k - 1][at - 1] if context else sums[k][at], k, context)
                    found = self._find(keys)
                    missing = found < 0
                    value = np.where(missing, -1, full[found])
                    seen = value >= 0
                    spent[live[seen]] += value[seen]
                    away = np.flatnonzero(missing)
                    away = away[self._outside(keys[away])]
                    if len(away):
                        pairs = np.empty(len(away), [("text", "<i8"), ("key", "<u8")])
                        pairs["text"], pairs["key"] = owner[live[away]], keys[away]
                        rest.append(np.unique(pairs, return_counts=True))
                    if not context:
                        live = live[~seen]
            spent[live] += self._fresh[model]
            costs += np.bincount(owner, spent, len(texts)).astype(np.int64)
        return costs, [(p["text"], p["key"].view(np.int64), n) for p, n in rest]


def row_digest(text_col: str, lang_col: str):
    """What a row's verdict depends on, as a digest."""
    return F.md5(F.concat_ws("\x00", F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))


def scores(docs: DataFrame, terms: DataFrame, parts, marks, place_size: int, kind: str, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, digest, n, cost, held) of each row; held is the cost under the model of the other half, for rows that may be trusted."""
    import uuid

    import pyarrow as pa

    sent, key = docs.sparkSession.sparkContext.broadcast(parts), uuid.uuid4().hex
    doc = F.struct(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), row_digest(text_col, lang_col).alias("digest"))
    picked = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"), F.coalesce(_trusted_place(F.col(id_col), kind, place_size), F.lit(0)).alias("place"), doc.alias("doc"))
    names = ["key", "rid", "times", "model", "doc", "n", "cost", "held"]

    def run(batches):
        import numpy as np

        scorer, seen = held(("scorer", key), lambda: Scorer(*sent.value)), np.frombuffer(marks.value, np.uint8)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rids, at = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            maybe = np.flatnonzero((seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)
            halves = np.array([half_of(texts[i]) for i in maybe], np.int64)
            other_half, rest = [None] * len(texts), []
            costs, found = scorer(texts, 0)
            rest += [(rids[i], k, n, 0) for i, k, n in found]
            for half in (0, 1):
                own = maybe[halves == half]
                other, found = scorer([texts[i] for i in own], 2 - half)
                for i, x in zip(own.tolist(), other.tolist()):
                    other_half[i] = x
                rest += [(rids[own[i]], k, n, 2 - half) for i, k, n in found]
            # A row's own entry goes to any partition; no term touches it.
            none, size = pa.nulls(len(texts), pa.int32()), [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), none, none, batch.column(3), *(pa.array(x, pa.int64()) for x in (size, costs, other_half))], names)
            for r, k, n, model in rest:
                for lo in range(0, len(k), 50_000):
                    part = slice(lo, lo + 50_000)
                    size = len(k[part])
                    columns = [pa.array(k[part]), pa.array(r[part]), pa.array(n[part].astype(np.int32)), pa.array(np.full(size, model, np.int32)), pa.nulls(size, batch.column(3).type)]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(size, pa.int64()) for _ in range(3))], names)

    made = picked.mapInArrow(tidy(run), f"key bigint, rid bigint, times int, model int, doc {picked.schema['doc'].dataType.simpleString()}, n bigint, cost bigint, held bigint")
    met = made.join(terms.select("key", *[f"more{m}" for m in _MODELS]), "key", "left")
    term = F.when(F.col("model") == 0, F.col("more0")).when(F.col("model") == 1, F.col("more1")).when(F.col("model") == 2, F.col("more2"))
    added = F.col("times").cast("bigint") * term
    sums = met.groupBy("rid").agg(
        F.first("doc", ignorenulls=True).alias("doc"), F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("held").alias("held"),
        F.coalesce(F.sum(F.when(F.col("model") == 0, added)), F.lit(0)).alias("more"), F.coalesce(F.sum(F.when(F.col("model") > 0, added)), F.lit(0)).alias("more_held"),
    )
    return sums.select("doc.*", "n", (F.col("cost") + F.col("more")).alias("cost"), (F.col("held") + F.col("more_held")).alias("held"))


def _score(cost: str, mean: str, prior: int):
    """Hundredths of a nat beyond the mean for each square root of the length, rounded down."""
    beyond = (F.col(cost) - F.col("n") * F.col(mean)).cast("double")
    return F.floor(beyond / (F.sqrt(F.col("n") + F.lit(prior)) * F.lit(_MICRO / 100.0))).cast("int")


def verdicts(
    docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = QUANTILE, prior: int = PRIOR, head: int = HEAD, order: int = ORDER,
) -> DataFrame | None:
    """(id, lang, digest, n, cost, score, threshold, keep) of each row; None without any trusted text.

    trusted_ids: one column, the ids of trusted documents.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "quality")
    trusted = keep(trusted_ids.toDF("id").where("id is not null").distinct(), "trusted")
    kind, size = trusted.schema["id"].dataType.simpleString(), bits_for(trusted.count())
    marks = spark.sparkContext.broadcast(bitmap(trusted.select((_trusted_place(F.col("id"), kind, size) + 1).alias("bit")), size))
    counts = keep(gram_counts(trusted_texts(docs, trusted, marks, size, id_col, text_col), order), "counts")
    if counts.isEmpty():
        keep.close()
        return None
    terms, fresh = train(counts, keep, order)
    term_size = bits_for(terms.count())
    bit = F.col("key").bitwiseAND((1 << term_size) - 1) + 1
    parts = (head_of(terms, head), fresh, bitmap(terms.select(bit.alias("bit")), term_size), term_size, order)
    scored = materialise(scores(docs, terms, parts, marks, size, kind, id_col, text_col, lang_col), "quality-scores")

    good = scored.where("n > 0 and held is not null").withColumn("own", F.col("id").cast(kind)).join(trusted.withColumnRenamed("id", "own"), "own", "left_semi")
    good = keep(good.select("lang", "n", "held"), "good")
    # A row for each language: the mean cost of a character, in whole millionths.
    means = keep(good.groupBy("lang").agg(F.sum("held").alias("held"), F.sum("n").alias("n")), "means")
    total = means.agg(F.sum("held"), F.sum("n")).first()
    means = means.select("lang", F.expr("held div n").alias("mean"))
    scores_of = good.join(means, "lang").select("lang", _score("held", "mean", prior).alias("score"))
    histogram = keep(scores_of.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("rows")), "histogram")

    def limits(table: DataFrame) -> DataFrame:
        # A row for each language and hundredth: the width is bounded, whatever the documents.
        upto, whole = W.partitionBy("lang").orderBy("score"), W.partitionBy("lang")
        ranked = table.withColumn("upto", F.sum("rows").over(upto)).withColumn("all", F.sum("rows").over(whole))
        return ranked.where(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy("lang").agg(F.greatest(F.min("score"), F.lit(0)).alias("threshold"))

    merged = histogram.groupBy("score").agg(F.sum("rows").alias("rows")).select(F.lit("").alias("lang"), "score", "rows")
    default = limits(merged).first()["threshold"]
    by_lang = materialise(limits(histogram).join(means, "lang"), "quality-limits")
    keep.close()
    mean, threshold = F.coalesce("mean", F.lit(total[0] // total[1])), F.coalesce("threshold", F.lit(default))
    limited = scored.join(by_lang, "lang", "left").withColumns({"mean": mean, "threshold": threshold}).withColumn("score", _score("cost", "mean", prior))
    return limited.select("id", "lang", "digest", "n", "cost", "score", "threshold", (F.col("score") <= F.col("threshold")).alias("keep"))


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(id, lang, n_chars, perplexity, score, threshold, keep) of each row; score and threshold in hundredths of a nat."""
    found = verdicts(docs, trusted_ids, id_col, text_col, lang_col, **options)
    if found is None:
        return docs.select(
            F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
            F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("n_chars"), F.lit(None).cast("double").alias("perplexity"),
            F.lit(None).cast("int").alias("score"), F.lit(None).cast("int").alias("threshold"), F.lit(True).alias("keep"),
        )
    mean = F.col("cost") / (_MICRO * F.greatest("n", F.lit(1)))
    return found.select("id", "lang", F.col("n").alias("n_chars"), F.round(F.exp(mean), 6).alias("perplexity"), "score", "threshold", "keep")


def keep_good(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs, with all columns, that the classifier keeps; decided in place, without a shuffle of the texts that stay."""
    import pyarrow as pa

    found = verdicts(docs, trusted_ids, id_col, text_col, lang_col, **options)
    if found is None:
        return docs
    bad = materialise(found.where(~F.col("keep")).select("digest").distinct(), "quality-bad")
    size = bits_for(bad.count())
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint").bitwiseAND((1 << size) - 1)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(bad.select((place + 1).alias("bit")), size))

    def suspect(places):
        import numpy as np

        at = places.to_numpy(zero_copy_only=False)
        return pa.array((np.frombuffer(sent.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    # Python is given a number for each row, rows wait beside it; not deterministic, so it is evaluated once.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    digests = docs.select(row, row_digest(text_col, lang_col).alias("digest"))
    pointed = F.arrow_udf(suspect, "boolean", ArrowUDFType.SCALAR).asNondeterministic()
    marked = digests.select("row", "digest", pointed(place).alias("suspect"))
    # Only what the bitmap points at is shuffled.
    held = marked.where("suspect").join(bad.hint("merge"), "digest", "left_anti").select("row.*")
    return marked.where("not suspect").select("row.*").union(held)
