"""Token ids in a compact binary format.

The file format (".svb"): ids are replaced by their frequency ranks over the whole corpus (most
frequent first, ties by id), and ranks are stored in 1 to 4 bytes with separate control bytes
of four 2-bit lengths each. A folder holds `ranks.bin` (little-endian uint32: the id of each
rank) and one file for each range of documents. A file is a sequence of blocks:

    uint32 documents, uint64 control bytes, uint64 data bytes,
    int64 doc_id[documents], uint8 doc_id is null[documents], uint32 ids[documents],
    control bytes (each document begins a new one), data bytes

Decoding looks lengths up in a table with a row for each control byte, and gathers whole blocks.

Texts are tokenised once; their ids wait in a scratch table while all are counted. Then coded
documents, not texts, go through the range shuffle into ascending doc_id order.

Defined results: a null text is an empty one and holds the end id alone; equal ids keep all
their rows, ordered by a hash of their coded bytes where they fill several ranges, then by these; null ids come first; an empty table gives an empty
folder and an empty result. Only the id and text columns are read. Document ids are 64-bit
integers, or what casts to them; token ids are below 2**32.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from itertools import chain

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import AtomicFile, drop_path, filesystem, held, materialise, scratch_path, sliced, tidy, written

_BLOCK_IDS = 1 << 20
#: Token ids of one file: as many as give each shuffle partition a file, within these.
_LEAST_IDS, _MOST_IDS = 1 << 18, 1 << 25
_HEAD = "<IQQ"
_KNOWN_PARTS = 800_000
_KNOWN_BYTES = 24_000_000

#: Characters of the texts that are cut at once, and new parts that the tokenizer gets at once.
_TEXT_CHARS, _NEW_PARTS = 1 << 22, 20_000
_PLAIN = b"\n" + bytes(range(32, 127))
_STRANGE = re.compile("[^\\t-\\r -~\u00a0-\u024f\u2010-\u2027\u20ac]").search
_GAP, _GAPS = re.compile("[\\t\\v\\f\\r\u00a0]").search, re.compile(r"\s \s").search


def _unsure(text: str) -> bool:
    """Whether a text has characters outside the blocks that are sure, or white space on both sides of a space.

    Bytes of plain ASCII are dropped first, so that characters are looked at one by one only where they are others.
    """
    if "  " in text:
        return True
    gaps = "\n " in text
    if rest := text.encode("utf-8", "surrogatepass").translate(None, _PLAIN):
        others = rest.decode("utf-8", "surrogatepass")
        if _STRANGE(others):
            return True
        gaps = gaps or _GAP(others) is not None
    return gaps and _GAPS(text) is not None


#: Classes of bytes: letters, digits, other signs, apostrophes, a space, other white space; the rest may be anything.
_LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE, _BREAK, _ANY = range(7)
#: Bytes of parts that are a single pre-token, or those of a space and what follows it.
_SINGLE = bytes(set(range(32, 127)) - {39}) + bytes(set(range(0x80, 0xC0)) - {0x97, 0xB7}) + bytes(range(0xC3, 0xCA))


def _classes() -> tuple[bytes, bytes]:
    """The class of each byte, and for 8 * class + class of the next byte whether a pre-token ends between them."""
    import numpy as np

    of = np.full(256, _ANY, dtype=np.uint8)
    of[33:127], of[ord("'")], of[32], of[9:14] = _SIGN, _QUOTE, _SPACE, _BREAK
    of[48:58], of[65:91], of[97:123], of[0xC3:0xCA] = _DIGIT, _LETTER, _LETTER, _LETTER
    ends = np.zeros((32, 8), dtype=np.uint8)
    ends[: _QUOTE + 1, : _BREAK + 1] = 1
    ends[range(_BREAK + 1), range(_BREAK + 1)] = 0
    ends[_SIGN, _QUOTE] = ends[_QUOTE, _SIGN] = ends[_QUOTE, _LETTER] = 0
    return of.tobytes(), ends.tobytes()


def _cut_places(raw: bytes, bounds):
    """Where the parts of texts begin, and the end of the last; raw: the texts, bounds: where each begins and the end."""
    import numpy as np

    of, ends = _classes()
    data, kinds = np.frombuffer(raw, dtype=np.uint8), np.frombuffer(bytearray(raw).translate(of), dtype=np.uint8)
    # U+00C0 to U+024F are letters of two bytes, but for the signs of multiplication and division.
    lead = np.flatnonzero((data >= 0xC3) & (data < 0xCA))
    kinds[lead + 1] = _LETTER
    signs = lead[(data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))]
    kinds[signs] = kinds[signs + 1] = _ANY
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(ends), dtype=bool)
    alone = np.flatnonzero(kinds[1:-1] == _BREAK) + 1
    cut[alone[(kinds[alone - 1] <= _QUOTE) & (kinds[alone + 1] <= _QUOTE)] + 1] = True
    cut[bounds] = True
    return np.flatnonzero(cut)


class _Parts(dict):
    """Parts of texts by number; a new one gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.noted: list[bytes] = []

    def __missing__(self, part: bytes) -> int:
        number = self[part] = len(self)
        self.noted.append(part)
        return number


class WordEncoder:
    """Encodes texts by their parts, about words and signs, each of which the tokenizer encodes once.

    Texts are cut where a pre-token always ends, whatever stands around: between letters, digits and signs, in
    front of white space behind one of them, and behind a single break between two of them. A space stays with
    what follows it, an apostrophe with letters behind it, and no cut is made beside other white space or beside characters
    outside ASCII that are no Latin letters. Merges never cross pre-tokens, so the ids of a text are
    those of its parts in order. A text with white space on both sides of a space, with one of the vocabulary's
    added tokens, or with characters outside the blocks in which every Unicode version agrees on letters and spaces,
    goes to the tokenizer whole. So do all texts where the vocabulary file has another pre-tokenizer, a normaliser or a
    prefix space, for which this does not hold. The memory is bounded: a full one is emptied.
    """

    def __init__(self, vocabulary: str, dtype: str):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(vocabulary)
        about = json.loads(self._tokenizer.to_str())
        before = about["pre_tokenizer"] or {}
        self._cuts = about["model"]["type"] == "BPE" and about["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
        # Takes lines that are a pre-token each.
        self._lines = Tokenizer(self._tokenizer.model)
        self._lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._dtype = dtype
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        # Byte-level pieces have a character for each byte.
        self._bytes = np.array([len(self._tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self._parts = _Parts()
        self._flat, self._used = np.zeros(1 << 16, dtype=self._dtype), 0
        self._starts, self._sizes = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self._held = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, numbers, ids, sizes) -> None:
        """Appends the ids of parts; numbers: the parts' numbers, sizes: how many ids each has."""
        import numpy as np

        while self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[self._used : self._used + len(ids)] = ids
        self._sizes[numbers] = sizes
        self._starts[numbers] = self._used + np.cumsum(sizes) - sizes
        self._used += len(ids)

    def _learn(self) -> None:
        """Encodes the noted parts. Those of a single pre-token go through as lines of one text, and the
        bytes of pieces tell where each ends."""
        import numpy as np

        noted, self._parts.noted = self._parts.noted, []
        first = len(self._parts) - len(noted)
        self._held += sum(map(len, noted))
        while len(self._parts) > len(self._starts):
            self._starts, self._sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self._starts, self._sizes))
        several = [bool(part.translate(None, _SINGLE)) for part in noted]
        single, other = ([i for i, x in enumerate(several) if x is kind] for kind in (False, True))
        for lo in range(0, len(single), _NEW_PARTS):
            numbers = single[lo : lo + _NEW_PARTS]
            lines = [noted[i] for i in numbers]
            text = b"\n".join(lines).decode()
            ids = np.array(self._lines.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self._dtype)
            ends, at = np.cumsum(list(map(len, lines))), np.cumsum(self._bytes[ids])
            cuts = np.searchsorted(at, ends)
            if len(at) == 0 or at[-1] != ends[-1] or not np.array_equal(at[cuts], ends):
                raise ValueError("pieces cross parts")
            self._store(first + np.array(numbers), ids, np.diff(cuts, prepend=-1))
        for lo in range(0, len(other), _NEW_PARTS):
            numbers = other[lo : lo + _NEW_PARTS]
            found = self._ids([noted[i].decode() for i in numbers])
            self._store(first + np.array(numbers), list(chain.from_iterable(found)), np.array(list(map(len, found))))

    def _joined(self, texts: list[bytes]):
        """(ids of texts that can be cut, how many each has)."""
        import numpy as np
        import pyarrow as pa

        raw = b"".join(texts)
        if not raw:
            return np.zeros(0, dtype=self._dtype), np.zeros(len(texts), dtype=np.int64)
        bounds = np.cumsum([0, *map(len, texts)])
        starts = _cut_places(raw, bounds)
        offsets = pa.py_buffer(starts.astype("<i4"))
        parts = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self._parts.__getitem__, distinct), np.int64, len(distinct))
        self._learn()
        sizes = self._sizes[numbers]
        ends = np.cumsum(sizes)
        ids = self._flat[np.repeat(self._starts[numbers] - ends + sizes, sizes) + np.arange(int(ends[-1]))]
        # The ids of each distinct part, as bytes, are laid out by the parts of the texts.
        width = ids.itemsize
        each = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends]) * width), pa.py_buffer(ids)])
        laid = each.take(parts.indices)
        upto = np.frombuffer(laid.buffers()[1], dtype="<i8", count=len(laid) + 1) // width
        ids = np.frombuffer(laid.buffers()[2], dtype=self._dtype, count=int(upto[-1]))
        return ids, np.diff(upto[np.searchsorted(starts, bounds)])

    def encode(self, texts: list[str]):
        """(ids of all texts in order, how many each text has)."""
        import numpy as np

        parts_ids, parts_sizes = [np.zeros(0, dtype=self._dtype)], [np.zeros(0, dtype=np.int64)]
        upto = np.cumsum([len(t) for t in texts])
        lo = 0
        while lo < len(texts):
            if len(self._parts) > _KNOWN_PARTS or self._held > _KNOWN_BYTES:
                self._forget()
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - len(texts[lo]) + _TEXT_CHARS, side="right")))
            own, lo = texts[lo:hi], hi
            whole = [i for i, t in enumerate(own) if not self._cuts or _unsure(t) or any(a in t for a in self._added)]
            strange = dict(zip(whole, self._ids([own[i] for i in whole])))
            ids, per_text = self._joined([t.encode() for i, t in enumerate(own) if i not in strange])
            if strange:
                ends, plain, mixed, lengths = np.cumsum(per_text), 0, [], []
                for i in range(len(own)):
                    if i in strange:
                        mixed.append(np.array(strange[i], dtype=self._dtype))
                    else:
                        mixed.append(ids[ends[plain] - per_text[plain] : ends[plain]])
                        plain += 1
                    lengths.append(len(mixed[-1]))
                ids, per_text = np.concatenate(mixed), np.array(lengths, dtype=np.int64)
            parts_ids.append(ids)
            parts_sizes.append(per_text)
        return np.concatenate(parts_ids), np.concatenate(parts_sizes)


def _encoder(vocabulary: str, dtype: str) -> WordEncoder:
    """One encoder, with what it knows, for each Python worker."""
    return held(("encoder", vocabulary, dtype), lambda: WordEncoder(vocabulary, dtype))


def token_table(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, end_id: int, dtype: str) -> DataFrame:
    """(id, n, ids, counts): the ids of each row with the end id, as little-endian binary.

    Each task adds one row in which only `counts` is set: how often it saw each id.
    """
    import pyarrow as pa

    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    names = ["id", "n", "ids", "counts"]

    def run(batches):
        import numpy as np

        encoder = _encoder(vocabulary, dtype)
        seen = np.zeros(0, dtype=np.int64)
        for batch in sliced(batches, 2000):
            ids, sizes = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum(sizes)
            ids, sizes = np.insert(ids, ends, end_id), sizes + 1
            part = np.bincount(ids, minlength=len(seen))
            part[: len(seen)] += seen
            seen = part
            raw, width = ids.tobytes(), ids.itemsize
            cuts = (np.cumsum(sizes) * width).tolist()
            coded = [raw[a:b] for a, b in zip([0, *cuts], cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.binary()), pa.nulls(len(coded), pa.binary())], names
            )
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], names
            )

    return picked.mapInArrow(tidy(run), "id bigint, n bigint, ids binary, counts binary")


def _values(column):
    """The bytes of a binary column, one value after the other, without copies."""
    import numpy as np

    if len(column) == 0:
        return b""
    ends = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2] or b"")[ends[0] : ends[-1]]


def ranked_ids(tokens: DataFrame):
    """The ids that occur, most frequent first: as many as the vocabulary has at most."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                part = np.frombuffer(counts, dtype="<i8")
                longer, shorter = (part.copy(), total) if len(part) > len(total) else (total, part)
                longer[: len(shorter)] += shorter
                total = longer
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])

    counts = tokens.select("counts").where("counts is not null")
    counts = counts.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    rows = sorted(((r["n"], r["token"]) for r in counts.collect()), key=lambda r: (-r[0], r[1]))
    return np.array([t for _, t in rows], dtype="<u4")


def encode_ranks(ranks, counts) -> list[tuple[bytes, bytes]]:
    """(control bytes, data bytes) of each document; ranks: those of all, counts: how many each has."""
    import numpy as np

    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    counts = np.asarray(counts, dtype=np.int64)
    held = -(-counts // 4) * 4
    sizes = (1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(int(held.sum()), dtype=np.uint8)
    padded[np.arange(len(ranks)) + np.repeat(np.cumsum(held) - held - (np.cumsum(counts) - counts), counts)] = sizes - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < sizes[:, None]].tobytes()
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    data_ends = upto[np.cumsum(counts)].tolist()
    control_ends = (np.cumsum(held) // 4).tolist()
    return [
        (control[a:b], data[c:d])
        for a, b, c, d in zip([0, *control_ends], control_ends, [0, *data_ends], data_ends)
    ]


def length_table():
    """The four lengths that each control byte stands for."""
    import numpy as np

    return ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def decode_ranks(control: bytes, data: bytes, counts):
    """The ranks of a block; counts: the ids of each of its documents."""
    import numpy as np

    counts = np.asarray(counts, dtype=np.int64)
    held = -(-counts // 4) * 4
    lengths = length_table()[np.frombuffer(control, dtype=np.uint8)].ravel()
    place = np.arange(len(lengths)) - np.repeat(np.cumsum(held) - held, held)
    lengths = lengths[place < np.repeat(counts, held)]
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, dtype=np.uint8)
    ranks = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        ranks[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _sliced(batches, most: int = 4 << 20):
    """Batches (id, n, ids) cut so that each holds about `most` ids, or one document."""
    import numpy as np

    for batch in batches:
        upto = np.cumsum(batch.column(1).to_numpy())
        lo = 0
        while lo < batch.num_rows:
            before = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, before + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def write_tokens(
    docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> DataFrame:
    """Writes the format into `folder`; returns its files: (file_no, path, n_docs, n_ids, n_bytes)."""
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    tokens, waiting = written(token_table(docs, vocabulary, id_col, text_col, end_id, dtype), "tokens-ids")
    by_rank = ranked_ids(tokens)
    ranks_file = AtomicFile(f"{folder}/ranks.bin")
    ranks_file.write(by_rank.tobytes())
    ranks_file.commit()
    rank_of = np.zeros(size, dtype="<u4")
    rank_of[by_rank] = np.arange(len(by_rank), dtype="<u4")
    sent = spark.sparkContext.broadcast(rank_of)  # one number for each id of the vocabulary

    # Ranges of ids come from a sketch of the ids alone, so nothing is coded twice.
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // _LEAST_IDS))
    ranges = max(1, ranges, -(-total // _MOST_IDS))
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    lowest = F.coalesce("id", F.lit(-(1 << 63)))
    found = tokens.where("counts is null").select(F.percentile_approx(lowest, shares, max(10_000, 20 * ranges))).first()[0]
    # An id that fills several ranges stands here several times.
    bounds = np.array(found if ranges > 1 and found else [], dtype=np.int64)

    def code(batches):
        import xxhash

        for batch in _sliced(batches):
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy()
            place, upto = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
            tie = np.zeros(len(ids), np.int64)
            pairs = encode_ranks(sent.value[np.frombuffer(_values(batch.column(2)), dtype=dtype)], batch.column(1).to_numpy())
            for i in np.flatnonzero(upto - place > 1):  # rows of a hot id are spread by a hash, in its order
                digest = xxhash.xxh64_intdigest(pairs[i][0] + pairs[i][1])
                tie[i], place[i] = digest - (1 << 63), place[i] + (digest * int(upto[i] - place[i]) >> 64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place, pa.int32()), batch.column(0), pa.array(tie), batch.column(1), pa.array([c for c, _ in pairs], pa.binary()), pa.array([d for _, d in pairs], pa.binary())],
                ["place", "id", "tie", "n", "control", "data"],
            )

    def write(batches):
        number = TaskContext.get().partitionId()
        out, docs_total, ids_total, bytes_total = None, 0, 0, 0
        path = f"{folder}/part-{number:06d}.svb"
        for batch in batches:
            ids, counts, controls, datas = (c.to_pylist() for c in batch.columns)
            lo = 0
            while lo < len(ids):
                hi, held = lo, 0
                while hi < len(ids) and (hi == lo or held + counts[hi] <= _BLOCK_IDS):
                    held += counts[hi]
                    hi += 1
                control, data = b"".join(controls[lo:hi]), b"".join(datas[lo:hi])
                block = b"".join([
                    struct.pack(_HEAD, hi - lo, len(control), len(data)),
                    np.array([i or 0 for i in ids[lo:hi]], dtype="<i8").tobytes(),
                    bytes(i is None for i in ids[lo:hi]),
                    np.array(counts[lo:hi], dtype="<u4").tobytes(), control, data,
                ])
                out = out or AtomicFile(path)
                out.write(block)
                docs_total, ids_total, bytes_total, lo = docs_total + hi - lo, ids_total + held, bytes_total + len(block), hi
        if out:
            out.commit()
            yield pa.RecordBatch.from_pylist(
                [{"file_no": number, "path": path, "n_docs": docs_total, "n_ids": ids_total, "n_bytes": bytes_total}]
            )

    order = ["id", "tie", "n", "control", "data"]
    coded = tokens.where("counts is null").select("id", "n", "ids").mapInArrow(code, "place int, id bigint, tie bigint, n bigint, control binary, data binary")
    files = (
        coded.repartitionById(ranges, F.col("place"))
        .select(*order)
        .sortWithinPartitions(*order)
        .select("id", "n", "control", "data")
        .mapInArrow(write, "file_no bigint, path string, n_docs bigint, n_ids bigint, n_bytes bigint")
    )
    files = materialise(files, "tokens-files")
    drop_path(spark, waiting)
    return files


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) of each document of the files that write_tokens gave."""
    import pyarrow as pa

    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    placed = files.select("file_no", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    placed = materialise(placed, "tokens-places")
    dense = placed.withColumn("_n", F.row_number().over(W.orderBy("file_no")) - 1)
    dense = dense.repartitionById(max(1, placed.count()), F.col("_n").cast("int")).select("path", "start")

    def run(batches):
        import numpy as np

        by_rank = None
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if by_rank is None:
                    fs, at = filesystem(f"{folder}/ranks.bin")
                    with fs.open_input_stream(at, compression=None) as f:
                        by_rank = np.frombuffer(f.read(), dtype="<u4")
                fs, at = filesystem(path)
                with fs.open_input_stream(at, compression=None) as f:
                    while head := f.read(struct.calcsize(_HEAD)):
                        n, n_control, n_data = struct.unpack(_HEAD, head)
                        ids = np.frombuffer(f.read(8 * n), dtype="<i8")
                        null = np.frombuffer(f.read(n), dtype=np.uint8).astype(bool)
                        counts = np.frombuffer(f.read(4 * n), dtype="<u4").astype(np.int64)
                        tokens = by_rank[decode_ranks(f.read(n_control), f.read(n_data), counts)]
                        ends = np.cumsum(counts)
                        raw = tokens.astype("<u4").tobytes()
                        parts = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids, pa.int64(), mask=null), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                                pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary()),
                            ],
                            ["id", "start", "n_tokens", "ids_crc32", "ids"],
                        )
                        start += int(ends[-1])

    return dense.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def tokens_roundtrip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Writes the tokens of docs into a scratch folder and reads them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, vocabulary, folder, **options), folder)
