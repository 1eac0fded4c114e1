"""SentencePiece encoding and decoding as weighted finite-state transducers.

Three machines are compiled from a model file. The normaliser maps white space to the marker
U+2581, with a dummy prefix; it is deterministic and has three states. The piece transducer reads
normalised characters along the arcs of a tree of prefixes and gives a piece's id where one ends;
a character that is no piece has a fallback arc, which gives its UTF-8 bytes (or the unknown id).
The weights are a third machine, over neighbouring pieces.

An input is composed with the normaliser, and the result with the other two, lazily: a state of
the lattice is (place, last piece), arcs are made when a state is reached, and an arc's weight is
looked up when it comes up. The segmentation is the lattice's shortest path in the tropical
semiring (the least sum of weights), found by uniform-cost search; of equal sums the one that has
come furthest is taken up first.

A unigram model weighs a piece by its negative score, whatever stands in front. A BPE model does
not choose the path of the best total score: it applies merges in the order of their scores. So
for BPE the weight from piece a to piece b is 0 where merging the characters of a + b yields
exactly a, b, and infinity elsewhere. Merges inside a piece never depend on what lies beyond its
neighbour before a merge crosses that border, so a path whose neighbours all agree is the merge
order's result, and the only path of finite weight.

Pieces never hold a marker after another character, so the lattice falls apart in front of each
run of markers, and with byte fallback also between characters that no piece holds side by
side; equal parts have equal paths, which a bounded memory keeps.

Defined results: a null or empty text has no pieces and decodes to an empty text; characters
that no piece covers become their UTF-8 bytes; decoding joins bytes and replaces those that are
not UTF-8. A model with a compiled character map raises NotImplementedError.
Only the id and text columns are read.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions.text import free_name
from sparkloom.llm.common import held, sliced

_MARK = "▁"
_BREAK = "\ud800"
_RUNS = re.compile(" +|[^ ]+")
_PARTS = re.compile(f"{_MARK}+[^{_MARK}]*|[^{_MARK}]+")
# Piece types of the model format (fixed values).
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2
_MEMORY = 400_000


# Each byte that is not UTF-8 becomes one replacement character.
codecs.register_error("sparkloom-each", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Normaliser:
    """White space to markers: a deterministic transducer.

    arcs: of each state what a space and any other character lead to, as (next state, output); another
    character is itself put out behind the arc's output. What a last gap holds back is dropped.
    """

    BEGIN, WORD, GAP = range(3)

    def __init__(self, prefix: bool, squeeze: bool):
        front = _MARK if prefix else ""
        self.squeeze, self.front = squeeze, front
        if squeeze:
            self.arcs = {
                self.BEGIN: ((self.BEGIN, ""), (self.WORD, front)),
                self.WORD: ((self.GAP, ""), (self.WORD, "")),
                self.GAP: ((self.GAP, ""), (self.WORD, _MARK)),
            }
        else:
            self.arcs = {
                self.BEGIN: ((self.WORD, front + _MARK), (self.WORD, front)),
                self.WORD: ((self.WORD, _MARK), (self.WORD, "")),
            }

    def compose(self, text: str) -> str:
        """The output for an input, run by run: the arcs of a run's first character, then its loop."""
        state, out = self.BEGIN, []
        for run in _RUNS.findall(text):
            space = run[0] == " "
            for _ in run if space else run[:1]:
                state, put = self.arcs[state][not space]
                out.append(put)
            if not space:
                out.append(run)
        return "".join(out)

    def parts(self, text: str) -> list[str]:
        """The output, cut in front of each run of markers.

        Without squeezing the machine maps each character by itself, and with it each word, so both
        are composed at once where the input has no marker of its own.
        """
        if not self.squeeze:
            return _PARTS.findall(self.front + text.replace(" ", _MARK)) if text else []
        if _MARK in text:
            return _PARTS.findall(self.compose(text))
        found = [_MARK + w for w in text.split(" ") if w]
        if found and not self.front:
            found[0] = found[0][1:]
        return found


class Transducer:
    """A compiled model: encode gives piece ids, decode gives text."""

    def __init__(self, model_file: str):
        with open(model_file, "rb") as f:
            data = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normal: dict = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, _NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if normal.get(2):
            raise NotImplementedError("models with a compiled character map")
        self._kind = trainer.get(3, _UNIGRAM)
        if self._kind not in (_UNIGRAM, _BPE):
            raise NotImplementedError("only unigram and BPE models")
        self._prefix = bool(normal.get(3, 1))
        self.normaliser = Normaliser(self._prefix, bool(normal.get(4, 1)))
        self._fallback = bool(trainer.get(35, 0))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == _UNKNOWN)
        if any(p[2] in (_USER, _UNUSED) for p in self.pieces):
            raise NotImplementedError("models with user-defined or unused pieces")
        self._id = {p[0]: i for i, p in enumerate(self.pieces) if p[2] == _NORMAL}
        self._byte = {int(p[0][1:-1], 16): i for i, p in enumerate(self.pieces) if p[2] == _BYTE}
        if any(_MARK in p.lstrip(_MARK) for p in self._id):
            raise NotImplementedError("pieces with white space inside")
        # What each id decodes to. Bytes outside ASCII wait as surrogates, which no piece has, for those beside
        # them; a control piece is a surrogate that keeps bytes apart.
        self._texts = [" ⁇ " if p[2] == _UNKNOWN else _BREAK if p[2] == _CONTROL else p[0].replace(_MARK, " ") for p in self.pieces]
        for byte, i in self._byte.items():
            self._texts[i] = chr(byte if byte < 128 else 0xDC00 + byte)
        self._marked = {i for i, p in enumerate(self.pieces) if p[2] != _BYTE and p[0].startswith(_MARK)}
        # The piece transducer: arcs by character from each state, and the pieces that end there.
        self._arcs: list[dict[str, int]] = [{}]
        self._ends = [False]
        for piece in self._id:
            state = 0
            for c in piece:
                after = self._arcs[state].get(c)
                if after is None:
                    after = self._arcs[state][c] = len(self._arcs)
                    self._arcs.append({})
                    self._ends.append(False)
                state = after
            self._ends[state] = True
        worst = min((self.pieces[i][1] for i in self._id.values()), default=0.0)
        # Weights of pieces by themselves; a fallback arc costs 10 more than the worst piece.
        self._alone = {p: -self.pieces[i][1] for p, i in self._id.items()}
        self._fall_back = 10.0 - worst
        # No merge joins two characters that no piece holds side by side.
        self._inside = {p[i : i + 2] for p in self._id for i in range(len(p) - 1)}
        self._agree: dict[str, dict[str, bool]] = {}
        self._agreed = 0
        self._paths: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def normalise(self, text: str) -> str:
        """The text as it enters the lattice."""
        return self.normaliser.compose(text)

    def _merge(self, text: str) -> list[str]:
        """The pieces that merging by score leaves of a text, ties from the left."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(parts):
                joined = parts[i] + parts[j]
                if joined in self._id:
                    heapq.heappush(queue, (-self.pieces[self._id[joined]][1], i, joined))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = right[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _agrees(self, a: str, b: str) -> bool:
        """Whether the weight from piece a to piece b is 0 (for BPE); a is empty at the start."""
        if self._agreed >= _MEMORY:
            self._agree.clear()
            self._agreed = 0
        self._agreed += 1
        known = self._merge(a + b) == ([a, b] if a else [b])
        self._agree.setdefault(a, {})[b] = known
        return known

    def _arcs_from(self, part: str, at: int) -> list[int]:
        """Where the arcs of the composed machine that begin at a place end: at the end of each piece,
        and behind the character itself."""
        arcs, last = self._arcs, self._ends
        found, state, end, size = [at + 1], arcs[0].get(part[at]), at + 1, len(part)
        while state is not None and end < size:
            state = arcs[state].get(part[end])
            end += 1
            if state is not None and last[state]:
                found.append(end)
        return found

    def _path(self, part: str) -> list[str]:
        """The shortest path through the lattice of a part, by uniform-cost search.

        A waiting arc is (least weight of a path along it and minus the place it leads to, piece, from).
        For BPE all finite weights are 0, so the place alone orders arcs, and an arc's own weight is
        looked up when it comes up: infinite ones are dropped then.
        """
        size, bpe, agree, push, pop = len(part), self._kind == _BPE, self._agree, heapq.heappush, heapq.heappop
        start = here = (0, "")
        reached: dict = {start: None}
        waiting: list = []
        spent, at = 0.0, 0
        while at < size:
            for end in self._arcs_from(part, at):
                piece = part[at:end]
                push(waiting, (-end if bpe else (spent + self._alone.get(piece, self._fall_back), -end), piece, here))
            while True:
                key, piece, before = pop(waiting)
                if bpe:
                    there = (-key, piece)
                    if there in reached:
                        continue
                    known = agree.get(before[1])
                    fits = known.get(piece) if known is not None else None
                    if fits is None:
                        fits = self._agrees(before[1], piece)
                    if not fits:
                        continue
                else:
                    spent, there = key[0], (-key[1], "")
                    if there in reached:
                        continue
                reached[there] = (before, piece)
                here, at = there, there[0]
                break
        path = []
        while here != start:
            here, piece = reached[here]
            path.append(piece)
        return path[::-1]

    def _remember(self, part: str, ids: tuple[int, ...]) -> None:
        """Keeps a path; of a full memory the older half is forgotten."""
        if len(part) <= 64:
            if len(self._paths) >= _MEMORY:
                self._older, self._paths = self._paths, {}
            self._paths[part] = ids

    def _shortest(self, part: str) -> tuple[int, ...]:
        """The ids of the shortest path of a part."""
        out: list[int] = []
        for piece in self._path(part):
            if piece in self._id:
                out.append(self._id[piece])
            elif self._fallback:
                out += [self._byte[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def _ids(self, part: str) -> tuple[int, ...]:
        """The ids of a part that is not in memory, cut where no piece crosses."""
        known = self._older.get(part)
        if known is not None:
            self._remember(part, known)
            return known
        cuts = [0, *[i for i, pair in enumerate(map(str.__add__, part, part[1:]), 1) if pair not in self._inside], len(part)]
        # Runs of unknown characters are one piece in models without bytes, so those are not cut.
        if len(cuts) == 2 or not self._fallback:
            known = self._shortest(part)
        else:
            found: list[int] = []
            for a, b in zip(cuts, cuts[1:]):
                own = part[a:b]
                ids = self._paths.get(own) or self._older.get(own)
                if ids is None:
                    ids = self._shortest(own)
                    self._remember(own, ids)
                found += ids
            known = tuple(found)
        self._remember(part, known)
        return known

    def encode(self, text: str | None) -> list[int]:
        """The piece ids of a text."""
        ids: list[int] = []
        for part in self.normaliser.parts(text or ""):
            ids += self._paths.get(part) or self._ids(part)
        return ids

    def decode(self, ids) -> str:
        """The text of piece ids."""
        out = "".join(map(self._texts.__getitem__, ids))
        try:
            out.encode()
        except UnicodeEncodeError:  # bytes outside ASCII, or control pieces
            runs = [r.encode("utf-8", "surrogateescape").decode("utf-8", "sparkloom-each") for r in out.split(_BREAK)]
            out = "".join(runs).replace(_MARK, " ")
        # Whether the dummy prefix stands in front.
        return out[1:] if self._prefix and len(ids) and ids[0] in self._marked else out


def transducer(model_file: str) -> Transducer:
    """One compiled transducer for each Python worker."""
    return held(("transducer", model_file), lambda: Transducer(model_file))


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pieces array<int>) of each row."""
    import pyarrow as pa

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        encode = transducer(model_file).encode
        for batch in sliced(batches):
            ids = [encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "pieces"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, pieces array<int>")


def decode_documents(coded: DataFrame, model_file: str) -> DataFrame:
    """(id, text) of rows (id, pieces)."""
    import pyarrow as pa

    def run(batches):
        decode = transducer(model_file).decode
        for batch in sliced(batches):
            texts = [decode(p or []) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    coded = coded.select("id", "pieces")
    return coded.mapInArrow(run, f"id {coded.schema['id'].dataType.simpleString()}, text string")


def with_pieces(docs: DataFrame, model_file: str, text_col: str = "text", pieces: bool = True) -> DataFrame:
    """docs with pieces (if they are wanted), n_pieces, pieces_crc32 and decoded_equal of each row, both
    directions in one pass.

    pieces_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers. A column of
    docs that has one of these names keeps it, and the new one gets underscores in front.
    """
    import pyarrow as pa

    types = ({"pieces": "array<int>"} if pieces else {}) | {"n_pieces": "bigint", "pieces_crc32": "bigint", "decoded_equal": "boolean"}
    names = [free_name(docs.columns, n) for n in types]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    given = docs.select(row, F.col(text_col).alias("text"))

    def run(batches):
        import numpy as np

        machine = transducer(model_file)
        for batch in sliced(batches, 200):
            coded, sums, equal = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.array(machine.encode(text), dtype="<i4")
                coded.append(ids)
                sums.append(zlib.crc32(ids.tobytes()))
                equal.append(machine.decode(ids.tolist()) == (text or ""))
            columns = [pa.array(coded, pa.list_(pa.int32()))] if pieces else []
            columns += [pa.array([len(p) for p in coded], pa.int64()), pa.array(sums, pa.int64()), pa.array(equal, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", *types])

    added = StructType.fromDDL(", ".join(f"{n} {t}" for n, t in types.items()))
    done = given.mapInArrow(run, StructType([given.schema["row"], *added]))
    return done.select("row.*", *[F.col(n).alias(own) for n, own in zip(types, names)])


def roundtrip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, pieces_crc32, decoded_equal) of each row."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_pieces(picked, model_file, pieces=False).select("id", "n_pieces", "pieces_crc32", "decoded_equal")
