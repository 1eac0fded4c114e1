"""WARC archives whose repeated payloads become revisit records.

Headers alone (place in the source, digest, size, id, url) are shuffled by payload digest; of equal
payloads of at least `least` bytes the record with the largest id is the original. Headers of rows
that repeat a digest join their original, and only rows that become revisits are written down, by
stretches of the source file. The pass that writes the archives reads payloads where they lie and
looks its own stretch up; payloads are never exchanged. Rows are known by file and row number, so a
frame that is not a plain Parquet scan is first written as one.

An archive is a sequence of gzip members (the format of ".warc.gz"): a warcinfo record, then one
record for each row, with fresh headers: responses with the payload, revisits without it, naming
the original's record, URI and date. Each task writes its own file under a temporary name and
renames it when it is whole.

Defined results: a null payload is an empty one; payloads below `least` bytes are all responses;
of equal payloads whose ids are all null all are responses, otherwise rows with a null id revisit
the largest id; repeated rows with the largest id are all responses; a null url is left out of
the headers; an empty table gives no archive and an empty result. Records of equal or null ids have
record ids of their own. Only the id, url and payload columns are read. Ids are 64-bit integers.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timezone

from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import AtomicFile, filesystem, materialise, scratch_path, sliced

LEAST_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = 1 << 64
#: Rows of a source file whose revisits are written down together.
_STRETCH = 1 << 16

HEADER_SCHEMA = (
    "file string, offset bigint, record_type string, id bigint, url string, payload_digest string, "
    "payload_bytes bigint, refers_to bigint"
)


def record_urn(number: int | None, place: int = 0) -> str:
    """A record's id. The 64 low bits of the uuid hold the number; the high ones a number of the row's
    place, whose two lowest bits tell a null number (2) from others (1)."""
    high = (place % _SPACE) >> 2 << 2 | (2 if number is None else 1)
    return f"<urn:uuid:{uuid.UUID(int=(high << 64) + (number or 0) % _SPACE)}>"


def urn_number(urn: str) -> int | None:
    """The number of record_urn."""
    value = uuid.UUID(urn.strip("<>").rpartition(":")[2]).int
    if (value >> 64) & 3 == 2:
        return None
    low = value % _SPACE
    return low - _SPACE if low >> 63 else low


def _clean(url: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)


def record(number: int | None, place: int, url: str | None, payload: bytes, size: int, digest: str, date: str, refers_to: tuple | None) -> bytes:
    """One record, uncompressed. refers_to: (id, place, url) of the original, for revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_urn(number, place)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to:
        lines += [f"WARC-Refers-To: {record_urn(*refers_to[:2])}", f"WARC-Refers-To-Date: {date}", f"WARC-Profile: {PROFILE}"]
        if refers_to[2] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_clean(refers_to[2])}")
    return _framed(lines, "application/http; msgtype=response", http if refers_to else http + payload)


def warcinfo(name: str, date: str) -> bytes:
    """The record at the head of an archive."""
    block = b"software: sparkloom\r\nformat: WARC File Format 1.1\r\n"
    return _framed(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}"], "application/warc-fields", block)


def _framed(lines: list[str], kind: str, block: bytes) -> bytes:
    head = ["WARC/1.1", *lines, f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def members(stream, chunk: int = 1 << 20):
    """(offset, bytes) of each gzip member of a stream; one record at a time is in memory."""
    offset, rest = 0, b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not rest:
                rest = stream.read(chunk)
                if not rest:
                    raise ValueError("an archive ends inside a record")
            parts.append(unpack.decompress(rest))
            used += len(rest) - len(unpack.unused_data)
            rest = unpack.unused_data
        yield offset, b"".join(parts)
        offset += used


def _plain_scan(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, payload) as a plain Parquet scan, whose rows have a file and a number."""
    picked = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    if "_metadata" not in pages.columns and pages._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            pages.select("_metadata.row_index")
            return pages.select(*[F.col(c).cast(t).alias(n) for c, t, n in ((id_col, "bigint", "id"), (url_col, "string", "url"), (payload_col, "binary", "payload"))], "_metadata")
        except AnalysisException:  # a source without row numbers
            pass
    return materialise(picked, "warc-rows").select("id", "url", "payload", "_metadata")


def with_places(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, payload, size, digest, stretch, row): what each row's record says, and its place in the source."""
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    row = F.col("_metadata.row_index")
    return _plain_scan(pages, id_col, url_col, payload_col).select(
        "id", "url", payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("size"), F.sha1(payload).alias("digest"),
        F.xxhash64("_metadata.file_path", F.floor(row / _STRETCH)).alias("stretch"), row.alias("row"),
    )


def resolve_revisits(rows: DataFrame, least: int) -> str:
    """Writes (row, original id, place and url) of each revisit below a folder for each stretch; gives the path.

    Only headers are shuffled. Both sides of the join are plain exchanges that the adaptive planner
    can split where one digest is hot.
    """
    spark = rows.sparkSession
    headers = materialise(rows.where(F.col("size") >= least).select("id", "url", "digest", "stretch", "row"), "warc-headers")
    original = F.max(F.struct("id", "url", "stretch", "row")).alias("original")
    originals = headers.groupBy("digest").agg(original, F.count(F.lit(1)).alias("n")).where("n > 1 and original.id is not null").drop("n")
    revisits = headers.join(materialise(originals, "warc-originals"), "digest").where(~F.col("id").eqNullSafe(F.col("original.id")))
    path = scratch_path(spark, "warc-revisits")
    found = revisits.select("stretch", "row", F.col("original.id").alias("to_id"), _place("original.stretch", "original.row").alias("to_place"), F.col("original.url").alias("to_url"))
    found.repartition("stretch").write.partitionBy("stretch").parquet(path)
    return path


def _place(stretch: str, row: str):
    return F.xxhash64(stretch, row)


def _revisits_of(path: str, stretch: int) -> dict:
    """{row: (id, place, url) of the original} of one stretch."""
    import pyarrow.parquet as pq
    from pyarrow import fs as arrow_fs

    store, folder = filesystem(f"{path}/stretch={stretch}")
    found = {}
    for info in store.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                table = pq.read_table(f)
            for row, *to in zip(*(table.column(c).to_pylist() for c in ("row", "to_id", "to_place", "to_url"))):
                found[row] = tuple(to)
    return found


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES, date: str | None = None
) -> DataFrame:
    """Writes deduplicated archives into folder; returns its files: (file, n_records, n_bytes).

    date: the date of all records, by default that of the call.
    """
    import pyarrow as pa

    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = with_places(pages, id_col, url_col, payload_col)
    path = resolve_revisits(rows, least)

    def run(batches):
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        out, records, size = None, 0, 0
        now, known = None, {}
        for batch in sliced(batches):
            for number, url, payload, length, digest, stretch, row, place in zip(*(c.to_pylist() for c in batch.columns)):
                if stretch != now:
                    now, known = stretch, _revisits_of(path, stretch)
                written = []
                if out is None:
                    out = AtomicFile(name)
                    written.append(warcinfo(name.rpartition("/")[2], date))
                written.append(record(number, place, url, payload, length, digest, date, known.get(row)))
                for data in written:
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = pack.compress(data) + pack.flush()
                    out.write(data)
                    size += len(data)
                records += 1
        if out:
            out.commit()
            yield pa.RecordBatch.from_pylist([{"file": name, "n_records": records, "n_bytes": size}])

    placed = rows.select("*", _place("stretch", "row").alias("place"))
    return materialise(placed.mapInArrow(run, "file string, n_records bigint, n_bytes bigint"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """The headers of all records of the files (column `file`), as HEADER_SCHEMA has them.

    Digests of responses are checked against their payloads.
    """
    import pyarrow as pa

    n = max(1, files.count())
    from pyspark.sql import Window as W

    # One row for each file, each file in a task of its own.
    spread = files.select("file", (F.row_number().over(W.orderBy("file")) - 1).cast("int").alias("_n"))
    spread = spread.repartitionById(n, F.col("_n")).select("file")
    names = [x.split()[0] for x in HEADER_SCHEMA.split(", ")]

    def run(batches):
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                fs, path = filesystem(file)
                with fs.open_input_stream(path, compression=None) as stream:
                    for offset, data in members(stream):
                        headers, block = parse(data)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
                        digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                        if headers["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                        refers = headers.get("warc-refers-to")
                        rows.append((file, offset, headers["warc-type"], urn_number(headers["warc-record-id"]), headers.get("warc-target-uri"), digest, size, refers and urn_number(refers)))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    return spread.mapInArrow(run, HEADER_SCHEMA)


def payload_at(file: str, offset: int) -> bytes:
    """The payload of the response record at an offset of a file."""
    fs, path = filesystem(file)
    with fs.open_input_file(path) as stream:
        stream.seek(offset)
        _, block = parse(next(members(stream))[1])
    return block.partition(b"\r\n\r\n")[2]


def archives_roundtrip(pages: DataFrame, **options) -> DataFrame:
    """Writes the archives of pages into a scratch folder and reads their headers back."""
    return read_archives(write_archives(pages, scratch_path(pages.sparkSession, "warc"), **options))
