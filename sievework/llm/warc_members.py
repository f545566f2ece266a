"""WARC archives: writing, and normalising monolithic gzip files to one member a record with an offset index (operator 4).

Some tools compress a whole WARC file as one gzip stream, which can't be read from the middle. The normaliser inflates such a
stream once, from start to end and in pieces, cuts the records out of it by their Content-Length, writes every record again
as a gzip member of its own and lists (offset, length, type, id) in a sidecar index. Readers then open any record alone.

Pages become records in three staged steps, each a DataFrame of the files that its tasks finished: monolithic archives are
written, normalised, and read back by their indexes. Files are written under names that no other attempt uses and count only
once their row is staged, so a lost executor leaves unused files at worst. Only records pass through memory, never archives.

Defined cases: a null html is the empty payload; of rows with equal payloads those with the least page_id are responses and
the others revisits of it (rows that repeat that page_id are responses too; null ids rank last, and if there are only null
ids all are responses); a null or odd url is written percent-encoded; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, drop_path, new_path, stage

MIN_REVISIT_BYTES = 0
CHUNK = 1 << 18
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "path string, records long"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One whole record. A revisit's block is the HTTP header alone, which still states the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~-._"))]
    if is_revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    lines += [("WARC-Payload-Digest", "sha1:" + payload_digest(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(lines) + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def inflated_records(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """Whole records of a gzip stream of one or more members, read once from start to end."""
    tool, held, need, scanned = zlib.decompressobj(31), bytearray(), None, 0
    while True:
        raw = stream.read(chunk)
        if not raw:
            break
        while raw:
            held += tool.decompress(raw)
            raw = tool.unused_data
            if tool.eof:
                tool = zlib.decompressobj(31)
            while True:
                if need is None:
                    end = held.find(b"\r\n\r\n", max(0, scanned - 3))
                    if end < 0:
                        scanned = len(held)
                        break
                    length = next(int(line[15:]) for line in bytes(held[:end]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
                    need = end + 4 + length + 4
                if len(held) < need:
                    break
                yield bytes(held[:need])
                del held[:need]
                need, scanned = None, 0
    if held:
        raise ValueError("the archive ends within a record")


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    system, path = pa.fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """plan: page_id, url, html, first_id -> path, records of monolithic gzip archives in folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(folder)
        path, out, tool, count, size, done = "", None, None, 0, 0, []

        def close() -> None:
            out.write(tool.flush())
            out.close()
            done.append((path, count))

        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    path, tool, count, size = f"{top}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(4, zlib.DEFLATED, 31), 0, 0
                    out = system.open_output_stream(path, compression=None)
                page, refers, payload = page_id.as_py(), first.as_py(), (html.as_py() or "").encode()
                revisit = refers is not None and refers != page and len(payload) >= MIN_REVISIT_BYTES
                raw = record_bytes(page, url.as_py(), payload, refers, revisit)
                out.write(tool.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return plan.select("page_id", "url", "html", "first_id").mapInArrow(run, _FILES)


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """path, records of archives -> path, records of archives with a member a record, each with a sidecar index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(folder)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path, offset, count = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                with system.open_input_stream(source, compression=None) as stream, system.open_output_stream(path, compression=None) as out, system.open_output_stream(path + ".idx", compression=None) as index:
                    for raw in inflated_records(stream):
                        fields, _ = parse_record(raw)
                        member = gzip.compress(raw, 5, mtime=0)
                        out.write(member)
                        index.write((json.dumps({"offset": offset, "length": len(member), "type": fields["WARC-Type"], "id": fields["WARC-Record-ID"]}) + "\n").encode())
                        offset, count = offset + len(member), count + 1
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["path", "records"])

    return archives.mapInArrow(run, _FILES)


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the normalised archives, found by the sidecar indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with system.open_input_file(path) as data, system.open_input_stream(path + ".idx", compression=None) as index:
                    held = b""
                    while raw := index.read(CHUNK):
                        *lines, held = (held + raw).split(b"\n")
                        for line in lines:
                            entry = json.loads(line)
                            fields, block = parse_record(gzip.decompress(data.read_at(entry["length"], entry["offset"])))
                            head, _, payload = block.partition(b"\r\n\r\n")
                            stated = int(head.rsplit(b"Content-Length: ", 1)[1])
                            digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                            if not revisit and (len(payload) != stated or payload_digest(payload) != digest):
                                raise ValueError(f"a damaged record in {path}")
                            rows.append((page_of(fields["WARC-Record-ID"]), stated, digest, fields["WARC-Type"], page_of(fields["WARC-Refers-To"]) if revisit else None))
                        if len(rows) >= 5000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return archives.mapInArrow(run, _READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from the archives."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("payload", F.sha2("html", 256))
    stages = Scratch(spark)
    # staged, so that both sides of the join come straight from a shuffle and a payload of very many pages is split
    firsts = stages(rows.select("page_id", F.sha2("html", 256).alias("payload")).groupBy("payload").agg(F.min("page_id").alias("first_id")), "firsts")
    plan = keyed.join(firsts, "payload")
    raw_folder, folder = new_path(spark, "warc-raw"), new_path(spark, "warc")
    written = stage(write_archives(plan, raw_folder), "archives")
    normal = stage(normalise_archives(written.repartition(spark.sparkContext.defaultParallelism * 2, "path"), folder), "normalised")
    stages.drop()
    drop_path(spark, raw_folder)
    return read_archives(normal.repartition(spark.sparkContext.defaultParallelism * 2, "path"), folder)
