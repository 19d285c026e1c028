"""WARC archives: writing, normalising monolithic gzip files, and reading back by offset index.

Three steps, joined by small tables of records (never by payloads):

write      Each task writes its rows as WARC records into gzip files of one
           member each (a monolithic file: nothing in it can be read without
           inflating all before), closed once it holds FILE_BYTES of records.
normalise  One task a file inflates the whole stream once, and writes every
           record as a gzip member of its own with a sidecar index of offsets
           and lengths.  Records that repeat an earlier payload become revisit
           records here: the response is the one of least id with that payload.
read       One task a file follows the index, inflates each member alone and
           parses its record.

Files live below the shared checkpoint folder.  A task names its files at
random and reports them in its output rows, so a second attempt of a task
leaves orphans, not wrong results; normalising and reading are repeatable.
Payload groups are aggregated on digests, pre-aggregated a task, so a payload
that is a third of all pages costs one row a task.

Edge cases.  A null payload is empty.  A null URL has no target header.  Of
equal payloads of at least ``least`` bytes the least id is the response (null
ids last; then file and place decide); smaller ones are all responses.  An id
may repeat: each row is a record.  A payload may hold anything, also what looks
like records: lengths rule.  A payload longer than FILE_BYTES is one record whole,
held in memory by one task.  Extra columns are not read.  An empty table gives no
files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonogrid.llm import _text
from sonogrid.llm._store import open_fs, shared_dir, written

FILE_BYTES = 32 << 20
LEVEL = 3
VERSION = "WARC/1.1"
DATE = "2020-01-01T00:00:00Z"
_WRITTEN = "file string, place long, page_id long, payload_bytes long, payload_digest string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    number = uri[len("<urn:page:") : -1] if uri else ""
    return int(number) if number else None


def build_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def response_headers(page_id: int | None, url: str | None, payload: bytes) -> list[tuple[str, str]]:
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    return [*headers, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8")]


def revisit_headers(headers: list[tuple[str, str]], refers_to: int | None) -> list[tuple[str, str]]:
    kept = [(k, v) for k, v in headers if k not in ("WARC-Type", "Content-Length")]
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return [("WARC-Type", "revisit"), *kept, ("WARC-Profile", profile), ("WARC-Refers-To", record_uri(refers_to))]


class Reader:
    """Records of an uncompressed WARC stream given in pieces of any size."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buffer, self.at = pieces, bytearray(), 0

    def _more(self) -> bool:
        if self.at:
            del self.buffer[: self.at]
            self.at = 0
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.buffer += piece
        return True

    def __iter__(self) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
        while True:
            while (end := self.buffer.find(b"\r\n\r\n", self.at)) < 0:
                if not self._more():
                    if self.at < len(self.buffer):
                        raise ValueError("a record is cut short")
                    return
            lines = bytes(self.buffer[self.at : end]).decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record: {lines[0][:40]!r}")
            headers = [tuple(x.split(": ", 1)) for x in lines[1:]]
            size = int(dict(headers)["Content-Length"])
            self.at = end + 4
            while len(self.buffer) < self.at + size + 4:
                if not self._more():
                    raise ValueError("a record is cut short")
            yield headers, bytes(self.buffer[self.at : self.at + size])
            self.at += size + 4


def inflate(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """The content of a gzip stream, also of several members, in pieces of bounded size."""
    inflater = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            yield inflater.decompress(data, 4 * size)
            data = inflater.unconsumed_tail
            if inflater.eof:
                data = inflater.unused_data
                inflater = zlib.decompressobj(31)
    if tail := inflater.flush():
        yield tail


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _open_out(uri: str):
    system, path = open_fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def _open_in(uri: str, random: bool = False):
    system, path = open_fs(uri)
    return system.open_input_file(path) if random else system.open_input_stream(path, compression=None)


def _write(folder: str):
    """mapInArrow: monolithic files, a row for each record."""

    def run(batches):
        out = packer = None
        uri, place, held = "", 0, 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html")):
                if out is None:
                    uri, place, held = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = _open_out(uri), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                payload = (html.as_py() or "").encode()
                headers = response_headers(page_id, url, payload)
                record = build_record(headers, payload)
                out.write(packer.compress(record))
                rows.append((uri, place, page_id, len(payload), digest(payload)))
                place, held = place + 1, held + len(record)
                if held >= FILE_BYTES:
                    out.write(packer.flush())
                    out.close()
                    out = None
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["file", "place", "page_id", "payload_bytes", "payload_digest"])
        if out is not None:
            out.write(packer.flush())
            out.close()

    return run


def normalise_file(uri: str, refers_to: dict[int, int | None]) -> str:
    """Rewrite a monolithic file record by record beside itself; returns the new file's URI.

    ``refers_to``: place of each record that becomes a revisit, and the id it refers to.
    """
    target = uri.removesuffix(".warc.gz") + ".members.warc.gz"
    index, offset = [], 0
    with _open_in(uri) as stream, _open_out(target) as out:
        for place, (headers, block) in enumerate(Reader(inflate(stream))):
            if place in refers_to:
                headers, block = revisit_headers(headers, refers_to[place]), b""
            else:
                headers = [h for h in headers if h[0] != "Content-Length"]
            member = _member(build_record(headers, block))
            out.write(member)
            index.append((offset, len(member)))
            offset += len(member)
    with _open_out(f"{target}.index") as out:
        out.write(json.dumps({"file": target.rsplit("/", 1)[1], "members": index}).encode())
    return target


def read_member(stream, offset: int, length: int) -> tuple[list[tuple[str, str]], bytes]:
    """One record, by its place in the index."""
    stream.seek(offset)
    (record,) = Reader(iter([zlib.decompress(stream.read(length), 31)]))
    return record


def _normalise(pdf: pd.DataFrame) -> pd.DataFrame:
    again = pdf[pdf["revisit"]]
    refers = {int(p): None if pd.isna(r) else int(r) for p, r in zip(again["place"], again["refers_to"])}
    return pd.DataFrame({"file": [normalise_file(pdf["file"].iloc[0], refers)]})


def _read(batches):
    """mapInArrow: all records of normalised files by their indexes."""
    for batch in batches:
        for uri in batch.column("file").to_pylist():
            with _open_in(f"{uri}.index") as got:
                index = json.loads(got.read())["members"]
            rows = []
            with _open_in(uri, random=True) as stream:
                for offset, length in index:
                    headers, block = read_member(stream, offset, length)
                    has = dict(headers)
                    kind = has["WARC-Type"]
                    said = has["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(block) != said:
                        raise ValueError(f"{uri} at {offset}: the payload doesn't fit its digest")
                    size = len(block) if kind == "response" else int(has["X-Payload-Length"])
                    rows.append((page_of(has["WARC-Record-ID"]), size, said, kind, page_of(has.get("WARC-Refers-To"))))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Monolithic files of the pages; (file, place, page_id, payload_bytes, payload_digest) of each record."""
    _text.small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    return written(rows.mapInArrow(_write(shared_dir(pages.sparkSession)), _WRITTEN))


def normalise_archives(records: DataFrame, least: int = 0) -> DataFrame:
    """Normalise the files of ``write_archives``, payloads of ``least`` bytes or more stored once; (file) of each."""
    key = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id"), F.col("file"), F.col("place"))
    groups = records.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    several = groups.where("n > 1").select("payload_digest", "payload_bytes", "first")
    marked = records.join(several, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ((F.col("file") != F.col("first.file")) | (F.col("place") != F.col("first.place")))
    marked = marked.select("file", "place", again.alias("revisit"), F.when(again, F.col("first.page_id")).alias("refers_to"))
    # a file is much work on few rows, so the number of tasks follows the files, not the rows' bytes
    n = max(1, records.select("file").distinct().count())
    return written(marked.repartition(n, "file").groupBy("file").applyInPandas(_normalise, "file string"))


def read_archives(files: DataFrame) -> DataFrame:
    """The records of normalised files; many files are read side by side."""
    n = max(1, files.count())
    return files.repartition(n, "file").mapInArrow(_read, RECORDS)
