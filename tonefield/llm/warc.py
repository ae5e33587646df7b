"""WARC archives whose records are compressed one by one with a dictionary that leads the file."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, numbered, of_texts, stored

#: Skippable frame that holds the dictionary, as the .warc.zst convention has it.
MAGIC = 0x184D2A5D
#: The dictionary is trained on so many records at most, each no longer than that; its own bytes; zstd's level.
SAMPLES, SAMPLE_CHARS, DICTIONARY, LEVEL = 512, 100_000, 1 << 16, 6
#: The table of payloads that several pages have is broadcast if it has so many bytes at most.
BROADCAST = 32 << 20
#: An archive is closed once it has so many bytes; bytes read at once.
ARCHIVE, READ = 256 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header_value(x: str | None) -> str:
    """One line of printable characters: others, and %, as percent escapes."""
    return "".join(c if 32 < ord(c) < 127 and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in x or "")


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def page_record(page_id: str | None, url: str | None, html: str | None, first_id: str | None, first_url: str | None, is_first: bool) -> bytes:
    payload = (html or "").encode("utf-8", "replace")
    fields = [("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", header_value(url)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-Id", page_id or "")]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if is_first:
        return record("response", fields, block + payload)
    refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first_id)), ("WARC-Refers-To-Target-URI", header_value(first_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", first_id or "")]
    return record("revisit", fields + refers, block)


def dictionary(pages: DataFrame) -> bytes:
    """Trained on a bounded sample of records, the same in every run; empty where there is nothing to train on.

    The sample are the records of least hash; a bound on the hash leaves about four times as many for the sort.
    """
    fit, u = pages.where(F.length("html").between(1, SAMPLE_CHARS)), F.xxhash64("html", "page_id") / F.lit(2.0**64) + 0.5
    some = fit.where(u < 4 * SAMPLES / max(1, fit.count())).select("html", "page_id").orderBy(F.xxhash64("html", "page_id"), "page_id").limit(SAMPLES).collect()
    records = [page_record(str(r["page_id"]), None, r["html"], None, None, True) for r in some]
    try:
        return zstandard.train_dictionary(DICTIONARY, records).as_bytes() if records else b""
    except zstandard.ZstdError:  # too little to train on: the records themselves serve
        return b"".join(records)[:DICTIONARY]


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


class Writer:
    """One archive: the dictionary's frame, a warcinfo record, then each record as a frame of its own."""

    def __init__(self, folder: str, words: bytes):
        self.path = f"{folder}/pages-{uuid.uuid4().hex}.warc.zst"
        fs, self.at = open_fs(self.path)
        fs.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.fs, self.out, self.bytes, self.records = fs, fs.open_output_stream(f"{self.at}.part", compression=None), 0, 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        self.raw(struct.pack("<II", MAGIC, len(words)) + words)
        self.put(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def raw(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def put(self, data: bytes) -> None:
        self.raw(self.zip.compress(data))
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        self.fs.move(f"{self.at}.part", self.at)
        return {"path": self.path, "records": self.records, "bytes": self.bytes}


def written(pages: DataFrame, folder: str) -> DataFrame:
    """(path, records, bytes) of the archives that hold pages (page_id, url, html).

    Of equal payloads (of the same length and SHA-256) the smallest page_id is the response, one row of it where
    it repeats; the others revisit it and hold no payload. A null html is an empty payload. A null id comes
    after all others; where a payload has no other id its rows are responses. Ids are text in a task, so that they
    stay exact. Each task writes archives of its own into the folder, which all
    executors must see; the table lists those of the tasks that were finished, so one that a lost executor
    left behind is never read.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html").withColumn("payload", F.concat(F.unhex(F.sha2(payload, 256)), F.length(payload).cast("string").cast("binary")))
    ids = pages.groupBy("payload", "page_id").agg(F.min("url").alias("url"), F.count("*").alias("n"))
    firsts = ids.groupBy("payload").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.min_by("n", "page_id").alias("same"), F.sum("n").alias("n"))
    firsts = stored(firsts.where("n > 1").drop("n"), "firsts")
    size = firsts.agg(F.sum(F.lit(80) + F.coalesce(F.length("first_url"), F.lit(0)))).first()[0] or 0
    rows = pages.join(F.broadcast(firsts) if size <= BROADCAST else firsts, "payload", "left")
    rows = rows.withColumn("is_first", F.col("first_id").isNull() | F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False)))
    several = F.col("is_first") & F.coalesce(F.col("same") > 1, F.lit(False))
    if firsts.where("same > 1").limit(1).count():
        again = numbered(stored(rows.where(several), "repeats"), ["payload"], "place")
        rows = rows.where(~several).unionByName(again.withColumn("is_first", F.col("place") == 1).drop("place"))
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("first_id").cast("string").alias("first_id"), "first_url", "is_first")
    words = dictionary(pages)

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for p in parts:
            for r in p.itertuples(index=False):
                page, url, html, first, first_url = (x if isinstance(x, str) else None for x in r[:5])
                out = out or Writer(folder, words)
                out.put(page_record(page, url, html, first, first_url, bool(r[5])))
                if out.bytes > ARCHIVE:
                    yield pd.DataFrame([out.close()])
                    out = None
        if out:
            yield pd.DataFrame([out.close()])

    return stored(of_texts(rows).mapInPandas(of, "path string, records long, bytes long"), "archives")


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive, one at a time."""
    fs, at = open_fs(path)
    with fs.open_input_stream(at, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != MAGIC:
            raise ValueError("no dictionary frame")
        words = f.read(size)
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        frame, out, data = unzip.decompressobj(), [], f.read(READ)
        while data:
            out.append(frame.decompress(data))
            data = b""
            if frame.eof:
                data = frame.unused_data
                yield parsed(b"".join(out))
                frame, out = unzip.decompressobj(), []
            data = data or f.read(READ)
        if out:
            raise ValueError("the archive ends within a record")


def read(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, html of each record of the archives (path).

    The digest of a response is computed from the payload that was read and must be the one in its header.
    """

    schema = pa.schema({"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "html": pa.string()})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                some: list[dict] = []
                size = 0
                for h, block in records(path):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    n = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                    whole, said = h["WARC-Type"] == "response", h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if whole and (digest(payload) != said or len(payload) != n):
                        raise ValueError(f"a payload in {path} is not what its header says")
                    some.append({"page_id": int(h["X-Page-Id"]) if h["X-Page-Id"] else None, "url": h["WARC-Target-URI"], "payload_bytes": n, "payload_digest": said, "record_type": h["WARC-Type"], "refers_to": None if whole else int(h["X-Refers-To-Page-Id"]), "html": payload.decode() if whole else None})
                    size += len(payload)
                    if size > READ:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

    return archives.select("path").mapInArrow(of, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages into new archives in the shared folder and reads those."""
    archives = written(pages, new_path(spark, "warc"))
    return read(archives.repartition(max(1, min(10_000, archives.count()))))
