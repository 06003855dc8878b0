"""WARC archives in seekable Zstandard bundles (operator 5).

Records are grouped into frames that decompress on their own; a seek table of the frames' sizes, in a skippable frame,
ends each file. A Parquet map holds file, frame and offset within the frame of every record id, so one record costs one
frame. Equal payloads are stored once: the page with the largest id holds it, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.llm.blobs import BlobWriter, open_blob
from runlore.llm.common import new_dir, scratch, session_setup, written

#: Bytes of records in a frame, and of frames in a file.
FRAME_BYTES = 1 << 20
FILE_BYTES = 1 << 29
LEVEL = 3
#: The seekable format's numbers: a skippable frame's magic, and the seek table's at the end of the file.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: When records say they were made: a parameter of the data, so that equal inputs give equal files.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, page_id long, file string, frame int, offset long, size long, record_type string, refers_to long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    """The name of a row's record: its page, which rows may share or lack, and the row's own number."""
    return f"urn:page:{'none' if page_id is None else page_id}:{row}"


def one_line(text: str | None) -> str:
    """A header's value: line ends would end it."""
    return re.sub(r"[\r\n]", lambda m: "%0D" if m[0] == "\r" else "%0A", text or "")


def warc_record(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A record of that name; a revisit where refers_to names the response that holds the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    stop = end + 4 + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"a record's length is wrong at {at}")
    return headers, data[end + 4 : stop], stop + 4


def page_of(name: str) -> int | None:
    page = name.strip("<>").split(":")[2]
    return None if page == "none" else int(page)


class BundleWriter:
    """Frames of records, and the seek table at the end."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES):
        self.out, self.frames, self.open, self.frame_bytes = BlobWriter(uri), [], bytearray(), frame_bytes
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset within it."""
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self.flush()
        place = (len(self.frames), len(self.open))
        self.open += record
        return place

    def flush(self) -> None:
        packed = self.pack.compress(bytes(self.open))
        self.frames.append((len(packed), len(self.open)))
        self.out.write(packed)
        self.open = bytearray()

    def close(self) -> None:
        if self.open:
            self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Any frame of a bundle by its number."""

    def __init__(self, uri: str):
        self.source = open_blob(uri)
        size = self.source.size()
        self.source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", self.source.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {uri}")
        self.source.seek(size - 9 - 8 * count)
        entries = list(struct.iter_unpack("<II", self.source.read(8 * count)))
        self.places, at = [], 0
        for packed, plain in entries:
            self.places.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.places[number]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)

    def close(self) -> None:
        self.source.close()


def with_sources(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, html, sha1 of each row, its number, and holder: page_id and number of the row that holds the payload,
    null where the row is a response itself. Rows are numbered once and written, so that all name a row alike."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    shared = rows.where((F.col("size") >= least_bytes) if least_bytes >= 0 else F.lit(False))
    holders = shared.groupBy("sha1").agg(F.max(F.struct("page_id", "row")).alias("holder"), F.count("*").alias("n"))
    holders = written(holders.where("n > 1").drop("n"), "holders")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder.page_id"))
    return rows.join(holders, "sha1", "left").withColumn("holder", F.when(revisit, F.col("holder"))).drop("size")


def write_bundles(pages: DataFrame, out_dir: str, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write a WARC record for each row of pages (page_id, url, html) and the map of record ids, and return the map.

    Of records with equal payloads of least_bytes or more, that with the largest page_id is a response and the others
    revisit it; rows that repeat the largest page_id are responses too, and revisits name the one of them with the largest
    number. A record id holds the page_id and the row's number in the table, so rows that share a page_id, or have none,
    have ids of their own. A null html is an empty payload; a null url an empty one; a record longer than frame_bytes is a
    frame of its own; a null page_id is less than any other and reads none in the record id (a group of null ids alone: all
    responses). Line ends in urls are percent-encoded. Other columns are ignored. An empty table gives an empty map.
    """
    spark = pages.sparkSession
    session_setup(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, file, files = None, "", 0
        for b in batches:
            made: list[list] = [[] for _ in INDEX.split(", ")]
            for page_id, number, url, html, holder, sha1, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bundle is None or bundle.out.size >= FILE_BYTES:
                    if bundle is not None:
                        bundle.close()
                    file, files = f"{out_dir}/warc/part-{part:06d}-{files:04d}.warc.zst", files + 1
                    bundle = BundleWriter(file, frame_bytes)
                name = record_id(page_id, number)
                refers_to = None if holder is None else record_id(holder["page_id"], holder["row"])
                data = warc_record(name, url, html.encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to)
                frame, offset = bundle.add(data)
                kind = "response" if holder is None else "revisit"
                row = (name, page_id, file, frame, offset, len(data), kind, holder and holder["page_id"])
                for column, x in zip(made, row, strict=True):
                    column.append(x)
            types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in INDEX.split(", ")])
        if bundle is not None:
            bundle.close()

    with scratch(spark):
        rows = with_sources(pages, least_bytes).select("page_id", "row", "url", "html", "holder", "sha1")
        rows.withColumn("part", F.spark_partition_id()).mapInArrow(run, INDEX).write.parquet(f"{out_dir}/map")
    return read_map(spark, out_dir)


def read_map(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{out_dir}/map")


def read_record_at(uri: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record, from its frame alone."""
    bundle = BundleReader(uri)
    try:
        headers, block, _ = parse_record(bundle.frame(frame), offset)
    finally:
        bundle.close()
    return headers, block


def read_bundles(spark: SparkSession, out_dir: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives, frame by frame: page_id, payload_bytes and payload_digest of the full
    payload, record_type, refers_to, record_id, url, payload (null for revisits, or without payloads). A response's
    digest is computed from its payload and compared with its header; a revisit has length and digest from its headers."""
    session_setup(spark)
    files = read_map(spark, out_dir).groupBy("file").agg(F.max("frame").alias("last"))
    frames = files.select("file", F.explode(F.sequence(F.lit(0), "last")).alias("frame"))
    # Whole frames are dealt out, so a large file is read by many tasks.
    work = frames.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "frame").sortWithinPartitions("file", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for b in batches:
            for file, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bundle = BundleReader(file)
                data = bundle.frame(frame)
                bundle.close()
                made: list[list] = [[] for _ in names]
                at = 0
                while at < len(data):
                    headers, block, at = parse_record(data, at)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or digest_of(payload) != digest):
                        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']} in {file}")
                    name = headers["WARC-Record-ID"]
                    row = (page_of(name), size, digest, headers["WARC-Type"], page_of(headers["WARC-Refers-To"]) if revisit else None, name.strip("<>"), headers["WARC-Target-URI"], payload if payloads and not revisit else None)
                    for column, x in zip(made, row, strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types, strict=True)], names)

    return work.mapInArrow(run, RESULT)


def fresh_dir(spark: SparkSession) -> str:
    return new_dir(spark, "bundles")
