"""Token ids in length-delimited binary records with an offset index (operator 4).

Documents are dealt out by ranges of doc_id, so file n holds lower ids than file n + 1, and encoded where they land.
A record is: length (8 bytes), masked CRC-32C of the length (4), the payload, masked CRC-32C of the payload (4), all
little-endian. The payload is the ids, of 2 bytes each where the vocabulary allows it, else of 4. A separate Parquet
index holds file, offset and length of every record, for reads in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.llm.blobs import BlobWriter, open_blob
from runlore.llm.common import new_dir, session_setup
from runlore.llm.pieces import SPLIT, Pieces

#: CRC-32C (Castagnoli), reflected polynomial; and the constant that masks a checksum stored beside its data.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
#: Bytes whose checksums are joined before records are told apart.
BLOCK = 64
#: A file is closed at this size, and the next one of the same task begun.
FILE_BYTES = 1 << 29


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


@lru_cache(maxsize=1)
def _pair_table() -> np.ndarray:
    """The checksums of all two bytes, read as a little-endian number."""
    t, x = _byte_table(), np.arange(1 << 16, dtype=np.uint32)
    first = t[x & 255]
    return t[(first ^ (x >> 8)) & 255] ^ (first >> 8)


@lru_cache(maxsize=64)
def _shift_tables(power: int) -> tuple[np.ndarray, np.ndarray]:
    """What the lower and the upper half of a checksum become after 2**power zero bytes."""
    half = np.arange(1 << 16, dtype=np.uint32)
    if power == 0:
        t = _byte_table()
        return (half >> 8) ^ t[half & 255], half << 8
    before = _shift_tables(power - 1)
    return _shift_by(before[0], before), _shift_by(before[1], before)


def _shift_by(crc: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return tables[0].take(crc & np.uint32(0xFFFF)) ^ tables[1].take(crc >> np.uint32(16))


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of each record. All records are cut into blocks; the checksums of a block's bytes are joined in pairs,
    level by level, and a record's blocks by moving each to its distance from the end."""
    sizes = np.fromiter(map(len, records), np.int64, len(records))
    blocks = np.maximum(1, -(-sizes // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    raw = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    begins = (first + blocks) * BLOCK - sizes  # zeros in front change nothing while the register is zero
    for data, at, n in zip(records, begins.tolist(), sizes.tolist(), strict=True):
        raw[at : at + n] = np.frombuffer(data, np.uint8)
        raw[at : at + min(n, 4)] ^= 255  # the register starts as all ones
    crc = _pair_table().take(raw.view("<u2"))
    for power in range(1, BLOCK.bit_length() - 1):
        crc = _shift_by(crc[0::2], _shift_tables(power)) ^ crc[1::2]
    after = np.repeat(first + blocks, blocks) - 1 - np.arange(len(crc))  # blocks that follow within the record
    for bit in range(int(after.max(initial=0)).bit_length()):
        move = np.flatnonzero(after >> bit & 1)
        crc[move] = _shift_by(crc[move], _shift_tables(bit + BLOCK.bit_length() - 1))
    out = np.bitwise_xor.reduceat(crc, first) if len(records) else crc
    unmet = np.array([0xFFFFFFFF >> (8 * n) if n < 4 else 0 for n in sizes.tolist()], np.uint32)  # the ones that a short record did not meet
    return out ^ unmet ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def framed(payloads: list[bytes]) -> list[bytes]:
    """The records of some payloads."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    sums = masked(crc32c([*heads, *payloads])).astype("<u4")
    n = len(payloads)
    return [b"".join((h, sums[i].tobytes(), p, sums[n + i].tobytes())) for i, (h, p) in enumerate(zip(heads, payloads, strict=True))]


def payloads_of(records: list[bytes], where: str) -> list[bytes]:
    """The payloads of some records; an error if a length or checksum is wrong."""
    out = [r[12:-4] for r in records]
    for r, p in zip(records, out, strict=True):
        if len(r) < 16 or struct.unpack_from("<Q", r)[0] != len(p):
            raise ValueError(f"damaged length in {where}")
    sums = masked(crc32c([*(r[:8] for r in records), *out])).astype("<u4")
    n = len(records)
    for i, r in enumerate(records):
        if r[8:12] != sums[i].tobytes() or r[-4:] != sums[n + i].tobytes():
            raise ValueError(f"damaged record in {where}")
    return out


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes as: a printable byte is its own, and the others get those from
    256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)).difference(own))
    return {b: 256 + i for i, b in enumerate(others)}


class LibraryModel:
    """The tokenizers library's own model of a vocabulary, applied to pieces: its splitting is the same for any text, and
    several times the cost of looking pieces up, so each distinct piece goes to the library once."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.whole, self.kind = Tokenizer.from_file(path), kind
        self.model, self.before = self.whole.model, self.whole.pre_tokenizer
        byte_level = type(self.before).__name__ == "ByteLevel" and self.before.use_regex and not self.before.add_prefix_space
        plain = byte_level and self.whole.normalizer is None
        self.width, self.letters = np.dtype(kind).itemsize, _byte_letters()
        self.pieces = Pieces(SPLIT, self.piece_ids).encode if plain else self.whole_ids
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        # The library cuts a text at the strings of its added tokens before it splits.
        return self.whole_ids(text) if any(a in text for a in self.added) else self.pieces(text)

    def piece_ids(self, piece: str) -> bytes:
        # A piece is not split again, so its bytes only need to be written as the vocabulary's letters.
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(letters)])

    def whole_ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


@lru_cache(maxsize=2)
def library_model(path: str, kind: str) -> LibraryModel:
    return LibraryModel(path, kind)


INDEX = "file string, part int, record long, doc_id long, start long, offset long, size int, n_tokens long"


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 0, wide: bool = False, partitions: int | None = None) -> DataFrame:
    """Write the records and the index under out_dir; returns the index: file, part, record (in its part), doc_id, start
    (ids of the part before it), offset, size and n_tokens.

    docs: doc_id, text; other columns are ignored. Order: ascending doc_id, null ids first, ties by the text's hash, so
    that one id's many rows spread over files. A null text counts as empty: its record holds the end id alone. Repeated
    rows give a record each. An empty table gives an empty index. wide: 4-byte ids, needed beyond 65,536 of them.
    partitions: files at least; by default the session's shuffle partitions.
    """
    spark = docs.sparkSession
    session_setup(spark)
    kind = "<u4" if wide else "<u2"
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, file, count, before, files = None, "", 0, 0, 0
        end = np.array([end_id], kind).tobytes()
        for b in batches:
            parts = b.column(3).to_pylist()
            made: list[list] = [[] for _ in INDEX.split(", ")]
            encode = library_model(tokenizer_path, kind).encode
            payloads = [encode(t or "") + end for t in b.column(1).to_pylist()]
            for doc_id, part, payload, data in zip(b.column(0).to_pylist(), parts, payloads, framed(payloads), strict=True):
                if out is None or out.size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    file = f"{out_dir}/ids/part-{part:06d}-{files:04d}.bin"
                    out, files = BlobWriter(file), files + 1
                n_tokens = len(payload) // len(end)
                for column, x in zip(made, (file, part, count, doc_id, before, out.size, len(data), n_tokens), strict=True):
                    column.append(x)
                out.write(data)
                count, before = count + 1, before + n_tokens
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    rows.mapInArrow(run, INDEX).write.parquet(f"{out_dir}/index")
    return read_index(spark, out_dir)


def read_index(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{out_dir}/index")


def read_token_files(spark: SparkSession, out_dir: str, wide: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (bytes as stored), ids_crc32 (of the ids as 4-byte
    integers), read from the files by the index, with every checksum compared."""
    session_setup(spark)
    index = read_index(spark, out_dir)
    # One row for each part of the files; where a part begins among all ids is a sum over these few rows.
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = {r["part"]: r["n"] for r in totals.collect()}
    bases, total = {}, 0
    for part in sorted(ahead):
        bases[part], total = total, total + ahead[part]
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for b in batches:
            file, part, doc_id, start, offset, size, n = (b.column(i).to_pylist() for i in range(7))
            records = []
            for f, at, k in zip(file, offset, size, strict=True):
                if f != name:
                    if source is not None:
                        source.close()
                    name, source = f, open_blob(f)
                source.seek(at)
                records.append(source.read(k))
            ids = [np.frombuffer(x, kind) for x in payloads_of(records, str(name))]
            if [len(x) for x in ids] != n:
                raise ValueError(f"the index has other lengths than {name}")
            starts = [bases[p] + s for p, s in zip(part, start, strict=True)]
            crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            columns = [pa.array(doc_id, pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])
        if source is not None:
            source.close()

    rows = index.select("file", "part", "doc_id", "start", "offset", "size", "n_tokens")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def fresh_dir(spark: SparkSession) -> str:
    return new_dir(spark, "tokens")
