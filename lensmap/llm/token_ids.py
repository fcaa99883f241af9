"""Token ids in binary shards, document boundaries in Elias-Fano code.

Documents are range-partitioned by doc_id; a shard (one file) is a row of
blocks, each self-contained:

    magic "EFB1" | header | EF(doc ids) | EF(document ends) | token ids | "\\n"

Token ids are unsigned 16-bit little-endian numbers (32-bit when the vocabulary
is larger), concatenated.  The document ends are kept as an Elias-Fano sequence:
of each end the low l bits as they are, the high bits in unary, in one bit
string with a sample of every 64th one.  ``EliasFano.get(i)`` selects the i-th
one from the nearest sample, so an offset needs no table of 64-bit numbers; the
code takes about 2 + log2(tokens / documents) bits a document.  Doc ids are
ascending, too, and are kept the same way.

Files are written by Spark's text sink (its commit protocol picks one attempt of
a task; "\\n" is its line separator) and read through ``binaryFile``.  The ids of
all documents before a shard are a running sum over one row per shard.

Defined cases: a null text is empty and has the end id alone; documents with a
null id come first; rows with the same id follow each other in the order of
their texts, a repeated row is written twice; an empty table gives no file and
no row; extra columns are ignored.  A text longer than a block has a block to
itself.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensmap.llm.bpe import PieceEncoder
from lensmap.llm.textscan import process_cache, slices
from lensmap.session import ensure_checkpoint_dir, materialize

MAGIC = b"EFB1"
HEAD = "<4sIIIQq"  # magic, documents, of them with a null id, bytes per id, tokens, smallest doc id
SAMPLE = 64
ROWS = ("shard long, block long, doc long, doc_id long, at long, n_tokens long, ids_crc32 long")


class EliasFano:
    """A non-decreasing sequence of n numbers in [0, universe]."""

    def __init__(self, n: int, universe: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.universe = n, universe
        self.l = max(0, (universe // n).bit_length() - 1) if n else 0
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> "EliasFano":
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        ef = cls(n, universe, b"", b"", b"")
        if not n:
            return ef
        if ef.l:
            bits = (v[:, None] >> np.arange(ef.l, dtype=np.uint64)) & np.uint64(1)
            ef.low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(ef.l)).astype(np.int64) + np.arange(n)
        bits = np.zeros(n + (universe >> ef.l) + 1, dtype=np.uint8)
        bits[ones] = 1
        ef.high = np.packbits(bits, bitorder="little")
        ef.samples = ones[::SAMPLE].astype("<u4")
        return ef

    def _low(self, i: int) -> int:
        out = 0
        for b in range(self.l):
            k = i * self.l + b
            out |= (int(self.low[k >> 3]) >> (k & 7) & 1) << b
        return out

    def select(self, i: int) -> int:
        """Place of the i-th one of the high bits, from the sample before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at >> 3, at & 7
        word = int(self.high[byte]) >> skip << skip
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + ((word & -word).bit_length() - 1)

    def get(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return ((self.select(i) - i) << self.l) | self._low(i)

    def all(self) -> np.ndarray:
        """The whole sequence, decoded at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        v = (ones - np.arange(self.n)).astype(np.int64) << self.l
        if self.l and self.n:
            bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.l].reshape(self.n, self.l)
            v |= (bits.astype(np.int64) << np.arange(self.l)).sum(axis=1)
        return v

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return struct.pack("<QQIII", self.n, self.universe, *map(len, parts)) + b"".join(parts)

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple["EliasFano", int]:
        n, universe, a, b, c = struct.unpack_from("<QQIII", data, at)
        at += 28
        return cls(n, universe, data[at:at + a], data[at + a:at + a + b], data[at + a + b:at + a + b + c]), at + a + b + c


class Block:
    """Documents of one block: ``ids(i)``, ``span(i)``, ``doc_id(i)``."""

    def __init__(self, n, n_null, base, doc_ids: EliasFano, ends: EliasFano, tokens: np.ndarray):
        self.n, self.n_null, self.base, self.doc_ids, self.ends, self.tokens = n, n_null, base, doc_ids, ends, tokens

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.get(i - 1) if i else 0), self.ends.get(i)

    def ids(self, i: int) -> np.ndarray:
        lo, hi = self.span(i)
        return self.tokens[lo:hi]

    def doc_id(self, i: int):
        return None if i < self.n_null else self.base + self.doc_ids.get(i - self.n_null)


def pack_block(doc_ids: list, ids: list[np.ndarray], width: int) -> bytes:
    """One block of documents in ascending doc_id order, null ids first."""
    n_null = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[n_null:], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    spread = (known.astype(np.uint64) - np.uint64(base & ((1 << 64) - 1))) if len(known) else known.astype(np.uint64)
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return b"".join([
        struct.pack(HEAD, MAGIC, len(doc_ids), n_null, width, total, base),
        EliasFano.of(spread, int(spread[-1]) if len(spread) else 0).to_bytes(),
        EliasFano.of(ends, total).to_bytes(), flat.astype(f"<u{width}").tobytes()])


def read_blocks(data: bytes) -> Iterator[Block]:
    view, at = memoryview(data), 0
    while at < len(view):
        magic, n, n_null, width, total, base = struct.unpack_from(HEAD, view, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        doc_ids, at = EliasFano.read(view, at + struct.calcsize(HEAD))
        ends, at = EliasFano.read(view, at)
        tokens = np.frombuffer(view[at:at + total * width], dtype=f"<u{width}")
        at += total * width + 1
        yield Block(n, n_null, base, doc_ids, ends, tokens)


def _encoder(path: str | None) -> PieceEncoder:
    kept = process_cache()
    if ("bpe", path) not in kept:
        if path is None:
            import public_tokenizers
            kept["bpe", path] = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
        else:
            kept["bpe", path] = PieceEncoder(path)
    return kept["bpe", path]


def _packer(path: str | None, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        width = 2 if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], dtype=np.uint32)
        for b in slices(batches, max_bytes=1 << 20):
            ids = enc.encode([t or "" for t in b.column("text").to_pylist()])
            block = pack_block(b.column("doc_id").to_pylist(), [np.concatenate([x, end]) for x in ids], width)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["value"])
    return pack


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encode (doc_id, text) and write the shards under ``path``.

    ``tokenizer``: a byte-level BPE file of the tokenizers library, readable on
    every executor (None: byte_bpe_50k.json of public_tokenizers)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    (d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(_packer(tokenizer, end_id), "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\n").text(path))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ROWS.split(", ")]
    for b in batches:
        for shard, content in zip(b.column("shard").to_pylist(), b.column("content")):
            for k, block in enumerate(read_blocks(content.as_buffer())):
                ends = block.ends.all()
                starts = np.concatenate([[0], ends[:-1]])
                ids = [None] * block.n_null + (block.doc_ids.all() + block.base).tolist()
                wide = block.tokens.astype("<u4")
                crc = [zlib.crc32(wide[a:z]) for a, z in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * block.n), pa.array([k] * block.n), pa.array(range(block.n), pa.int64()),
                     pa.array(ids, pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=names)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shard = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^part-(\d+)", 1).cast("long")
    rows = (spark.read.format("binaryFile").load(path).select(shard.alias("shard"), "content")
            .mapInArrow(_scan, ROWS))
    rows = materialize(rows, "token-rows")
    blocks = rows.groupBy("shard", "block").agg(F.sum("n_tokens").alias("n"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    at = (blocks.withColumn("off", F.coalesce(inside, F.lit(0))).join(shards, "shard")
          .select("shard", "block", (F.col("off") + F.col("base")).alias("base")))
    return (rows.join(at, ["shard", "block"])
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "block"))


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the shards of ``docs`` and return the documents read back from them."""
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/lensmap-ids-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)


def op2(spark, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "start", "n_tokens", "ids_crc32")
