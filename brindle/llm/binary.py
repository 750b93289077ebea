"""Token ids as binary segments with Elias-Fano coded document boundaries.

A segment holds the ids of consecutive documents, end to end, and their boundaries: a monotone sequence of n + 1 offsets
coded by Elias and Fano (low bits packed; high bits in unary in a bit vector, with a sample of every 64th one for select),
about 2 + log2(ids / documents) bits a document. ``boundaries.select(i)`` is the offset of document i without decoding the
rest. The documents' own ids ascend too, and are coded the same way.

The files are a Parquet table of segments (shard, segment, first id's place in the shard, n_docs, n_ids, blob), written by Spark's committer to
any store, so a lost executor's half-written segments never show. Documents are dealt by ranges of doc_id (balanced by
sampling; rows of one doc_id stay together), sorted in each range, and cut into segments of ``SEGMENT_IDS`` ids, so one task holds one segment.

Defined results: null or empty texts have only their end id; rows with equal doc_id are ordered by their text; null
doc_ids come first. An empty table gives an empty file. Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: The file format's mark and version; ids of a segment; the id that ends a document; ones between select samples.
MAGIC, SEGMENT_IDS, END_ID, SAMPLE = b"BRSEG002", 1 << 20, 2, 64
#: Bytes of text that a task writes.
TASK_BYTES = 16 << 20
SEGMENTS = "shard int, segment int, first bigint, n_docs bigint, n_ids bigint, blob binary"
_HEAD = struct.Struct("<8sB3xIIQQQq")  # magic, bytes an id, bytes of boundaries, bytes of names, documents, ids, documents without doc_id, least doc_id


class EliasFano:
    """A non-decreasing sequence of n + 1 values from 0 to u in about n * (2 + log2(u / n)) bits."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1])
        bits = max(0, (top // n).bit_length() - 1)
        values = values.astype(np.uint64)
        low = values & np.uint64((1 << bits) - 1)
        packed = np.packbits(((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if bits else np.zeros(0, np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1, np.uint8)
        vector[ones] = 1
        return cls(n, bits, packed, np.packbits(vector, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        return int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8].tobytes(), "little") >> (a % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i: the place of the i-th one, from the sample before it on."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, word = place // 8, int(self.high[place // 8]) >> (place % 8) << (place % 8)
        while True:
            ones = word.bit_count()
            if left < ones:
                for _ in range(left):
                    word &= word - 1
                return ((byte * 8 + (word & -word).bit_length() - 1 - i) << self.low_bits) | self._low(i)
            left -= ones
            byte += 1
            word = int(self.high[byte])

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        high = (ones - np.arange(self.count)) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits)
        return high | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def to_bytes(self) -> bytes:
        return struct.pack("<QBII", self.count, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        count, bits, n_low, n_high = struct.unpack_from("<QBII", raw)
        at = struct.calcsize("<QBII")
        take = lambda n, kind="u1": np.frombuffer(raw, kind, n, at)
        low = take(n_low)
        at += n_low
        high = take(n_high)
        at += n_high
        return cls(count, bits, low, high, take(-(-count // SAMPLE), "<u4"))


class Segment:
    """A segment of the file: boundaries and doc_ids by select, ids as an array."""

    def __init__(self, blob: bytes):
        magic, width, n_bounds, n_names, self.n_docs, n_ids, self.unnamed, self.least = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size
        self.boundaries = EliasFano.from_bytes(blob[at : at + n_bounds])
        self.names = EliasFano.from_bytes(blob[at + n_bounds : at + n_bounds + n_names]) if n_names else None
        self.ids = np.frombuffer(blob, f"<u{width}", n_ids, at + n_bounds + n_names)

    def doc_id(self, i: int) -> int | None:
        """The id of document i; those without one come first."""
        return None if i < self.unnamed else self.least + self.names.select(i - self.unnamed)

    @staticmethod
    def write(ids: bytes, width: int, ends: list[int], names: list[int | None]) -> bytes:
        """A segment's bytes: head, boundaries, doc_ids, ids (``ends``: where each document ends, in ids; ``names`` ascend, nulls first)."""
        boundaries = EliasFano.encode(np.array([0, *ends], np.int64)).to_bytes()
        known = [n for n in names if n is not None]
        least = known[0] if known else 0
        coded = EliasFano.encode(np.array([n - least for n in known], np.uint64)).to_bytes() if known else b""
        return _HEAD.pack(MAGIC, width, len(boundaries), len(coded), len(ends), ends[-1] if ends else 0, len(names) - len(known), least) + boundaries + coded + ids


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, tasks: int | None = None) -> DataFrame:
    """The segments of ``docs`` (doc_id, text) in ascending doc_id order; shard and segment number them in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("tokens")
        encoder = tokens.encoder(tokenizer or tokens.word_tokenizer())
        end, width = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        ends: list[int] = []
        ids: list[bytes] = []

        def flush() -> pa.RecordBatch:
            row = (shard, segment, first, len(ends), ends[-1], Segment.write(b"".join(ids), width, ends, names))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "segment", "first", "n_docs", "n_ids", "blob"])

        for part in common.slices(batches):
            for doc, text in zip(part.column("doc_id").to_pylist(), common.text_bytes(part.column("text")).to_pylist(), strict=True):
                own = encoder.encode(text) + end
                names.append(doc)
                ids.append(own)
                ends.append((ends[-1] if ends else 0) + len(own) // width)
                if ends[-1] >= SEGMENT_IDS:
                    yield flush()
                    segment, first = segment + 1, first + ends[-1]
                    names, ends, ids = [], [], []
        if ends:
            yield flush()
        common.finish()

    tasks = tasks or max(2, -(-(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // TASK_BYTES))
    return docs.select("doc_id", "text").repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENTS)


def digests(segments: DataFrame) -> DataFrame:
    """Read segments back where they lie: a row for each document with its global start, its length and the checksum of its ids, by select."""
    # ids of each shard: two numbers a shard, and there are as many shards as tasks wrote the files
    sizes = sorted((r["shard"], r["n"]) for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip((s for s, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "blob")), strict=True):
                here = Segment(blob)
                at = [here.boundaries.select(i) for i in range(here.n_docs + 1)]
                names = [here.doc_id(i) for i in range(here.n_docs)]
                sums = [zlib.crc32(here.ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:], strict=False)]
                start = np.array(at, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start[:-1] + (before[shard] + first)), pa.array(np.diff(start)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("shard", "first", "blob").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return digests(common.materialize(encode(docs), "tokens"))
