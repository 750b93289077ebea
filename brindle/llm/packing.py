"""Best-fit packing of token sequences with a bounded number of open bins.

Texts are encoded where they are read; only narrow piece rows (id, piece, length, checksum) are shuffled, dealt evenly by
their place in the input, whatever their ids are. A task packs the pieces of its shares as they arrive, by best fit: open bins hang in a
bitset keyed by free space, so the tightest bin that fits is one shift and one lowest set bit away. The number of open
bins is fixed (``OPEN_BINS``); when it is reached, the fullest bin closes. Pieces arrive in windows of about ``ARRIVE``
for each open bin (by hash), the longest of a window first, so that short ones can fill what is left, and open bins stay
open from window to window. A share's waste is its last bins, so it has many pieces (``PACK_PIECES``).

Defined results: a null or empty text is its end id alone; repeated rows are packed each for itself; a document longer
than a sequence is cut into full pieces and a rest. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Tokens of a sequence; id that ends a document; open bins a share; pieces of a window for each of them; pieces of a share on average.
LENGTH, END_ID, OPEN_BINS, ARRIVE, PACK_PIECES = 2048, 0, 512, 4, 50_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class OpenBins:
    """A fixed number of open bins, found by free space: ``place`` returns (bin, offset)."""

    def __init__(self, size: int = LENGTH, limit: int = OPEN_BINS):
        self.size, self.limit, self.open, self.made = size, limit, 0, 0
        self.free = 0  # bit f: some open bin has f free places
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, f: int) -> int:
        bins = self.at[f]
        b = bins.pop()
        if not bins:
            self.free &= ~(1 << f)
        return b

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1  # the least free space that suffices
            b = self._take(f)
            self.open -= 1
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.open -= 1
            b, f = self.made, self.size
            self.made += 1
        if f > length:  # a full bin closes
            self.at[f - length].append(b)
            self.free |= 1 << (f - length)
            self.open += 1
        return b, self.size - f


def cut(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document of (doc_id, text): where it starts, how long it is, and the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("tokens")
        encoder = tokens.encoder(tokenizer or tokens.word_tokenizer())
        for part in common.slices(batches):
            out: list[tuple] = []
            for doc, text in zip(part.column("doc_id").to_pylist(), common.text_bytes(part.column("text")).to_pylist(), strict=True):
                ids = np.append(np.frombuffer(encoder.encode(text), encoder.dtype).astype("<u4"), np.uint32(end_id))
                for k, a in enumerate(range(0, len(ids), length)):
                    piece = ids[a : a + length]
                    out.append((doc, k, a, len(piece), zlib.crc32(piece.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def place(lengths: Iterable[int], size: int = LENGTH, limit: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """(bin, offset) for each length, in order."""
    bins = OpenBins(size, limit)
    return (bins.place(n) for n in lengths)


def pack(pieces: DataFrame, rows: int, length: int = LENGTH, limit: int = OPEN_BINS) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``rows`` (about how many documents there are) sets the number of shares."""
    shares = max(2, -(-rows // PACK_PIECES))
    windows = max(1, min(PACK_PIECES, rows // shares) // (ARRIVE * limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, bins = None, OpenBins(length, limit)  # shares come one after the other
        for batch in batches:
            where, offset = [], []
            for s, n in zip(batch.column("share").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if s != share:
                    share, bins = s, OpenBins(length, limit)
                b, at = bins.place(n)
                where.append((s << 40) + b)
                offset.append(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(where, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # by place in the input: one doc_id, or none, may have any number of rows
    placed = pieces.withColumn("place", F.monotonically_increasing_id())
    dealt = placed.select("*", F.pmod(F.xxhash64("place"), F.lit(shares)).alias("share"), F.pmod(F.xxhash64("place", F.lit("window")), F.lit(windows)).alias("window"))
    ordered = dealt.repartition(shares, "share").sortWithinPartitions("share", "window", F.desc("length"), "place").drop("place", "window")
    return ordered.mapInArrow(run, PIECES + ", sequence_id bigint, offset bigint")


def sequences(packed: DataFrame, ids: DataFrame) -> DataFrame:
    """The sequences themselves, (sequence_id, ids array): ``ids`` has doc_id, piece, start and the piece's ids; a sequence is bounded by its length."""
    rows = packed.join(ids, ["doc_id", "piece", "start"])
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def best_fit(docs: DataFrame) -> DataFrame:
    """Cut and pack every row of ``docs`` (doc_id, text)."""
    return pack(cut(docs), docs.count())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(common.table(spark, sf_dir, "documents", "doc_id", "text"))
