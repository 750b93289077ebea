"""Removal of repeated byte strings by prefix-free parsing.

Texts are parsed into phrases at rolling-hash triggers: the trigger of a 50-byte string is the least rolling hash of its
12-byte grams, and a phrase is a maximal run of strings with the same trigger. Phrases overlap by 49 bytes, so every
50-byte string lies whole in exactly one phrase, no phrase's string is a prefix of another's continuation, and equal strings
lie in phrases with equal triggers. Rows are dealt by hash into slices of bounded size, once; all passes read that one
exchange:

1. Each slice sends the 40-bit fingerprints of its triggers to their buckets; a bucket answers each slice with two bits for
   each trigger: whether several documents have it, and whether it is hot (it has more than ``HOT_PHRASES`` phrases).
2. A slice keeps a dictionary of its distinct phrases with shared triggers and the least document of each (later copies are
   settled there) and sends it, packed, to the buckets. Phrases of hot triggers are first split into their strings, which
   go to buckets by their own content, so that no trigger fills a bucket.
3. In a bucket the dictionary is the distinct phrases in byte order, and the parse is the sequence of their ranks, by
   document. The suffix array of the dictionary orders all its suffixes to the depth of one string, by comparing bytes;
   the suffix array of the parse lists each phrase's occurrences by document (deeper order can't matter, as a phrase holds
   its strings whole). Both combine into corpus order: a run of suffixes with a common prefix of 50 bytes is one string, with
   the least document of its phrases' occurrences, and all other documents' starts in the run are covered.
4. Covered starts return to their slices, where each row's intervals are united and cut.

Fingerprints only choose what is compared; equality itself is decided by bytes.

Defined results: null and empty texts have nothing to remove; matches never cross documents; rows with equal doc_id
remove nothing from each other, not even equal texts; rows with null doc_id neither lose nor own anything. Very long
texts are parsed in overlapping pieces. Extra columns are kept or ignored, whatever their names are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: Bytes of a string that counts as repeated; bytes of a trigger gram; bytes parsed at once; text bytes of a slice, and those a bucket stands for.
LENGTH, GRAM, PIECE, SLICE_BYTES, BUCKET_BYTES = 50, 12, 1 << 20, 6 << 20, 9 << 20
#: A trigger of more phrases than this (about 10 MB) is hot: its strings are dealt one by one.
HOT_PHRASES = 100_000
#: Phrase bytes whose suffixes are sorted at once in a bucket (whole triggers).
SORTED_BYTES = 3 << 20
_VALUE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)
_P = np.uint64(0xA0761D6478BD642F)


def rolling(x: np.ndarray) -> np.ndarray:
    """Polynomial hash of each ``GRAM``-byte gram of bytes ``x``, combined from those of 4 and 8 bytes."""
    base = lambda k: np.uint64(pow(int(_P), k, 1 << 64))
    h, size, parts = _VALUE[x], 1, {}
    while True:
        parts[size] = h
        if size * 2 > GRAM:
            break
        h, size = h[:-size] + h[size:] * base(size), size * 2
    out, used, n = np.zeros(max(0, len(x) - GRAM + 1), np.uint64), 0, len(x) - GRAM + 1
    for size in sorted(parts, reverse=True):
        if GRAM - used >= size:
            out += parts[size][used : used + n] * base(used)
            used += size
    return common.mix64(out)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    m, size = h, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(h) - width + 1
    return np.minimum(m[:n], m[width - size : width - size + n])


def pieces(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """(row of each piece, its place in the text, the pieces joined, their offsets), of at most about ``PIECE`` bytes; pieces of one text overlap."""
    rows: list[int] = []
    base: list[int] = []
    parts: list[bytes] = []
    total = 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t or b"") - LENGTH + 1), PIECE):
            part = t[a : a + PIECE + LENGTH - 1] if t else b""
            if len(part) < LENGTH:
                continue
            rows.append(i)
            base.append(a)
            parts.append(part)
            total += len(part)
            if total >= PIECE:
                yield rows, base, b"".join(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                rows, base, parts, total = [], [], [], 0
    if parts:
        yield rows, base, b"".join(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def parse(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first start, number of starts, trigger) of each phrase of joined pieces."""
    x = np.frombuffer(raw, np.uint8)
    trigger = sliding_min(rolling(x), LENGTH - GRAM + 1)
    valid = np.ones(len(trigger), bool)  # starts whose string ends in the piece
    ends = offsets[1:-1]
    for k in range(1, LENGTH):
        valid[ends - k] = False
    new = np.ones(len(trigger), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (valid[1:] != valid[:-1])
    new[ends] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(trigger)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    piece = np.searchsorted(offsets, first, side="right") - 1
    return piece, first, count, trigger[first]


_SEGMENTS = [("slice", pa.int64()), ("row", pa.binary()), ("start", pa.binary()), ("count", pa.binary())]
_SEGMENT_SCHEMA = "slice bigint, row binary, start binary, count binary"


def _cuts(key: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of a sorted key begin and end."""
    at = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)).tolist() if len(key) else []
    return at, [*at[1:], len(key)] if at else []


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, joined."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)


def _by_slice(where: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[pa.Array]:
    """Covered starts packed by slice."""
    order = np.argsort(where, kind="stable")
    where, parts = where[order], [c[order].astype("<i8") for c in (row, start, count)]
    at, to = _cuts(where)
    return [pa.array(where[at], pa.int64()), *(pa.array([c[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary()) for c in parts)]


class Names:
    """Column names for a row's slice and the hash of its text that ``columns`` don't have."""

    def __init__(self, columns: list[str]):
        self.slice, self.tag = common.fresh("_slice", columns), common.fresh("_tag", columns)

    def ordered(self, table: pa.Table) -> pa.Table:
        """The rows of a slice as every pass numbers them."""
        return table.take(pc.sort_indices(table, [("doc_id", "ascending"), (self.tag, "ascending")]))


class Slice:
    """The phrases of one slice's rows, which are numbered in order of (doc_id, tag)."""

    def __init__(self, table: pa.Table, names: Names):
        self.name = table.column(names.slice)[0].as_py()
        table = names.ordered(table.select(["doc_id", "text", names.tag]))
        ids = table.column("doc_id").combine_chunks().cast(pa.int64())
        texts = common.text_bytes(table.column("text")).to_pylist()
        self.ids = ids.fill_null(0).to_numpy()
        known = ids.is_valid().to_pylist()
        found = []
        self.raw: list[bytes] = []
        for k, (rows, base, raw, offsets) in enumerate(pieces([t if ok else None for t, ok in zip(texts, known, strict=True)])):
            piece, first, count, trigger = parse(raw, offsets)
            row = np.array(rows)[piece]
            found.append((row, first - offsets[piece] + np.array(base)[piece], count, trigger, np.full(len(row), k), first))
            self.raw.append(raw)
        empty = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64, np.int64)]
        self.row, self.start, self.count, self.trigger, self.block, self.first = (np.concatenate(c) for c in zip(*found, strict=True)) if found else empty

    def marks(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, fingerprint) of each distinct trigger, in that order, and for each phrase its place in them."""
        mixed = common.mix64(self.trigger ^ _P)
        joint = ((mixed % np.uint64(buckets)) << np.uint64(40)) | (mixed >> np.uint64(24))
        joint, place = np.unique(joint, return_inverse=True)
        return (joint >> np.uint64(40)).astype(np.int64), joint & np.uint64((1 << 40) - 1), place

    def split(self, use: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, place in it, number of starts) of the phrases ``use``, with one row for each string of the ``hot`` ones."""
        cold = use[~hot]
        each = use[hot]
        n = self.count[each]
        return np.concatenate((cold, np.repeat(each, n))), np.concatenate((np.zeros(len(cold), np.int64), _spread(np.zeros(len(each), np.int64), n))), np.concatenate((self.count[cold], np.ones(n.sum(), np.int64)))

    def texts_of(self, phrase: np.ndarray, skip: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The bytes of each (phrase, place in it, number of starts)."""
        lo = self.first[phrase] + skip
        return [self.raw[b][i:j] for b, i, j in zip(self.block[phrase].tolist(), lo.tolist(), (lo + count + LENGTH - 1).tolist(), strict=True)]


def fingerprints(sliced: DataFrame, names: Names, buckets: int) -> DataFrame:
    """(bucket, slice, prints, several, phrases): each slice's distinct trigger fingerprints of a bucket, ascending, a bit for each if several of its documents have it, and its phrases (65,535 at most)."""

    def run(table: pa.Table) -> pa.Table:
        common.begin("suffix_dedup")
        here = Slice(table, names)
        bucket, mark, place = here.marks(buckets)
        own = here.ids[here.row]
        low, high = np.full(len(mark), np.iinfo(np.int64).max), np.full(len(mark), np.iinfo(np.int64).min)
        np.minimum.at(low, place, own)
        np.maximum.at(high, place, own)
        at, to = _cuts(bucket)
        five = mark.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        prints = [five[a:b].tobytes() for a, b in zip(at, to, strict=True)]
        bits = [np.packbits(low[a:b] < high[a:b]).tobytes() for a, b in zip(at, to, strict=True)]
        times = np.minimum(np.bincount(place, minlength=len(mark)), 65_535).astype("<u2")
        pack = zstandard.ZstdCompressor(level=1)  # nearly all are one
        counts = [pack.compress(times[a:b].tobytes()) for a, b in zip(at, to, strict=True)]
        return pa.table({"bucket": pa.array(bucket[at], pa.int64()), "slice": pa.array([here.name] * len(at), pa.int64()), "prints": pa.array(prints, pa.binary()), "several": pa.array(bits, pa.binary()), "phrases": pa.array(counts, pa.binary())})

    return sliced.groupBy(names.slice).applyInArrow(run, "bucket bigint, slice bigint, prints binary, several binary, phrases binary")


def answers(marks: DataFrame, hot_phrases: int) -> DataFrame:
    """(slice, bucket, shared, hot): bits for each fingerprint that a slice has sent, whether several documents have it, and whether it has more than ``hot_phrases`` phrases."""

    def run(table: pa.Table) -> pa.Table:
        common.begin("suffix_dedup")
        values, flags = [], []
        for prints, several in zip(table.column("prints").to_pylist(), table.column("several").to_pylist(), strict=True):
            five = np.frombuffer(prints, np.uint8).reshape(-1, 5)
            eight = np.zeros((len(five), 8), np.uint8)
            eight[:, :5] = five
            values.append(eight.view("<u8").ravel())
            flags.append(np.unpackbits(np.frombuffer(several, np.uint8), count=len(five)).astype(bool))
        times = np.concatenate([np.frombuffer(zstandard.decompress(p), "<u2") for p in table.column("phrases").to_pylist()])
        every = np.concatenate(values)
        many = np.flatnonzero(times > 1)
        often, own = np.unique(every[many], return_inverse=True)  # all else has a phrase a slice
        extra = np.bincount(own, times[many] - 1.0, len(often))
        every.sort()
        twice = every[1:][every[1:] == every[:-1]]
        total = extra + np.searchsorted(every, often, side="right") - np.searchsorted(every, often)
        often = often[total > hot_phrases]
        if len(values) > hot_phrases:
            often = np.union1d(often, every[hot_phrases:][every[hot_phrases:] == every[:-hot_phrases]])
        del every
        twice = np.unique(np.concatenate([twice, *(v[f] for v, f in zip(values, flags, strict=True))]))

        def bits(known: np.ndarray) -> pa.Array:
            at = [np.minimum(np.searchsorted(known, v), max(len(known) - 1, 0)) for v in values]
            return pa.array([np.packbits(known[k] == v if len(known) else np.zeros(len(v), bool)).tobytes() for k, v in zip(at, values, strict=True)], pa.binary())

        return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "shared": bits(twice), "hot": bits(often)})

    return marks.groupBy("bucket").applyInArrow(run, "slice bigint, bucket bigint, shared binary, hot binary")


def phrases(sliced: DataFrame, names: Names, replies: DataFrame, buckets: int) -> DataFrame:
    """Dictionary phrases with shared triggers, packed by bucket, and what slices settle themselves (bucket null)."""
    schema = pa.schema([("bucket", pa.int64()), ("payload", pa.binary()), *_SEGMENTS])

    def run(table: pa.Table, reply: pa.Table) -> pa.Table:
        common.begin("suffix_dedup")
        if not table.num_rows or not reply.num_rows:
            return schema.empty_table()
        here = Slice(table, names)
        bucket, mark, place = here.marks(buckets)
        bits = {k: (s, h) for k, s, h in zip(*(reply.column(c).to_pylist() for c in ("bucket", "shared", "hot")), strict=True)}
        at, to = _cuts(bucket)
        shared, hot = (np.concatenate([np.unpackbits(np.frombuffer(bits[k][i], np.uint8), count=b - a) for k, a, b in zip(bucket[at].tolist(), at, to, strict=True)]).astype(bool) for i in (0, 1))
        use = np.flatnonzero(shared[place])
        phrase, skip, count = here.split(use, hot[place[use]])
        where, group = bucket[place[phrase]], (mark[place[phrase]] & np.uint64(0xFFFF)).astype("<u2")
        # the dictionary: the least document of each distinct phrase
        texts = here.texts_of(phrase, skip, count)
        known: dict[bytes, int] = {}
        entry = np.fromiter((known.setdefault(t, len(known)) for t in texts), np.int64, len(texts))
        # strings of hot triggers are dealt by their own bytes
        alone = np.flatnonzero(hot[place[phrase]])
        if len(alone):
            own = np.array([string_hash(texts[i]) for i in alone.tolist()], np.uint64)
            where[alone], group[alone] = (own % np.uint64(buckets)).astype(np.int64), (own >> np.uint64(48)).astype("<u2")
        doc, row, start = here.ids[here.row[phrase]], here.row[phrase], here.start[phrase] + skip
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, entry, doc)
        late, use = np.flatnonzero(doc > least[entry]), np.flatnonzero(doc == least[entry])
        parts = []
        if len(late):
            own = _by_slice(np.full(len(late), here.name), row[late], start[late], count[late])
            parts.append(pa.Table.from_arrays([pa.nulls(len(own[0]), pa.int64()), pa.nulls(len(own[0]), pa.binary()), *own], schema=schema))
        if len(use):
            pack = zstandard.ZstdCompressor(level=3)
            use = use[np.argsort(where[use], kind="stable")]
            at, to = _cuts(where[use])
            made = []
            for a, b in zip(at, to, strict=True):
                k = use[a:b]
                head = np.array([len(k), here.name], "<i8").tobytes()
                body = (np.diff(doc[k], prepend=0), row[k].astype("<u4"), start[k].astype("<i8"), count[k].astype("<u4"), group[k])
                made.append(pack.compress(head + b"".join(c.tobytes() for c in body) + b"".join([texts[i] for i in k.tolist()])))
            parts.append(pa.Table.from_arrays([pa.array(where[use][at], pa.int64()), pa.array(made, pa.binary()), *(pa.nulls(len(at), t) for _, t in _SEGMENTS)], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return sliced.groupBy(names.slice).cogroup(replies.groupBy("slice")).applyInArrow(run, "bucket bigint, payload binary, " + _SEGMENT_SCHEMA)


def string_hash(text: bytes) -> int:
    """A 64-bit hash of a string's bytes, for dealing."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(doc, slice, row, start, count, group, bytes) of packed phrases."""
    raw = zstandard.decompress(payload)
    n, name = np.frombuffer(raw, "<i8", 2).tolist()
    take = lambda kind, at: np.frombuffer(raw, kind, n, at)
    return np.cumsum(take("<i8", 16)), np.full(n, name), take("<u4", 16 + 8 * n).astype(np.int64), take("<i8", 16 + 12 * n), take("<u4", 16 + 20 * n).astype(np.int64), take("<u2", 16 + 24 * n), raw[16 + 26 * n :]


def suffix_array(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``raw`` at ``at`` in byte order to a depth of ``LENGTH``: (order, whether the prefix differs from the one before).

    Bytes are compared eight at a time; only suffixes that are still tied are ordered further.
    """
    word = np.ndarray((max(0, len(raw) - 7),), ">u8", raw, strides=(1,))
    key = word[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    for depth in (*range(8, LENGTH - 8, 8), LENGTH - 8):
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        run, own = np.cumsum(new)[tied], order[tied]
        key = word[at[own] + depth].astype(np.uint64)
        # runs whose bytes are all equal here stay as they are
        unlike = run[1:][(key[1:] != key[:-1]) & (run[1:] == run[:-1])]
        if not len(unlike):
            continue
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[unlike] = True
        mixed = mixed[run]
        tied, run, own, key = tied[mixed], run[mixed], own[mixed], key[mixed]
        by = np.lexsort((key, run))
        order[tied], key = own[by], key[by]
        new[tied[1:]] |= (key[1:] != key[:-1]) & (run[1:] == run[:-1])
    return order, new


def covered(doc: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered runs (phrase, first start, number of starts) among the phrases ``texts`` of documents ``doc``: starts of strings that a smaller document has too."""
    dictionary = sorted(set(texts))
    rank = {t: i for i, t in enumerate(dictionary)}
    parse_of = np.fromiter((rank[t] for t in texts), np.int64, len(texts))
    # the suffix array of the parse: occurrences by phrase, then by document
    occurrences = np.lexsort((doc, parse_of))
    head = np.flatnonzero(np.diff(parse_of[occurrences], prepend=-1))
    least_of = doc[occurrences[head]]  # of each phrase
    size = np.fromiter(map(len, dictionary), np.int64, len(dictionary))
    count = size - (LENGTH - 1)
    at = _spread(np.cumsum(size) - size, count)
    phrase = np.repeat(np.arange(len(dictionary)), count)
    order, new = suffix_array(b"".join(dictionary), at)
    # corpus order: each suffix stands for its phrase's occurrences; runs of equal strings get their least document
    run = np.flatnonzero(new)
    least = np.empty(len(at), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(least_of[phrase[order]], run), np.diff(np.append(run, len(at))))
    hit = least < least_of[phrase]
    edge = np.ones(len(hit), bool)
    edge[1:] = (hit[1:] != hit[:-1]) | (phrase[1:] != phrase[:-1])
    first = np.flatnonzero(edge)
    length = np.diff(np.append(first, len(hit)))
    first, length = first[hit[first]], length[hit[first]]
    owner, inside = phrase[first], first - (np.cumsum(count) - count)[phrase[first]]
    # a phrase's least document has these runs covered; its other documents' occurrences are covered whole
    late = doc > least_of[parse_of]
    whole, mine = np.flatnonzero(late), np.flatnonzero(~late)
    a, b = np.searchsorted(owner, parse_of[mine]), np.searchsorted(owner, parse_of[mine], side="right")
    runs = _spread(a, b - a)
    return np.concatenate((whole, np.repeat(mine, b - a))), np.concatenate((np.zeros(len(whole), np.int64), inside[runs])), np.concatenate((count[parse_of[whole]], length[runs]))


def settle(packed: DataFrame) -> DataFrame:
    """Covered starts of all buckets and of all slices, packed by slice."""
    schema = pa.schema(_SEGMENTS)

    def run(table: pa.Table) -> pa.Table:
        common.begin("suffix_dedup")
        if table.column("payload").null_count:
            return table.select([k for k, _ in _SEGMENTS])  # settled in a slice
        parts = [_unpack(p) for p in table.column("payload").to_pylist()]
        doc, where, row, start, count, group = (np.concatenate([p[i] for p in parts]) for i in range(6))
        raw = b"".join(p[6] for p in parts)
        del parts, table
        size = count + LENGTH - 1
        end = np.cumsum(size)
        # whole groups of triggers at a time, about SORTED_BYTES
        order = np.argsort(group, kind="stable")
        edge = np.flatnonzero(np.diff(group[order].astype(np.int64), prepend=-1))
        filled = (np.cumsum(size[order]) - size[order])[edge] // SORTED_BYTES
        cut = edge[np.flatnonzero(np.diff(filled, prepend=-1))].tolist()
        out = []
        for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
            k = order[a:b]
            phrase, inside, length = covered(doc[k], [raw[i:j] for i, j in zip((end[k] - size[k]).tolist(), end[k].tolist(), strict=True)])
            out.append((where[k][phrase], row[k][phrase], start[k][phrase] + inside, length))
        common.finish()
        if not sum(len(o[0]) for o in out):
            return schema.empty_table()
        return pa.Table.from_arrays(_by_slice(*(np.concatenate(c) for c in zip(*out, strict=True))), schema=schema)

    key = F.coalesce("bucket", -1 - F.col("slice"))  # what slices have settled passes through groups of its own
    return packed.groupBy(key).applyInArrow(run, _SEGMENT_SCHEMA)


def united(segments: pa.Table) -> dict[int, np.ndarray]:
    """For each row of a slice with covered strings, its maximal removed runs as [from, to) pairs."""
    row, start, count = (np.frombuffer(b"".join(segments.column(c).to_pylist()), "<i8") for c in ("row", "start", "count"))
    if not len(row):
        return {}
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + count + LENGTH - 1)[order]
    # a running maximum of ends within each row: rows are set apart by a step larger than any place
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + row * step) - row * step
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    head = np.flatnonzero(fresh)
    pairs = np.column_stack((start[head], reach[np.append(head[1:], len(start)) - 1]))
    at, to = _cuts(row[head])
    return {int(row[head][a]): pairs[a:b] for a, b in zip(at, to, strict=True)}


def keep(text: bytes, cuts: np.ndarray | None) -> bytes:
    """``text`` without the [from, to) runs."""
    if cuts is None:
        return text
    out, at = [], 0
    for a, b in cuts.tolist():
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def apply(docs: DataFrame, function: Callable[[pa.Table, list[bytes | None], list[np.ndarray | None]], pa.Table], schema: str | StructType) -> DataFrame:
    """``function`` over the rows of ``docs`` in slices: it gets the rows, their texts, and each one's removed runs (or None)."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    slices, buckets = max(4, total // SLICE_BYTES), max(4, total // BUCKET_BYTES)
    names = Names(docs.columns)
    where = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).alias(names.slice)
    sliced = docs.select("*", where, F.xxhash64("text").alias(names.tag))
    segments = settle(phrases(sliced, names, answers(fingerprints(sliced, names, buckets), HOT_PHRASES), buckets))

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        common.begin("suffix_dedup")
        table = names.ordered(table)
        runs = united(found)
        return function(table, common.text_bytes(table.column("text")).to_pylist(), [runs.get(i) for i in range(table.num_rows)])

    return sliced.groupBy(names.slice).cogroup(segments.groupBy("slice")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut out of text; bytes left over of a cut character go with it."""
    names = docs.columns

    def run(table: pa.Table, texts: list[bytes | None], runs: list[np.ndarray | None]) -> pa.Table:
        new = [t if t is None else keep(t, r).decode("utf-8", "ignore") for t, r in zip(texts, runs, strict=True)]
        return pa.table({c: pa.array(new, pa.string()) if c == "text" else table.column(c) for c in names})

    return apply(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(table: pa.Table, texts: list[bytes | None], runs: list[np.ndarray | None]) -> pa.Table:
        texts = [t or b"" for t in texts]
        columns = {
            "doc_id": table.column("doc_id").cast(pa.int64()),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array([0 if r is None else int((r[:, 1] - r[:, 0]).sum()) for r in runs], pa.int64()),
            "n_spans": pa.array([0 if r is None else len(r) for r in runs], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(keep(t, r)).hexdigest() for t, r in zip(texts, runs, strict=True)], pa.string()),
        }
        return pa.table(columns)

    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return apply(docs, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
