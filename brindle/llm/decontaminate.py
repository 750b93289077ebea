"""Benchmark decontamination under edit distance.

A document holds an item if some run of its words is within an edit distance (words inserted, deleted, replaced) of a
fifth of the item's words. Candidates come from an embedding of edit distance into Hamming distance: a random walk reads a
window word by word, and at each step the word under it and the step's random bits decide whether it moves on, so walks over two
versions of a text fall in step again after an edit. Bit sampling reads a few steps of a walk as one key (``PLANS``). Documents
are read in windows of the items' size from every word on; items are embedded from each of their words on, so a copy
whose first words are edited still meets. Walks with new random bits are repeated until a copy with as many edits as are allowed is found
with probability ``TARGET_RECALL``: their number follows, for each length of item, from a simulation with random edits. Then an
exact edit distance of the whole item decides around each candidate, so nothing else is told.

Items are the stated query set. Their index is built once and broadcast, in blocks of bounded size (``BLOCK_BYTES``); a block is one pass
over the documents, and several blocks are written one after the other.

Defined results: items without words and null or empty texts match nothing; short items are searched whole like others (under
five words no edit is allowed); repeated rows match each; with several places in a document, the one with fewest edits, then
the first, is told. Capitals A-Z and white space don't count. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import words

#: Edits allowed for 100 words of the item; bytes of item text in a block; least share of the copies at the limit that has to be found.
EDIT_PERCENT, BLOCK_BYTES, TARGET_RECALL = 20, 4 << 20, 0.9999
#: Bit sampling: (least words of an item, steps of a walk, steps sampled, words that a key must show at least).
PLANS = ((1, 1, 1, 1), (2, 4, 2, 2), (3, 6, 3, 3), (15, 8, 4, 3), (25, 10, 5, 4))
#: Simulated copies of the calibration; walks at most (a length that needs more is an error).
TRIALS, MOST_WALKS = 4000, 256
#: Bits of the table that tells most keys of documents from those of items.
_BITS = 22
#: Places behind the last word that a walk may reach.
_TAIL = max(steps for _, steps, _, _ in PLANS)
_P = np.uint64(0x9E3779B97F4A7C15)


def plan_of(size: int) -> int:
    """The last plan for items of ``size`` words."""
    return max(k for k, (least, _, _, _) in enumerate(PLANS) if size >= least)


@lru_cache(maxsize=1024)
def sampled(plan: int, repeat: int) -> tuple[int, tuple[int, ...]]:
    """(seed, sampled steps) of a repeated walk."""
    rng = np.random.default_rng((plan, repeat))
    _, steps, take, _ = PLANS[plan]
    return int(rng.integers(1, 1 << 63)), tuple(sorted(rng.choice(steps, take, replace=False).tolist()))


def embed(hashes: np.ndarray, plan: int, repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, words it shows, last place it shows) of the walk from every word on; ``hashes`` are :func:`padded`."""
    seed, steps = sampled(plan, repeat)
    coin = common.mix64(hashes ^ np.uint64(seed)).astype(np.uint32)  # a bit for each step
    n = len(hashes) - _TAIL
    at = np.arange(n, dtype=np.int32)
    key, shown, before = np.full(n, np.uint64(plan * MOST_WALKS + repeat)), np.zeros(n, np.uint8), np.full(n, -1, np.int32)
    for step in range(steps[-1] + 1):
        if step in steps:
            key *= _P
            key += hashes[at]
            shown += at != before
            before = at.copy()
        if step < steps[-1]:
            at += ((coin[at] >> np.uint32(step)) & np.uint32(1)).astype(np.int32)
    return common.mix64(key), shown, at


def padded(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate((hashes, np.zeros(_TAIL, np.uint64)))


@lru_cache(maxsize=1024)
def walks(size: int, edits: int, target: float = TARGET_RECALL) -> int:
    """How many walks find a copy of an item of ``size`` words with ``edits`` random edits with probability ``target``."""
    rng = np.random.default_rng((size, edits))
    plan = plan_of(size)
    least = PLANS[plan][3]
    stride = size + edits + _TAIL
    items = rng.integers(1, 1 << 63, (TRIALS, size + _TAIL), dtype=np.uint64)
    copies = rng.integers(1, 1 << 63, (TRIALS, stride), dtype=np.uint64)
    for item, copy in zip(items, copies, strict=True):
        made = item[:size].tolist()
        for _ in range(edits):
            place, kind = int(rng.integers(max(1, len(made)))), int(rng.integers(3))
            made[place : place + (kind > 0)] = [int(rng.integers(1, 1 << 62))] if kind < 2 else []
        copy[: len(made)] = made
    found = np.zeros(TRIALS, bool)
    trial, other = np.repeat(np.arange(TRIALS), size + _TAIL), np.repeat(np.arange(TRIALS), stride)
    place = np.tile(np.arange(size + _TAIL), TRIALS)
    for repeat in range(MOST_WALKS):
        key, shown, last = embed(padded(items.ravel()), plan, repeat)
        good = (place < size) & (shown >= least) & (last - np.arange(len(last)) + place < size)
        mark = lambda k, t: k ^ common.mix64(t.astype(np.uint64) * _P + _P)
        theirs = embed(padded(copies.ravel()), plan, repeat)[0]
        met = np.isin(mark(key[good], trial[good]), mark(theirs, other))
        found[trial[good][met]] = True
        if found.mean() >= target:
            return repeat + 1
    raise ValueError(f"items of {size} words need more than {MOST_WALKS} walks")


class Items:
    """Benchmark items, indexed by the sampled keys of their walks."""

    def __init__(self, ids: list[int], texts: list[bytes], edit_percent: int = EDIT_PERCENT, target: float = TARGET_RECALL):
        self.hashes, first, _, _ = words(texts)
        self.ids = ids
        self.first = first
        self.size = np.diff(first)
        self.allowed = self.size * edit_percent // 100
        self.patterns: dict[int, tuple[dict[int, int], int]] = {}
        # lengths with equally many edits are calibrated by the shortest one, which loses most
        worst: dict[tuple[int, int], int] = {}
        for n, k in zip(self.size.tolist(), self.allowed.tolist(), strict=True):
            if n:
                worst[plan_of(n), k] = min(n, worst.get((plan_of(n), k), n))
        needed = {key: walks(n, key[1], target) for key, n in worst.items()}
        plans = np.array([plan_of(n) if n else -1 for n in self.size.tolist()])
        repeats = np.array([needed[plan_of(n), k] if n else 0 for n, k in zip(self.size.tolist(), self.allowed.tolist(), strict=True)])
        item = np.repeat(np.arange(len(ids)), self.size)
        end = np.repeat(first[1:], self.size)
        keys, owner, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        #: plan -> number of walks
        self.walks = {int(p): int(repeats[plans == p].max()) for p in np.unique(plans) if p >= 0}
        for plan, most in self.walks.items():
            for repeat in range(most):
                key, shown, last = embed(padded(self.hashes), plan, repeat)
                take = np.flatnonzero((plans[item] == plan) & (repeats[item] > repeat) & (shown >= PLANS[plan][3]) & (last < end))
                keys.append(key[take])
                owner.append(item[take])
                offset.append(take - first[item[take]])
        key, owned, off = np.concatenate(keys), np.concatenate(owner), np.concatenate(offset)
        order = np.argsort(key, kind="stable")
        self.keys, self.item, self.offset = key[order], owned[order], off[order]
        self.maybe = np.zeros(1 << (_BITS - 3), np.uint8)
        bit = self.keys >> np.uint64(64 - _BITS)
        np.bitwise_or.at(self.maybe, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))

    def spans(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, from, to) of the runs of words in which a copy that shares a key may lie, ascending; ``first`` is each document's first word."""
        found = [np.zeros((0, 3), np.int64)]
        behind = padded(hashes)
        for plan, most in self.walks.items():
            for repeat in range(most):
                key = embed(behind, plan, repeat)[0]
                bit = (key >> np.uint64(64 - _BITS)).astype(np.int32)
                hit = np.flatnonzero((self.maybe[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                a, b = np.searchsorted(self.keys, key[hit]), np.searchsorted(self.keys, key[hit], side="right")
                n = b - a
                row = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = np.repeat(hit, n)
                found.append(np.column_stack((np.searchsorted(first, place, side="right") - 1, self.item[row], place - self.offset[row])))
        doc, item, begin = np.unique(np.concatenate(found), axis=0).T
        if not len(doc):
            return
        low = np.maximum(first[doc], begin - self.allowed[item])
        high = np.minimum(first[doc + 1], begin + self.size[item] + self.allowed[item])
        # spans that overlap are one, so that an item is looked for once in each word of a document
        head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1]))))
        high = high[np.append(head[1:], len(doc)) - 1]
        yield from zip(doc[head].tolist(), item[head].tolist(), low[head].tolist(), high.tolist(), strict=True)

    def distance(self, item: int, text: list[int]) -> tuple[int, int]:
        """(fewest edits, end) of the whole item against any run of ``text`` (word hashes), by bit-parallel columns."""
        if item not in self.patterns:
            masks: dict[int, int] = {}
            own = self.hashes[self.first[item] : self.first[item + 1]].tolist()
            for k, h in enumerate(own):
                masks[h] = masks.get(h, 0) | 1 << k
            self.patterns[item] = masks, len(own)
        masks, n = self.patterns[item]
        full, top = (1 << n) - 1, 1 << (n - 1)
        up, down, score = full, 0, n
        best, end = n, 0
        for j, h in enumerate(text):
            eq = masks.get(h, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | ~(xh | up) & full
            mh = up & xh
            score += bool(ph & top) - bool(mh & top)
            ph <<= 1
            mh <<= 1
            up = (mh | ~(xv | ph)) & full
            down = ph & xv & full
            if score < best:
                best, end = score, j + 1
        return best, end


def contaminated(docs: DataFrame, benchmark: DataFrame, edit_percent: int = EDIT_PERCENT, target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, item_id, start, n_item_words, edits) for each document (doc_id, text) and each item (item_id, text) it holds; start counts words and is about where the copy begins."""
    benchmark = benchmark.filter("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text")
    blocks = max(1, -(-(benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // BLOCK_BYTES))

    def search(block: int) -> DataFrame:
        rows = sorted((r["item_id"], r["text"]) for r in benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect())
        ids = [r[0] for r in rows]
        index = docs.sparkSession.sparkContext.broadcast(Items(ids, [r[1].encode() for r in rows], edit_percent, target))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.begin("decontaminate")
            items = index.value
            for part in common.slices(batches):
                names = part.column("doc_id").to_pylist()
                hashes, first, _, _ = words(common.text_bytes(part.column("text")).to_pylist())
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for d, i, lo, hi in items.spans(hashes, first):
                    n = int(items.size[i])
                    edits, end = items.distance(i, hashes[lo:hi].tolist())
                    if edits <= items.allowed[i]:
                        now = (edits, max(0, lo + end - n - int(first[d])))
                        best[d, i] = min(best.get((d, i), now), now)
                if best:
                    out = [(names[d], ids[i], s, int(items.size[i]), e) for (d, i), (e, s) in sorted(best.items())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "item_id", "start", "n_item_words", "edits"])
            items.patterns.clear()
            common.finish()

        found = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, start bigint, n_item_words bigint, edits bigint")
        if blocks > 1:  # one block's index at a time
            found = common.materialize(found, "leaks")
            index.destroy()
        return found

    return reduce(DataFrame.unionByName, [search(b) for b in range(blocks)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text"))
