"""N-gram Jaccard join with signature trees.

Sets that are equal are one set from the start. Under a global order of shingles (frequent ones last), two sets at the
threshold share at least k of their first n - ceil(t * n) + k shingles (their keys), for any k. Keys that a single set has
are dropped at once, and so are sets with too few keys left to have a partner (``SURPLUS`` sets k by size). Then:

1. Each set goes to the groups of its first few shared keys (``GROUPS``), once to each, with its text. Groups of many shingles are
   salted into parts, differently for each key, and a task holds one part, so texts move a fixed number of times whatever
   the group's size. A signature tree finds linked sets of a part exactly, and only a tree of links leaves the task.
   Components of these links come from star rounds; as a set is in several differently salted groups, copies of one text grow together.
2. What is left are keys that sets of different components share. There a tree over small signatures (a bitmap over an
   eighth of the shingles) yields the few candidate pairs that have met in no part, and their texts decide. Keys of many
   such sets are salted too, and a task holds a pair of parts; only ids and signatures are repeated for that.

A signature tree's node has the OR of its sets' bitmaps and the range of their sizes; a walk over pairs of nodes skips a
pair if its largest possible overlap is below what its sizes need, or if all its sets are in one component already.
Components of the remaining links come from star rounds. No pair within a group of copies is ever written.

Defined results: null and wordless texts have no shingles and are alone; repeated rows get the same component as their
doc_id's least; null doc_ids are left out of components (component null). Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common
from .components import components
from .shingles import set_ids, shingle_sets

#: Frequent shingles ordered last, at most (a bound on what is sent to tasks); how often one must be seen in a slice of rows to be counted.
FREQUENT, SEEN = 100_000, 4
#: Bytes of text in such a slice.
CENSUS_BYTES = 8 << 20
#: Percent of a set's shingles that are keys beyond those that a partner may lack.
SURPLUS = 7
#: Groups that each set joins with its text.
GROUPS = 3
#: Shingles of all sets in one salted part; signatures in one; sets in a leaf; bits of a signature.
PART_SHINGLES, PART_SETS, LEAF, BITS = 1_500_000, 100_000, 32, 512
#: Places in which the rows of a frequent key are looked at.
SIDES = 32
_HOT = np.uint64(1 << 62)


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of sets of sizes a and b that makes 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def surplus(n: np.ndarray) -> np.ndarray:
    """Keys of a set of n elements beyond those that a partner may lack; grows with n, so partners share the lesser one's."""
    return 1 + SURPLUS * n // 100


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Two linked sets share min(surplus) of their first n - ceil(percent * n / 100) + surplus elements."""
    return np.minimum(n, n - (-(-percent * n // 100)) + surplus(n))


class SignatureTree:
    """Sets' bitmaps in an order of similar size and component, combined by OR level by level (fan-out ``LEAF``)."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, sampled: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.rest = sizes - sampled  # elements that the bitmap doesn't show
        self.excess = sampled - np.bitwise_count(bits).sum(1)  # elements that share a bit
        level = [(np.arange(0, len(sizes), LEAF), bits, sizes, sizes, self.rest, self.excess)]
        self.levels: list[tuple] = []
        width = 1
        while True:
            _, b, lo, hi, rest, excess = level[-1]
            cut = np.arange(0, len(lo), LEAF)
            width *= LEAF
            node = (width, np.bitwise_or.reduceat(b, cut, 0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(rest, cut), np.maximum.reduceat(excess, cut))
            self.levels.append(node)
            level.append(node)
            if len(cut) == 1:
                return

    def walk(self, percent: int, same: Callable[[int, int, int, int], bool]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (i < j) whose possible overlap suffices, leaf pair by leaf pair. ``same(a, b, c, d)`` tells that rows a..b and c..d need no look."""
        todo = [(len(self.levels) - 1, 0, 0)]
        n = len(self.sizes)
        while todo:
            level, x, y = todo.pop()
            width, bits, lo, hi, rest, excess = self.levels[level]
            if x != y:
                small, big = (x, y) if hi[x] < hi[y] else (y, x)
                if 100 * hi[small] < percent * lo[big] or 100 * hi[big] < percent * lo[small]:
                    continue
                most = min(rest[x], rest[y]) + int(np.bitwise_count(bits[x] & bits[y]).sum()) + min(excess[x], excess[y])
                if most < needed(int(lo[x]), int(lo[y]), percent):
                    continue
            a, c = x * width, y * width
            b, d = min(n, a + width), min(n, c + width)
            if same(a, b, c, d):
                continue
            if level:
                below = len(self.levels[level - 1][1])
                todo += [(level - 1, i, j) for i in range(x * LEAF, min(below, x * LEAF + LEAF)) for j in range(max(y * LEAF, i), min(below, y * LEAF + LEAF))]
                continue
            na, nb = self.sizes[a:b, None], self.sizes[None, c:d]
            most = np.minimum(self.rest[a:b, None], self.rest[None, c:d]) + np.bitwise_count(self.bits[a:b, None] & self.bits[None, c:d]).sum(2) + np.minimum(self.excess[a:b, None], self.excess[None, c:d])
            fits = (most >= needed(na, nb, percent)) & (np.arange(a, b)[:, None] < np.arange(c, d)[None])
            i, j = np.nonzero(fits)
            if len(i):
                yield i + a, j + c


def signatures(hashes: np.ndarray, starts: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps over the shingles with an even eighth of the hashes, number of these) of each set."""
    take = np.flatnonzero((hashes >> np.uint64(40)) % np.uint64(8) == 0)
    row = np.searchsorted(starts, take, side="right") - 1
    at = (hashes[take] % np.uint64(bits)).astype(np.int64)
    out = np.zeros((len(starts) - 1, bits // 64), np.uint64)
    np.bitwise_or.at(out, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return out, np.bincount(row, minlength=len(starts) - 1)


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def cluster(texts: list[bytes], width: int, percent: int) -> list[int]:
    """For each text (of distinct sets), the first text of its component within this list, exactly."""
    hashes, starts = shingle_sets(texts, width)
    sizes = np.diff(starts)
    order = np.argsort(sizes, kind="stable")
    bits, sampled = signatures(hashes, starts)
    tree = SignatureTree(bits[order], sizes[order], sampled[order])
    forest = Forest(len(texts))
    rows = order.tolist()

    def same(a: int, b: int, c: int, d: int) -> bool:
        r = forest.root(rows[a])
        return all(forest.root(rows[k]) == r for k in (*range(a, b), *range(c, d)))

    for left, right in tree.walk(percent, same):
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            i, j = rows[i], rows[j]
            if forest.root(i) != forest.root(j):
                x, y = hashes[starts[i] : starts[i + 1]], hashes[starts[j] : starts[j + 1]]
                if len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y), percent):
                    forest.link(i, j)
    return [forest.root(i) for i in range(len(texts))]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            now = tuple(c[a] for c in columns)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _census(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: (doc_id, n, set_id, tag of the text) of each row; kind 1: (shingle, times, 0, 0) of shingles that a slice of rows repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("jaccard")
        for part in common.slices(batches, limit=CENSUS_BYTES):
            hashes, starts = shingle_sets(common.text_bytes(part.column("text")).to_pylist(), width)
            n = len(starts) - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), part.column("doc_id").cast(pa.int64()), pa.array(np.diff(starts)), pa.array(set_ids(hashes, starts)), part.column("tag")], ["kind", "id", "n", "set_id", "tag"])
            value, times = np.unique(hashes, return_counts=True)
            value, times = value[times >= SEEN], times[times >= SEEN]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(value), np.int32)), pa.array(value.astype(np.int64)), pa.array(times.astype(np.int64)), *[pa.array(np.zeros(len(value), np.int64))] * 2], ["kind", "id", "n", "set_id", "tag"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(run, "kind int, id bigint, n bigint, set_id bigint, tag bigint")


def _prefixes(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(key, set_id, n): each set's first shingles in the global order, frequent ones last; once for equal sets of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("jaccard")
        for part in common.slices(batches, limit=CENSUS_BYTES):
            hashes, starts = shingle_sets(common.text_bytes(part.column("text")).to_pylist(), width)
            ids, size = set_ids(hashes, starts), np.diff(starts)
            _, fresh = np.unique(ids, return_index=True)
            fresh = fresh[size[fresh] > 0]
            doc = np.repeat(np.arange(len(size)), size)
            place = np.minimum(np.searchsorted(frequent, hashes), max(len(frequent) - 1, 0))
            key = (hashes >> np.uint64(1)) | np.where(frequent[place] == hashes, _HOT >> np.uint64(1), np.uint64(0)) if len(frequent) else hashes >> np.uint64(1)
            key = key[np.lexsort((key, doc))]
            take = prefix_length(size[fresh], percent)
            row = np.repeat(fresh, take)
            at = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take) + starts[row]
            yield pa.RecordBatch.from_arrays([pa.array(key[at].astype(np.int64)), pa.array(ids[row]), pa.array(size[row])], ["key", "set_id", "n"])

    return docs.select("text").mapInArrow(run, "key bigint, set_id bigint, n bigint")


def _often() -> Column:
    """Whether a key is that of a frequent shingle: only these, at most ``FREQUENT``, can have many rows."""
    return F.col("key").bitwiseAND(F.lit(int(_HOT >> np.uint64(1)))) != 0


def _dealt(rows: DataFrame, ends: DataFrame, how: str) -> DataFrame:
    """``rows`` (key, set_id, ...) joined to ``ends`` (key, ...), where the rows of a frequent key meet it in ``SIDES`` places."""
    sides = ends.withColumn("_side", F.explode(F.when(_often(), F.sequence(F.lit(0), F.lit(SIDES - 1))).otherwise(F.array(F.lit(0)))))
    own = F.when(_often(), F.pmod(F.xxhash64("set_id"), F.lit(SIDES))).otherwise(0).cast("int")
    return rows.withColumn("_side", own).join(sides, ["key", "_side"], how).drop("_side")


def _shared(rows: DataFrame, by: str) -> DataFrame:
    """Rows (of a written table) of keys under which ``by`` has two values or more: a window for rare keys; for frequent ones an aggregate that combines before its shuffle, and a join in many places."""
    over = W.partitionBy("key")
    rare = rows.filter(~_often()).withColumn("_low", F.min(by).over(over)).withColumn("_high", F.max(by).over(over)).filter("_low < _high").select(rows.columns)
    often = rows.filter(_often())
    ends = often.groupBy("key").agg(F.min(by).alias("low"), F.max(by).alias("high")).filter("low < high").select("key")
    return rare.unionByName(_dealt(often, ends, "left_semi").select(rows.columns))


def _partnered(keys: DataFrame, percent: int) -> DataFrame:
    """Keys of the sets that have enough of them to have a partner: as many as the least partner's surplus."""
    least = 1 + F.floor(SURPLUS * F.ceil(percent * F.col("n") / 100) / 100)
    enough = keys.groupBy("set_id").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter(F.col("c") >= least).select("set_id")
    return keys.join(enough, "set_id", "left_semi")


def jaccard_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text); component_id is the least doc_id reachable by links."""
    return row_components(docs, width, percent).drop("tag")


def row_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """:func:`jaccard_components` with each row's tag, the ``xxhash64`` of its text."""
    tables = common.Tables()
    census = tables.write(_census(docs, width), "census")
    often = census.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("times")).orderBy(F.desc("times"), "id").limit(FREQUENT)
    frequent = np.sort(np.array([r["id"] for r in often.select("id").collect()], np.uint64))
    rows = census.filter("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "set_id", "tag")

    early = common.Tables()
    prefixes = early.write(_prefixes(docs, width, percent, frequent), "prefixes")
    shared = early.only(_partnered(_shared(prefixes, "set_id").distinct(), percent), "keys")
    shared = tables.write(_partnered(_shared(shared, "set_id"), percent), "keys")
    early.drop(docs.sparkSession)
    # frequent shingles first here: near copies of a common text share those, while their rare ones are their edits
    turned = F.col("key").bitwiseXOR(F.lit(int(_HOT >> np.uint64(1))))
    firsts = F.transform(F.slice(F.sort_array(F.collect_list(turned)), 1, GROUPS), lambda k: k.bitwiseXOR(F.lit(int(_HOT >> np.uint64(1)))))
    first = tables.write(shared.groupBy("set_id").agg(firsts.alias("firsts"), F.max("n").alias("n")), "firsts")
    # 1. a few groups for each set; groups of many shingles are salted into parts
    narrow = first.select("set_id", "n", F.explode("firsts").alias("key"))
    size = narrow.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("total")).filter("members > 1").select("key", F.ceil(F.col("total") / PART_SHINGLES).cast("int").alias("salts"))
    part = F.pmod(F.xxhash64("set_id", "key"), F.col("salts")).cast("int").alias("part")
    places = _dealt(narrow, size, "inner").groupBy("set_id").agg(F.collect_list(F.struct("key", part)).alias("places"))
    sets = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min(F.struct("doc_id", "tag")).alias("one")).select("set_id", "one.doc_id", "one.tag")
    wanted = first.join(places, "set_id", "left").join(sets, "set_id")
    tagged = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    # rows that are repeated as a whole give equal rows; nothing below counts them
    texts = tables.write(tagged.join(wanted, ["doc_id", "tag"]).select("set_id", "places", "n", "text"), "texts")
    dealt = texts.select("set_id", "n", "text", F.explode("places").alias("p")).select("p.key", "p.part", "set_id", "n", "text")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("jaccard")
        for group in groups(batches, ["key", "part"]):
            ids = group.column("set_id").to_numpy()
            if len(ids) > 1:
                root = np.array(cluster(common.text_bytes(group.column("text")).to_pylist(), width, percent))
                far = np.flatnonzero(ids != ids[root])
                yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["a", "b"])
        common.finish()

    parts = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "n", "set_id")
    linked, made = components(parts.mapInArrow(link, "a bigint, b bigint"))
    tables.paths += made.paths
    local = linked.select(F.col("id").alias("set_id"), F.col("component").alias("local"))

    # 2. keys shared across components
    placed = shared.join(local, "set_id", "left").withColumn("local", F.coalesce("local", "set_id"))
    open_keys = tables.write(_shared(placed, "local"), "open")
    # where a set has been: its parts, as many as it has groups
    spots = F.coalesce(F.transform("places", lambda p: F.xxhash64(p["key"], p["part"])), F.array().cast("array<bigint>"))
    been = texts.select("set_id", spots.alias("met")).dropDuplicates(["set_id"]).select("set_id", F.concat("met", F.array_repeat(F.lit(0).cast("bigint"), GROUPS - F.size("met"))).alias("been"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("jaccard")
        for part in common.slices(batches):
            hashes, starts = shingle_sets(common.text_bytes(part.column("text")).to_pylist(), width)
            bits, sampled = signatures(hashes, starts)
            yield pa.RecordBatch.from_arrays([part.column("set_id"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(sampled.astype(np.int64))], ["set_id", "bits", "sampled"])

    signs = texts.join(open_keys.select("set_id").distinct(), "set_id", "left_semi").select("set_id", "text").mapInArrow(sign, "set_id bigint, bits binary, sampled bigint").distinct()
    band = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    # a set meets its own band of sizes, and the next one as a guest
    narrow = open_keys.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("guest", F.col("band") != band)
    many = narrow.groupBy("key", "band").agg(F.ceil(F.count("*") / PART_SETS).cast("int").alias("salts"))
    side = F.pmod(F.xxhash64("set_id"), F.col("salts")).cast("int").alias("side")
    sided = narrow.join(many, ["key", "band"]).select("key", "band", "set_id", "n", "local", "guest", side, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other"))
    sided = sided.withColumns({"one": F.least("side", "other"), "two": F.greatest("side", "other")})
    banded = sided.join(signs.join(been, "set_id"), "set_id")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("jaccard")
        for group in groups(batches, ["key", "band", "one", "two"]):
            local_ids, guest = group.column("local").to_numpy(), group.column("guest").to_numpy()
            if len(local_ids) < 2 or guest.all() or (local_ids == local_ids[0]).all():
                continue
            ids, n = group.column("set_id").to_numpy(), group.column("n").to_numpy()
            bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
            been = group.column("been").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, GROUPS)
            tree = SignatureTree(bits, n, group.column("sampled").to_numpy())

            def same(a: int, b: int, c: int, d: int, local_ids: np.ndarray = local_ids, guest: np.ndarray = guest) -> bool:
                one = local_ids[a] == local_ids[b - 1] == local_ids[c] == local_ids[d - 1]
                return bool(one or (guest[a:b].all() and guest[c:d].all()))

            for i, j in tree.walk(percent, same):
                keep = (local_ids[i] != local_ids[j]) & ~(guest[i] & guest[j])
                i, j = i[keep], j[keep]
                met = ((been[i][:, :, None] == been[j][:, None]) & (been[i][:, :, None] != 0)).any((1, 2))
                if not met.all():
                    x, y = ids[i[~met]], ids[j[~met]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    ordered = banded.repartition("key", "band", "one", "two").sortWithinPartitions("key", "band", "one", "two", "local", "n", "set_id")
    ordered = ordered.select("key", "band", "one", "two", "local", "n", "set_id", "guest", "bits", "sampled", "been")
    pairs = tables.write(ordered.mapInArrow(pair, "a bigint, b bigint").distinct(), "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("jaccard")
        for part in common.slices(common.slices(batches), "other"):
            x, xs = shingle_sets(common.text_bytes(part.column("text")).to_pylist(), width)
            y, ys = shingle_sets(common.text_bytes(part.column("other")).to_pylist(), width)
            good = [
                len(np.intersect1d(x[a:b], y[c:d], assume_unique=True)) >= needed(int(b - a), int(d - c), percent)
                for a, b, c, d in zip(xs, xs[1:], ys, ys[1:], strict=False)
            ]
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("set_id").alias("a"), "text")
    right = texts.select(F.col("set_id").alias("b"), F.col("text").alias("other"))
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "text", "other").mapInArrow(verify, "a bigint, b bigint").distinct()
    links = tables.write(links, "links")
    names = local
    if links.limit(1).count():
        ends = links.join(local.select(F.col("set_id").alias("a"), F.col("local").alias("la")), "a", "left").join(local.select(F.col("set_id").alias("b"), F.col("local").alias("lb")), "b", "left")
        joined, made = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
        tables.paths += made.paths
        joined = joined.withColumnRenamed("id", "local")
        names = local.join(joined, "local", "left").select("set_id", F.coalesce("component", "local").alias("local"))
        names = names.unionByName(joined.join(local, joined["local"] == local["set_id"], "left_anti").select(F.col("local").alias("set_id"), F.col("component").alias("local")))

    # the least doc_id of each set, of each component
    labelled = sets.drop("tag").join(names, "set_id", "left").withColumn("component", F.coalesce("local", "set_id"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = tables.write(labelled.join(least, "component").select("set_id", "component_id"), "components")
    found = rows.join(final, "set_id", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return tables.only(found.select("doc_id", "tag", "n_shingles", alone.alias("component_id")), "found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents", "doc_id", "text"), 3, 90)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(sh) AS sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 90 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
walk(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, c FROM walk JOIN e ON x = walk.doc_id WHERE c < y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM walk WHERE walk.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
