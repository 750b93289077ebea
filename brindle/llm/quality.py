"""Quality rules with an isolation forest over rule statistics.

Every text gets a few counting statistics. Two hard rules reject at once; for the rest, an isolation forest (random
splits over random features) measures how soon a document's statistics are isolated: odd documents have short paths.
The forest grows on a bounded sample of the labelled rows; the threshold on its score comes from all labelled rows
that pass the base rules, by their distributed histogram over score and label.

Defined results: a null or empty text has zero words, so it fails the base rule; repeated rows give repeated rows, each
judged alone; without labelled rows of both classes the threshold is 1 (the forest rejects nothing). Texts are read
whole. Columns of the input other than the id and the text are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Base statistics (counts) and the columns the forest sees. Marks are "!" (shouting, as in advertising), pipes are "|" (what
#: menus and tables leave when their markup is lost); shares of all punctuation, of words without letters and the entropy of
#: bytes were measured instead of these two, and told fewer of the labelled bad rows (182 and 180 against 256 of 301 at sf0.1).
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_share", "mark_share", "pipe_share"]
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)
#: Words per window for repeated words; the two base limits.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: The forest: trees, rows a tree, labelled rows taken as the sample (a bound, by hash of doc_id), score bins of the calibration.
TREES, TREE_ROWS, SAMPLE_ROWS, BINS = 200, 256, 20_000, 1000
#: The calibration keeps at least this share of the rows labelled good.
KEEP_GOOD = 0.995
_SPACES = bytes([32, 9, 10, 11, 12, 13])
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_P = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that occurs twice or more in the text (first occurrence included)."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = common.mix64(ids.astype(np.uint64) + _P)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * _P + mixed[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def statistics(text: bytes | None) -> tuple:
    """The counts and features of one whole text (UTF-8)."""
    text = text or b""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    # continuation bytes (10xxxxxx) are not code points
    raw = np.frombuffer(joined, np.uint8)
    chars = int(np.count_nonzero((raw & 0xC0) != 0x80))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line and not line.isspace():
                lines += 1
                if line in seen:
                    dup += 1
                else:
                    seen.add(line)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n) if n >= WINDOW else np.zeros(0, np.int64)
    distinct = len(known) if n >= WINDOW else len(set(words))
    repeat = repeated_words(ids)
    # upper case beyond ASCII: in UTF-8, lower-casing changes the same number of places
    upper = len(joined) - len(joined.translate(None, _UPPER))
    m = max(n, 1)
    return (n, chars, symbols, dup, repeat, chars / m, symbols / m, dup / max(lines, 1), repeat / m, upper / max(chars, 1), min(1.0, distinct / m**0.5 / 10), text.count(b"!") / m, text.count(b"|") / m)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.begin("quality")
    names = [*COUNTS, *FEATURES]
    kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(FEATURES)
    for part in common.slices(batches):
        rows = [statistics(t) for t in common.text_bytes(part.column("text")).to_pylist()]
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])


def measure(docs: DataFrame) -> DataFrame:
    """One row of counts and features for each row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_measure, SCHEMA)


class IsolationForest:
    """Random trees over bounded subsamples, stored as flat arrays; trees are cut at the usual depth log2(rows)."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = min(tree_rows, len(rows))
        self.norm = self.expected(size) or 1.0
        self.trees = [self._grow(rows[rng.choice(len(rows), size, replace=False)], rng, max(1, int(np.ceil(np.log2(max(size, 2)))))) for _ in range(trees)]

    @staticmethod
    def expected(n: float) -> float:
        """Mean path length of an unsuccessful search among n points."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, ...]:
        feature, cut, left, value = [], [], [], []
        queue = [(rows, 0)]
        for rows, level in queue:  # grows while it is walked: breadth first, children side by side
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and level < depth else []
            if len(spread):
                f = int(rng.choice(spread))
                at = rng.uniform(rows[:, f].min(), rows[:, f].max())
                feature.append(f)
                cut.append(at)
                left.append(len(queue))
                value.append(0.0)
                below = rows[:, f] <= at
                queue += [(rows[below], level + 1), (rows[~below], level + 1)]
            else:
                feature.append(-1)
                cut.append(0.0)
                left.append(0)
                value.append(level + self.expected(len(rows)))
        return np.array(feature), np.array(cut), np.array(left), np.array(value)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that are isolated at once, under 0.5 for usual rows."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, left, value in self.trees:
            node = np.zeros(len(rows), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[node] + (rows[every, f] > cut[node])
                node = np.where(inner, step, node)
            total += value[node]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in FEATURES]) if part.num_rows else np.zeros((0, len(FEATURES)))


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> IsolationForest | None:
    """Grow the forest on at most about ``sample_rows`` labelled rows, chosen by hash of doc_id."""
    total = labels.count()
    share = min(1.0, sample_rows / max(total, 1))
    picked = labels.filter(F.col("quality").isNotNull()).select("doc_id").distinct().filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = stats.join(picked, "doc_id", "left_semi").select("doc_id", *FEATURES).toArrow().sort_by([("doc_id", "ascending"), *((f, "ascending") for f in FEATURES)])
    values = np.column_stack([rows.column(c).to_numpy() for c in FEATURES]) if rows.num_rows else np.zeros((0, len(FEATURES)))
    return IsolationForest(values) if len(values) >= 2 else None


def with_score(stats: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """``stats`` and the column anomaly (0 to 1; 0 without a forest)."""
    if forest is None:
        return stats.withColumn("anomaly", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("quality")
        for batch in batches:
            yield batch.append_column("anomaly", pa.array(forest.score(_matrix(batch)), pa.float64()))

    return stats.mapInArrow(run, SCHEMA + ", anomaly double")


def threshold(scored: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """The score from which rows are rejected: best true minus false rejection rate over all labelled rows that keeps ``keep_good`` of the good ones."""
    bins = (
        scored.select("doc_id", F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
        .join(labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
        .groupBy("bin").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") != 0).alias("good")).collect()
    )
    bad, good = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in bins:
        bad[r["bin"]], good[r["bin"]] = r["bad"], r["good"]
    if not bad.sum() or not good.sum():
        return 1.0
    caught, lost = bad[::-1].cumsum()[::-1] / bad.sum(), good[::-1].cumsum()[::-1] / good.sum()
    gain = np.where(lost <= 1 - keep_good, caught - lost, -1)
    best = np.flatnonzero(gain >= gain.max())
    return float((best[0] + best[-1]) / 2 / BINS) if gain.max() > 0 else 1.0  # the middle of the gap between the classes


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, anomaly for every row of ``docs``; ``labels`` has doc_id and quality (0 bad, 1 good)."""
    stats = common.materialize(measure(docs), "quality")
    forest = fit(stats, labels)
    scored = with_score(stats, forest)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    limit = threshold(scored.filter(~failed), labels) if forest else 1.0
    return scored.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("anomaly") < limit)).alias("kept"), "anomaly")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "labels", "doc_id", "quality"))
