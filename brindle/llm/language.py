"""Language identification in two steps: the family first, then linear support vector machines within it.

A text is a vector of hashed byte 1- to 4-grams and words (square roots of counts, unit length). A one-versus-rest linear
SVM picks the family; inside a family with several languages, one SVM for each pair votes by margin. Machines are
trained here, by averaged subgradient steps, on a bounded sample of labelled rows (about ``PER_LANGUAGE`` rows of each
language, by hash of doc_id); everything else covers all rows, whole.

Families of known language codes are fixed values; a code without an entry is a family of its own.

Defined results: null texts and texts without a letter are ``und`` with score 0; without labelled rows all are ``und``;
repeated rows are predicted each. Extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Language codes by family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "semitic": ["ar", "he", "mt"],
}
#: Hash buckets, longest n-gram in bytes, labelled rows a language, training passes.
BUCKETS, GRAM, PER_LANGUAGE, PASSES = 1 << 13, 4, 800, 12
UND = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # ASCII capitals
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[48:58] = 48  # digits are alike
_KEYS = [np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def grams(raw: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram length, the bucket of the n-gram that ends at each byte (from the first full one on)."""
    x = _FOLD[raw].astype(np.uint32) + np.uint32(1)
    h = np.zeros(len(x), np.uint32)
    for n in range(1, GRAM + 1):
        h = (h[:-1] if n > 1 else h) * np.uint32(0x01000193) + x[n - 1 :]
        if len(h) == 0:
            return
        mixed = (h ^ (h >> np.uint32(15))) * _KEYS[n - 1]
        yield (mixed >> np.uint32(32 - 13)).astype(np.int32)


def vectors(texts: list[bytes | None]) -> np.ndarray:
    """A unit vector of square-rooted counts for each text (dense; callers pass slices of bounded size)."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(out, texts, strict=True):
        if text:
            raw = np.frombuffer(text, np.uint8)
            for at in grams(raw):
                row += np.bincount(at, minlength=BUCKETS)
            np.sqrt(row, out=row)
            row /= np.linalg.norm(row)
    return out


def has_letter(text: bytes | None) -> bool:
    """Whether any code point of a UTF-8 text is a letter."""
    if not text:
        return False
    if any(65 <= b <= 90 or 97 <= b <= 122 for b in text[:64]):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Svm:
    """A linear SVM (hinge loss, L2) by averaged subgradient descent on the ``rows`` of x (all, if None); y of these is -1 or 1, both classes weigh the same.

    x is never copied as a whole; half-precision vectors are widened a few at a time.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, penalty: float = 1e-4, seed: int = 11, rows: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        rows = np.arange(len(x)) if rows is None else rows
        weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
        w, b, mean, mean_b, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
        for _ in range(passes):
            order = rng.permutation(len(rows))
            for part in np.array_split(order, max(1, len(rows) // 32)):
                t += 1
                rate = 1 / (penalty * (t + 1 / penalty / 8))
                some = x[rows[part]].astype(np.float32, copy=False)
                off = y[part] * (some @ w + b) < 1
                wrong = part[off]
                w *= 1 - rate * penalty
                if len(wrong):
                    push = weight[wrong] * y[wrong]
                    w += rate / len(part) * (push @ some[off])
                    b += rate / len(part) * push.sum()
                mean += (w - mean) * 2 / (t + 1)
                mean_b += (b - mean_b) * 2 / (t + 1)
        self.w, self.b = mean, float(mean_b)
        margins = [x[rows[a : a + 64]].astype(np.float32, copy=False) @ mean.astype(np.float32) + mean_b for a in range(0, len(rows), 64)]
        self.scale = 1.0 / max(float(np.median(np.abs(np.concatenate(margins)))), 1e-6)


class Model:
    """Family machines, then pairwise machines in each family."""

    def __init__(self, x: np.ndarray, lang: np.ndarray, families: dict[str, list[str]] | None = None):
        known = {c: f for f, codes in (families or FAMILIES).items() for c in codes}
        self.languages = sorted(set(lang.tolist()))
        self.family = {c: known.get(c, c) for c in self.languages}
        self.families = sorted(set(self.family.values()))
        fam = np.array([self.family[c] for c in lang])
        self.family_at = list(range(len(self.families))) if len(self.families) > 1 else []
        machines = [Svm(x, np.where(fam == f, 1.0, -1.0)) for f in self.families] if self.family_at else []
        self.pairs: dict[str, list[tuple[int, str, str]]] = {}
        for f in self.families:
            self.pairs[f] = []
            for a, b in combinations([c for c in self.languages if self.family[c] == f], 2):
                rows = np.flatnonzero((lang == a) | (lang == b))
                self.pairs[f].append((len(machines), a, b))
                machines.append(Svm(x, np.where(lang[rows] == a, 1.0, -1.0), rows=rows))
        self.w = np.column_stack([m.w for m in machines]).astype(np.float32) if machines else np.zeros((BUCKETS, 0), np.float32)
        self.b = np.array([m.b for m in machines])
        self.scale = np.array([m.scale for m in machines])

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (the probability of the family times that of the language in it) of each row."""
        margin = (x @ self.w + self.b) * self.scale
        sure = 1 / (1 + np.exp(-3 * margin))
        n = len(x)
        if self.family_at:
            fam, p = margin[:, self.family_at].argmax(1), sure[:, self.family_at].max(1)
        else:
            fam, p = np.zeros(n, int), np.ones(n)
        lang = np.empty(n, object)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(fam == i)
            codes = [c for c in self.languages if self.family[c] == f]
            votes = np.zeros((len(rows), len(codes)))
            best = np.ones((len(rows), len(codes)))
            for k, a, b in self.pairs[f]:
                s = sure[rows, k]
                for c, v in ((a, s), (b, 1 - s)):
                    votes[:, codes.index(c)] += v
                    best[:, codes.index(c)] = np.minimum(best[:, codes.index(c)], v)
            pick = votes.argmax(1)
            lang[rows] = np.array(codes, object)[pick]
            p[rows] *= best[np.arange(len(rows)), pick]
        return lang.tolist(), p


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, list[str]] | None = None) -> Model | None:
    """Train on about ``per_language`` rows (doc_id, text, lang) of each language, chosen by hash of doc_id.

    Vectors come to the driver deflated (most of a vector is 0 or one of a few values) and lie there once, in half precision.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.lit(0)
    for lang, n in sorted(counts.items()):
        limit = F.when(F.col("lang") == lang, F.lit(int(min(1.0, per_language / n) * (1 << 30)))).otherwise(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("language")
        for part in common.slices(batches, limit=1 << 20):
            texts = common.text_bytes(part.column("text")).to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            for a in range(0, len(keep), 64):
                some = keep[a : a + 64]
                made = vectors([texts[i] for i in some]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), part.column("lang").take(pa.array(some)), pa.array([zlib.compress(v, 1) for v in made], pa.binary())], ["doc_id", "lang", "vector"])

    sample = rows.filter(place < limit).select("doc_id", "text", "lang").mapInArrow(run, "doc_id bigint, lang string, vector binary").toArrow()
    if not sample.num_rows:
        return None
    sample = sample.take(pc.sort_indices(sample, [("doc_id", "ascending"), ("lang", "ascending"), ("vector", "ascending")]))
    x = np.empty((sample.num_rows, BUCKETS), np.float16)
    for row, packed in zip(x, sample.column("vector"), strict=True):
        row[:] = np.frombuffer(zlib.decompress(packed.as_buffer()), np.float16)
    model = Model(x, np.array(sample.column("lang").to_pylist()), families)
    del x, row, sample, packed
    common.finish()
    return model


def predict(model: Model | None, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, in blocks of bounded size."""
    lang, score = [UND] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    for a in range(0, len(known), 256):
        some = known[a : a + 256]
        names, p = model.predict(vectors([texts[i] for i in some]))
        score[some] = p
        for i, name in zip(some, names, strict=True):
            lang[i] = name
    return lang, score


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("language")
        for part in common.slices(batches):
            lang, score = predict(model, common.text_bytes(part.column("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def kept(docs: DataFrame, model: Model | None, min_score: float) -> DataFrame:
    """The rows of ``docs`` whose language is believed, in one pass; a null lang becomes the prediction."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("language")
        for part in common.slices(batches):
            lang, score = predict(model, common.text_bytes(part.column("text")).to_pylist())
            good = pa.array([c != UND and s >= min_score for c, s in zip(lang, score.tolist(), strict=True)])
            columns = [pc.fill_null(part.column(c), pa.array(lang, part.column(c).type)) if c == "lang" else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(good)

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """The fold that is never learned from; a null doc_id is in it."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(common.table(spark, sf_dir, "documents", "doc_id", "text", "lang").filter(~held_out()))
    found = identify(common.table(spark, sf_dir, "documents", "doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
