"""Word shingles of many texts at once, as 62-bit hashes, in numpy alone."""

from __future__ import annotations

import numpy as np

from . import common

_RNG = np.random.default_rng(20)
#: A random value for each byte, with ASCII capitals folded; zero for the white space that separates words.
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MASK = np.uint64((1 << 62) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_GROWN: dict[str, np.ndarray] = {"p": _powers(_P, 1), "i": _powers(_P_INVERSE, 1)}


def _shrink() -> None:
    _GROWN.update(p=_powers(_P, 1), i=_powers(_P_INVERSE, 1))


common.keeps(_shrink)

#: Bytes of text hashed at once (a longer text is hashed alone); larger tables of powers than this needs aren't kept.
CHUNK = 1 << 20


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 2 * CHUNK:
        return _powers(_P, n), _powers(_P_INVERSE, n)
    if len(_GROWN["p"]) < n:
        _GROWN["p"], _GROWN["i"] = _powers(_P, n), _powers(_P_INVERSE, n)
    return _GROWN["p"], _GROWN["i"]


def words(texts: list[bytes | None], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end, byte place of each word's start and end) over joined texts.

    Words are runs of anything but ASCII white space; capitals A-Z are folded unless ``fold`` is off. Byte places count
    from the start of the joined texts, with one separator before each.
    """
    raw = b"\n" + b"\n".join(t or b"" for t in texts) + b"\n"
    x = np.frombuffer(raw, np.uint8)
    space = _SPACE[x]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    p, inverse = _tables(len(x) + 1)
    value = _VALUE[x] if fold else _VALUE[x] ^ (x.astype(np.uint64) * _P)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(value * p[: len(x)], out=total[1:])
    h = common.mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return h, first, starts, ends


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, ascending within it; offsets of the texts). A shorter text is one shingle; none without words."""
    sizes = np.cumsum([0, *(len(t) if t else 0 for t in texts)]) // CHUNK
    cut = [0, *(np.flatnonzero(np.diff(sizes[:-1])) + 1).tolist(), len(texts)]
    made = [_shingle_sets(texts[a:b], width) for a, b in zip(cut, cut[1:], strict=False) if b > a]
    hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in made)])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.diff(s) for _, s in made)])
    return hashes, np.concatenate(([0], np.cumsum(counts)))


def _shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    h, first, _, _ = words(texts)
    counts = np.diff(first)
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), per)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + first[doc]
    have = np.minimum(counts, width)[doc]
    made = have.astype(np.uint64)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    for k in range(width):
        made = np.where(k < have, common.mix64(made * _P + padded[at + k]), made)
    made &= _MASK
    order = np.lexsort((made, doc))
    doc, made = doc[order], made[order]
    fresh = np.ones(len(made), bool)
    fresh[1:] = (made[1:] != made[:-1]) | (doc[1:] != doc[:-1])
    doc, made = doc[fresh], made[fresh]
    return made, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_ids(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 63-bit id of each set (order-free sum of mixed hashes, and the size); 0 for the empty set."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(common.mix64(hashes ^ _P), out=total[1:])
    size = np.diff(starts).astype(np.uint64)
    return np.where(size > 0, common.mix64(total[starts[1:]] - total[starts[:-1]] + size * _P) >> np.uint64(1), np.uint64(0)).astype(np.int64)
