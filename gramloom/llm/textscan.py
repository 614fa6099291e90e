"""Vectorised scanning of UTF-8 text inside tasks: words, hashes, k-grams, winnowing, slot bitmaps.

All hashes are 64-bit and depend on content only, so every task on every
executor gives a string the same hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64
R = U(0x9E3779B97F4A7C15 | 1)
R_INV = U(pow(int(R), -1, 1 << 64))
BYTE_HASH = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
SEGMENT = 1 << 18
CHUNK_BYTES = 1 << 20


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """Table of 256 flags: True for bytes of words, False for the excluded ranges."""
    keep = np.ones(256, dtype=bool)
    for lo, hi in excluded:
        keep[lo : hi + 1] = False
    return keep


NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def power(at: np.ndarray, base: np.uint64, name: str) -> np.ndarray:
    """``base`` to the powers ``at``; the tables kept for it follow the segments of the largest, not its size."""
    far = at // SEGMENT
    strides = powers(int(far.max()) + 1 if len(at) else 1, U(pow(int(base), SEGMENT, 1 << 64)), f"{name}, segments")
    return powers(SEGMENT, base, name)[at % SEGMENT] * strides[far]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def words(buf: bytes, keep: np.ndarray, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the maximal runs of ``keep`` bytes; memory beyond the result is a segment's."""
    starts, ends, hashes, at, n = [], [], [], 0, len(buf)
    whole = np.frombuffer(buf, dtype=np.uint8)
    while at < n:
        stop = min(n, at + SEGMENT)
        while stop < n and keep[buf[stop]] and keep[buf[stop - 1]]:  # never inside a word
            stop += 1
        a = whole[at:stop]
        flag = np.zeros(len(a) + 2, dtype=np.int8)
        flag[1:-1] = keep[a]
        turn = np.diff(flag)
        s, e = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        if hashed:
            total = np.zeros(len(a) + 1, dtype=np.uint64)
            np.cumsum(BYTE_HASH[a] * powers(len(a), R, "up"), out=total[1:])
            hashes.append(mix((total[e] - total[s]) * powers(len(a) + 1, R_INV, "down")[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive hashes (length n - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        acc = acc * R + h[j : j + n]
    return mix(acc)


def sliding(h: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every w consecutive values (length n - w + 1), in about log2(w) passes."""
    have, acc = 1, h
    while have < w:
        step = min(have, w - have)
        acc = op(acc[: len(acc) - step], acc[step:])
        have += step
    return acc


def lows(grams: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w grams, 0 where it is not valid (crosses documents)."""
    if len(grams) < w:
        return np.zeros(0, dtype=np.uint64)
    low = sliding(grams, w, np.minimum)
    return np.where(valid[: len(low)], low, U(0))


def winnow(grams: np.ndarray, valid: np.ndarray, w: int, low: np.ndarray | None = None) -> np.ndarray:
    """Positions whose hash is the minimum of some valid window of w grams (ties all kept).

    ``valid[s]`` says whether the window that starts at gram s lies in one document.
    Every valid window keeps at least one position, the same ones wherever its content recurs.
    """
    if len(grams) < w or not valid.any():
        return np.zeros(0, dtype=np.int64)
    low = lows(grams, valid, w) if low is None else low
    pad = np.zeros(w - 1, dtype=np.uint64)
    best = sliding(np.concatenate([pad, low, pad]), w, np.maximum)
    return np.flatnonzero(best == grams)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as UTF-8) in groups of about ``limit`` bytes; null texts are empty."""
    for batch in batches:
        ids, size, out = [], 0, []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = b"" if not t.is_valid else t.as_buffer().to_pybytes()
            ids.append(i)
            out.append(raw)
            size += len(raw)
            if size >= limit:
                yield ids, out
                ids, size, out = [], 0, []
        if ids:
            yield ids, out


def id_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + R) >> U(64 - bits)).astype(np.uint32)


def slots_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.uint32)


BUCKET_BITS = 6
HELD_SLOTS = 1 << 20


def bitmap(rows: DataFrame, slots: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int, twice: bool) -> np.ndarray:
    """A fixed-size bitmap (2**bits bits) over all ``rows``: slots met at least once, or at least twice.

    The size is a constant of the operator, so the broadcast is bounded at any
    scale.  It only thins work ahead of exact steps: an unset slot proves that a
    hash is absent (or unique), a set one proves nothing.  Tasks send sorted
    distinct slots (a repeated one twice); merging tasks hold two fixed bitmaps
    per slot range whatever the input size.
    """
    low = bits - BUCKET_BITS
    span = 1 << low

    def emit(batches):
        held, size = [], 0
        for found in slots(batches):
            held.append(found)
            size += len(found)
            if size >= HELD_SLOTS:
                yield sent_together(np.concatenate(held))
                held, size = [], 0
        if size:
            yield sent_together(np.concatenate(held))

    def sent_together(found):
        s, n = np.unique(found, return_counts=True)
        rows = []
        for b, lo, hi in cut(s):
            part = s[lo:hi] & np.uint32(span - 1)
            rows.append((b, part.tobytes(), part[n[lo:hi] > 1].tobytes() if twice else b""))
        b, once, again = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"bucket": pa.array(b, pa.int32()), "once": pa.array(once, pa.binary()), "again": pa.array(again, pa.binary())})

    def cut(s):
        edge = np.searchsorted(s, (np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64) << U(low)))
        return [(b, edge[b], edge[b + 1]) for b in range(1 << BUCKET_BITS) if edge[b + 1] > edge[b]]

    def merge(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for b, once, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = seen.setdefault(b, (np.zeros(span, dtype=bool), np.zeros(span, dtype=bool)))
                s = np.frombuffer(once, dtype=np.uint32)
                two[s[one[s]]] = True
                one[s] = True
                two[np.frombuffer(again, dtype=np.uint32)] = True
        for b, (one, two) in seen.items():
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "bits": pa.array([np.packbits(two if twice else one, bitorder="little").tobytes()], pa.binary())})

    sent = rows.mapInArrow(emit, "bucket int, once binary, again binary")
    merged = sent.repartition(1 << BUCKET_BITS, "bucket").mapInArrow(merge, "bucket int, bits binary")
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in merged.collect():  # 2**bits / 8 bytes in all
        out[(row.bucket * span) // 8 : ((row.bucket + 1) * span) // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def is_set(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> np.uint32(3)] >> (slots & np.uint32(7)).astype(np.uint8)) & np.uint8(1) != 0
