"""Substring dedup by seed and extend over words.

Seeds are winnowed anchors: of every run of 13 consecutive 8-word grams inside
one document, the one with the smallest hash.  A 20-word window holds 13 such
grams, so two equal windows share an anchor, their smallest.  Around an anchor, a
match extends over the windows of which it is the smallest, at most 12 words to
the left and to the right; anchors of one seed whose full extensions agree match
in every such window, so only the first of them goes on.  Where the extensions
of a seed differ, each of its windows is ranked among the holders of the same
window.  Runs of windows that also start
earlier form the maximal repeats and are removed; the earliest copy stays.

Scale: a fixed-size bitmap of anchor hashes met twice drops unique anchors
before the shuffle; each task sends only its first holder of a seed and full
extension, and then of a window, so a group of copies or a passage in a third of
the texts costs a row per task, not a row per copy; no step groups by seed, so a
hot seed is spread by its surroundings; a second bitmap finds the seeds with
several surroundings, a third of affected documents keeps other texts out of the
last join.
Bitmaps only thin the work: results are exact when they are full.  No pairs
are formed: every occurrence is compared with the earliest one by ordering.

Seeds, whole extensions and windows are compared by 64-bit hashes, each whole.

Defined results: null text has no words; rows with a null doc_id are returned
unchanged and are nobody's partner; doc_id is the identity of a document (rows
repeating one are each cut by what is found for that id); a long text is one
row, whole, and a task holds it with its word hashes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import apply_ranges
from .scratch import materialize, spread
from .textscan import NOT_SPACE, R, U, bitmap, chunks, is_set, kgrams, lows, mix, slots_of, winnow, words

WINDOW = 20
GRAM = 8
REACH = WINDOW - GRAM
SPAN_BYTES = 8
BITS = 29
SPANS = 1 << 20


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document index, word position, gram hash) of anchors, with all word hashes, each document's first word index and the windows' minima."""
    starts, _, h = words(b"\n".join(texts), NOT_SPACE)
    edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, edge)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    grams = kgrams(h, GRAM)
    valid = doc[: max(0, len(h) - WINDOW + 1)] == doc[WINDOW - 1 :] if len(h) >= WINDOW else np.zeros(0, dtype=bool)
    low = lows(grams, valid, REACH + 1)
    at = winnow(grams, valid, REACH + 1, low)
    return doc[at], at, grams[at], h, first, low


def seed_slots(seed: np.ndarray, bits: int) -> np.ndarray:
    """Slots of seeds, mixed once more: a seed is the least of 13 hashes, so its own upper bits crowd a thirteenth of the bitmap."""
    return slots_of(mix(seed), bits)


def reach(at: np.ndarray, seed: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words to the left and right of each anchor's gram that its own windows take: those of which it is the minimum, a run of starts."""
    start = at[:, None] - np.arange(REACH + 1)[None, :]
    own = (start >= 0) & (start < len(low)) & (low[np.clip(start, 0, len(low) - 1)] == seed[:, None])
    nearest = own.argmax(axis=1)
    return nearest + own.sum(axis=1) - 1, REACH - nearest


NAMES = ["seed", "code", "doc_id", "place", "spans"]


class Earliest:
    """The earliest holder of each code that a task has met."""

    def __init__(self):
        self.code, self.doc, self.pos = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def later(self, code: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Which of these have an earlier holder here, among themselves or before."""
        old = len(self.code)
        code, doc, pos = np.concatenate([self.code, code]), np.concatenate([self.doc, doc]), np.concatenate([self.pos, pos])
        order = np.lexsort((pos, doc, code))
        code, doc, pos = code[order], doc[order], pos[order]
        head = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        late = np.empty(len(code), dtype=bool)
        late[order] = (doc != doc[lead]) | (pos != pos[lead])
        self.code, self.doc, self.pos = code[head], doc[head], pos[head]
        return late[old:]


def joined_ranges(number: np.ndarray, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, start, stop) with overlapping or touching ranges of one document joined; input in order of document and start."""
    if not len(doc):
        return number[doc], start, stop
    far = np.maximum.accumulate(doc * (1 << 40) + stop)
    fresh = np.concatenate([[True], doc[1:] * (1 << 40) + start[1:] > far[:-1]])
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(doc) - 1]])
    return number[doc[fresh]], start[fresh], far[last] & ((1 << 40) - 1)


def repeats(docs: DataFrame, spark) -> DataFrame:
    """``doc_id, start, stop``: word ranges to remove (ranges may overlap, stop exclusive)."""

    def slots(batches):
        for ids, texts in chunks(batches):
            kept = [t for i, t in zip(ids, texts, strict=True) if i is not None]
            yield seed_slots(anchors(kept)[2], BITS)

    seen = spark.sparkContext.broadcast(bitmap(docs, slots, BITS, twice=True))

    def seeds(batches):
        first_seen = Earliest()
        for ids, texts in chunks(batches):
            pairs = [(i, t) for i, t in zip(ids, texts, strict=True) if i is not None]
            if not pairs:
                continue
            number = np.array([i for i, _ in pairs], dtype=np.int64)
            doc, at, seed, h, first, low = anchors([t for _, t in pairs])
            hit = is_set(seen.value, seed_slots(seed, BITS))
            doc, at, seed = doc[hit], at[hit], seed[hit]
            if not len(at):
                continue
            left, right = reach(at, seed, low)
            code = seed.copy()
            for j in range(REACH):
                code = mix(code * R + np.where(j < left, h[np.maximum(at - 1 - j, 0)], U(0)))
                code = mix(code * R + np.where(j < right, h[np.minimum(at + GRAM + j, len(h) - 1)], U(1)))
            code = mix(code + (left * 64 + right).astype(np.uint64))
            pos = at - first[doc]
            later = first_seen.later(code, number[doc], pos)
            yield from rows(*joined_ranges(number, doc[later], (pos - left)[later], (pos + GRAM + right)[later]))
            doc, at, seed, code, pos, left, right = (x[~later] for x in (doc, at, seed, code, pos, left, right))
            nearest, n = REACH - right, left + right - REACH + 1
            own = np.repeat(at - nearest + np.cumsum(n) - n, n) - np.arange(n.sum())  # starts of the own windows, nearest first
            spans = kgrams(h, WINDOW)[own].tobytes()
            offsets = np.concatenate([[0], np.cumsum(n * SPAN_BYTES)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(seed.view(np.int64)), pa.array(code.view(np.int64)), pa.array(number[doc]), pa.array(pos * 4096 + left * 64 + right),
                pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(spans)]),
            ], names=NAMES)

    def rows(doc, start, stop):
        """Settled ranges (place: start, code: stop, no spans) travel with keys of their own, so they crowd no seed's partition."""
        if len(doc):
            key = mix(doc.view(np.uint64) * R + start.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(stop), pa.array(doc), pa.array(start), pa.nulls(len(doc), pa.binary())], names=NAMES)

    found = docs.mapInArrow(seeds, "seed long, code long, doc_id long, place long, spans binary")
    settled = F.col("spans").isNull()
    ranked = found.withColumn("n", F.rank().over(Window.partitionBy("seed", "code").orderBy("doc_id", "place"))).select(
        "seed", "doc_id", F.when(settled, F.col("place")).alias("start"), F.when(settled, F.col("code")).alias("stop"), (settled | (F.col("n") > 1)).alias("later"), F.when(F.col("n") == 1, F.col("spans")).alias("spans"),
        F.expr("place div 4096").alias("pos"), F.expr("place div 64 % 64").alias("l"), F.expr("place % 64").alias("r"))
    ranked = materialize(ranked, "seeds")
    seen.destroy()  # the written table needs it no more
    whole = ranked.where("later").select("doc_id", F.coalesce("start", F.col("pos") - F.col("l")).alias("start"), F.coalesce("stop", F.col("pos") + GRAM + F.col("r")).alias("stop"))
    return whole.union(window_repeats(ranked.where("not later").select("seed", "doc_id", "pos", "l", "r", "spans"), spark))


def window_repeats(firsts: DataFrame, spark) -> DataFrame:
    """``doc_id, start, stop`` of windows that an earlier holder also has, from the first holders of each seed and full extension.

    A second bitmap, sized by the number of these rows up to ``BITS``, finds the seeds with several extensions; only their windows go on.  Tasks settle the
    windows of ``SPANS`` together and send one holder of each, so a hot window costs a row per task and a
    hot seed is spread by its windows: neither is ever one key.
    """

    bits = min(BITS, max(16, (8 * firsts.count()).bit_length()))

    def seeds(batches):
        for batch in batches:
            yield seed_slots(batch.column(0).to_numpy().view(np.uint64), bits)

    mixed = spark.sparkContext.broadcast(bitmap(firsts.select("seed"), seeds, bits, twice=True))

    def windows(batches):
        held, size = [], 0
        for batch in batches:
            seed = batch.column(0).to_numpy().view(np.uint64)
            keep = is_set(mixed.value, seed_slots(seed, bits))
            doc, pos, left, right = (batch.column(k).to_numpy()[keep] for k in range(1, 5))
            n = left + right - REACH + 1
            back = np.repeat(REACH - right, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            span = np.frombuffer(b"".join(batch.column(5).filter(pa.array(keep)).to_pylist()), dtype=np.uint64)
            code = mix(mix(np.repeat(seed[keep], n) * R + back.astype(np.uint64)) * R + span)
            held.append((code, np.repeat(doc, n), np.repeat(pos, n) - back))
            size += len(code)
            if size >= SPANS:
                yield from sent(held)
                held, size = [], 0
        if size:
            yield from sent(held)

    def sent(held):
        code, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
        later = Earliest().later(code, doc, start)
        order = np.flatnonzero(later)[np.lexsort((start[later], doc[later]))]
        number, index = np.unique(doc[order], return_inverse=True)
        owner, a, b = joined_ranges(number, index, start[order], start[order] + WINDOW)
        key = mix(owner.view(np.uint64) * R + a.astype(np.uint64)).view(np.int64)  # settled ranges have keys of their own
        first = ~later
        columns = [pa.array(np.concatenate(x)) for x in ((code[first].view(np.int64), key), (doc[first], owner), (start[first], a))]
        stop = pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(b)])
        yield pa.RecordBatch.from_arrays([*columns, stop], names=["span", "doc_id", "start", "stop"])

    found = firsts.mapInArrow(windows, "span long, doc_id long, start long, stop long")
    ranked = found.withColumn("n", F.rank().over(Window.partitionBy("span").orderBy("doc_id", "start")))
    return ranked.where("stop is not null or n > 1").select("doc_id", "start", F.coalesce("stop", F.col("start") + WINDOW).alias("stop"))


def cut(raw: bytes, ranges: list | None) -> tuple[int, int, str]:
    """(words, removed, sha256 of the kept words joined by a space)."""
    found = raw.split()
    if not ranges:
        return len(found), 0, hashlib.sha256(b" ".join(found)).hexdigest()
    gone = np.zeros(len(found) + 1, dtype=np.int64)
    for r in ranges:
        gone[min(r["start"], len(found))] += 1
        gone[min(r["stop"], len(found))] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    kept = [w for w, k in zip(found, keep.tolist(), strict=True) if k]
    return len(found), len(found) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` after removal of every later 20-word repeat."""
    docs = spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return apply_ranges(docs, repeats(docs, docs.sparkSession), cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op5_seedextend(spark, sf_dir: str) -> DataFrame:
    """Digest of ``drop_repeats`` over the whole ``documents`` table."""
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
