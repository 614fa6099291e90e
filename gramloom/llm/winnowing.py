"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and split into words of letters, digits and bytes
beyond ASCII.  A benchmark item holds a match in every occurrence of ten of its
consecutive words.  Fingerprints are the minimum hash of every six consecutive
5-word grams, so any shared span of ten words shares one; items of fewer than
ten words are one window, found by the hash of their whole length.

Document fingerprints that the benchmark also has are seeds; a seed is extended
to the ten-word windows around it, and each window is looked up in the item
windows.  Hit words and items follow from the windows found.

Two ways bring the benchmark to the documents, with the same results.  The bytes
of its windows and names are summed first: up to ``BROADCAST_BYTES`` they are
broadcast, items as numbers into one list of names, and documents are scanned
where they are, without a shuffle.  Beyond, a bitmap of fixed size of all item
seeds is broadcast instead; documents send the places and hashes of the windows
that it lets through to a join with the item windows.  No step groups by seed or
window, a join's hot window has one row on the items' side until items are named,
and texts stay where they are.

Defined results: null or word-less texts are not contaminated and null or
word-less items match nothing; ids are labels (null doc_ids pass through, null
item_ids are ignored); repeated items count once by id; repeated rows each get
their own result; a long text is one row, whole; other columns are ignored unless
named in ``carry``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import carried_schema, materialize, spread, with_carried
from .textscan import ALNUM, U, bitmap, chunks, is_set, kgrams, sliding, slots_of, winnow, words

WINDOW = 10
GRAM = 5
BROADCAST_BYTES = 64 << 20
BITS = 29
RESULT = "doc_id long, n_words long, n_hit long, items array<string>"


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows; the length is part of the hash."""
    return kgrams(h + U(n), n)


def item_rows(benchmark: DataFrame) -> DataFrame:
    """``item_id, length, window, seed``: distinct windows of every item, each with its fingerprint gram."""

    def run(batches):
        for ids, texts in chunks(batches):
            out = []
            for i, t in zip(ids, texts, strict=True):
                _, _, h = words(t.lower(), ALNUM)
                if i is None or not len(h):
                    continue
                n = min(WINDOW, len(h))
                window = window_hash(h, n)
                seed = window if n < WINDOW else sliding(kgrams(h, GRAM), WINDOW - GRAM + 1, np.minimum)
                out += [(i, n, w, s) for w, s in zip(window.view(np.int64).tolist(), seed.view(np.int64).tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item_id", "length", "window", "seed"])

    chosen = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "item_id string, length int, window long, seed long").distinct()


class Windows:
    """Item windows as sorted arrays, for lookups from documents; items are numbers into ``names``."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        length, window, seed = (rows.column(c).to_numpy() for c in ("length", "window", "seed"))
        window, seed = window.view(np.uint64), seed.view(np.uint64)
        order = np.argsort(window, kind="stable")
        self.window = window[order]
        items = rows.column("item_id").combine_chunks().dictionary_encode()
        items = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
        self.items, self.names = items.indices.to_numpy()[order], items.dictionary.to_pylist()
        self.seeds = {int(n): np.unique((seed if n == WINDOW else window)[length == n]) for n in np.unique(length)}

    @staticmethod
    def has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
        return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of texts laid end to end, the text of each, and every text's first word."""
    starts, _, h = words(b"\n".join(t.lower() for t in texts), ALNUM)
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    return h, np.repeat(np.arange(len(texts)), np.diff(first)), first


def candidates(h: np.ndarray, doc: np.ndarray, lengths, is_seed):
    """(starts, hashes, length) of the document windows that may be item windows: those around a seed, and short ones that are seeds."""
    for n in lengths:
        if n < WINDOW:
            found = window_hash(h, n)
            at = np.flatnonzero(is_seed(found, n))
            at = at[doc[at] == doc[at + n - 1]]
            yield at, found[at], n
        elif len(h) >= WINDOW:
            grams = kgrams(h, GRAM)
            valid = doc[: len(h) - WINDOW + 1] == doc[WINDOW - 1 :]
            seeds = winnow(grams, valid, WINDOW - GRAM + 1)
            seeds = seeds[is_seed(grams[seeds], n)]
            at = np.unique((seeds[:, None] - np.arange(WINDOW - GRAM + 1)[None, :]).ravel())
            at = at[(at >= 0) & (at + WINDOW <= len(h))]
            at = at[doc[at] == doc[at + WINDOW - 1]]
            if len(at):
                yield at, window_rows(h[at[:, None] + np.arange(WINDOW)[None, :]] + U(WINDOW)), n


def hits(texts: list[bytes], known: Windows) -> list[tuple[int, int, list[str]]]:
    """(words, hit words, items) of every text."""
    h, doc, first = laid_out(texts)
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    items: list[set] = [set() for _ in texts]
    for at, found, n in candidates(h, doc, known.seeds, lambda x, n: Windows.has(known.seeds[n], x)):
        good = Windows.has(known.window, found)
        at, found = at[good], found[good]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        lo, hi = np.searchsorted(known.window, found, "left"), np.searchsorted(known.window, found, "right")
        for d, a, b in zip(doc[at].tolist(), lo.tolist(), hi.tolist(), strict=True):
            items[d].update(known.items[a:b].tolist())
    hit = (np.cumsum(cover)[:-1] > 0).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(hit)])
    return [(int(first[d + 1] - first[d]), int(total[first[d + 1]] - total[first[d]]), sorted(known.names[i] for i in items[d])) for d in range(len(texts))]


def window_rows(span: np.ndarray) -> np.ndarray:
    """``window_hash`` of rows that each hold one window's word hashes."""
    flat = kgrams(span.ravel(), span.shape[1])
    return flat[:: span.shape[1]]


def _result(ids, found, own):
    a, b, c = zip(*found, strict=True)
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(a, pa.int64()), "n_hit": pa.array(b, pa.int64()), "items": pa.array(c, pa.list_(pa.string())), **own})


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` of every row of ``docs(doc_id, text)``, and the row's columns named in ``carry``."""
    docs = spread(with_carried(docs, carry))
    rows = item_rows(benchmark)
    if (rows.agg(F.sum(F.octet_length("item_id") + 24)).first()[0] or 0) > broadcast_bytes:  # three numbers a window, and its item's name
        return _joined(docs, rows, carry)
    known = docs.sparkSession.sparkContext.broadcast(Windows(rows.toArrow()))

    def run(batches):
        for batch in batches:
            at = 0
            for ids, texts in chunks(iter([batch])):
                yield _result(ids, hits(texts, known.value), {name: batch.column(name).slice(at, len(ids)) for name in carry})
                at += len(ids)

    return docs.mapInArrow(run, RESULT + carried_schema(docs, carry))


def _joined(docs: DataFrame, rows: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The way for benchmarks beyond the broadcast bound: windows that a bitmap of all item seeds lets through meet the item windows in a join."""
    rows = materialize(rows, "item-windows")
    lengths = [r.length for r in rows.select("length").distinct().collect()]  # ten values at most

    def seeds(batches):
        for batch in batches:
            yield slots_of(batch.column(0).to_numpy().view(np.uint64), BITS)

    seen = docs.sparkSession.sparkContext.broadcast(bitmap(rows.select("seed"), seeds, BITS, twice=False))  # a short window is its own seed

    def scan(batches):
        row = TaskContext.get().partitionId() << 40  # written with its row, so a lost task changes no number in use
        for batch in batches:
            at = 0
            for ids, texts in chunks(iter([batch])):
                h, doc, first = laid_out(texts)
                start, window, length = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for places, hashes, n in candidates(h, doc, lengths, lambda x, n: is_set(seen.value, slots_of(x, BITS))):
                    start.append(places)
                    window.append(hashes)
                    length.append(np.full(len(places), n, dtype=np.int64))
                start, window, length = map(np.concatenate, (start, window, length))
                order = np.argsort(start, kind="stable")
                start, window, length = start[order], window[order], length[order]
                offsets = np.searchsorted(start, first).astype(np.int32)
                place = start - np.repeat(first[:-1], np.diff(offsets))
                places = pa.StructArray.from_arrays([pa.array(place), pa.array(place + length), pa.array(window.view(np.int64))], names=["start", "stop", "window"])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(np.diff(first).astype(np.int64)), "row": pa.array(np.arange(row, row + len(ids))),
                    "found": pa.ListArray.from_arrays(pa.array(offsets), places), **{f"own_{name}": batch.column(name).slice(at, len(ids)) for name in carry},
                })
                at, row = at + len(ids), row + len(ids)

    kinds = dict(docs.dtypes)
    own = "".join(f", own_{name} {kinds[name]}" for name in carry)
    table = materialize(docs.mapInArrow(scan, "doc_id long, n_words long, row long, found array<struct<start: long, stop: long, window: long>>" + own), "scanned")
    found = table.select("row", F.inline("found"))
    found = materialize(found.join(rows.select("window").distinct(), "window", "left_semi").select("row", "start", "stop", "window"), "benchmark-hits")
    before = F.max("stop").over(Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    covered = found.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = found.select("row", "window").distinct().join(rows.select("window", "item_id").distinct(), "window").select("row", "item_id").distinct()
    items = named.groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    out = table.drop("found").join(covered.join(items, "row"), "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *[F.col(f"own_{name}").alias(name) for name in carry])


def op6_winnowing(spark, sf_dir: str) -> DataFrame:
    """Digest of ``contamination`` of the whole ``documents`` table by the whole ``benchmark``."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (t)),
p AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM hit) GROUP BY doc_id),
x AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(x.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN x USING (doc_id)
"""
