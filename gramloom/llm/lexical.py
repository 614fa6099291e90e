"""Ranked lexical search as a blocked sparse matrix product.

The left factor holds items by terms (multiplicities), the right one terms by
documents: 64-bit integer impacts, saturating in the term frequency and falling
with the document's length.  Items come in groups whose terms fit a fixed
budget.  For a group, every document is scanned once into blocks that keep the
group's terms only: postings sorted by term, frequencies and lengths.  The
collection's numbers (documents, words, documents a term) are sums over all
blocks.  A block of impacts is then multiplied row by row: for an item, the rows
of its terms are merged into one accumulator over the block's documents.  Each
task keeps the best ``k`` of every item over its blocks, and a bound (an item's
greatest impacts in the block, summed) skips products that cannot reach them;
ties count, so the skipping is exact.  The last step ranks a few rows an item.

No pair of item and document is emitted but the best of a task, and no term is
a join key, so common terms and copies cost no rows.

Defined results: null text has no term; an item without a term, or without a
document that scores above 0, has no row; rows of one item_id (or null ones)
are separate items; a null doc_id follows other ids among ties; repeated rows
are separate documents; empty tables give an empty result.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .importance import tokens
from .scratch import discard, materialize, spread

TOP = 10
#: Bytes of item texts that one group may hold, so that its terms are a bounded broadcast; texts of a block of documents.
GROUP_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20


def term_weight(n: int, df: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, n: int, words: int) -> np.ndarray:
    """Impact of a term of weight 1 that occurs ``tf`` times in documents of ``lengths``: all in 64-bit integers."""
    m = 10 + 90 * lengths * n // max(1, words)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def groups(items: DataFrame, limit: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """Written ``item, item_id, terms, group`` of ``items(item_id, text)``: each group's texts are about ``limit`` bytes; and the number of groups."""

    def run(batches):
        for batch in batches:
            raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id"), "terms": pa.array([tokens(t) for t in raw], pa.list_(pa.binary())), "n_bytes": pa.array(list(map(len, raw)), pa.int64())})

    kind = dict(items.dtypes)["item_id"]
    found = items.select("item_id", F.col("text").cast("string")).mapInArrow(run, f"item_id {kind}, terms array<binary>, n_bytes long")
    table = materialize(found.withColumn("item", F.monotonically_increasing_id()), "items")
    number = max(1, -(-(table.agg(F.sum("n_bytes")).first()[0] or 0) // limit))
    return table.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(number))), number


class Factor:
    """The left factor of one group: for every item its terms (numbers in the group's vocabulary) and multiplicities."""

    def __init__(self, rows: list, multiplicity: bool):
        self.vocabulary: dict[bytes, int] = {}
        self.items, self.terms, self.times = [], [], []
        for item, terms in rows:
            if terms:
                own = np.array([self.vocabulary.setdefault(bytes(t), len(self.vocabulary)) for t in terms])
                at, times = np.unique(own, return_counts=True)
                self.items.append(item)
                self.terms.append(at)
                self.times.append(times.astype(np.int64) if multiplicity else np.ones(len(at), np.int64))


def term_blocks(docs: DataFrame, vocabulary: dict[bytes, int], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Written blocks of ``docs(doc_id, text)``: ``ids, none, lengths`` of the documents with a term, and ``term, doc, tf`` of the postings in the vocabulary, sorted by term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def block(ids, lengths, own):
        n = len(ids)
        doc, term = np.repeat(np.arange(n), [len(x) for x in own]), np.concatenate([np.zeros(0, np.int64), *own])
        cell, tf = np.unique(term * n + doc, return_counts=True)
        columns = {"none": np.array([i is None for i in ids], np.int8), "ids": np.array([0 if i is None else i for i in ids], np.int64), "lengths": np.array(lengths, np.int64), "term": (cell // n).astype(np.int32), "doc": (cell % n).astype(np.int32), "tf": tf.astype(np.int32)}
        return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "words": pa.array([sum(lengths)], pa.int64()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in columns.items()}})

    def run(batches):
        number = shared.value.get
        ids, lengths, own, held = [], [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = tokens(t.as_buffer().to_pybytes()) if t.is_valid else []
                if not found:
                    continue
                at = np.fromiter(map(number, found, repeat(-1)), np.int64, len(found))
                ids.append(i)
                lengths.append(len(found))
                own.append(at[at >= 0])
                held += len(t.as_buffer())
                if held >= block_bytes:
                    yield block(ids, lengths, own)
                    ids, lengths, own, held = [], [], [], 0
        if ids:
            yield block(ids, lengths, own)

    texts = spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return materialize(texts.mapInArrow(run, "n long, words long, none binary, ids binary, lengths binary, term binary, doc binary, tf binary"), "terms", **{"compression": "zstd", "parquet.block.size": 16 << 20})


def _array(row, name: str, kind) -> np.ndarray:
    return np.frombuffer(row[name].as_buffer(), kind)


def document_counts(blocks: DataFrame, terms: int) -> np.ndarray:
    """Documents of every term of the vocabulary: one count a term from each task."""

    def run(batches):
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            for raw in batch.column("term"):
                total += np.bincount(np.frombuffer(raw.as_buffer(), np.int32), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "df": pa.array(total[at])})

    found = blocks.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(terms, dtype=np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def best(score: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0; ties by ascending id, null ids last."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], none[at], -score[at]))[:k]]


def multiply(blocks: DataFrame, factor: Factor, weights: np.ndarray, n: int, words: int, k: int) -> DataFrame:
    """``item, doc_id, score``: the best ``k`` documents of every item within each task."""
    shared = blocks.sparkSession.sparkContext.broadcast((factor.items, factor.terms, factor.times, weights))

    def run(batches):
        items, terms, times, weights = shared.value
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)) for _ in items]
        flat, head = np.concatenate([np.zeros(0, np.int64), *terms]), np.cumsum([0, *map(len, terms)])[:-1]
        flat_times = np.concatenate([np.zeros(0, np.int64), *times])
        for batch in batches:
            for at in range(len(batch)):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                ids, none, lengths = _array(row, "ids", np.int64), _array(row, "none", np.int8), _array(row, "lengths", np.int64)
                term, doc, tf = _array(row, "term", np.int32), _array(row, "doc", np.int32), _array(row, "tf", np.int32).astype(np.int64)
                value = weights[term] * impacts(tf, lengths[doc], n, words)
                edge = np.searchsorted(term, np.arange(len(weights) + 1))
                most = np.zeros(len(weights), dtype=np.int64)
                there = np.flatnonzero(np.diff(edge))
                if len(there):
                    most[there] = np.maximum.reduceat(value, edge[there])
                bound = np.add.reduceat(most[flat] * flat_times, head) if len(flat) else np.zeros(0, np.int64)
                for i in np.flatnonzero(bound > 0).tolist():
                    old = kept[i]
                    if len(old[0]) == k and bound[i] < old[0][-1]:
                        continue
                    total = np.zeros(len(ids), dtype=np.int64)
                    for t, f in zip(terms[i].tolist(), times[i].tolist(), strict=True):
                        a, b = edge[t], edge[t + 1]
                        if a < b:
                            total[doc[a:b]] += f * value[a:b]  # a document occurs once in a term's row
                    new = best(total, ids, none, k)
                    score, ident, blank = (np.concatenate(x) for x in zip(old, (total[new], ids[new], none[new]), strict=True))
                    top = best(score, ident, blank, k)
                    kept[i] = (score[top], ident[top], blank[top])
        for i, (score, ident, blank) in zip(items, kept, strict=True):
            if len(score):
                yield pa.RecordBatch.from_pydict({"item": pa.array([i] * len(score), pa.int64()), "doc_id": pa.array(ident, mask=blank.astype(bool)), "score": pa.array(score)})

    return blocks.select("ids", "none", "lengths", "term", "doc", "tf").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, multiplicity: bool = True, group_bytes: int = GROUP_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item, item_id, rank, doc_id, score``: the ``k`` highest-scoring rows of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``.

    With ``multiplicity`` a term counts as often as the item holds it, else once.  Every group of items is one more scan of the documents.
    """
    table, number = groups(items, group_bytes)
    found = None
    for group in range(number):
        own = table.where(F.col("group") == group).select("item", "terms").toArrow()  # bounded by group_bytes
        factor = Factor(list(zip(own.column("item").to_pylist(), own.column("terms").to_pylist(), strict=True)), multiplicity)
        blocks = term_blocks(docs, factor.vocabulary, block_bytes)
        n, words = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        counts = document_counts(blocks, len(factor.vocabulary))
        weights = np.array([term_weight(n, int(c)) for c in counts], dtype=np.int64)
        part = materialize(multiply(blocks, factor, weights, n, words, k), "best")
        discard(blocks)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(table.select("item", "item_id"), "item").select("item", "item_id", "rank", "doc_id", "score")


def op13_lexical(spark, sf_dir: str) -> DataFrame:
    """The ten best of ``documents`` for every item of ``benchmark``, each term once."""
    found = search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), multiplicity=False)
    return found.select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH c AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, c),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark, c),
l AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS weight FROM t, l GROUP BY term, n),
s AS (SELECT q, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w)::BIGINT * n) // words))))::BIGINT AS score
  FROM (SELECT q, unnest(w) AS term FROM i) JOIN t USING (term) JOIN f USING (term) JOIN d USING (r), l GROUP BY q, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= 10
"""
