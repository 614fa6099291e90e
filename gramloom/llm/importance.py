"""Importance resampling of documents towards a target distribution.

Texts are bags of hashed word n-grams.  The counts of every bucket over all
documents and over the target texts give an array of gains, one a bucket; the
weight of a document is the sum of its features' gains (one look-up and one
sum in numpy).  A score is the weight and Gumbel noise from a hash of the id, so
the highest scores are a sample without replacement in proportion to
exp(weight / 1000).

The draw takes the exact number of highest scores.  Tasks sort their eligible
rows into runs of bounded size, cut at quantiles of the score into ranges and
written in blocks.  The runs of one range are merged by a tournament tree whose
leaves are the open blocks: blocks come in order of their first row, so a run's
next block is read only when the tree reaches it, and memory holds one block a
run.  Ranges wholly beyond the draw are not merged, and the last one stops at
the exact count.  Ranks follow from the sizes of the ranges before, so ranges
merge apart and nothing passes through one task.

Defined results: null text and text without a word have no features, weight 0
and are never drawn; a null doc_id gets the noise of an empty id and follows
other ids among ties; repeated rows are separate documents; without eligible
rows nothing is drawn; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, spread
from .textscan import ALNUM

BUCKETS, GRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
RUN_ROWS, BLOCK_ROWS, RANGE_ROWS = 1 << 18, 1 << 12, 1 << 19
_LOWER = bytes((b | 32 if 65 <= b <= 90 else b) if ALNUM[b | 32 if 65 <= b <= 90 else b] else 32 for b in range(256))


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, all other ASCII but digits and letters between them."""
    return raw.translate(_LOWER).split()


def features(raw: bytes, grams: int = GRAMS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of 1 to ``grams`` words."""
    words, crc = tokens(raw), zlib.crc32
    hashes = list(map(crc, words))
    for n in range(2, grams + 1):
        hashes += [crc(b" ".join(words[k : k + n])) for k in range(len(words) - n + 1)]
    return len(words), np.array(hashes, dtype=np.int64) % buckets


def _texts(batch, name: str = "text") -> Iterator[bytes]:
    for t in batch.column(name):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all ``texts(text)`` by bucket; a task sends one count a bucket, the driver gets ``buckets`` numbers."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for raw in _texts(batch):
                total += np.bincount(features(raw, grams, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at])})

    found = spread(texts.select(F.col("text").cast("string"))).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + b) / ((s + 1) (T + b)))) of every bucket, for b buckets."""
    b, big_s, big_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (big_s + b) / ((float(s) + 1) * (big_t + b)))) for s, t in zip(source, target, strict=True)], dtype=np.int64)


def noise(ident: str, seed: str = SEED) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256 of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS, least: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Written table ``doc_id, n_features, weight, score, eligible, row`` of every row of ``docs(doc_id, text)``; ``row`` is a number of its own."""
    gain = np.asarray(gain)

    def run(batches):
        for batch in batches:
            n_features, weight, score, enough = [], [], [], []
            ids = batch.column("doc_id").to_pylist()
            for ident, raw in zip(ids, _texts(batch), strict=True):
                words, at = features(raw, grams, len(gain))
                n_features.append(len(at))
                weight.append(int(gain[at].sum()))
                score.append(weight[-1] + noise("" if ident is None else str(ident), seed))
                enough.append(words >= least)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_features": pa.array(n_features, pa.int64()), "weight": pa.array(weight, pa.int64()), "score": pa.array(score, pa.int64()), "eligible": pa.array(enough, pa.bool_())})

    found = spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, n_features long, weight long, score long, eligible boolean")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "scored")


#: Columns by which rows are ordered: negated score, whether the id is null, id, features and number.
ORDER = ("low", "none", "doc_id", "n_features", "row")
_BLOCK = ", ".join(f"{n} binary" for n in ORDER)


class Tournament:
    """Winner tree over the heads of open blocks: leaves are places of blocks, a node holds the place with the smaller head."""

    def __init__(self):
        self.places, self.open, self.free, self.best = 2, {}, [1, 0], [None, None]

    def _head(self, place: int) -> tuple:
        rows, at = self.open[place]
        return rows[at]

    def _replay(self, place: int) -> None:
        """The matches from a place up to the root."""
        node = (self.places + place) // 2
        while node:
            rivals = [self.best[c] if c < self.places else c - self.places for c in (2 * node, 2 * node + 1)]
            self.best[node] = min((r for r in rivals if r in self.open), key=self._head, default=None)
            node //= 2

    def add(self, rows: list[tuple]) -> None:
        """Open a block of sorted rows; the tree doubles when no place is free."""
        if not self.free:
            self.free = list(range(2 * self.places - 1, self.places - 1, -1))
            self.places *= 2
            self.best = [None] * self.places
            for place in self.open:
                self._replay(place)
        place = self.free.pop()
        self.open[place] = (rows, 0)
        self._replay(place)

    def least(self) -> tuple | None:
        """The smallest row, None when no block is open."""
        return self._head(self.best[1]) if self.open else None

    def pop(self) -> tuple:
        """Take the smallest row."""
        place = self.best[1]
        rows, at = self.open[place]
        if at + 1 < len(rows):
            self.open[place] = (rows, at + 1)
        else:
            del self.open[place]
            self.free.append(place)
        self._replay(place)
        return rows[at]


def runs(rows: DataFrame, cuts: list[int], run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Written table of sorted blocks of ``rows(doc_id, n_features, weight, score, row)``: ``range, head, n`` and the packed columns.

    Rows of score ``cuts[k - 1]`` > score >= ``cuts[k]`` fall in range ``k``; ``cuts`` descend.
    """
    edges = -np.array(cuts, dtype=np.int64)

    def blocks(parts):
        table = pa.Table.from_batches(parts)
        get = lambda name: table.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        low, none = -get("score"), table.column("doc_id").combine_chunks().is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        at = {"low": low, "none": none, "doc_id": get("doc_id"), "n_features": get("n_features"), "row": get("row")}
        order = np.lexsort([at[n] for n in reversed(ORDER)])
        at = {n: v[order] for n, v in at.items()}
        weight, kind = get("weight")[order], np.searchsorted(edges, at["low"], side="left")
        out = []
        for k in np.unique(kind):
            a, b = np.searchsorted(kind, [k, k + 1])
            for s in range(a, b, block_rows):
                e = min(b, s + block_rows)
                out.append({"range": int(k), "n": e - s, "head": {n: int(at[n][s]) for n in ORDER}, "weight": weight[s:e].tobytes(), **{n: at[n][s:e].tobytes() for n in ORDER}})
        fields = [("range", pa.int64()), ("n", pa.int64()), ("head", pa.struct([(n, pa.int64()) for n in ORDER])), ("weight", pa.binary()), *((n, pa.binary()) for n in ORDER)]
        return pa.RecordBatch.from_pylist(out, pa.schema(fields))

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for at in range(0, len(batch), run_rows):
                parts.append(batch.slice(at, run_rows))
                held += len(parts[-1])
                if held >= run_rows:
                    yield blocks(parts)
                    parts, held = [], 0
        if held:
            yield blocks(parts)

    head = "struct<" + ", ".join(f"{n}: bigint" for n in ORDER) + ">"
    return materialize(rows.select("doc_id", "n_features", "weight", "score", "row").mapInArrow(run, f"range long, n long, head {head}, weight binary, {_BLOCK}"), "runs")


def merged(blocks: DataFrame, starts: dict[int, int], count: int) -> DataFrame:
    """``doc_id, n_features, weight, score, row, rank`` of the first ``count`` rows of all runs in order; ``starts`` has the rows before each range."""

    def run(batches):
        tree, now, rank, out = Tournament(), None, 0, []
        columns = ("doc_id", "n_features", "weight", "score", "row", "rank")

        def told(part):
            cells = {n: pa.array([r[k] for r in part], pa.int64()) for k, n in enumerate(columns)}
            return pa.RecordBatch.from_pydict(cells)

        def drain(upto):
            """Rows before ``upto`` (all if None), while the draw lasts."""
            nonlocal rank
            while rank < count and (head := tree.least()) is not None and (upto is None or head < upto):
                low, none, ident, n, row, weight = tree.pop()
                rank += 1
                out.append((None if none else ident, n, weight, -low, row, rank))

        for batch in batches:
            for r in batch.to_pylist():
                if r["range"] != now:
                    drain(None)
                    tree, now, rank = Tournament(), r["range"], starts[r["range"]]
                if rank >= count:
                    continue
                drain(tuple(r["head"][n] for n in ORDER))
                tree.add(list(zip(*(np.frombuffer(r[n], np.int64).tolist() for n in (*ORDER, "weight")), strict=True)))
                if len(out) >= BLOCK_ROWS:
                    yield told(out)
                    out.clear()
        drain(None)
        yield told(out)

    wanted = sorted(k for k, before in starts.items() if before < count)
    dealt = blocks.where(F.col("range").isin(wanted)).repartition(max(1, len(wanted)), "range").sortWithinPartitions("range", "head")
    return dealt.select("range", "head", "weight", *ORDER).mapInArrow(run, "doc_id long, n_features long, weight long, score long, row long, rank long")


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs(doc_id, text)``: ranks of the drawn, null for the others.

    Of the documents with ``least`` words or more, ``percent`` in a hundred (rounded down) are drawn for their closeness to ``target(text)``.
    """
    rows = scored(docs, gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets)), grams, least, seed)
    eligible = rows.where("eligible")
    n = eligible.count()
    count = percent * n // 100
    if count == 0:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    parts = -(-n // range_rows)
    found = eligible.stat.approxQuantile("score", [k / parts for k in range(parts - 1, 0, -1)], 1 / (8 * parts)) if parts > 1 else []
    cuts = sorted({int(c) for c in found}, reverse=True)
    sorted_runs = runs(eligible, cuts)
    sizes = dict(sorted_runs.groupBy("range").agg(F.sum("n")).collect())
    starts, before = {}, 0
    for k in sorted(sizes):
        starts[k], before = before, before + sizes[k]
    drawn = materialize(merged(sorted_runs, starts, count), "drawn")
    last = drawn.where(F.col("rank") == count).first()
    low = lambda c: (-c("score"), c("doc_id").isNull(), F.coalesce(c("doc_id"), F.lit(0).cast("long")), c("n_features"), c("row"))
    key = F.struct(*low(F.col))
    end = F.struct(*[F.lit(x).cast("boolean" if isinstance(x, bool) else "long") for x in (-last.score, last.doc_id is None, last.doc_id or 0, last.n_features, last.row)])
    rest = rows.where(~F.col("eligible") | (key > end))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank").unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op12_importance(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, drawn towards ``benchmark``."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
