"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target in words: its share by weight of the whole budget,
at most ``cap`` times its own size, what is above that reshared by weight among
the others until none is above.  A source gives whole epochs of all its
documents first; what is left of its target is a weighted sample without
replacement: documents in ascending order of an exponential key divided by
their quality weight, taken while their running total of words stays within the
rest.  The document that crosses it gives its first words up to the rest, so a
source's words meet its target to the word.

The running totals are two-level: rows are dealt by ranges of (source, key), so
a source of any size lies in many partitions; each partition adds up its own
rows once they are sorted, and the totals of the partitions before are added by
a join of one row per source and partition.

Defined results: null text has size 0 and gives nothing; an empty source has
target 0; a null source is a source of its own, the last one; a null doc_id
draws its key from the text; repeated rows are separate documents; an empty
table gives an empty result.  Long texts are only counted, a few bytes of memory for each of theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize, spread
from .textscan import NOT_SPACE

SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Rows of a side that may be broadcast: some 40 bytes each.
BROADCAST_ROWS = 1_000_000


def running(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` (long) over the rows of the same group that come earlier in the order ``group + order``.

    ``order`` holds columns that tell rows apart, so that no key is too large for a partition.  The caller may ``discard`` the result's ``parts``.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def add_up(batches):
        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            v = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            number = batch.column("group_number").to_numpy(zero_copy_only=False)
            head = np.flatnonzero(np.diff(number, prepend=number[:1] - 1))
            upto = np.cumsum(v) - v
            start = np.repeat(upto[head], np.diff(np.append(head, len(v))))
            before = upto - start
            if last is not None and len(v) and number[0] == last:
                own = head[1] if len(head) > 1 else len(v)
                before[:own] += total
            if len(v):
                last, total = number[-1], int(before[-1] + v[-1])
            names = [n for n in batch.schema.names if n != "group_number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.full(len(v), part)), pa.array(before)], names=[*names, "part", "within"])

    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    numbered = dealt.withColumn("group_number", F.xxhash64(*group) if group else F.lit(0).cast("long"))  # neighbours of other groups differ
    parts = materialize(numbered.mapInArrow(add_up, f"{schema}, part long, within long"), "running")
    totals = parts.groupBy(*group, "part").agg(F.sum(value).alias("total"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"{g}_of") for g in group], F.col("part").alias("part_of"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    same = F.col("part") == F.col("part_of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_of"))
    out = parts.join(bounded(offsets), same, "left").select(*df.columns, (F.col("within") + F.col("offset")).alias("before"))
    out.parts = parts
    return out


def bounded(df: DataFrame) -> DataFrame:
    """``df``, written, to be broadcast if it has few rows; else left to Spark's joins, which split skewed keys."""
    table = materialize(df, "small")
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size`` and ``symbols``, the counts of words and symbols, in place of ``text``."""
    kept = [n for n in docs.columns if n != "text"]

    def run(batches):
        for batch in batches:
            size, symbols = [], []
            for t in batch.column("text"):
                raw = np.frombuffer(t.as_buffer() if t.is_valid else b"", dtype=np.uint8)
                inside = NOT_SPACE[raw]
                size.append(np.count_nonzero(inside[1:] & ~inside[:-1]) + int(inside[:1].sum()))
                symbols.append(np.count_nonzero(SYMBOL[raw]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(size, pa.int64()), pa.array(symbols, pa.int64())], names=[*kept, "size", "symbols"])

    schema = ", ".join(f"{n} {t}" for n, t in docs.dtypes if n != "text")
    return spread(docs).mapInArrow(run, f"{schema}, size long, symbols long")


def quality() -> Column:
    """Weight of a counted text, in (0, 1]: its words against its words and four times its symbols."""
    return F.when(F.col("size") > 0, F.col("size") / (F.col("size") + 4 * F.col("symbols"))).otherwise(F.lit(1.0))


def exponential_key(ident: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the first 52 bits of a SHA-256 of seed and id: smaller is drawn earlier."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256), 1, 13), 16, 10).cast("double")
    return -F.ln((h + 0.5) / float(1 << 52)) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` of ``sizes(source, source_size)``; sources by code point, null last, weigh ``weights`` in turn.

    Resharing what is above a cap ends where target = least(cap, level * weight); the level is found by one aggregate a round.
    """
    place = running(sizes.withColumn("none", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long")), [], ["none", "source"], "one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    table = materialize(place.select("source", "source_size", weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("most")), "sources")
    discard(place.parts)
    budget, level, full = share * (table.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        above = F.col("most") <= F.lit(level) * F.col("weight")
        n, held, open_ = table.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not open_:
            break
        full, level = n, (budget - (held or 0.0)) / open_
    return table.select("source", "source_size", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, weight: Column | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, epochs, taken`` of every row of ``docs(doc_id, text, source)``.

    ``epochs`` counts the source's complete passes, ``taken`` all words the mix takes of the row, the fraction included.  ``weight`` is
    the quality weight, a positive column; ``quality`` of the text stands in where it is absent or null.
    """
    if cap < 1 or share < 0 or not weights or min(weights) <= 0:
        raise ValueError("weights are positive, cap is 1 or more and share 0 or more")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.sha2(text, 256))
    given = F.lit(None).cast("double") if weight is None else weight.cast("double")
    read = docs.select("doc_id", F.col("source").cast("string").alias("source"), ident.alias("ident"), given.alias("given"), F.col("text").cast("string").alias("text"))
    keys = counted(read).select("doc_id", "source", "size", exponential_key(F.col("ident"), F.coalesce("given", quality()), seed).alias("key"))
    keyed = materialize(keys.withColumn("row", F.monotonically_increasing_id()), "keyed")  # texts are read once, though ranges are sampled first
    found = running(keyed, ["source"], ["key", "doc_id", "size", "row"], "size")
    discard(keyed)
    own = targets(found.parts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    whole = F.floor(F.col("target") + 0.5)
    own = bounded(own.select(F.col("source").alias("source_of"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).alias("epochs"), whole.alias("words")))
    both = found.join(own, F.col("source").eqNullSafe(F.col("source_of")), "left")
    rest = F.col("words") - F.col("epochs") * F.col("source_size")
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return both.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + more).alias("taken"))


def op11_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix over the whole ``documents`` table."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS size, len(regexp_extract_all(text, '[#*$%&|<>]')) AS symbols FROM d),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(sha256('mix-1:' || coalesce(doc_id::VARCHAR, sha256(text))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
  / (CASE WHEN size > 0 THEN size::DOUBLE / (size + 4 * symbols) ELSE 1.0 END) AS key FROM w),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS most,
  [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight FROM k GROUP BY source),
l(n, level, done) AS (
  SELECT -1::BIGINT, 0.0::DOUBLE, false
  UNION ALL
  SELECT t.n, CASE WHEN t.n = l.n OR t.left_ IS NULL THEN l.level ELSE (t.budget - t.held) / t.left_ END, t.n = l.n OR t.left_ IS NULL
  FROM l, LATERAL (SELECT count(*) FILTER (most <= l.level * weight)::BIGINT AS n, coalesce(sum(most) FILTER (most <= l.level * weight), 0)::DOUBLE AS held,
    (sum(weight) FILTER (most > l.level * weight))::DOUBLE AS left_, (1.5 * sum(source_size))::DOUBLE AS budget FROM s) t WHERE NOT l.done),
t AS (SELECT s.source, source_size, least(most, z.level * weight) AS target FROM s, (SELECT max(level) AS level FROM l) z),
e AS (SELECT *, floor(target + 0.5)::BIGINT AS words, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
o AS (SELECT k.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM k)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, words - epochs * source_size - before)))::BIGINT AS taken, o.source, epochs
FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source
"""
