"""Cutting documents by ranges found elsewhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .scratch import materialize
from .textscan import bitmap, chunks, id_slots, is_set

DOC_BITS = 24


def apply_ranges(docs: DataFrame, ranges: DataFrame, cut_row, schema: str, bits: int | None = None, only_touched: bool = False) -> DataFrame:
    """``cut_row(text, ranges)`` of every document of ``docs(doc_id, text)``; texts without ranges stay out of the join.

    With ``only_touched``, documents without ranges may be left out.
    """
    spark, bits = docs.sparkSession, bits or DOC_BITS
    ranges = materialize(ranges, "ranges")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def slots(batches):
        for batch in batches:
            yield id_slots(batch.column(0).to_numpy(zero_copy_only=False), bits)

    touched = spark.sparkContext.broadcast(bitmap(ranges.select("doc_id"), slots, bits, twice=False))

    def mask(batch):
        ids = batch.column(0)
        here = is_set(touched.value, id_slots(ids.fill_null(0).to_numpy(zero_copy_only=False), bits))
        return here & ids.is_valid().to_numpy(zero_copy_only=False)

    def result(ids, rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([ids, *map(list, zip(*rows, strict=True))], arrow.types, strict=True)], schema=arrow)

    def untouched(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~mask(batch)))
            for ids, texts in chunks(iter([batch])):
                yield result(ids, [cut_row(t, None) for t in texts])

    def candidates(batches):
        for batch in batches:
            yield batch.filter(pa.array(mask(batch)))

    def joined(batches):
        for batch in batches:
            ranges_ = batch.column(2).to_pylist()
            at = 0
            for ids, texts in chunks(iter([batch])):
                yield result(ids, [cut_row(t, r) for t, r in zip(texts, ranges_[at : at + len(ids)], strict=True)])
                at += len(ids)

    per_doc = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    some = docs.mapInArrow(candidates, "doc_id long, text string").join(per_doc, "doc_id", "left").select("doc_id", "text", "ranges")
    if only_touched:
        return some.mapInArrow(joined, schema)
    return docs.mapInArrow(untouched, schema).union(some.mapInArrow(joined, schema))
