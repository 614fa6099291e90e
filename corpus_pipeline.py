"""The corpus pipeline: five stages from raw documents to token digests.

Every stage reads what its predecessor wrote and its decisions take effect:
quality rules drop rejected documents, SimHash finds near duplicates of which the smallest doc_id stays, decontamination drops documents that hold a benchmark
window, the secret scan overwrites secrets with a mark of their kind, and the
last stage encodes the text that is left.  Every row gets its own verdict: a
null or repeated doc_id is judged by its own text, and one row of a
near-duplicate group stays.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm import blobledger, bpetree, ruleledger, simhash, winnowing
from gramloom.llm.scratch import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the rule ledger keeps."""
    return docs.select(*COLUMNS).where(ruleledger.keeps(F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8 or more), of the smallest doc_id."""
    return simhash.one_of_each(docs, COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark window."""
    carry = tuple(c for c in COLUMNS if c != "doc_id")
    found = winnowing.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=carry)
    return found.where("n_hit = 0").select(*[F.col(n).cast(t) for n, t in docs.select(*COLUMNS).dtypes])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by ``<kind>``; n_chars follows."""
    paths = docs.select(F.col("doc_id").alias("path"), "text")
    found = blobledger.report(paths, blobledger.scan(paths)).where("spans <> ''")
    masks = found.select(F.col("blob").alias("masked"), "spans").distinct()
    blob = F.sha2(F.coalesce("text", F.lit("")), 256)

    def redact(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [blobledger.redact(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            columns = {name: batch.column(name) for name in COLUMNS}
            columns["text"] = pa.array(texts, pa.string())
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_pydict(columns)

    both = docs.select(*COLUMNS).join(masks, blob == F.col("masked"), "left").select(*COLUMNS, "spans")
    schema = ", ".join(f"{name} {kind}" for name, kind in docs.select(*COLUMNS).dtypes)
    return both.mapInArrow(redact, schema)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpetree.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret scan", mask_secrets),
    ("byte-level BPE", tokens),
]
#: XXH64 fingerprints and BPE are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
