from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from gramloom.llm import puquality

DATA = Path("/root/testdata")


def test_held_out_accuracy(spark):
    got = puquality.op10_puquality(spark, str(DATA / "sf0.01"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(str(DATA / "sf0.01/labels.parquet")).collect()}
    rows = got.collect()
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and len(held) > 50
    assert np.mean([a == b for a, b in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_risk_stays_non_negative_and_separates():
    rng = np.random.default_rng(1)
    p = np.c_[rng.normal(1, 0.5, 400), np.ones(400)]
    u = np.c_[np.r_[rng.normal(1, 0.5, 700), rng.normal(-2, 0.5, 300)], np.ones(1000)]
    w = puquality.minimise(p, u, 0.7)
    assert (p @ w > 0).mean() > 0.97 and (u[700:] @ w < 0).mean() > 0.97


def test_class_prior():
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 0.4, (2000, 2))
    u = np.r_[rng.uniform(0, 0.4, (1600, 2)), rng.uniform(0.6, 1, (400, 2))]
    assert 0.7 < puquality.class_prior(p, u) < 0.82


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(puquality, "Model", lambda p, u: seen.append((len(p), len(u))))
    table = spark.range(4000).select("id", F.array(*[F.lit(0.5).cast("float")] * len(puquality.FEATURES)).alias("x")).withColumnRenamed("id", "doc_id")
    puquality.fit(table, spark.range(4000).selectExpr("id as doc_id", "1 as quality"), sample=500)
    assert all(400 < n < 600 for n in seen[0])


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in puquality.classify(docs, labels).collect()} == {0.5}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert puquality.classify(none, labels).count() == 0
    some = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    assert puquality.classify(docs, some).count() == docs.count()
