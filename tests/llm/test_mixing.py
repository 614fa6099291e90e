import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gramloom.llm import mixing

COLUMNS = ["doc_id", "size", "source_size", "target", "taken", "source", "epochs"]


def level(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2) -> dict:
    """Targets by plain resharing: what is above a cap goes to the others by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, fixed, budget = {}, set(), share * sum(sizes.values())
    while len(fixed) < len(names):
        left = budget - sum(cap * sizes[s] for s in fixed)
        whole = sum(weight[s] for s in names if s not in fixed)
        target = {s: left * weight[s] / whole for s in names if s not in fixed}
        above = {s for s in target if target[s] >= cap * sizes[s]}
        if not above:
            break
        fixed |= above
    return {s: cap * sizes[s] if s in fixed else target[s] for s in names}


@pytest.fixture(scope="module")
def table(spark, rows):
    odd = [(900, "a b c", None), (None, "of the and", "s2"), (None, None, None), (901, None, "empty"), (902, "w " * 20_000, "é"), (902, "w w", "é"), (5, "x y z", "s0"), (5, "x y z", "s0"), (5, "x y z", "s0")]
    told = [(i, t, f"s{0 if i % 3 else i % 7}") for i, t in rows]  # s0 holds two thirds
    return spark.createDataFrame([(*r, 1, "p") for r in told + odd], "doc_id long, text string, source string, size int, key string").repartition(4)


def test_equals_sql(table, same_as_sql):
    assert same_as_sql(mixing.mix(table).select(*COLUMNS), mixing.ORACLE_SQL, documents=table.select("doc_id", "text", "source")) == table.count()


def test_targets_and_epochs(table):
    by = defaultdict(list)
    for r in mixing.mix(table).collect():
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    want = level({s: sum(r.size for r in rows) for s, rows in by.items()})
    for s, rows in by.items():
        assert math.isclose(rows[0].target, want[s], abs_tol=1e-6) and rows[0].source_size == sum(r.size for r in rows)
        assert sum(r.taken for r in rows) == math.floor(rows[0].target + 0.5)
        assert all(r.taken >= r.epochs * r.size for r in rows)  # whole epochs come first
        assert sum(0 < r.taken - r.epochs * r.size < r.size for r in rows) <= 1  # one document is cut


def test_reruns_agree(spark, table):
    got = lambda n: sorted(map(str, mixing.mix(table.repartition(n)).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        assert got(1) == got(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_better_documents_are_drawn_first(spark):
    """A weight of 9 against 1: the heavier half is far likelier to be among the first third."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(docs, (1,), 1 / 3, weight=F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()
    n = {r.odd: r.n for r in got}
    assert n[0] + n[1] == 4000 and n[0] > 4 * n[1]


def test_running_totals_of_equal_keys(spark):
    df = spark.range(500).select(F.lit(1).alias("g"), F.lit(0).alias("k"), F.col("id"), F.lit(2).cast("long").alias("v")).repartition(3)
    got = sorted(r.before for r in mixing.running(df, ["g"], ["k", "id"], "v").collect())
    assert got == list(range(0, 1000, 2))


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2


def test_illegal(spark):
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), weights=(1, 0))
