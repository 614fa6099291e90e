import hashlib
import math
import random
import re
import zlib

import pytest

from gramloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, bench, grams=1, buckets=10_000, least=20, percent=10):
    """Rows by the definition, one text at a time, one sort over all."""

    def feats(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(low)
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, grams + 1) for k in range(len(w) - n + 1)]

    own, target = [(i, *feats(t)) for i, t in docs], [f for t in bench for f in feats(t)[1]]
    s, t = [0] * buckets, [0] * buckets
    for _, _, f in own:
        for b in f:
            s[b] += 1
    for b in target:
        t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + float(buckets)) / ((a + 1.0) * (sum(t) + float(buckets))))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(str, (tuple(r[:5]) for r in rows)))


ODD = [(None, None), (None, "a b c " * 20), (None, "Of THE and"), (7, "é É ß " * 9), (7, "é É ß " * 9), (7, "x" * 200_000), (901, "lone of " * 60_000)]


@pytest.fixture(scope="module")
def tables(spark, rows):
    told = [*rows, *ODD]
    bench = [t for _, t in rows[::5]] + [None, ""]
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in told], "doc_id long, text string, score int, row string").repartition(4)
    return told, bench, docs, spark.createDataFrame([(t,) for t in bench], "text string")


@pytest.mark.parametrize(("grams", "buckets", "percent", "range_rows"), [(1, 10_000, 10, 1 << 19), (1, 10_000, 35, 9), (2, 97, 100, 5), (1, 10_000, 0, 5)])
def test_equals_brute_force(tables, grams, buckets, percent, range_rows):
    told, bench, docs, target = tables
    got = importance.resample(docs, target, grams, buckets, percent=percent, range_rows=range_rows).collect()
    assert sorted(map(str, map(tuple, got))) == brute(told, bench, grams, buckets, percent=percent)


def test_whole_table_equals_brute_force(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    docs, bench = [(r.doc_id, r.text) for r in read("documents").select("doc_id", "text").collect()], [r.text for r in read("benchmark").collect()]
    assert sorted(map(str, map(tuple, importance.op12_importance(spark, "/root/testdata/sf0.01").collect()))) == brute(docs, bench)


def test_merge_of_many_small_runs(spark):
    """Runs of 16 rows in blocks of 3, many equal scores: the merge is the sorted order, up to the exact count."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(90)]), rng.randrange(3), 5, rng.randrange(40), k) for k in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, row long").repartition(3)
    runs = importance.runs(table, [30, 10], 16, 3)
    assert max(r.n for r in runs.collect()) <= 3 and runs.select("range").distinct().count() == 3
    sizes, starts, before = {r.range: r.n for r in runs.groupBy("range").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}, {}, 0
    for k in sorted(sizes):
        starts[k], before = before, before + sizes[k]
    got = [tuple(r) for r in importance.merged(runs, starts, 555).orderBy("rank").collect()]
    want = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[4]))[:555]
    assert got == [(*r, k) for k, r in enumerate(want, 1)]


def test_tournament():
    tree, rng = importance.Tournament(), random.Random(5)
    blocks = [sorted((rng.randrange(99), k) for _ in range(rng.randint(1, 6))) for k in range(13)]
    for b in blocks:
        tree.add(b)
    got = []
    while tree.least() is not None:
        got.append(tree.pop())
    assert got == sorted(x for b in blocks for x in b)


def test_empty(spark):
    docs, texts = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")
    assert importance.resample(docs, texts).count() == 0
    assert [tuple(r) for r in importance.resample(spark.createDataFrame([(1, "")], "doc_id long, text string"), texts.limit(0)).collect()][0][:3] == (1, 0, 0)
