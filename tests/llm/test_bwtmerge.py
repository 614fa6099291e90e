import hashlib
import pathlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gramloom.llm import bwtmerge, exchange, textscan

pytestmark = pytest.mark.usefixtures("few_partitions")


def brute(rows, n=400):
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - n + 1):
            seen.setdefault(b[s : s + n], []).append((i, s))
    gone = {i: bytearray(len((t or "").encode())) for i, t in rows}
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + n] = b"\x01" * n
    out = {}
    for i, t in rows:
        b, g = (t or "").encode(), gone[i]
        runs = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        out[i] = (len(b), sum(g), runs, hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest())
    return out


def texts(seed):
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdefghij é") for _ in range(k))
    base, short = noise(1500), noise(401)
    out = [base, base, noise(300), noise(399) * 2, base[:700] + "X" + base[701:], noise(200) + base[100:900] + noise(500), noise(90) + short, short + noise(80), noise(10) + short + noise(10)]
    out += ["Of " * 400, "a" * 900, "ab" * 450 + noise(50), "- " * 210, noise(33) + "Of " * 300, None, "", base[200:], base[:650], base[350:1000] + base[300:960]]
    for _ in range(12):
        at = rng.randint(0, 900)
        t = noise(rng.randint(0, 60)) + base[at : at + rng.randint(380, 600)] + noise(rng.randint(0, 60))
        k = rng.randint(0, len(t) - 1)
        out.append(t[:k] + rng.choice(["", "Z", "é"]) + t[k + rng.randint(0, 1) :])
    return [(7 * i, t) for i, t in enumerate(out)]


def run(spark, rows, parts, *sizes):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwtmerge.drop_repeats(df, *sizes).collect()}


@pytest.mark.parametrize("seed,block,each", [(1, 1 << 22, 1 << 23), (2, 3000, 2000), (3, 1, 5000), (4, 9000, 1 << 20)])
def test_against_brute_force(spark, seed, block, each):
    rows = texts(seed)
    assert run(spark, rows, 3 + seed, block, each) == brute(rows)


def test_corpus(spark, rows):
    assert run(spark, rows, 6) == brute(rows)


@pytest.mark.parametrize("column,value", [("place", 0), ("size", 1)])
def test_the_interleave_decides(spark, column, value, monkeypatch):
    """Without the places, or the sizes, that passes give to intervals the result is another."""
    placed = bwtmerge.placed

    def broken(key, asks):
        t = placed(key, asks)
        flat = pa.array([np.full(len(x.as_py()) // 8, value, np.int64).tobytes() for x in t.column(column)], pa.binary())
        return t.set_column(t.schema.get_field_index(column), column, flat)

    rng = random.Random(6)
    parts = ["".join(rng.choice("abcdefghij ") for _ in range(130)) for _ in range(24)]
    rows = texts(1) + [(1000 + i, "".join(rng.sample(parts, 24))) for i in range(60)]  # the same phrases in other orders
    want = brute(rows)
    assert run(spark, rows, 3, 3000, 2000) == want
    monkeypatch.setattr(bwtmerge, "placed", broken)
    assert run(spark, rows, 3, 3000, 2000) != want


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(3)
    symbol, text = rng.integers(0, 3, 200).astype(np.uint64), np.sort(rng.integers(0, 9, 200))
    suffix = lambda i: symbol[i:][text[i:] == text[i]].tolist()
    order = bwtmerge.suffix_order(symbol, text)
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(200))


def test_long_text_clashing_columns_and_repeated_rows(spark):
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60_000))
    rows = [(1, long), (2, "x" + long[1000:1500]), (3, "y" * 399), (4, long[:350] + "Q"), (4, long[:350] + "Q"), (6, "once " + long[5000:5399])]
    df = spark.createDataFrame([(i, t, 1, "s", t) for i, t in rows], "doc_id int, text string, n_bytes int, start string, block string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in bwtmerge.drop_repeats(df, 100_000, 50_000).collect())
    assert got == [(1, len(long), 500, 1), (2, 501, 500, 1), (3, 399, 0, 0), (4, 351, 0, 0), (4, 351, 0, 0), (6, 404, 0, 0)]
    shared = {r.doc_id: r.shared_bytes for r in bwtmerge.drop_repeats(df).where(F.col("doc_id").isin(2, 3)).collect()}
    assert 300 < shared[2] <= 500 and shared[3] == 0


def test_empty_and_null_ids(spark):
    assert bwtmerge.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "ab c" * 200), (5, "xyz " * 30), (9, "xyz " * 30)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in bwtmerge.drop_repeats(df).collect()) == [(0, 0), (5, 0), (9, 0)]


@pytest.mark.parametrize("size", [0, 300, 399, 400, 401, 431, 432, 5000])
def test_segments_change_no_parse(monkeypatch, size):
    rng = np.random.default_rng(size)
    raw = [rng.integers(97, 105, k, dtype=np.uint8).tobytes() for k in (size, 0, 37, size // 2, 1200)] + [b"ab" * size]
    whole = bwtmerge.Parse(raw)
    monkeypatch.setattr(bwtmerge, "SEGMENT", 101)
    for name, found in vars(bwtmerge.Parse(raw)).items():
        assert np.array_equal(found, vars(whole)[name]), name


def test_covered_bytes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50):
        for many in (0, 1, 4, 30):
            start = rng.integers(0, n + 1, many if n else 0)
            stop = np.minimum(n, start + rng.integers(1, 9, len(start)))
            start = np.minimum(start, stop - 1)
            want = [any(a <= k < b for a, b in zip(start, stop, strict=True)) for k in range(n)]
            assert bwtmerge.covered(start, stop, n).tolist() == want


def test_memory_of_a_block():
    raw = [np.random.default_rng(1).integers(97, 123, 1 << 16, dtype=np.uint8).tobytes()] * 48
    textscan._powers.clear()
    tracemalloc.start()
    p = bwtmerge.Parse(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(p.raw)  # 54 before, and powers of 16 bytes a byte stayed in the worker
    assert sum(x.nbytes for x in textscan._powers.values()) < 10 << 20


def test_row_groups_of_a_task_with_many_blocks(spark, monkeypatch):
    """What one task writes is cut by bytes; it was one row group up to 100 rows (blocks) or 128 MB (shards), held whole by writer and reader."""
    rng, groups = np.random.default_rng(2), {}

    def sizes(table, name, **options):
        t = materialize(table, name, **options)
        files = [pq.ParquetFile(f).metadata for f in pathlib.Path(t.written_to.removeprefix("file://")).glob("*.parquet")]
        written = [sum(m.row_group(k).column(c).total_compressed_size for c in range(m.num_columns)) for m in files for k in range(m.num_row_groups)]
        groups[name] = max([groups.get(name, 0), *written])
        return t

    materialize = exchange.materialize
    monkeypatch.setattr(exchange, "materialize", sizes)
    monkeypatch.setattr(bwtmerge, "materialize", sizes)
    raw = [rng.integers(48, 112, 1 << 20, dtype=np.uint8).tobytes().decode() for _ in range(48)]
    texts = exchange.blocks(spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string").coalesce(1), 1 << 20)
    assert [t.decode() for _, _, found in exchange.unpacked(texts.orderBy("block").toArrow().to_batches()) for t in found] == raw
    bwtmerge.merge(texts.coalesce(1), exchange.owners_of(texts))
    assert all(n < exchange.ROW_GROUP + (1 << 20) for n in groups.values()), groups
