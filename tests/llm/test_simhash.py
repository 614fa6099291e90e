import random

import pytest
import xxhash

from pyspark.sql import functions as F

from gramloom.llm import simhash


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: {id: fp}; smallest id reachable through links of at most 3 bits."""
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i], changed = label[j], True
    return label


def test_against_brute_force(docs, rows):
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fp(t) for i, t in rows}
    label = brute_components(fps)
    assert got == {i: (fps[i], label[i]) for i in fps}


@pytest.mark.parametrize("wide", [None, 0, 2, 5])
@pytest.mark.parametrize("radius", [1, 3])
def test_close_pairs_lose_none(spark, wide, radius):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base:
        for _ in range(20):
            x = b
            for k in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << k
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = [(r.fp_a, r.fp_b) for r in simhash.close_pairs(df, radius, wide).collect()]
    got = set(found)
    assert len(found) == len(got)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= radius}
    assert got == want


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(df).collect()) == [(0, 0), (1, 1), (2, 1), (2, 1)]


def test_similar_pairs_in_parts(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(words[2 * k : 2 * k + 40])) for k in range(11)]
    docs = spark.createDataFrame(texts, "row long, text string")
    pairs = docs.select(F.col("row").alias("a")).crossJoin(docs.select(F.col("row").alias("b"))).where("a < b").cache()
    whole = sorted(simhash._similar(pairs, docs, 5, 8).collect())
    monkeypatch.setattr(simhash, "PART_TEXTS", 1)
    written, keep = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name, **k: written.append(name) or keep(df, name, **k))
    assert sorted(simhash._similar(pairs, docs, 5, 8).collect()) == whole and len(whole) == 10 + 9  # moved by two or four words
    assert written.count("similar") == simhash.COMPARED_PARTS
