import hashlib

import pytest

from gramloom.llm import ranges, seedextend


def brute(rows, w=20):
    first, words = {}, {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for s in range(len(words[i]) - w + 1):
            first.setdefault(tuple(words[i][s : s + w]), (i, s))
    out = {}
    for i, x in words.items():
        gone = set()
        for s in range(len(x) - w + 1):
            if first[tuple(x[s : s + w])] < (i, s):
                gone |= set(range(s, s + w))
        out[i] = (len(x), len(gone), hashlib.sha256(b" ".join(v for k, v in enumerate(x) if k not in gone)).hexdigest())
    return out


def test_against_brute_force(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in seedextend.drop_repeats(docs).collect()}
    want = brute(rows)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 500


def test_full_bitmaps_change_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(seedextend, "BITS", 10)
    monkeypatch.setattr(ranges, "DOC_BITS", 9)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in seedextend.drop_repeats(docs).collect()}
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    assert seedextend.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (5, t), (9, t)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in seedextend.drop_repeats(df).collect()) == [(0, 0), (5, 0), (9, 30)]


def test_windows_of_a_seed_are_compared_by_their_whole_hash(spark, monkeypatch):
    real, window = seedextend.kgrams, seedextend.WINDOW

    def alike(h, n):
        """Window hashes that differ in their lowest 24 bits only."""
        return real(h, n) if n != window else real(h, n) & type(real(h, n)[0])(0xFFFFFF)

    monkeypatch.setattr(seedextend, "kgrams", alike)
    phrase = [f"p{k}" for k in range(8)]
    rows = [(i, " ".join([f"l{i}x{k}" for k in range(12)] + phrase + [f"r{i}x{k}" for k in range(12)])) for i in range(6)]
    rows.append((6, rows[2][1] + " more"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in seedextend.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("spans", [1 << 20, 4])
def test_hot_seed_and_hot_window(spark, monkeypatch, spans):
    """One phrase in every text among surroundings of its own, and one 20-word passage in half of them."""
    monkeypatch.setattr(seedextend, "SPANS", spans)
    phrase, passage = [f"p{k}" for k in range(8)], [f"q{k}" for k in range(22)]
    own = lambda i, side, n: [f"{side}{i}x{k}" for k in range(n)]
    rows = [(i, " ".join(own(i, "l", 12) + phrase + own(i, "r", 12) + (passage + own(i, "t", 5) if i % 2 else []) + (own(i - 1, "l", 12) + phrase if i % 7 == 6 else []))) for i in range(60)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in seedextend.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    want = brute(rows)
    assert got == want
    assert sum(v[1] > 0 for v in want.values()) > 30


def test_repeated_ids_long_texts_and_clashing_columns(spark):
    a, b, long = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 30), ("b", 30), ("c", 60_000)))
    rows = [(1, a, "x", 0), (1, b, "x", 0), (2, a, None, 1), (3, long, "y", 2), (4, b + " " + long, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, start int")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in seedextend.drop_repeats(df).collect()) == [(1, 30, 0), (1, 30, 0), (2, 30, 30), (3, 60_000, 0), (4, 60_030, 60_030)]
