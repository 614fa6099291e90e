import random
import re

import pytest

from gramloom.llm import winnowing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, bench):
    windows = {}
    for i, t in bench:
        w = split(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(i))
    out = {}
    for d, t in rows:
        w, hit, items = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    items |= found
        out[d] = (len(w), len(hit), sorted(items))
    return out


@pytest.fixture(scope="module")
def bench(rows):
    rng = random.Random(1)
    texts = [" ".join(split(t)[a : a + n]) for _, t in rows for a, n in [(rng.randint(0, 40), rng.choice([3, 9, 10, 11, 25]))] if rng.random() < 0.4]
    return [(i, t and t.upper()) for i, t in enumerate([*texts, "", None, texts[0], "quite unknown words"])]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_against_brute_force(spark, docs, rows, bench, bound):
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in winnowing.contamination(docs, b, bound).collect()}
    want = brute(rows, bench)
    assert got == want
    assert sum(v[1] > 0 for v in want.values()) > 10


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnowing.contamination(docs, none).where("n_hit > 0").count() == 0
    assert winnowing.contamination(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_hot_grams_nulls_repeats_and_long_texts(spark, bound):
    """One five-word gram in most items and texts, null ids, a repeated row, a long text, columns with clashing names."""
    gram = "the same five words here"
    items = [(f"i{k}", " ".join([f"a{k}x{j}" for j in range(7)]) + f" {gram} " + " ".join(f"b{k}x{j}" for j in range(7))) for k in range(40)]
    items += [(None, "null ids match nothing " + gram), ("short", "Two WORDS"), ("short", "Two WORDS")]
    texts = [f"{gram} then {k} " + (items[k][1] if k % 4 == 0 else " ".join(f"z{k}y{j}" for j in range(20))) for k in range(40)]
    long = " ".join(f"w{k}" for k in range(50_000))
    rows = [*enumerate(texts), (None, texts[4]), (4, texts[4]), (50, long + " " + items[9][1] + " two words " + long), (51, None), (52, "--- !")]
    df = spark.createDataFrame([(i, t, "r", 1, [0]) for i, t in rows], "doc_id long, text string, row string, window int, items array<int>")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, seed int")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r["items"]) for r in winnowing.contamination(df, bench, bound).collect()), key=str)
    known = [(i, t) for i, t in items if i is not None]
    want = sorted(((i is None, i, *brute([(i, t)], known)[i]) for i, t in rows), key=str)
    assert got == want
    assert sum(v[3] > 0 for v in got) == 13


def test_carried_columns_both_ways(spark):
    text = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(1, text, "a", {"k": 1.5}), (None, None, None, None)], "doc_id long, text string, row string, items map<string,double>")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    both = [[(r.doc_id, r.n_hit, r.text, r.row) for r in winnowing.contamination(df.drop("items"), bench, bound, ("text", "row")).orderBy("doc_id").collect()] for bound in (1_000_000, 0)]
    assert both[0] == both[1] == [(None, 0, None, None), (1, 12, text, "a")]
