import random
from collections import Counter, defaultdict

import pytest

from gramloom.llm import importance, lexical


@pytest.fixture(scope="module")
def tables(spark, rows):
    docs = [*rows, (None, "of the and größe"), (None, "of the and größe"), (7, "of the and größe"), (901, "THE of " * 60_000), (902, "x" * 150_000)]
    items = [(k % 9, t) for k, (_, t) in enumerate(rows[:25])] + [(None, "of"), (None, "THE the größe"), (50, None), (51, "unheard"), (52, "")]
    return (
        spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, rank int").repartition(5),
        spark.createDataFrame([(i, t, "g") for i, t in items], "item_id long, text string, `group` string").repartition(2),
    )


@pytest.mark.parametrize(("group_bytes", "block_bytes"), [(8 << 20, 4 << 20), (3000, 5000)])
def test_equals_sql(tables, same_as_sql, group_bytes, block_bytes):
    docs, items = tables
    got = lexical.search(docs, items, multiplicity=False, group_bytes=group_bytes, block_bytes=block_bytes).select("item_id", "rank", "doc_id", "score")
    assert same_as_sql(got, lexical.ORACLE_SQL, documents=docs.select("doc_id", "text"), benchmark=items.select("item_id", "text")) > 200


def test_multiplicity_equals_brute_force(spark, tables):
    docs, items = tables
    d = [(r.doc_id, Counter(importance.tokens((r.text or "").encode()))) for r in docs.collect()]
    d = [(i, c) for i, c in d if c]
    n, words, df = len(d), sum(sum(c.values()) for _, c in d), Counter(t for _, c in d for t in c)
    want = defaultdict(list)
    for r in items.collect():
        terms, found = Counter(importance.tokens((r.text or "").encode())), []
        for i, c in d:
            m = 10 + 90 * sum(c.values()) * n // words
            score = sum(f * lexical.term_weight(n, df[t]) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, f in terms.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        for k, (score, none, i) in enumerate(sorted(found)[:4], 1):
            want[r.item_id].append((k, None if none else i, -score))
    got = defaultdict(list)
    for r in lexical.search(docs, items, k=4, block_bytes=9000).collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_bound_keeps_ties(spark):
    """Equal documents in many blocks: the smallest ids win, whatever block they lie in."""
    order = list(range(60))
    random.Random(1).shuffle(order)
    docs = spark.createDataFrame([(i, "same words here") for i in order], "doc_id long, text string").coalesce(1)
    got = lexical.search(docs, spark.createDataFrame([(1, "words same")], "item_id long, text string"), block_bytes=20)
    assert [(r["rank"], r.doc_id) for r in got.orderBy("rank").collect()] == [(k + 1, k) for k in range(10)]


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0
