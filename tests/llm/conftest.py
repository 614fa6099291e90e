import random

import pytest


def corpus(seed: int = 7, n: int = 60) -> list[tuple]:
    """Small texts with copies, near copies, shared passages, repeats, empties, nulls and one long text."""
    rng = random.Random(seed)
    lexicon = ["of", "the", "and", "été", "größe", "niño", "x"] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda k: [rng.choice(lexicon) for _ in range(k)]
    passage, common = say(70), say(24)
    rows = []
    for i in range(n):
        w = say(rng.randint(0, 160))
        kind = i % 10
        if kind == 1:
            at = rng.randint(0, len(w))
            w = w[:at] + passage + w[at:]
        elif kind == 2:
            w = w + common
        elif kind == 3 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "").split()
        elif kind == 4 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "").split()
            if w:
                w[rng.randrange(len(w))] = "EDIT"
        elif kind == 5:
            w = w[:30] + ["Of"] * 90 + w[30:]
        elif kind == 6:
            w = w + w[:50]
        text = "".join(x + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w)
        rows.append((i, text))
    rows += [(n, ""), (n + 1, None), (n + 2, "  \n "), (n + 3, "a"), (n + 4, " ".join(say(9000))), (n + 5, "zz" * 3000), (n + 6, "zz" * 3000)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, component_id string").repartition(5).cache()


@pytest.fixture(scope="session")
def same_as_sql():
    """Compare a query's rows with DuckDB SQL over views, as multisets."""
    import duckdb

    def compare(df, sql, **tables):
        con = duckdb.connect()
        for name, t in tables.items():
            con.register(name, t.toArrow())
        want = con.execute(sql).to_arrow_table()
        got = df.toArrow()
        assert sorted(got.column_names) == sorted(want.column_names)
        names = sorted(got.column_names)
        key = lambda r: tuple((r[c] is None, str(r[c])) for c in names)
        a, b = sorted(got.to_pylist(), key=key), sorted(want.to_pylist(), key=key)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == y
        return len(a)

    return compare


@pytest.fixture
def few_partitions(spark):
    """For operators of many small jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
