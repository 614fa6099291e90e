import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gramloom.llm import exchange, pitmanyor, scratch

pytestmark = pytest.mark.usefixtures("few_partitions")


def words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("each", [1 << 23, 4000])
def test_base_and_counts(docs, rows, each):
    got = {r.doc_id: r for r in pitmanyor.score(docs, each, each).collect()}
    learn = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows}
    c = Counter(w for i, t in rows if learn[i] for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w = [*words(t), None]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (not learn[i], len(w), sum(c[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert got[i].score < 0


def test_better_than_unigrams_on_held_out_text(spark):
    scored = pitmanyor.op4_pitmanyor(spark, "/root/testdata/sf0.01").cache()
    held = {r.held_out: r for r in pitmanyor.perplexity(scored).collect()}[True]
    assert held.perplexity < held.base_perplexity


class Plain:
    """The model of a captured seating in plain dictionaries."""

    def __init__(self, model, texts):
        arr = lambda raw, kind: np.frombuffer(raw, dtype=kind).tolist()
        self.m, self.stat, self.seats, self.once = model, {}, {}, Counter()
        for r in model.words.collect():
            opened, kept = (np.array(arr(x, float)).reshape(pitmanyor.SAMPLES, -1) for x in (r.opened, r.kept))
            self.stat |= {x: (c, opened[:, i], kept[:, i]) for i, (x, c) in enumerate(zip(arr(r.x, np.uint64), arr(r.c, np.int64), strict=True))}
        for r in model.pairs.collect():
            self.seats |= {(u, w): c - model.discount * told / pitmanyor.SAMPLES for u, w, c, told in zip(*(arr(x, k) for x, k in ((r.u, np.uint64), (r.w, np.uint64), (r.c, np.int64), (r.told, np.int64))), strict=True)}
        for t in texts:
            self.once.update(self.pairs(t))

    def pairs(self, text):
        _, u, w = pitmanyor.sequence(1, *pitmanyor.tokens([(text or "").encode()]))
        return list(zip(u.tolist(), w.tolist(), strict=True))

    def p(self, u, w):
        m, none = self.m, (0, np.zeros(pitmanyor.SAMPLES), np.zeros(pitmanyor.SAMPLES))
        of_u, of_w = self.stat.get(u, none), self.stat.get(w, none)
        own = self.seats.get((u, w), (1 - m.discount) if self.once[u, w] == 1 else 0)
        total = 0
        for k, (sent, tables) in enumerate(m.totals):
            root = (of_w[2][k] + (pitmanyor.STRENGTH + m.root_discount * tables) / (m.types + 1)) / (pitmanyor.STRENGTH + sent)
            total += (pitmanyor.STRENGTH + m.discount * of_u[1][k]) * root / pitmanyor.SAMPLES
        return (own + total) / (pitmanyor.STRENGTH + (0 if u == int(pitmanyor.END) else of_u[0]))


def captured(monkeypatch, table, *args):
    seen, shelves = {}, pitmanyor.Model.shelves

    def keep(model):
        seen["model"] = model
        model.words, model.pairs = (model.words.sparkSession.createDataFrame(t.collect(), t.schema) for t in (model.words, model.pairs))
        return shelves(model)

    monkeypatch.setattr(pitmanyor.Model, "shelves", keep)
    return seen, {r.doc_id: r for r in pitmanyor.score(table, *args).collect()}


def test_score_equals_plain_arithmetic_and_sums_to_one(docs, rows, monkeypatch):
    seen, got = captured(monkeypatch, docs, 4000, 9000)
    plain = Plain(seen["model"], [t for i, t in rows if not pitmanyor.held_out(i)])
    for i, t in rows:
        assert got[i].score == pytest.approx(sum(math.log10(plain.p(u, w)) for u, w in plain.pairs(t)), rel=1e-9)
    vocabulary = [x for x in plain.stat if x != int(pitmanyor.BEGIN)] + [12345]
    assert len(vocabulary) == seen["model"].types + 1
    for u in [*list(plain.stat)[:40], int(pitmanyor.BEGIN), 777]:
        if u != int(pitmanyor.END):
            assert sum(plain.p(u, w) for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_close_to_a_plain_gibbs_sampler(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{min(int(rng.zipf(1.6)), 40)}" for _ in range(12))) for i in range(300)]
    seen, got = captured(monkeypatch, spark.createDataFrame(texts, "doc_id long, text string"), 2000, 5000)
    m, plain = seen["model"], Plain(seen["model"], [])
    learn = [plain.pairs(t) for i, t in texts if not pitmanyor.held_out(i)]
    rest, draw = {}, np.random.default_rng(1)  # restaurants: dish -> sizes of its tables; the root is None

    def p(u, w):
        seats = rest.get(u, {})
        n, k, mine = sum(map(sum, seats.values())), sum(map(len, seats.values())), seats.get(w, [])
        d, parent = (m.root_discount, 1 / (m.types + 1)) if u is None else (m.discount, p(None, w))
        return (sum(mine) - d * len(mine) + (1 + d * k) * parent) / (1 + n)

    def sit(u, w):
        seats = rest.setdefault(u, {})
        d, parent, k = (m.root_discount, 1 / (m.types + 1), sum(map(len, seats.values()))) if u is None else (m.discount, p(None, w), sum(map(len, seats.values())))
        mine = seats.setdefault(w, [])
        odds = np.array([n - d for n in mine] + [(1 + d * k) * parent])
        at = draw.choice(len(odds), p=odds / odds.sum())
        if at == len(mine):
            mine.append(0)
            if u is not None:
                sit(None, w)
        mine[at] += 1

    def leave(u, w):
        mine = rest[u][w]
        at = draw.choice(len(mine), p=np.array(mine) / sum(mine))
        mine[at] -= 1
        if not mine[at]:
            mine.pop(at)
            if u is not None:
                leave(None, w)

    customers = [x for t in learn for x in t]
    for u, w in customers:
        sit(u, w)
    samples = []
    for _ in range(4):
        for u, w in customers:
            leave(u, w)
            sit(u, w)
        samples.append({x: p(*x) for i, t in texts for x in plain.pairs(t)})
    want = sum(math.log10(np.mean([s[x] for s in samples])) for i, t in texts for x in plain.pairs(t))
    assert sum(r.score for r in got.values()) == pytest.approx(want, rel=0.01)


def test_same_scores_under_any_number_of_partitions(spark, docs):
    def run(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        return sorted((r.doc_id, r.score) for r in pitmanyor.score(docs.repartition(partitions), 4000, 9000).collect())

    try:
        assert run(3) == run(8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def law(c, rest, p, d):
    """Chances of 1 .. c tables, in plain arithmetic: every customer joins a table or opens one at its odds."""
    ways = {0: 1.0}
    for n in range(c):
        more = {}
        for t, x in ways.items():
            more[t + 1] = more.get(t + 1, 0) + x * (pitmanyor.STRENGTH + d * (rest + t)) * p
            if t:
                more[t] = more.get(t, 0) + x * (n - d * t)
        total = sum(more.values())
        ways = {t: x / total for t, x in more.items()}
    return np.array([ways.get(t, 0) for t in range(1, c + 1)])


@pytest.mark.parametrize("c, rest, p, d", [(1, 0, 0.1, 0.5), (2, 3, 0.2, 0.7), (12, 40, 0.05, 0.8), (40, 4, 0.9, 0.5), (200, 9, 0.4, 0.6), (3000, 5000, 0.001, 0.5), (900, 0, 0.0001, 0.8), (3000, 300, 0.05, 0.9)])
def test_tables_follow_the_restaurant_law(c, rest, p, d):
    n = 20_000 if c <= pitmanyor.EXACT else 3000
    t = pitmanyor.seat(np.random.default_rng(c), np.full(n, c), np.full(n, rest), np.full(n, p), d)
    want = law(c, rest, p, d)
    mean = want @ np.arange(1, c + 1)
    assert (t >= 1).all() and (t <= c).all()
    if c <= pitmanyor.EXACT:
        assert abs(np.bincount(t, minlength=c + 1)[1:] / n - want).max() < 0.015
    assert abs(t.mean() - mean) < 0.02 * mean + 0.05


def test_odd_tables(spark):
    assert pitmanyor.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = pitmanyor.score(spark.createDataFrame([(None, "a b"), (None, None), (1, ""), (1, "a")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens) for r in one) == [(0, True, 1), (0, True, 3), (1, False, 1), (1, False, 2)]


def test_rare_words_have_context_restaurants_of_their_own(spark):
    texts = [(i, f"the a{i % 60} b{i % 60} of the b{(i * 7 + 1) % 60}") for i in range(600)]
    got = pitmanyor.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    # b follows a for certain: about a sixth of the tokens gains log10(60) over a model that lumps rare contexts
    assert sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got) > 0.7


def test_messages_of_many_owners(monkeypatch):
    monkeypatch.setattr(exchange, "PIECE", 4096)  # several buffers
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 30_000).astype(np.uint64)
    to = exchange.owner(keys, 20_000)
    order, owners, sizes = exchange.grouped(to)
    table = exchange.cut("owner long, src long, x binary, v binary, none binary", sizes, owner=owners, src=np.arange(len(owners)), x=keys[order], v=np.stack([keys[order]] * 3, axis=1).astype(float))
    assert len(table.column("x").chunks) > 10 and table.column("none").null_count == len(owners) == len(set(to.tolist()))
    assert exchange.joined(table.column("x"), np.uint64).tolist() == keys[order].tolist()
    assert exchange.sizes_of(table.column("x"), np.uint64).tolist() == sizes.tolist()
    part = table.slice(7, 50)
    for o, x, v in zip(part.column("owner").to_pylist(), exchange.arrays(part.column("x"), np.uint64), exchange.arrays(part.column("v"), float), strict=True):
        assert x.tolist() == keys[to == o].tolist() and v.tolist() == np.repeat(x, 3).astype(float).tolist()
    assert exchange.joined(part.column("x"), np.uint64).tolist() == keys[order][sizes[:7].sum() :][: sizes[7:57].sum()].tolist()
    assert exchange.cut("owner long, x binary", np.zeros(0, np.int64), owner=np.zeros(0, np.int64), x=keys[:0]).num_rows == 0


def test_blocks_hold_tokens_read_once(spark, monkeypatch):
    texts, ids = [b"A b a", b"", b"b \n c", b"a"], [3, None, 5, 5]
    where, u, w = pitmanyor.sequence(len(texts), *pitmanyor.tokens(texts))
    row = pitmanyor.tokenised(7, ids, texts)
    batch = pa.RecordBatch.from_pydict({"block": pa.array([7]), "ids": pa.array([ids], pa.list_(pa.int64())), **{n: pa.array([row[n]], k) for n, k in pitmanyor.TOKENS.items()}})
    monkeypatch.setattr(pitmanyor, "tokens", None)  # no step after the first tokenises
    ((block, found, at, x, at_u, at_w),) = pitmanyor._read([batch])
    assert (block, found) == (7, ids)
    assert np.array_equal(at, where) and np.array_equal(x[at_u], u) and np.array_equal(x[at_w], w)
    assert len(np.unique(x)) == len(x) == len({*w.tolist(), int(pitmanyor.END), int(pitmanyor.BEGIN)})


def test_law_at_chosen_places():
    c, rest, p = np.array([60, 900, 5000]), np.array([5, 70, 900]), np.array([1e-2, 1e-4, 1e-5])
    law, t = pitmanyor._Wide(0.7, c, rest, p), np.array([[1.0, 3, 59]] * 3) * np.array([[1], [4], [20]])
    whole, some = law(t), np.array([[True, False, True], [False, False, False], [True, True, True]])
    assert np.array_equal(law(t, some), np.where(some, whole, -np.inf)) and np.isfinite(whole).all()


def test_sweeps_after_the_first_send_counts_alone(docs, monkeypatch):
    seen, write = [], pitmanyor.materialize

    def keep(df, name, **options):
        table = write(df, name, **options)
        if name in ("seated", "rooted"):
            seen.append((name, table.where("src is not null").toArrow(), sum("/gramloom-pairs-" in x or "/gramloom-words-" in x for x in scratch._written)))
        return table

    monkeypatch.setattr(pitmanyor, "materialize", keep)
    before = sum("/gramloom-pairs-" in x or "/gramloom-words-" in x for x in scratch._written)
    pitmanyor.score(docs, 4000, 9000).count()
    told, answered = ([(rows, counted) for name, rows, counted in seen if name == kind] for kind in ("seated", "rooted"))
    assert len(told) == len(answered) == pitmanyor.BURN_IN + pitmanyor.SAMPLES
    asked = told[0][0].column("n").to_numpy().sum()
    assert exchange.joined(told[0][0].column("x"), np.uint64).size == asked > 0
    for rows, counted in told[1:]:
        assert rows.column("x").null_count == len(rows) and counted == before  # the counted tables are gone
        assert exchange.sizes_of(rows.column("less_u"), np.uint8).sum() == exchange.sizes_of(rows.column("less_w"), np.uint8).sum() == 4 * asked
    assert [len(rows) > 0 for rows, _ in answered] == [True] * (len(answered) - 1) + [False]  # nobody reads the last


def test_counts_in_few_bytes():
    for counts in ([], [0, 0], [1, 255], [0, 256, 65_535], [7, 1 << 31], [3, (1 << 40) + 5]):
        a = np.array(counts, np.int64)
        assert exchange.widened(np.frombuffer(exchange.narrow(a).tobytes(), np.uint8), len(a)).tolist() == counts
    assert exchange.widened(np.zeros(0, np.uint8), 3).tolist() == [0, 0, 0]
    few, far = np.array([1, 2, 3]), np.array([4, 1 << 33])  # two senders, one of counts beyond 4 bytes
    column = pa.chunked_array([pa.array([exchange.narrow(a, 4).tobytes() for a in part], pa.binary()) for part in ([few], [far, few])])
    assert exchange.counts_of(column, np.array([3, 2, 3])).tolist() == [1, 2, 3, 4, 1 << 33, 1, 2, 3]
    assert exchange.counts_of(column.slice(0, 1), np.array([3])).tolist() == [1, 2, 3]
    table = exchange.cut("owner long, known binary, value binary", np.array([2, 3]), {"value": np.array([0, 2])}, owner=np.array([5, 6]), known=np.array([0, 0, 1, 0, 1], np.uint8), value=np.array([0.5, 1.5]))
    assert [x.tolist() for x in exchange.arrays(table.column("value"), float)] == [[], [0.5, 1.5]]


@pytest.mark.parametrize("owners", [1, 7, 3750])
def test_keys_in_order_are_in_order_of_owner(owners):
    keys = np.sort(np.random.default_rng(2).integers(0, 1 << 64, 20_000, dtype=np.uint64))
    keys = np.concatenate([keys, [np.uint64((1 << 64) - 1)]])
    of = exchange.range_owner(keys, owners)
    to, sizes = exchange.shares(keys, owners)
    assert (np.diff(of) >= 0).all() and of.min() >= 0 and of.max() == owners - 1
    assert np.repeat(to, sizes).tolist() == of.tolist() and sizes.max() < 3 * len(keys) / owners + 20
