"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are lower-cased words and one end per text.  The model is

* a context restaurant for each preceding word (or the beginning of a text),
  over words: every observed (context, word) pair has its seats;
* one root restaurant over words, the parent all contexts share: it seats one
  customer for each table of theirs;
* its base, uniform over the training types and one unseen type.

Predictive probabilities are averaged over ``SAMPLES`` seating samples after a
burn-in.  A context that training never met has no customers and gives the
root's probability.  Discounts follow from the counts of counts, n1 / (n1 + 2 n2),
of pairs and of words.

Seating is sampled by Gibbs over numbers of tables: a dish's tables are drawn
given all other tables of its restaurant and its parent's probability, which is
one block of its customers' seats.  Restaurants sample in parallel against
their parent's last state and the other dishes' last tables; the root, whose
customers are the tables they sent, then moves in the same way.  A pair met once
always has one table, so a context's tables and a word's customers at the root
are its count less what its repeated pairs save: only pairs met twice are kept.

Form.  Texts lie in written blocks.  Words and repeated pairs belong to owners
by hash (see ``exchange``): an owner holds arrays of its own keys, sized by the
input, so no table of words, contexts or pairs is broadcast, and a frequent word
or context is one entry per block or owner.  Counting runs over ``ROUNDS`` ranges of owners,
scoring over ``PARTS`` of the blocks, one after the other: constants that bound
the disk in use, not the work.  In a sweep, owners of pairs tell owners of words
what their pairs save, owners of words seat the root and answer with tables and
probabilities.  To score, blocks ask owners for their distinct words and pairs.

Random numbers are seeded by owner and sweep, and owners depend on the input
alone, so scores do not depend on partitions or executors.

Defined results: null text is the empty text, one end token; a null doc_id is
held out; repeated rows count each time; texts of any length are one row of one
block; extra columns are ignored.  Words and pairs are told apart by 64-bit
hashes.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import BLOCK_BYTES, OWNER_BYTES, arrays, blocks, counts_of, cut, joined, narrow, owners_of, packed, range_owner, shares, sizes_of, widened
from .scratch import discard, materialize, spread
from .textscan import NOT_SPACE, R, U, mix, words

SAMPLES = 3
BURN_IN = 2
STRENGTH = 1.0
ADDED = 0.1
ROUNDS, PARTS = 2, 4
SEED = 20240607
END, BEGIN = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of all words, without ends."""
    start, _, h = words(b"\n".join(t.lower() for t in texts), NOT_SPACE)
    edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, edge))), h


def sequence(n_texts: int, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word before, word) of every token, ends included, in order of text."""
    size = np.bincount(doc, minlength=n_texts)
    stop = np.cumsum(size + 1) - 1
    word = np.full(len(h) + n_texts, END)
    inner = np.ones(len(word), dtype=bool)
    inner[stop] = False
    word[inner] = h
    before = np.concatenate([[BEGIN], word[:-1]])[: len(word)]
    before[stop - size] = BEGIN
    return np.repeat(np.arange(n_texts), size + 1), before, word


def pair_code(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before) * R + word)


def _heads(s: np.ndarray) -> np.ndarray:
    """Places where a sorted array starts a new value."""
    return np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def _summed(codes: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place of a first holder, sums of each count) by distinct code, in order of code."""
    order = np.argsort(codes)
    head = _heads(codes[order])
    return order[head], *(np.add.reduceat(c[order], head) if len(head) else c[:0] for c in counts)


def tokenised(block: int, ids: list, texts: list[bytes]) -> dict:
    """A block's texts as tokens, read once for all steps: its distinct words, END and BEGIN among them, and the place of each token's."""
    where, _, w = sequence(len(texts), *tokens(texts))
    x, at = np.unique(np.append(w, [END, BEGIN]), return_inverse=True)
    return {"tokens": np.bincount(where, minlength=len(texts)).tolist(), "x": x.tobytes(), "at": at[:-2].astype(np.int32).tobytes()}


TOKENS = {"tokens": pa.list_(pa.int64()), "x": pa.binary(), "at": pa.binary()}


def _read(batches):
    """(block, ids, text index, distinct words, place of the word before, place of the word) of every block; text ends with END, and BEGIN comes before."""
    for batch in batches:
        for block, ids, sizes, x, at in zip(*(batch.column(c) for c in ("block", "ids", "tokens", "x", "at")), strict=True):
            x, at_w = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(at.as_buffer(), np.int32)
            sizes = sizes.values.to_numpy(zero_copy_only=False)
            at_u = np.concatenate([at_w[:1], at_w[:-1]])
            at_u[np.cumsum(sizes) - sizes] = np.searchsorted(x, BEGIN)
            yield block.as_py(), ids.as_py(), np.repeat(np.arange(len(sizes)), sizes), x, at_u, at_w


def _send(schema: str, keys: np.ndarray, owners: int, **columns: np.ndarray):
    """Messages to the owners of ``keys``, which are in order, as their columns are."""
    to, sizes = shares(keys, owners)
    return cut(schema, sizes, owner=to, n=sizes, **columns).to_batches()


def _learns(ids: list) -> np.ndarray:
    return np.array([not held_out(i) for i in ids], dtype=np.int64)


WORDS = "owner long, x binary, c binary, opened binary, kept binary, t binary"
PAIRS = "owner long, u binary, w binary, c binary, t binary, told binary"
PLACED = "owner long, x binary, u binary, w binary, c binary, t binary, told binary"
_TOTALS = ", n long, types long, once long, twice long"


def _word_owners(texts: DataFrame, owners: int) -> DataFrame:
    """``WORDS`` and totals: every training word, and the beginning of texts, with its count."""
    sent = "owner long, n long, x binary, c binary"

    def run(batches):
        for _, ids, where, x, at_u, at_w in _read(batches):
            learn = _learns(ids)
            c = np.bincount(at_w[learn[where] > 0], minlength=len(x))
            c[x == BEGIN] = learn.sum()
            x, c = x[c > 0], c[c > 0]
            yield from _send(sent, x, owners, x=x, c=narrow(c, 4))

    def own(key, table):
        x = joined(table.column("x"), np.uint64)
        first, c = _summed(x, counts_of(table.column("c"), table.column("n").to_numpy()))
        x = x[first]
        real = c[x != BEGIN]
        none = np.zeros(0)
        return packed(WORDS + _TOTALS, [{"owner": key[0].as_py(), "x": x, "c": c, "opened": none, "kept": none, "t": none, "n": int(real.sum()), "types": len(real), "once": int((real == 1).sum()), "twice": int((real == 2).sum())}])

    return materialize(texts.mapInArrow(run, sent).groupBy("owner").applyInArrow(own, WORDS + _TOTALS), "words")


def _pair_owners(texts: DataFrame, owners: int, turn: int) -> DataFrame:
    """``PLACED`` and totals for the owners of one round: training pairs met twice, held-out texts included."""
    sent = "owner long, n long, u binary, w binary, c binary"

    def run(batches):
        for _, ids, where, x, at_u, at_w in _read(batches):
            code = pair_code(x[at_u], x[at_w])
            mine = range_owner(code, owners) % ROUNDS == turn
            code, learn = code[mine], _learns(ids)[where[mine]]
            first, c, n = _summed(code, learn, np.ones_like(learn))
            u, w = x[at_u[mine][first]], x[at_w[mine][first]]
            yield from _send(sent, code[first], owners, u=u, w=w, c=narrow(c * 2 + (n > c), 4))

    def own(key, table):
        u, w, c = joined(table.column("u"), np.uint64), joined(table.column("w"), np.uint64), counts_of(table.column("c"), table.column("n").to_numpy())
        first, c, held = _summed(pair_code(u, w), c >> 1, c & 1)
        kept = (c > 0) & (c + held > 1)
        x, at = np.unique(np.concatenate([u[first[kept]], w[first[kept]]]), return_inverse=True)
        at_u, at_w = np.split(at.astype(np.uint32), 2)
        return packed(PLACED + _TOTALS, [{"owner": key[0].as_py(), "x": x, "u": at_u, "w": at_w, "c": narrow(c[kept]), "once": int((c == 1).sum()), "twice": int((c == 2).sum())}])

    return materialize(texts.mapInArrow(run, sent).groupBy("owner").applyInArrow(own, PLACED + _TOTALS), "pairs")


EXACT, NEAR, GRID, POINTS, DEPTH, TERMS = 48, 8, 12, 64, 14.0, 32


def log_ways(n: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: weights of c customers at t tables, for c and t up to n."""
    found = np.full((n + 1, n + 1), -np.inf)
    found[0, 0] = 0
    t = np.arange(n + 1)
    for c in range(n):
        with np.errstate(divide="ignore"):
            found[c + 1] = np.logaddexp(np.append(-np.inf, found[c, :-1]), found[c] + np.log(np.maximum(c - discount * t, 0)))
    return found


def _one_of(rng, weight: np.ndarray) -> np.ndarray:
    """A column of each row, drawn by the logarithms of its weights."""
    up_to = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
    return (up_to[:, :-1] <= rng.random((len(weight), 1)) * up_to[:, -1:]).sum(axis=1)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for x of 1 or more; wrong by less than 0.001."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)


class _Wide:
    """The law of the tables of dishes with more than ``EXACT`` customers, up to a factor.

    The weight of c customers at t tables is c! / (discount^t t!) times the
    coefficient of z^c in (1 - (1 - z)^discount)^t.  Where t is below about
    c^discount, one table holds most customers, and the binomial series of the
    power is summed; above, the coefficient is taken at its saddle point, which
    depends on c / t alone.  With z = 1 - exp(-s).  A place pays for the one of
    the two that it takes, and what depends on c alone is computed once.
    """

    def __init__(self, discount: float, c: np.ndarray, rest: np.ndarray, p: np.ndarray):
        self.d, self.log_s = discount, np.linspace(np.log(1e-8), np.log(200.0), 1 << 14)
        self.log_r = self.at(np.exp(self.log_s))[2]
        self.c, self.log_p, self.a = c.astype(float), np.log(p), (STRENGTH + discount * rest.astype(float)) / discount
        self.log_c = np.log(self.c)
        x, lg_c = discount * np.arange(1, TERMS + 1)[:, None], _lgamma(self.c)
        sign = np.where(np.arange(1, TERMS + 1) % 2, 1, -1)[:, None]
        self.terms = sign * np.sin(np.pi * x) / np.pi * np.exp(_lgamma(1 + x) + _lgamma(self.c - x) - lg_c)

    def at(self, s):
        """log z, log of the base of the power, log of the ratio c / t that has its saddle here, and the curvature over t."""
        d, z, f = self.d, -np.expm1(-s), -np.expm1(-self.d * s)
        log_r = np.log(z) + np.log(d) + (1 - d) * s - np.log(f)
        return np.log(z), np.log(f), log_r, np.exp(log_r) * (1 + z * np.exp(s) * ((1 - d) - d * np.exp(-d * s) / f))

    def __call__(self, t, where=None):
        """The law at the places ``t``, a row of them for each dish; beyond ``where`` there is none."""
        out = np.full(t.shape, -np.inf)
        dish, at = np.nonzero(np.ones(t.shape, bool) if where is None else where)
        t = t[dish, at]
        few = np.log(t) - self.d * self.log_c[dish] + self.d * np.log(self.d) < 0
        ways = np.empty(len(t))
        ways[few] = self.series(t[few], dish[few])
        ways[~few] = self.saddle(t[~few], self.c[dish[~few]])
        out[dish, at] = ways + t * self.log_p[dish] + _lgamma(self.a[dish] + t) - _lgamma(t + 1.0)
        return out

    def saddle(self, t, c):
        log_z, log_f, _, bend = self.at(np.exp(np.interp(np.log(c / t), self.log_r, self.log_s)))
        return t * log_f - c * log_z - 0.5 * np.log(2 * np.pi * t * np.maximum(bend, 1e-12))

    def series(self, t, dish):
        """Term j has t over j; summed from the last, each takes its factor (t - j + 1) / j of what follows."""
        total, left = np.zeros(len(t)), t - TERMS
        for j in range(TERMS, 0, -1):
            left += 1
            total += self.terms[j - 1][dish]
            total *= left
            total *= 1 / j
        return np.log(np.maximum(total, 1e-300)) - self.log_c[dish]


def _of_many(rng, c: np.ndarray, rest: np.ndarray, p: np.ndarray, discount: float) -> np.ndarray:
    """Tables drawn from the law of ``_Wide`` by ``POINTS`` cells between the places where it has fallen by exp(-DEPTH)."""
    law, most = _Wide(discount, c, rest, p), c - 1
    low, high = np.ones(len(c)), most.astype(float)
    for _ in range(4):  # the mode, between neighbours of the best point of ever finer grids
        grid = low[:, None] * (high / low)[:, None] ** np.linspace(0, 1, GRID)
        best = np.argmax(law(grid), axis=1)
        low, high = (np.take_along_axis(grid, np.clip(best + side, 0, GRID - 1)[:, None], 1)[:, 0] for side in (-1, 1))
    mode = np.clip(np.rint((low + high) / 2), 1, most)
    floor = law(mode[:, None])[:, 0] - DEPTH

    def edge(inside, outside):
        """The last place towards ``outside`` where the law is above the floor."""
        for _ in range(64):
            middle = np.rint((inside + outside) / 2)
            above = law(middle[:, None])[:, 0] >= floor
            inside, outside = np.where(above, middle, inside), np.where(above, outside, middle)
            if (np.abs(inside - outside) <= 1).all():
                break
        return inside

    low, high = edge(mode, np.ones(len(c))), edge(mode, most.astype(float))
    low, high = np.maximum(1, low - 1), np.minimum(most, high + 1)
    cell = np.ceil((high - low + 1) / POINTS)
    start = low[:, None] + cell[:, None] * np.arange(POINTS)
    weight = law(np.minimum(start + (cell[:, None] - 1) / 2, most[:, None]), start <= high[:, None])
    chosen = low + cell * _one_of(rng, weight)
    return np.minimum(chosen + np.floor(rng.random(len(c)) * cell), most).astype(np.int64)


def seat(rng, c: np.ndarray, rest: np.ndarray, p: np.ndarray, discount: float) -> np.ndarray:
    """One Gibbs draw of every dish's tables, given the ``rest`` of its restaurant's tables and the parent's probability p.

    t tables of c customers have the weight of their seatings times the odds
    (strength + discount * tables so far) * p of each: drawn from that law up to
    ``EXACT`` customers, by the saddle point of its generating function beyond.
    """
    out, ways = np.zeros(len(c), np.int64), log_ways(EXACT, discount)
    out[c == 1] = 1
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    few = few[np.argsort(c[few].astype(np.uint8), kind="stable")]
    for all_ in np.split(few, np.flatnonzero(np.diff(c[few])) + 1) if len(few) else []:
        for at in np.split(all_, range(1 << 16, len(all_), 1 << 16)):
            n = int(c[at[0]])
            odds = (STRENGTH + discount * (rest[at] + np.arange(n)[:, None])) * p[at]
            if n <= NEAR:  # their product is in the range of doubles
                up_to = np.cumsum(np.exp(ways[n, 1 : n + 1, None]) * np.cumprod(odds, axis=0), axis=0)
                out[at] = 1 + (up_to[:-1] <= rng.random(len(at)) * up_to[-1]).sum(axis=0)
            else:
                out[at] = 1 + _one_of(rng, (ways[n, 1 : n + 1, None] + np.cumsum(np.log(odds), axis=0)).T)
    many = np.flatnonzero(c > EXACT)
    for at in np.split(many, range(1 << 16, len(many), 1 << 16)):
        out[at] = _of_many(rng, c[at], rest[at], p[at], discount)
    return out


SEATED = PLACED + ", src long, n long, less_u binary, less_w binary"
ANSWERED = WORDS + ", at binary, src long, sent long, tables long"


class Model:
    """Seating of all restaurants: ``pairs`` (PAIRS) and ``words`` (WORDS, a row of ``opened`` and ``kept`` per sample).

    Between sweeps an owner of pairs holds its distinct words in order and the
    places of its pairs' (PLACED, counts in few bytes); an owner of words holds
    the places of all words it was asked for (``at``).  So words are told apart
    in the first sweep alone, and later messages are counts.

    ``totals`` has the root's customers and tables of each sample.
    """

    def __init__(self, words_: DataFrame, pairs: DataFrame, owners: int):
        self.words, self.pairs, self.owners, self.totals = words_, pairs, owners, []
        count = lambda df: df.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "types", "once", "twice")]).first()
        self.tokens, self.types, once, twice = count(words_)
        discount = lambda once, twice: (once + 0.5) / (once + 2 * twice + 1)
        self.root_discount, self.discount = discount(once, twice), discount(*count(pairs)[2:])
        self.pairs, self.words = pairs.select(*[f.split()[0] for f in PLACED.split(", ")]), words_.select(*[f.split()[0] for f in WORDS.split(", ")])

    def base(self, tables: int) -> float:
        """What the root gives any type from its own base."""
        return (STRENGTH + self.root_discount * tables) / (self.types + 1)

    def sample(self, counted: list[DataFrame]) -> None:
        """All sweeps; the ``counted`` tables go with the first."""
        answers, sent, tables, old = None, 0, 0, counted
        for sweep in range(BURN_IN + SAMPLES):
            last = sweep == BURN_IN + SAMPLES - 1
            seated = materialize(self._seat(sweep, last, answers, sent, tables), "seated")
            if sweep:  # the first sweep's words are counted yet
                discard(old.pop(0))
            messages = seated.where("src is not null").select("owner", "src", "n", "x", "less_u", "less_w")
            rooted = materialize(self._root(sweep, last, messages, tables), "rooted")
            discard(*old)
            old = [seated, rooted]
            sent, tables = rooted.agg(F.coalesce(F.sum("sent"), F.lit(0)), F.coalesce(F.sum("tables"), F.lit(0))).first()
            mine = lambda table, schema: table.where("src is null").select(*[f.split()[0] for f in schema.split(", ")])
            self.pairs, self.words = mine(seated, PAIRS if last else PLACED), mine(rooted, WORDS if last else WORDS + ", at binary")
            answers = rooted.where("src is not null").select("owner", "src", "opened", "kept")
            if sweep >= BURN_IN:
                self.totals.append((sent, tables))
        self.last = old

    def _seat(self, sweep: int, last: bool, answers: DataFrame | None, sent: int, tables: int) -> DataFrame:
        """One Gibbs sweep over the pairs of context restaurants, and what they tell the owners of words."""
        owners, discount, base, first = self.owners, self.discount, self.base(tables), answers is None

        def run(key, mine, told_by):
            rows = []
            for number, x, u, w, *counts in zip(mine.column("owner").to_pylist(), *(arrays(mine.column(k), d) for k, d in (("x", np.uint64), ("u", np.uint32), ("w", np.uint32), ("c", np.uint8), ("t", np.uint8), ("told", np.uint8))), strict=True):
                u, w, (c, t, told) = u.astype(np.int64), w.astype(np.int64), (widened(raw, len(u)) for raw in counts)
                to, sizes = shares(x, owners)
                opened, p = np.zeros(len(x)), np.full(len(x), base)
                if told_by is not None:  # the owners answer each key, in the order in which they were asked
                    told_by = told_by.sort_by("src")
                    opened = counts_of(told_by.column("opened"), sizes)
                    p = (joined(told_by.column("kept"), float) + base) / (STRENGTH + sent)
                t = seat(np.random.default_rng([SEED, sweep, number]), c, np.maximum(opened[u] - t, 0), p[w], discount)
                told = told + t * (sweep >= BURN_IN)
                less_u, less_w = (narrow(np.bincount(at, weights=c - t, minlength=len(x)).astype(np.int64), 4) for at in (u, w))
                if last:
                    rows.append(packed(SEATED, [{"owner": number, "u": x[u], "w": x[w], "c": c, "t": t, "told": told}]))
                else:
                    rows.append(packed(SEATED, [{"owner": number, "x": x, "u": u.astype(np.uint32), "w": w.astype(np.uint32), "c": narrow(c), "t": narrow(t), "told": narrow(told)}]))
                asked = {"x": x} if first else {}
                rows.append(cut(SEATED, sizes, owner=to, src=np.full(len(to), number), n=sizes, less_u=less_u, less_w=less_w, **asked))
            return pa.concat_tables([packed(SEATED, []), *rows])

        mine = self.pairs.groupBy("owner")
        return mine.applyInArrow(lambda key, own: run(key, own, None), SEATED) if first else mine.cogroup(answers.groupBy("owner")).applyInArrow(run, SEATED)

    def _root(self, sweep: int, last: bool, messages: DataFrame, tables: int) -> DataFrame:
        """A Gibbs move of the root's seats over the customers sent to it by now, and the answers to the owners of pairs."""
        p, discount, first = 1 / (self.types + 1), self.root_discount, sweep == 0

        def run(key, mine, told):
            rows = []
            told = told.sort_by("src")
            sizes = told.column("n").to_numpy()
            less = [counts_of(told.column(k), sizes) for k in ("less_u", "less_w")]
            places = [None] * mine.num_rows if first else arrays(mine.column("at"), np.uint32)
            for number, x, c, old_opened, old_kept, t, at in zip(mine.column("owner").to_pylist(), *(arrays(mine.column(k), d) for k, d in (("x", np.uint64), ("c", np.int64), ("opened", float), ("kept", float), ("t", np.int64))), places, strict=True):
                at = (np.searchsorted(x, joined(told.column("x"), np.uint64)) if first else at).astype(np.int64)  # every training word is here
                of_u, of_w = (np.bincount(at, weights=k, minlength=len(x)).astype(np.int64) for k in less)
                opened, sent = np.where(x == END, 0, c) - of_u, np.where(x == BEGIN, 0, c) - of_w
                rest = tables - (t if len(t) else np.zeros_like(c))
                t = seat(np.random.default_rng([SEED, sweep, number, 1]), sent, rest, np.full(len(sent), p), discount)
                kept = sent - discount * t
                now = (np.concatenate([old_opened, opened]), np.concatenate([old_kept, kept])) if sweep >= BURN_IN else (old_opened, old_kept)
                own = {"owner": number, "x": x, "c": c, "opened": now[0].astype(float), "kept": now[1], "t": t, "sent": int(sent.sum()), "tables": int(t.sum())}
                rows.append(packed(ANSWERED, [own if last else own | {"at": at.astype(np.uint32)}]))
                if not last:  # after which nobody asks
                    rows.append(cut(ANSWERED, sizes, owner=told.column("src").to_numpy(), src=np.full(len(sizes), number), opened=narrow(opened, 4)[at], kept=kept[at]))
            return pa.concat_tables([packed(ANSWERED, []), *rows])

        return self.words.groupBy("owner").cogroup(messages.groupBy("owner")).applyInArrow(run, ANSWERED)

    def shelves(self) -> DataFrame:
        """``owner, code, value``: what owners answer when texts are scored; owners of words are numbered after those of pairs."""
        owners, discount, schema = self.owners, self.discount, "owner long, code binary, value binary"

        def of_pairs(batches):
            for b in batches:
                for o, u, w, c, told in zip(b.column("owner").to_pylist(), *(arrays(b.column(k), d) for k, d in (("u", np.uint64), ("w", np.uint64), ("c", np.int64), ("told", np.int64))), strict=True):
                    yield from packed(schema, [{"owner": o, "code": pair_code(u, w), "value": c - discount * told / SAMPLES}]).to_batches()

        def of_words(batches):
            for b in batches:
                for o, x, c, opened, kept in zip(b.column("owner").to_pylist(), *(arrays(b.column(k), d) for k, d in (("x", np.uint64), ("c", np.int64), ("opened", float), ("kept", float))), strict=True):
                    value = np.concatenate([c[None, :].astype(float), opened.reshape(SAMPLES, -1), kept.reshape(SAMPLES, -1)]).T
                    yield from packed(schema, [{"owner": o + owners, "code": x, "value": np.ascontiguousarray(value)}]).to_batches()

        return self.pairs.mapInArrow(of_pairs, schema).union(self.words.mapInArrow(of_words, schema))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(texts: DataFrame, shelves: DataFrame, model: Model) -> DataFrame:
    """Rows of ``RESULT`` for the texts of some blocks."""
    owners, discount, total, types = model.owners, model.discount, model.tokens, model.types
    answered = "owner long, block long, known binary, value binary"
    base = np.array([model.base(t) for _, t in model.totals])
    scale = np.array([STRENGTH + n for n, _ in model.totals])
    log_base = lambda c: np.log10((c + ADDED) / (total + ADDED * (types + 1)))

    def ask(batches):
        for block, _, _, x, at_u, at_w in _read(batches):
            code = np.sort(pair_code(x[at_u], x[at_w]))
            code = code[_heads(code)]
            (of_pairs, n_pairs), (of_words, n_words) = shares(code, owners), shares(x, owners)
            to = np.concatenate([of_pairs, of_words + owners])
            yield from cut("owner long, block long, code binary", np.concatenate([n_pairs, n_words]), owner=to, block=np.full(len(to), block), code=np.concatenate([code, x])).to_batches()

    def answer(key, questions, shelf):
        """A byte for every question, whether it is known, and the values of those that are."""
        width = 1 if key[0].as_py() < owners else 1 + 2 * SAMPLES
        code, value = joined(shelf.column("code"), np.uint64), joined(shelf.column("value"), float).reshape(-1, width)
        wanted, sizes = joined(questions.column("code"), np.uint64), sizes_of(questions.column("code"), np.uint64)
        at = np.searchsorted(code, wanted)
        known = at < len(code)
        known[known] = code[at[known]] == wanted[known]
        edge = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(sizes)])]
        return cut(answered, sizes, {"value": np.diff(edge)}, owner=np.full(len(sizes), key[0].as_py()), block=questions.column("block").to_numpy(), known=known.view(np.uint8), value=value[at[known]])

    def score_block(key, mine, answers):
        for _, ids, where, x, at_u, at_w in _read([mine]):
            code, at = np.unique(pair_code(x[at_u], x[at_w]), return_inverse=True)
            answers = answers.sort_by("owner")  # owners of pairs come first, and keys in order
            known, found = joined(answers.column("known"), bool), joined(answers.column("value"), float)
            of_pairs, of_words = known[: len(code)], known[len(code) :]
            learn = _learns(ids)
            once, seats = np.zeros(len(code)), np.zeros(len(code))
            once[~of_pairs], seats[of_pairs] = 1 - discount, found[: of_pairs.sum()]  # a training pair that no owner keeps is met once, here
            stat = np.zeros((1 + 2 * SAMPLES, len(x)))
            stat[:, of_words] = found[of_pairs.sum() :].reshape(-1, 1 + 2 * SAMPLES).T
            customers = np.where(x == END, 0, stat[0])
            c = np.where(x == BEGIN, 0, stat[0])
            back = np.zeros(len(at))
            for opened, kept, b, n in zip(stat[1 : 1 + SAMPLES], stat[1 + SAMPLES :], base, scale, strict=True):
                back += (STRENGTH + discount * opened)[at_u] * ((kept + b) / n)[at_w]
            p = np.log10((seats[at] + once[at] * learn[where] + back / SAMPLES) / (STRENGTH + customers)[at_u])
            sums = lambda v: pa.array(np.bincount(where, weights=v, minlength=len(ids)))
            whole = lambda v: sums(v).cast(pa.int64())
            columns = [pa.array(ids, pa.int64()), pa.array(learn == 0), whole(np.ones(len(where))), whole((c > 0)[at_w]), pa.array([total] * len(ids), pa.int64()), sums(log_base(c)[at_w]), sums(p)]
            return pa.table(columns, names=[f.split()[0] for f in RESULT.split(", ")])
        return pa.table({f.split()[0]: pa.array([], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.split()[1]]) for f in RESULT.split(", ")})

    questions = texts.mapInArrow(ask, "owner long, block long, code binary")
    answers = questions.groupBy("owner").cogroup(shelves.groupBy("owner")).applyInArrow(answer, answered)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score_block, RESULT)


def score(docs: DataFrame, each: int = OWNER_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text)``; see ``RESULT``.

    ``block``: bytes of text in a block; ``each``: bytes for which there is an owner of words and of pairs.
    """
    texts = blocks(spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))), block, tokenised, TOKENS)
    owners = owners_of(texts, each)
    counted = [_word_owners(texts, owners), *[_pair_owners(texts, owners, turn) for turn in range(ROUNDS)]]
    pairs = counted[1]
    for more in counted[2:]:
        pairs = pairs.union(more)
    model = Model(counted[0], pairs, owners)
    model.sample(counted)
    shelves = materialize(model.shelves(), "shelves")
    discard(*model.last)
    part = F.pmod(F.xxhash64("block"), F.lit(PARTS))
    scores = [materialize(_scored(texts.where(part == k), shelves, model), "scores") for k in range(PARTS)]
    discard(texts, shelves)
    found = scores[0]
    for more in scores[1:]:
        found = found.union(more)
    return found


def perplexity(scored: DataFrame) -> DataFrame:
    """``held_out, tokens, perplexity, base_perplexity`` per kind of row."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op4_pitmanyor(spark, sf_dir: str) -> DataFrame:
    """``score`` over the whole ``documents`` table."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
