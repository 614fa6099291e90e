"""Substring dedup over merged Burrows-Wheeler transforms of phrases.

Texts are parsed into phrases at anchors.  A candidate is a byte whose next 32
bytes have a hash in 1 / ``SPACING`` of all hashes; an anchor lies ``GAP`` bytes
before a candidate that has no other in between.  Being an anchor thus depends on
its own 48 bytes (its gram) alone, so equal bytes parse alike; anchors are 17 bytes apart at least, in
repetitive text too, so a window holds at most 21.  A phrase runs from its anchor over the gram of
the next one; the bytes from the start of a text over its first gram are a
phrase too.  Phrases are the symbols of the transforms.

* Shards.  A block of texts is a shard: it sorts its own suffixes and holds, in
  that order, the symbol before each suffix (its BWT) and the row of the suffix
  that starts with it (its LF step).
* Merge.  Shards are never sorted together.  After pass h every suffix has its
  place in the merged order by its first h symbols: the number of its interval.
  A pass steps by LF: the suffix that starts one symbol earlier belongs, at h + 1,
  to the interval (BWT symbol, interval of the rest).  A shard asks the owners of
  its distinct intervals (see ``exchange``) for their places and sizes, with its
  own counts.  Suffixes alone in their interval have parted from their
  neighbours and leave; the pass at which they do is their longest common
  prefix.  The merge ends when nothing is left to refine within the reach of a window.
* Repeats.  A 400-byte window with first anchor i and last anchor i + h lies
  between the phrase before i and the phrase at i + h.  If the interval of these
  h + 2 symbols has two suffixes or more, the window repeats.  If only the
  interval of the h inner symbols is larger, the window's ends decide: its bytes
  are compared, by a 64-bit hash and four bytes of its own, for one text of each
  distinct surrounding.
* Windows with fewer than two anchors go straight to that last comparison.

A passage in a third of all texts is one question per shard and interval, and
only windows next to a difference are spelled out.  The order of symbols is that
of their hashes by owner; any order of symbols gives the same intervals.

Defined results: null text is empty; texts shorter than 400 bytes lose nothing;
rows with a null doc_id are returned unchanged and are nobody's partner; every
row is cut by itself, rows repeating a doc_id or a text included; extra columns
are ignored; a text is held in one task, at some forty bytes of memory a byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import BLOCK_BYTES, OWNER_BYTES, WIDE, arrays, blocks, dealt, joined, owner, owners_of, packed, unpacked
from .scratch import discard, materialize, spread
from .textscan import BYTE_HASH, R, R_INV, SEGMENT, U, mix, power, powers

LENGTH = 400
HASHED, GAP, SPACING = 32, 16, 32
GRAM = GAP + HASHED
REST = LENGTH - GRAM
CHECKED = (57, 157, 257, 357)
PARTS = 2


def span_hashes(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((total[hi] - total[lo]) * power(lo, R_INV, "down") + (hi - lo).astype(np.uint64))


def segments(n: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + SEGMENT)) for a in range(0, n, SEGMENT)]


def running(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    for a, b in segments(len(raw)):
        np.cumsum(BYTE_HASH[raw[a:b]] * powers(b - a, R, "up") * power(np.array([a]), R, "up"), out=out[a + 1 : b + 1])
        out[a + 1 : b + 1] += out[a]
    return out


class Parse:
    """Anchors, phrases and windows of a few texts, laid end to end.

    Nodes are the phrases: of each text with an anchor, the phrase before its first one and then one per anchor.
    """

    def __init__(self, texts: list[bytes]):
        self.edge = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        raw = self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(raw)
        self.total = running(raw)
        doc_at = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.edge))
        candidate = [np.zeros(0, np.int64)]
        for a, b in segments(max(0, n + 1 - HASHED)):
            grams = (self.total[a + HASHED : b + HASHED] - self.total[a:b]) * powers(b - a, R_INV, "down") * power(np.array([a]), R_INV, "down")
            candidate.append(a + np.flatnonzero(grams < U((1 << 64) // SPACING)))
        candidate = np.concatenate(candidate)
        at = candidate[np.diff(candidate, prepend=-GAP - 1) > GAP] - GAP
        at = at[at >= 0]
        at = at[at + GRAM <= self.edge[doc_at[at] + 1]]  # at and its gram in one text
        self.at = at
        self.doc = doc = doc_at[at].astype(np.int64)
        head = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(at) else np.zeros(0, bool)
        tail = np.append(head[1:], True) if len(at) else head
        begin, end = self.edge[doc], self.edge[doc + 1]
        following = np.append(at[1:], n) if len(at) else at
        stop = np.where(tail, end, np.minimum(following + GRAM, end))
        self.node = np.arange(len(at)) + np.cumsum(head)  # of each anchor
        self.symbol = np.zeros(len(at) + int(head.sum()), dtype=np.uint64)
        self.symbol[self.node] = mix(span_hashes(self.total, at, stop) + tail.astype(np.uint64))
        self.first = self.node[head] - 1
        self.symbol[self.first] = mix(span_hashes(self.total, begin[head], at[head] + GRAM) + U(2))
        self.anchor = np.full(len(self.symbol), -1)
        self.anchor[self.node] = np.arange(len(at))
        self.following = np.where(tail, np.iinfo(np.int64).max // 2, following)
        self.stop = stop
        self.low = np.where(head, begin, np.concatenate([[0], at[:-1]]) + 1) if len(at) else at
        self.high = np.minimum(at, end - LENGTH)
        reach = np.searchsorted(at, np.minimum(at + REST, end - 1), "right") - 1 - np.arange(len(at))
        self.need = np.zeros(len(self.symbol), dtype=np.int64)  # symbols that some window needs
        self.need[self.node] = reach
        np.maximum.at(self.need, self.node - 1, reach + 2)
        bare = [np.zeros(0, np.int64)]
        for a, b in segments(max(0, n - LENGTH + 1)):  # starts
            count = np.zeros(b - a + REST + 1, dtype=np.int32)
            count[at[np.searchsorted(at, a) : np.searchsorted(at, b + REST)] + 1 - a] = 1
            count = np.cumsum(count, dtype=np.int32)
            inside = doc_at[a:b] == doc_at[LENGTH - 1 + a : LENGTH - 1 + b]
            bare.append(a + np.flatnonzero(inside & (count[REST + 1 :] - count[: b - a] <= 1)))
        self.bare = np.concatenate(bare)

    def windows(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and four bytes of every window."""
        check = np.stack([self.raw[s + k] for k in CHECKED], axis=1) if len(s) else np.zeros((0, 4), np.uint8)
        return span_hashes(self.total, s, s + LENGTH), check.view(np.uint32).ravel()


def parsed(ids: list, texts: list[bytes]) -> tuple[np.ndarray, Parse]:
    """The texts that may be somebody's partner, by their places among all of the block, and their parse."""
    own = np.array([k for k, i in enumerate(ids) if i is not None], dtype=np.int64)
    return own, Parse([texts[k] for k in own])


def suffix_order(symbol: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Nodes in order of their suffixes within their text (``text``: number of each node's), by doubling."""
    _, rank = np.unique(symbol, return_inverse=True)
    step, places = 1, np.arange(len(symbol))
    while len(symbol) and rank.max() < len(symbol) - 1 and step < len(symbol):
        onward = places + step
        same = onward < len(symbol)
        same[same] = text[onward[same]] == text[places[same]]
        key = (rank + 1) * (len(symbol) + 2) + np.where(same, rank[np.minimum(onward, len(symbol) - 1)] + 1, 0)
        _, finer = np.unique(key, return_inverse=True)
        if finer.max() == rank.max():
            break
        rank, step = finer, step * 2
    return np.argsort(rank, kind="stable")


#: A shard (src null) or what it asks an owner: distinct intervals (symbol, rest) with counts; found: sizes of the pass before.
SHARD = "owner long, src long, symbol binary, rest binary, n binary, bwt binary, lf binary, need binary, node binary, at binary, found long"
FOUND = "owner long, depth long, node binary, size binary"
ANSWER = "owner long, src long, place binary, size binary"


def _asks(block: int, owners: int, symbol: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """(distinct symbols, their rests, which of them each row is, questions to owners)."""
    order = np.lexsort((rest, symbol))
    s, r = symbol[order], rest[order]
    head = np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])]) if len(s) else np.zeros(0, bool)
    at = np.empty(len(s), dtype=np.int32)
    at[order] = np.cumsum(head) - 1
    n = np.diff(np.append(np.flatnonzero(head), len(s)))
    s, r = s[head], r[head]
    return s, r, at, [{"owner": o, "src": block, "symbol": s[part], "rest": r[part], "n": n[part]} for o, part in dealt(_interval_owner(s, r, owners))]


def _interval_owner(symbol: np.ndarray, rest: np.ndarray, owners: int) -> np.ndarray:
    return owner(mix(symbol * R + rest.astype(np.uint64)), owners)


def shards(texts: DataFrame, owners: int) -> DataFrame:
    """``SHARD`` rows ahead of the first pass: symbols in order of text, and the questions about them."""

    def run(batches):
        for block, ids, raw in unpacked(batches):
            _, p = parsed(ids, raw)
            if not len(p.symbol):
                continue
            rest = np.zeros(len(p.symbol), np.int64)
            first = np.zeros(len(p.symbol), np.int32)
            first[p.first] = 1
            *_, asks = _asks(block, owners, p.symbol, rest)
            yield from packed(SHARD, [{"owner": block, "symbol": p.symbol, "need": p.need.astype(np.uint16), "at": first}, *asks]).to_batches()

    return texts.mapInArrow(run, SHARD)


def placed(key, asks):
    """An owner's part of one pass: the places of its intervals in the merged order, with their sizes, to every shard that asked.

    A size is negative for all but the first shard of an interval.
    """
    symbol, rest, n = (joined(asks.column(c), t) for c, t in (("symbol", np.uint64), ("rest", np.int64), ("n", np.int64)))
    src = asks.column("src").to_numpy()
    each = [len(x) for x in arrays(asks.column("n"), np.int64)]
    order = np.lexsort((np.repeat(src, each), rest, symbol))
    s, r = symbol[order], rest[order]
    head = np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
    size = np.add.reduceat(n[order], np.flatnonzero(head))
    start = (key[0].as_py() << 40) + np.cumsum(size) - size
    group = np.cumsum(head) - 1
    place, sizes = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
    place[order], sizes[order] = start[group], np.where(head, size[group], -size[group])
    edge = np.concatenate([[0], np.cumsum(each)])
    return packed(ANSWER, [{"owner": o, "src": key[0].as_py(), "place": place[a:b], "size": sizes[a:b]} for o, a, b in zip(src.tolist(), edge[:-1], edge[1:], strict=True)])


def refined(depth: int, owners: int):
    """A shard's part of one pass: note the sizes its suffixes have at ``depth``, step by LF and ask about the next depth."""

    def run(key, mine, answers):
        rows = []
        for number, symbol, rest, bwt, lf, need, node, at in zip(mine.column("owner").to_pylist(), *(arrays(mine.column(c), t) for c, t in (("symbol", np.uint64), ("rest", np.int64), ("bwt", np.uint64), ("lf", np.int32), ("need", np.uint16), ("node", np.uint32), ("at", np.int32))), strict=True):
            if depth == 1:  # the shard's own transform
                text = np.cumsum(at)
                order = suffix_order(symbol, text)
                row = np.empty(len(order), np.int32)
                row[order] = np.arange(len(order))
                first = at[order] == 1
                bwt = np.where(first, U(0), symbol[order - 1])
                lf = np.where(first, -1, row[order - 1]).astype(np.int32)
                need, node = need[order], order.astype(np.uint32)
                symbol, rest, at, _ = _asks(number, owners, symbol[order], np.zeros(len(order), np.int64))
            place, size = np.zeros(len(symbol), np.int64), np.ones(len(symbol), np.int64)
            parts = dict(dealt(_interval_owner(symbol, rest, owners)))
            for src, p, n in zip(answers.column("src").to_pylist(), arrays(answers.column("place"), np.int64), arrays(answers.column("size"), np.int64), strict=True):
                place[parts[src]], size[parts[src]] = p, n
            live = np.abs(size[at]) > 1
            chosen = np.flatnonzero(live)
            if not len(chosen):
                continue
            lead = np.zeros(len(at), dtype=bool)
            lead[np.unique(at, return_index=True)[1]] = True
            shown = np.where(lead & (size[at] > 0), size[at], -np.abs(size[at]))
            rows.append({"owner": number, "found": depth, "node": node[chosen], "n": shown[chosen]})
            step = chosen[lf[chosen] >= 0]
            step = step[live[lf[step]] & (need[lf[step]] > depth)]
            if not len(step):
                continue
            step = step[np.argsort(lf[step])]  # the shard's order of the suffixes they step to
            to = lf[step]
            row = np.full(len(at), -1, np.int32)
            row[to] = np.arange(len(to))
            s, r, at_next, asks = _asks(number, owners, bwt[step], place[at[step]])
            further = np.where(lf[to] >= 0, row[lf[to]], -1).astype(np.int32)
            rows.append({"owner": number, "symbol": s, "rest": r, "bwt": bwt[to], "lf": further, "need": need[to], "node": node[to], "at": at_next})
            rows += asks
        return packed(SHARD, rows)

    return run


def merge(texts: DataFrame, owners: int) -> list[DataFrame]:
    """Tables of ``FOUND``, one a pass: sizes of the intervals of all suffixes that share their first ``depth`` symbols (the first of an interval has it positive)."""
    state, sizes, depth = materialize(shards(texts, owners), "shards", **WIDE), [], 0
    while not state.where("symbol is not null").isEmpty():
        depth += 1
        asks = state.where("src is not null").select("owner", "src", "symbol", "rest", "n")
        mine = state.where("src is null and found is null")
        answers = asks.groupBy("owner").applyInArrow(placed, ANSWER)
        after = materialize(mine.groupBy("owner").cogroup(answers.groupBy("owner")).applyInArrow(refined(depth, owners), SHARD), "shards", **WIDE)
        discard(state)
        state = after
        sizes.append(materialize(state.where("found is not null").select("owner", F.col("found").alias("depth"), "node", F.col("n").alias("size")), "sizes", **WIDE))
    discard(state)
    return sizes


#: Starts of windows found to repeat (of all of a block's bytes), or windows to compare; shared: longest shared run of each text.
STARTS = "owner long, src long, start binary, n binary, code binary, check binary, shared binary"


def classified(owners: int):
    """Windows that repeat by their intervals, and windows to compare, of one block."""

    def run(key, mine, found):
        rows = []
        for block, ids, raw in unpacked([mine]):
            own, p = parsed(ids, raw)
            shift = np.concatenate([[0], np.cumsum([len(t) for t in raw])])[own] - p.edge[:-1] if len(own) else np.zeros(0, np.int64)
            text_of = lambda s: np.searchsorted(p.edge, s, "right") - 1  # noqa: B023, E731
            size = {0: np.ones(len(p.symbol), np.int64)}
            for d, node, n in zip(found.column("depth").to_pylist(), arrays(found.column("node"), np.uint32), arrays(found.column("size"), np.int64), strict=True):
                size[d] = np.ones(len(p.symbol), np.int64)
                size[d][node] = n
            starts, times, spelled = [], [], [p.bare]
            shared = np.zeros(len(ids), np.int64)
            for d, inner in size.items():
                a = p.anchor[np.flatnonzero(np.abs(inner) > 1)]
                a = a[a >= 0]
                if not len(a):
                    continue
                last = a + d - 1  # the last shared phrase
                a, last = a[last < len(p.at)], last[last < len(p.at)]
                np.maximum.at(shared, own[p.doc[a]], p.stop[last] - p.at[a])
                e = last + 1
                a = a[e < len(p.at)]
                e = a + d
                a = a[p.doc[e] == p.doc[a]]
                e = a + d
                lo, hi = np.maximum(p.low[a], p.at[e] - REST), np.minimum(p.high[a], p.following[e] - REST - 1)
                some = hi >= lo
                a, lo, hi = a[some], lo[some], hi[some]
                whole = size.get(d + 2, size[0])[p.node[a] - 1]
                known = np.abs(whole) > 1
                starts.append(lo[known])
                times.append((hi - lo + 1)[known])
                unsure = (np.abs(inner[p.node[a]]) > np.abs(whole)) & (~known | (whole > 0))
                many = (hi - lo + 1)[unsure]
                spelled.append(np.repeat(lo[unsure] - (np.cumsum(many) - many), many) + np.arange(many.sum()))
            s = np.unique(np.concatenate(spelled))
            code, check = p.windows(s)
            order = np.lexsort((s, check, code))
            c, k = code[order], check[order]
            head = np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])]) if len(c) else np.zeros(0, bool)
            n = np.diff(np.append(np.flatnonzero(head), len(c)))
            again = order[np.repeat(n, n) > 1]  # met twice in this block
            starts.append(s[again])
            times.append(np.ones(len(again), np.int64))
            start, n_starts = np.concatenate(starts), np.concatenate(times)
            rows.append({"owner": block, "start": start + shift[text_of(start)], "n": n_starts, "shared": shared})
            one = order[head]
            place = s[one] + shift[text_of(s[one])]
            rows += [{"owner": o, "src": block, "start": place[part], "n": np.minimum(n[part], 2), "code": code[one[part]], "check": check[one[part]]} for o, part in dealt(owner(code[one], owners))]
        return packed(STARTS, rows)

    return run


def compared(key, asks):
    """Starts of an owner's windows that two blocks or more hold, to each block that holds them once."""
    start, n, code, check = (joined(asks.column(c), t) for c, t in (("start", np.int64), ("n", np.int64), ("code", np.uint64), ("check", np.uint32)))
    each = [len(x) for x in arrays(asks.column("n"), np.int64)]
    order = np.lexsort((check, code))
    c, k = code[order], check[order]
    head = np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])])
    total = np.empty(len(c), np.int64)
    total[order] = np.add.reduceat(n[order], np.flatnonzero(head))[np.cumsum(head) - 1]
    told = (total > 1) & (n == 1)
    edge = np.concatenate([[0], np.cumsum(each)])
    rows = [{"owner": o, "start": start[a:b][told[a:b]]} for o, a, b in zip(asks.column("src").to_pylist(), edge[:-1], edge[1:], strict=True)]
    return packed(STARTS, [r | {"n": np.ones(len(r["start"]), np.int64)} for r in rows if len(r["start"])])


def covered(start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Whether some range start .. stop holds a byte, for each of ``n`` bytes."""
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(stop[order])
    head = np.concatenate([[True], start[1:] > reach[:-1]]) if len(start) else np.zeros(0, bool)
    turn = np.zeros(n + 1, np.int8)  # ranges that meet are one, so no place turns twice
    turn[start[head]] = 1
    turn[reach[np.append(head[1:], True)] if len(start) else reach] = -1
    return np.cumsum(turn[:-1], dtype=np.int8) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shared_bytes long"


def cut(key, mine, found):
    """The texts of a block without the bytes of repeated windows."""
    rows = []
    for _, ids, raw in unpacked([mine]):
        edge = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        start, n = joined(found.column("start"), np.int64), joined(found.column("n"), np.int64)
        shared = joined(found.column("shared"), np.int64)
        shared = shared if len(shared) else np.zeros(len(ids), np.int64)
        gone = covered(start, start + n - 1 + LENGTH, int(edge[-1]))
        for k, (i, t) in enumerate(zip(ids, raw, strict=True)):
            own = gone[edge[k] : edge[k + 1]]
            if not own.any():
                rows.append((i, len(t), 0, 0, hashlib.sha256(t).hexdigest(), int(shared[k])))
                continue
            kept = np.frombuffer(t, np.uint8)[~own].tobytes()
            runs = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1]))
            rows.append((i, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest(), int(shared[k])))
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return pa.table({f.split()[0]: pa.array(list(c), pa.string() if f.endswith("string") else pa.int64()) for f, c in zip(RESULT.split(", "), columns, strict=True)})


def drop_repeats(docs: DataFrame, block: int = BLOCK_BYTES, each: int = OWNER_BYTES) -> DataFrame:
    """``RESULT`` after removal of every byte of a repeated 400-byte string.

    ``shared_bytes`` is the longest run of whole phrases of a text that is found elsewhere too, followed as far as a window reaches.
    ``block``: bytes of text in a shard; ``each``: bytes for which there is an owner.
    """
    texts = blocks(spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))), block)
    owners = owners_of(texts, each)
    sizes = merge(texts, owners)
    found = sizes[0] if sizes else texts.sparkSession.createDataFrame([], FOUND)
    for more in sizes[1:]:
        found = found.union(more)
    part = F.pmod(F.xxhash64("block"), F.lit(PARTS))
    owned = F.pmod(F.xxhash64("owner"), F.lit(PARTS))
    starts = [materialize(texts.where(part == k).groupBy("block").cogroup(found.where(owned == k).groupBy("owner")).applyInArrow(classified(owners), STARTS), "starts", **WIDE) for k in range(PARTS)]
    discard(*sizes)
    asks = starts[0].where("src is not null")
    for more in starts[1:]:
        asks = asks.union(more.where("src is not null"))
    told = materialize(asks.groupBy("owner").applyInArrow(compared, STARTS), "told", **WIDE)
    done = [materialize(texts.where(part == k).groupBy("block").cogroup(starts[k].where("src is null").union(told.where(owned == k)).groupBy("owner")).applyInArrow(cut, RESULT), "cut") for k in range(PARTS)]
    discard(texts, told, *starts)
    result = done[0]
    for more in done[1:]:
        result = result.union(more)
    return result


def op2_bwtmerge(spark, sf_dir: str) -> DataFrame:
    """Digest of ``drop_repeats`` over the whole ``documents`` table."""
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
