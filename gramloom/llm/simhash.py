"""Near-duplicate detection by SimHash with pigeonring candidate filtering.

A fingerprint has 64 bits, seen as a ring of 16 segments of 4 bits.  If two
fingerprints differ in at most ``t`` bits, the pigeonring principle gives a
start segment from which every chain of ``l`` consecutive segments holds at
most ``l * t / 16`` differing bits.  For t = 3 the first five segments of that
chain are therefore equal: these 20 bits with their start are the join key.
The join itself checks the budgets of the longer chains and then the full
Hamming distance, so a bucket emits surviving pairs only, and of the starts
that give a pair only the first one emits it.  ``wide`` lengthens
the key: the next ``wide`` segments (at most five) may hold one differing bit
in all, so one side spells out the single-bit variants; keys of up to 40 bits
keep buckets small for billions of fingerprints.  Either way no pair within
the radius is lost and no bucket is capped.

Texts with the same fingerprint are one vertex, so copies never multiply pairs.

Defined results: null or word-less text has fingerprint zero and links like any
other; a null doc_id keeps its fingerprint, takes no part in linking and gets a
null component; repeated rows with one doc_id are one document each time.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import carried_schema, components, discard, materialize, spread, with_carried
from .textscan import NOT_SPACE, R, U, chunks, kgrams, mix, words

SEED = 42
SEGMENTS = 16
SEGMENT_BITS = 4


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """SimHash of the lower-cased words' shingles, repeats included: a bit is 1 if set in over half of the hashes."""
    found = raw.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, found), np.int64, len(found)) + 1
        start = np.cumsum(size) - size
        stop = (start + size - 1)[shingle - 1 :]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(start.tolist(), stop.tolist(), strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row of ``docs(doc_id, text)``, and the row's columns named in ``carry``."""
    docs = with_carried(docs, carry)

    def run(batches):
        for batch in batches:
            at = 0
            for ids, texts in chunks(iter([batch])):
                fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
                own = {name: batch.column(name).slice(at, len(ids)) for name in carry}
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "fp": pa.array(fp), **own})
                at += len(ids)

    return spread(docs).mapInArrow(run, "doc_id long, fp long" + carried_schema(docs, carry))


def _rotated(fp: Column, start: int) -> Column:
    """The ring read from segment ``start`` on."""
    by = start * SEGMENT_BITS
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _segments(start: int, length: int) -> int:
    """The bits of ``length`` consecutive segments of the ring, as a signed 64-bit mask."""
    mask = sum(15 << 60 - 4 * (k % SEGMENTS) for k in range(start, start + length))
    return mask - (mask >> 63 << 64)


def chain_ok(diff: Column, radius: int, start: int = 0) -> Column:
    """Pigeonring condition on a difference, read from segment ``start`` on: each prefix chain within its share, the last one being the whole distance."""
    ok = F.lit(True)
    for length in range(1, SEGMENTS + 1):
        budget = length * radius // SEGMENTS
        if length == SEGMENTS or (length + 1) * radius // SEGMENTS > budget:  # the last chain of each budget implies the shorter ones
            chain = diff.bitwiseAND(F.lit(_segments(start, length)))
            ok = ok & (F.bit_count(chain) <= budget if budget else chain == 0)
    return ok


def first_start(diff: Column, start: Column, radius: int) -> Column:
    """Whether no earlier start gives the pair of a difference that is rotated to ``start``."""
    ok = F.lit(True)
    for back in range(1, SEGMENTS):
        ok = ok & ((start < back) | ~chain_ok(diff, radius, SEGMENTS - back))
    return ok


def close_pairs(fps: DataFrame, radius: int = 3, wide: int | None = None, more: tuple[str, ...] = (), also=None) -> DataFrame:
    """Pairs ``fp_a < fp_b`` of distinct ``fps(fp)`` within ``radius`` differing bits, each once.

    The join also holds ``also(a, b)``, a condition on the columns ``more`` of both rows (``a("name")``), so what it refuses is not emitted.
    """
    zero = (SEGMENTS - 1) // radius  # chains up to here have budget 0
    if wide is None:
        bits = math.log2(max(2, fps.count())) + 2
        wide = max(0, min(zero, math.ceil((bits - zero * SEGMENT_BITS) / SEGMENT_BITS)))
    key_bits = (zero + wide) * SEGMENT_BITS
    starts = F.explode(F.array(*[F.struct(F.lit(s).alias("start"), _rotated(F.col("fp"), s).alias("ring")) for s in range(SEGMENTS)]))
    rings = fps.select("fp", *more, starts.alias("s")).select("fp", *more, "s.start", "s.ring")
    key = F.shiftrightunsigned("ring", 64 - key_bits)
    left = rings.select(F.col("fp").alias("fp_a"), *more, "start", F.col("ring").alias("ring_a"), key.alias("key"))
    if wide:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(wide * SEGMENT_BITS)])
        left = left.select("fp_a", *more, "start", "ring_a", F.explode(F.transform(flips, lambda f: F.col("key").bitwiseXOR(f))).alias("key"))
    right = rings.select(F.col("fp").alias("fp_b"), *more, "start", F.col("ring").alias("ring_b"), key.alias("key"))
    on = ["start", "key"]
    a, b = left.alias("a"), right.alias("b")
    match = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
    differ = F.col("ring_a").bitwiseXOR(F.col("ring_b"))
    found = [F.col("fp_a") < F.col("fp_b"), chain_ok(differ, radius)]
    found += [also(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))] if also else []
    return a.join(b, [*match, *found, first_start(differ, F.col("a.start"), radius)]).select("fp_a", "fp_b")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (smallest doc_id linked to it by any path)."""
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    per_class = linked(classes, radius)
    return marked.join(per_class, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def linked(classes: DataFrame, radius: int) -> DataFrame:
    """``fp, component_id`` of every row of ``classes(fp, rep)``: the smallest ``rep`` linked to it by any path."""
    pairs = close_pairs(classes.select("fp"), radius)
    edges = (
        pairs.join(classes.select(F.col("fp").alias("fp_a"), F.col("rep").alias("a")), "fp_a")
        .join(classes.select(F.col("fp").alias("fp_b"), F.col("rep").alias("b")), "fp_b")
        .select("a", "b")
    )
    found = components(edges)
    return classes.join(found, classes.rep == found.v, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def _texts_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of all lower-cased words."""
    start, _, h = words(b"\n".join(t.lower() for t in texts), NOT_SPACE)
    edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, edge))), h


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, bool)
    return doc[fresh], h[fresh]


def shingle_sets(doc: np.ndarray, h: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct shingles of every text; one of fewer words has its whole sequence."""
    grams = kgrams(h, shingle)
    inside = doc[: len(grams)] == doc[len(h) - len(grams) :]
    lone, first, n = np.unique(doc, return_index=True, return_counts=True)
    short = n < shingle
    whole = [int(kgrams(h[a : a + k], k)[0] + U(k)) for a, k in zip(first[short], n[short], strict=True)]
    return _distinct(np.concatenate([doc[: len(grams)][inside], lone[short]]), np.concatenate([grams[inside], np.array(whole, dtype=np.uint64)]))


def _set_sums(n: int, doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of every text; ``doc`` is sorted."""
    out = np.zeros(n, dtype=np.uint64)
    head = np.flatnonzero(np.diff(doc, prepend=-1))
    if len(doc):
        out[doc[head]] = np.add.reduceat(values, head)
    return out


def set_fingerprints(n: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the set of hashes of every text; ``doc`` is sorted, a hash occurs once in a text."""
    edge = np.searchsorted(doc, np.arange(n + 1))
    ones = np.zeros((n, 64), dtype=np.int64)
    for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        for at in range(a, b, 1 << 16):
            own = mix(h[at : min(b, at + (1 << 16))])
            ones[k] += np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > np.diff(edge)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


#: Prefix search: one in so many texts tells which shingles are frequent, the list's length (1 MB), and rows of ids that may be broadcast (8 bytes each).
ORDER_SAMPLE, FREQUENT, BROADCAST_ROWS = 16, 1 << 17, 1_000_000
#: Pairs are compared in so many parts, one after the other, from so many texts a part on: it bounds the shuffled shingle sets on disk, not the work.
COMPARED_PARTS, PART_TEXTS = 4, 4096
RADIUS = 3


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs(row, ...)`` whose number is in ``ids(row)``; few ids are broadcast, so that no text is shuffled for them."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "row", "left_semi")


def _shingled(batches, shingle: int):
    """(rows, edges, shingles) of chunks of texts: row k has the shingles edges[k] .. edges[k + 1]."""
    for batch in batches:
        for rows, texts in chunks(iter([batch])):
            doc, gram = shingle_sets(*_texts_words(texts), shingle)
            yield rows, np.searchsorted(doc, np.arange(len(texts) + 1)), gram


def _similar(pairs: DataFrame, docs: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """Those ``pairs(a, b)`` of rows of ``docs(row, text)`` whose shingle sets have a Jaccard similarity of ``tenths`` / 10 or more."""

    def run(batches):
        for rows, edge, gram in _shingled(batches, shingle):
            yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "grams": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(gram.view(np.int64)))})

    wanted = materialize(pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct(), "wanted")
    sets = materialize(_only(docs, wanted).select("row", "text").mapInArrow(run, "row long, grams array<long>"), "shingles")
    shared = F.size(F.array_intersect("in_a", "in_b"))
    enough = 10 * shared >= tenths * (F.size("in_a") + F.size("in_b") - shared)
    parts, found = min(COMPARED_PARTS, 1 + wanted.count() // PART_TEXTS), []
    for k in range(parts):
        own, left, right = pairs, sets, sets
        if parts > 1:
            within = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)) == k  # noqa: B023, E731
            own, right = pairs.where(within("b")), sets.where(within("row"))
            left = _only(sets, own.select(F.col("a").alias("row")).distinct())
        both = own.join(left.select(F.col("row").alias("a"), F.col("grams").alias("in_a")), "a").join(right.select(F.col("row").alias("b"), F.col("grams").alias("in_b")), "b")
        found.append(materialize(both.where(enough).select("a", "b"), "similar"))
    discard(sets, wanted)
    return functools.reduce(DataFrame.union, found)


def frequent(texts: DataFrame, shingle: int) -> np.ndarray:
    """The most frequent shingles of a sample of ``texts(row, text)``, rarest first.

    They only decide which shingles a search looks at last: any order gives the same pairs.
    """

    def run(batches):
        for _, _, gram in _shingled(batches, shingle):
            yield pa.RecordBatch.from_pydict({"token": pa.array(gram.view(np.int64))})

    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(ORDER_SAMPLE)) == 0)
    counts = some.mapInArrow(run, "token long").groupBy("token").count().where("count > 3")
    return counts.orderBy(F.desc("count"), "token").limit(FREQUENT).orderBy("count", "token").select("token").toArrow().column(0).to_numpy()


def prefixes(texts: DataFrame, shingle: int, tenths: int, last: np.ndarray) -> DataFrame:
    """``token, v, at, n``: the first n - ceil(n tenths / 10) + 1 of the n shingles of every row of ``texts(row, text)``.

    Shingles are in one order for all texts: by hash, those of ``last`` at the end.  Two sets of the similarity share one of these.
    """
    place = np.argsort(last)
    known = last[place]

    def run(batches):
        for rows, edge, gram in _shingled(batches, shingle):
            gram = gram.view(np.int64)
            at = np.searchsorted(known, gram)
            late = np.zeros(len(gram), np.int64)
            if len(known):
                hit = known[np.minimum(at, len(known) - 1)] == gram
                late[hit] = place[at[hit]] + 1
            size = np.diff(edge)
            doc = np.repeat(np.arange(len(rows)), size)
            order = np.lexsort((gram, late, doc))
            nth = np.arange(len(gram)) - np.repeat(edge[:-1], size)
            n = np.repeat(size, size)
            keep = nth < n + (-tenths * n // 10) + 1
            ids = np.array(rows, np.int64)[doc]
            yield pa.RecordBatch.from_pydict({"token": pa.array(gram[order][keep]), "v": pa.array(ids[keep]), "at": pa.array(nth[keep].astype(np.int32)), "n": pa.array(n[keep].astype(np.int32))})

    return texts.mapInArrow(run, "token long, v long, at int, n int")


def may_agree(a: Column, b: Column, tenths: int) -> Column:
    """Whether two sets whose first common shingle is at ``a.at`` and ``b.at`` can have the similarity: sizes, and what is left of either."""
    size = 10 * F.least(a["n"], b["n"]) >= tenths * F.greatest(a["n"], b["n"])
    return size & ((10 + tenths) * F.least(a["n"] - a["at"], b["n"] - b["at"]) >= tenths * (a["n"] + b["n"]))


#: Columns of the parity bitmap of a set, 512 bits: each shingle flips one.
BITS = tuple(f"bits_{k}" for k in range(8))


def parities(n: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the sets of ``n`` texts.  Two bitmaps differ in no more bits than the sets in elements."""
    width = 64 * len(BITS)
    flips = np.bincount(doc * width + (mix(h ^ R) % U(width)).astype(np.int64), minlength=n * width).reshape(n, width)
    return np.packbits(flips & 1, axis=1, bitorder="little").view("<i8")


def near_enough(a, b, tenths: int) -> Column:
    """Whether the bitmaps of two rows leave the similarity open: sets of sizes m and n have it if at most (10 - t) (m + n) / (10 + t) elements differ."""
    differ = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in BITS), F.lit(0))
    return (10 + tenths) * differ <= (10 - tenths) * (a("n") + b("n"))


def similar_links(classes: DataFrame, texts: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """Links ``a, b`` between the vertices of ``classes(v, fp, *BITS)`` that join the same groups as all pairs of the similarity do.

    Pairs come from three searches, each compared exactly before the next, which only looks across the groups known by then: texts
    of one fingerprint and of one prefix shingle against the first of them; fingerprints within ``RADIUS`` bits (pigeonring); texts
    of one prefix shingle against others of them in turn, while that finds links and many pairs across groups are left; and at last
    all pairs that share a prefix shingle and whose sizes, places and bitmaps leave the similarity open.  The last loses none, so the groups are exact; the others keep large groups of copies
    from giving their square in pairs.
    """
    found = materialize(prefixes(texts, shingle, tenths, frequent(texts, shingle)), "prefixes")
    one = F.struct("v", "at", "n")
    heads = found.groupBy("token").agg(F.min(one).alias("head"), F.max("v").alias("most")).where("head.v <> most")
    met = materialize(found.join(heads.select("token", "head"), "token"), "met")
    discard(found)
    same = classes.groupBy("fp").agg(F.min("v").alias("a"))
    stars = classes.join(same, "fp").where("a <> v").select("a", F.col("v").alias("b"))
    near = met.where(F.col("head.v") != F.col("v")).where(may_agree(F.col("head"), one, tenths)).select(F.col("head.v").alias("a"), F.col("v").alias("b"))
    links = _similar(materialize(near.union(stars).distinct(), "pairs"), texts, shingle, tenths)

    label = components(links)
    known = materialize(classes.join(label, "v", "left").select("v", "fp", F.coalesce("component", "v").alias("known")), "known")
    firsts = materialize(known.groupBy("fp").agg(F.min(F.struct("v", "known")).alias("h")).select("fp", "h.v", "h.known"), "heads")
    met_fp = close_pairs(firsts.select("fp", "known"), RADIUS, more=("known",), also=lambda a, b: a("known") != b("known"))
    side = lambda x, y: firsts.select(F.col("fp").alias(x), F.col("v").alias(y))
    close = met_fp.join(side("fp_a", "a"), "fp_a").join(side("fp_b", "b"), "fp_b").select("a", "b")
    links = links.union(_similar(materialize(close, "close"), texts, shingle, tenths))

    rows = _mixed(met.select("token", "v", "at", "n").join(classes.select("v", *BITS), "v"), components(links))
    discard(met)
    turn, worth = 0, True
    while worth and _crossing(rows) > CROSSING * rows.count():
        turn += 1
        tried = materialize(_star(rows, turn, tenths), "turn")
        more = _similar(tried, texts, shingle, tenths)
        n, worth = more.count(), False
        if n:
            before, links = rows, links.union(more)
            rows, worth = _mixed(before, components(links)), WORTH * n >= before.count()
            discard(before)
    a, b = rows.alias("a"), rows.alias("b")
    cell = lambda t: {n: F.col(f"{t}.{n}") for n in ("at", "n")}
    open_ = may_agree(cell("a"), cell("b"), tenths) & near_enough(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), tenths)
    rest = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.v") < F.col("b.v")) & (F.col("a.of") != F.col("b.of")) & open_)
    rest = materialize(rest.select(F.col("a.v").alias("a"), F.col("b.v").alias("b")).distinct(), "rest")
    links = links.union(_similar(rest, texts, shingle, tenths))
    discard(rows)
    return links


#: Pairs across groups that buckets may hold a row before all are compared; above, stars go first, while they find a link for each WORTH rows.
CROSSING, WORTH = 2, 100


def _mixed(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the groups ``of`` ``label(v, component)``, those of buckets that hold more than one group."""
    named = rows.drop("of").join(label, "v", "left").select("token", "v", "at", "n", *BITS, F.coalesce("component", "v").alias("of"))
    named = materialize(named, "named")
    mixed = named.groupBy("token").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("token")
    found = materialize(named.join(mixed, "token", "left_semi"), "mixed")
    discard(named)
    return found


def _crossing(rows: DataFrame) -> int:
    """Pairs of rows of one bucket and two groups, counted without making any."""
    each = rows.groupBy("token", "of").count().groupBy("token").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("own"))
    return each.agg(F.sum(F.col("n") * F.col("n") - F.col("own"))).first()[0] or 0


def _star(rows: DataFrame, turn: int, tenths: int) -> DataFrame:
    """Pairs ``a, b`` of each bucket's rows and one of them, another in every turn, that lie in two groups."""
    one = F.struct("v", "at", "n", "of", *BITS)
    heads = rows.groupBy("token").agg(F.min_by(one, F.xxhash64("v", F.lit(turn))).alias("head"))
    met = rows.join(heads, "token").where(F.col("of") != F.col("head.of")).where(may_agree(F.col("head"), F.struct("at", "n"), tenths))
    met = met.where(near_enough(F.col, lambda c: F.col(f"head.{c}"), tenths))
    return met.select(F.least("v", "head.v").alias("a"), F.greatest("v", "head.v").alias("b")).distinct()


def one_of_each(docs: DataFrame, columns: list[str], shingle: int = 5, tenths: int = 8) -> DataFrame:
    """``columns`` of one row of each near-duplicate group: of smallest doc_id (nulls last), whichever of its rows comes first.

    Near duplicates share ``tenths`` / 10 or more of their ``shingle``-word shingles (Jaccard over distinct ones), directly or by a
    path.  At that similarity a fingerprint of shingles differs in up to 14 of its 64 bits, too many for a selective chain, so the
    fingerprints' pigeonring search finds near ones first and a prefix search over the shingles finds what is left; see
    ``similar_links``.  Texts of the same shingle set are one vertex.

    Rows are told apart by a number written beside them, so null and repeated doc_ids link and go like any other;
    texts without a word are alike; a text of any length is read whole, a shingle set at a time.
    """
    carry = tuple(dict.fromkeys(["text", *(c for c in columns if c != "doc_id")]))
    table = with_carried(docs, carry)

    def run(batches):
        for batch in batches:
            at = 0
            for ids, texts in chunks(iter([batch])):
                own, gram = shingle_sets(*_texts_words(texts), shingle)
                sets = mix(_set_sums(len(texts), own, mix(gram)) + np.bincount(own, minlength=len(texts)).astype(np.uint64))
                bits = parities(len(texts), own, gram)
                kept = {name: batch.column(name).slice(at, len(ids)) for name in carry}
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "set": pa.array(sets.view(np.int64)), "fp": pa.array(set_fingerprints(len(texts), own, gram).view(np.int64)), **{c: pa.array(bits[:, k]) for k, c in enumerate(BITS)}, **kept})
                at += len(ids)

    scanned = spread(table).mapInArrow(run, "doc_id long, set long, fp long" + "".join(f", {c} long" for c in BITS) + carried_schema(table, carry))
    marked = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "numbered")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = materialize(marked.groupBy("set").agg(F.min("row").alias("v"), F.min("fp").alias("fp"), *[F.min(c).alias(c) for c in BITS], first.alias("first")), "classes")
    links = similar_links(classes.select("v", "fp", *BITS), _only(marked.select("row", "text"), classes.select(F.col("v").alias("row"))), shingle, tenths)
    verdict = classes.join(components(links), "v", "left").select("set", F.coalesce("component", "v").alias("component"), "first")
    kept = verdict.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return _only(marked, materialize(kept, "kept")).select(*[F.col(n).cast(t) for n, t in docs.select(*columns).dtypes])


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Digest of ``near_duplicates`` over the whole ``documents`` table."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
