import hashlib
import random

import corpus_pipeline
import public_tokenizers
import test_blobledger
import test_winnowing

from gramloom.llm import bpetree, ruleledger


def quality(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id for r in ruleledger.apply_policy(ruleledger.ledger(table)).where("kept").collect()}


def masked(text):
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in test_blobledger.brute(text).split(",") if s))
    out, at = "", 0
    for a, b, k in spans:
        if b > at:
            out, at = out + (text[at:a] + f"<{k}>" if a >= at else ""), b
    return out + text[at:]


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def similar_groups(rows):
    """Smallest id linked by 5-word shingles with a Jaccard similarity of 0.8 or more."""
    sets, label = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 10 * len(x & y) >= 8 * len(x | y) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if g == high else g for i, g in label.items()}
    return label


def test_near_dedup_of_edited_copies(spark):
    """Copies with words changed here and there: groups by exact shingle similarity, whatever the fingerprints are."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))] if i % 4 == 0 else list(w)
        for _ in range(rng.choice([0, 1, 2, 4, 8]) if i % 4 else 0):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99999)}"
        rows.append((i, " ".join(w)))
    table = spark.createDataFrame([(i, t, "en", "s", len(t), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, head int")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "").collect()}
    label = similar_groups(rows)
    assert kept == {i for i, g in label.items() if g == i}


def test_near_dedup_loses_no_kind_of_copy(spark):
    """Scattered edits, appended passages, replaced blocks and moved parts, a passage that many share, one very long text: groups as by brute force."""
    rng = random.Random(5)
    say = lambda k: [f"w{rng.randrange(40000)}" for _ in range(k)]
    rows, passage = [], say(40)
    for i in range(60):
        w = say(250)
        edits = list(w)
        for _ in range(5):
            edits[rng.randrange(250)] = f"x{rng.randrange(10**7)}"
        at = rng.randrange(200)
        rows += [" ".join(x) for x in (w, edits, w + say(37), w + say(54), w[:at] + say(20) + w[at + 20 :], w[100:] + w[:100], say(30 + i) + passage)]
    base = say(120)  # near copies of near copies, of which few reach the similarity
    for _ in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(120)] = f"y{rng.randrange(10**7)}"
        rows.append(" ".join(w))
    long = say(30_000)
    rows += ["", " ", "a b", "A b", "a", " ".join(long), " ".join(long[:-900])]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, t, "en", "s", len(t), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, token long").repartition(4)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "").collect())
    sets, label = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for a, b in {(min(p), max(p)) for h in holders.values() for p in ((i, j) for i in h for j in h if i < j)}:
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if g == high else g for i, g in label.items()}
    assert kept == sorted(i for i, g in label.items() if g == i)


def test_run_against_brute_force(spark, rows, tmp_path):
    secret = "password = Abcdefgh123"
    docs = [(i, (t or "") + (f" {secret} {'ab12' * 10}" if i % 7 == 0 else ""), "en", "s", 0, "more") for i, t in rows]
    bench = [(1, " ".join(test_winnowing.split(rows[1][1])[10:22])), (2, "unknown words only")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = quality(spark, [d[:2] for d in docs])
    left = [d[:2] for d in docs if d[0] in good]
    label = similar_groups(left)
    assert any(label[i] != i and t not in [u for j, u in left if j != i] for i, t in left)  # near copies, not exact ones alone
    left = [(i, t) for i, t in left if label[i] == i]
    dirty = test_winnowing.brute(left, bench)
    left = [(i, masked(t)) for i, t in left if not dirty[i][1]]
    vocab = bpetree.vocabulary(public_tokenizers.path(bpetree.VOCABULARY))
    want = {i: (len(x := vocab.encode(t)) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in left}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert 5 < len(want) < len(good) < len(docs)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.dtypes == none.dtypes and out.count() == 0


def test_each_row_gets_its_own_verdict(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    spark.createDataFrame([(1, " ".join(a.split()[8:22]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    order = lambda df: sorted(((r.doc_id or 0, r.text, r.lang, r.source, r.n_chars) for r in df.collect()))
    got = order(corpus_pipeline.decontaminate(spark, table([(None, a), (1, a), (1, b), (None, b), (2, c)]), str(tmp_path)))
    assert got == [(i, t, "en", "s", len(t)) for i, t in [(0, b), (1, b), (2, c)]]
    got = order(corpus_pipeline.near_dedup(spark, table([(None, a), (None, a), (None, b), (5, b), (5, b), (9, b), (7, c)]), str(tmp_path)))
    assert got == [(i, t, "en", "s", len(t)) for i, t in [(0, a), (5, b), (7, c)]]
    found = test_winnowing.winnowing.contamination(table([(None, a), (1, a), (1, b)]), spark.read.parquet(f"{tmp_path}/benchmark.parquet"), 0, ("text", "n_chars"))
    assert sorted((r.n_hit, r.text, r.n_chars) for r in found.collect()) == [(0, b, len(b)), (14, a, len(a)), (14, a, len(a))]
