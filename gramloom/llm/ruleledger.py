"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every text once and evaluates every rule once: bit ``k`` of
``failed`` is set when rule ``k`` fails.  Policies are versioned masks over the
same ledger, so changing a policy or asking what each rule costs never reads a
text again: ``apply_policy`` is one bitwise AND, ``ablation`` one aggregation.

Everything about a text is computed inside its row: no shuffle, no skew.
Arrays are bound once by ``let`` (a one-element ``transform``), so Catalyst
does not evaluate an array again for each of its elements.

Defined results: null text has no words, fails the length rule and is not kept;
null ids and repeated rows pass through, one ledger row each; a long text is one
row, measured whole inside it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of words, and symbols counted.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Rules in bit order: name, and when it fails over the measurements.
RULES: list[tuple[str, Callable]] = [
    ("too_few_words", lambda m: m["n_words"] < 50),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 14 * m["n_words"])),
    ("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 5 * m["n_lines"]),
    ("upper_case", lambda m: 10 * m["n_upper"] > 5 * m["word_chars"]),
    ("same_neighbours", lambda m: 100 * m["n_same_next"] > 20 * m["n_words"]),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versioned policies: masks of the rules that reject.
POLICIES: dict[str, int] = {
    "base": BIT["too_few_words"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
}


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, first included."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def over_sorted(s):
        """s: (hash, position) sorted; positions of hashes met again, then the words they cover."""
        again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def some(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, over_sorted))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, some)).cast("long")


def measures(text: Column) -> Column:
    """Struct of the measurements of one text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\r\x0b\x0c"))) > 0)

    def measured(w):
        same = F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))
        return let(lines, lambda x: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(x).cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            same.cast("long").alias("n_same_next"),
        ))

    return let(words, measured)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_same_next"]


def failures(m) -> Column:
    """Bit ``k`` is set when rule ``k`` fails; ``m`` gives a measurement's column by name."""
    bits = [F.when(fails(m), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, fails) in enumerate(RULES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def ledger(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns named in ``carry``, the measurements, and ``failed``: one bit for each rule."""
    own = ["doc_id", *carry]
    measured = docs.select(*own, measures(F.col("text").cast("string")).alias("m")).select(*own, *[F.col(f"m.{c}").alias(c) for c in MEASURES])
    return measured.withColumn("failed", failures({c: F.col(c) for c in MEASURES}))


def verdict(policy: str = "v1", failed: Column | None = None) -> Column:
    """Whether the policy keeps a ledger row."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def keeps(text: Column, policy: str = "v1") -> Column:
    """The verdict on a text as one expression, for use in a filter."""
    return let(measures(text.cast("string")), lambda m: verdict(policy, failures(m)))


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    return rows.withColumn("kept", verdict(policy))


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that it alone rejects (kept if the rule went)."""
    mask = POLICIES[policy]
    within = F.col("failed").bitwiseAND(F.lit(mask))
    used = [(k, name) for k, (name, _) in enumerate(RULES) if mask >> k & 1]
    counts = rows.agg(*[f.alias(f"{kind}{k}") for k, _ in used for kind, f in (
        ("f", F.count_if(within.bitwiseAND(F.lit(1 << k)) != 0)), ("o", F.count_if(within == 1 << k)))])
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"f{k}").alias("n_failed"), F.col(f"o{k}").alias("n_only")) for k, name in used])
    return counts.select(F.explode(each).alias("x")).select("x.rule", "x.n_failed", "x.n_only")


def op1_ruleledger(spark, sf_dir: str) -> DataFrame:
    """Ledger and verdict over the whole ``documents`` table."""
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base"])) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def ruleledger_ablation(spark, sf_dir: str) -> DataFrame:
    """``source, policy, rule, n_docs, n_failed, n_only, n_kept``: both policies taken apart over the whole ``documents`` table, source by source, from one ledger.

    No text is read again for a policy or a rule: the ledger is grouped by source and bits with a partial
    count first, so a source with a third of all rows is a few counts a task.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = ledger(docs, carry=("source",)).groupBy("source", "failed").agg(F.count("*").alias("n"))
    used = F.array(*[F.struct(F.lit(policy).alias("policy"), F.lit(name).alias("rule"), F.lit(mask).alias("mask"), F.lit(BIT[name]).alias("bit"))
                     for policy, mask in POLICIES.items() for name in BIT if mask & BIT[name]])
    within = F.col("failed").bitwiseAND(F.col("mask"))
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    each = rows.select("source", "failed", "n", F.inline(used))
    return each.groupBy("source", "policy", "rule").agg(
        F.sum("n").alias("n_docs"), n(within.bitwiseAND(F.col("bit")) != 0).alias("n_failed"), n(within == F.col("bit")).alias("n_only"), n(within == 0).alias("n_kept"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
s AS (SELECT k, unnest(range(1, greatest(1, len(w) - 1))) AS i, w FROM w),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n FROM s),
c AS (SELECT k, count(DISTINCT p)::BIGINT AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(regexp_extract_all(text, '\p{Lu}'))::BIGINT AS n_upper,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_same_next
  FROM w LEFT JOIN c USING (k)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 8 ELSE 0 END
  + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 16 ELSE 0 END + CASE WHEN 10 * n_upper > 5 * word_chars THEN 32 ELSE 0 END
  + CASE WHEN 100 * n_same_next > 20 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

ABLATION_SQL = ORACLE_SQL[: ORACLE_SQL.rindex("SELECT doc_id")].replace("SELECT row_number() OVER () AS k, doc_id", "SELECT row_number() OVER () AS k, source AS doc_id") + r"""
, p AS (SELECT * FROM (VALUES ('base', 'too_few_words', 3, 1), ('base', 'repeated_words', 3, 2), ('v1', 'too_few_words', 127, 1), ('v1', 'repeated_words', 127, 2), ('v1', 'symbols', 127, 4),
  ('v1', 'word_length', 127, 8), ('v1', 'repeated_lines', 127, 16), ('v1', 'upper_case', 127, 32), ('v1', 'same_neighbours', 127, 64)) AS x(policy, rule, mask, bit))
SELECT doc_id AS source, policy, rule, count(*) AS n_docs, count(*) FILTER (failed & mask & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only, count(*) FILTER (failed & mask = 0) AS n_kept
FROM f, p GROUP BY ALL
"""
