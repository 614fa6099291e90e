"""Secret scans over an incremental blob ledger.

Every version of every text is a blob, addressed by the SHA-256 of its bytes.
The ledger has one row per (blob, rule version) that was ever scanned, with its
findings.  ``scan`` hashes all paths, keeps the (blob, rule version) pairs that
the ledger lacks, scans each such blob once however many paths hold it, and
returns the new ledger rows; ``report`` joins findings back to all paths.

Copies are reduced before the shuffle by partial aggregation, so a blob held by
a third of all paths costs one row per map task.  The join back to paths moves
hashes only; on a hot blob it is an ordinary skewed equi-join that adaptive
execution splits, and the ledger side has one row per blob.

Defined results: null text is the empty blob; null paths are kept and get their
findings; repeated rows are paths of the same blob; a long text is one blob,
scanned whole; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, spread
from .textscan import chunks

#: Kinds in the order of reports.
KINDS = ["assign", "access", "hex"]
RULES_VERSION = 1

_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
LEDGER = "blob string, rules int, n_assign long, n_access long, n_hex long, spans string"


def find(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind as listed; leftmost non-overlapping per kind."""
    lower = raw.lower()  # ASCII letters only, so offsets stay
    found = []
    if b"=" in raw or b":" in raw:
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(lower) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(raw)]
    found.sort(key=lambda x: (x[0], x[2]))
    out, at, points = [], 0, 0
    for start, end, kind in found:
        points += len(raw[at:start].decode())
        at = start
        out.append((points, points + len(raw[start:end].decode()), KINDS[kind]))
    return out


def blobs(paths: DataFrame) -> DataFrame:
    """``path, blob``: the content address of every path's text."""
    return paths.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))


def scan(paths: DataFrame, ledger: DataFrame | None = None, rules: int = RULES_VERSION) -> DataFrame:
    """New ledger rows for ``paths(path, text)``: blobs that ``ledger`` has not under this rule version, each scanned once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unseen = spread(paths.select(F.sha2(text, 256).alias("blob"), text.alias("text"))).dropDuplicates(["blob"])
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")

    def run(batches):
        for keys, texts in chunks(batches):
            found = [find(t) for t in texts]
            count = lambda kind: pa.array([sum(x[2] == kind for x in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_pydict({
                "blob": pa.array(keys, pa.string()), "rules": pa.array([rules] * len(keys), pa.int32()),
                "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
                "spans": pa.array([",".join(f"{k}:{a}:{b}" for a, b, k in f) for f in found]),
            })

    return unseen.select("blob", "text").mapInArrow(run, LEDGER)


def report(paths: DataFrame, ledger: DataFrame, rules: int = RULES_VERSION) -> DataFrame:
    """Findings of every path: ``path, blob, n_assign, n_access, n_hex, spans`` (zero and empty where the blob has none)."""
    hits = ledger.where((F.col("rules") == rules) & (F.col("spans") != "")).drop("rules")
    found = blobs(paths).join(hits, "blob", "left")
    return found.select("path", "blob", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.coalesce("spans", F.lit("")).alias("spans"))


def redact(text: str | None, spans: str) -> str | None:
    """The text with every span overwritten by ``<kind>``; spans that lie in an earlier one go with it."""
    if text is None:
        return None
    out, at = [], 0
    for span in spans.split(","):
        kind, start, end = span.split(":")
        if int(end) <= at:
            continue
        if int(start) >= at:
            out += [text[at : int(start)], f"<{kind}>"]
        at = int(end)
    return "".join([*out, text[at:]])


def op7_blobledger(spark, sf_dir: str) -> DataFrame:
    """Digest of a first ``scan`` and ``report`` over the whole ``documents`` table (an empty ledger: all blobs are unseen)."""
    paths = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    found = report(paths, scan(paths))
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def blobledger_history(spark, sf_dir: str) -> DataFrame:
    """A ledger kept over four loads of whole tables: ``load, n_paths, n_scanned, n_flagged``.

    Load 1 is ``benchmark`` and ``conversations``, load 2 adds ``documents``, load 3 brings all of them again, load 4 is load 3
    under the next rule version.  ``n_scanned`` counts the blobs that the ledger lacked, ``n_flagged`` the paths with findings.
    Each load's new ledger rows are written, so a later load reads them and no text is scanned twice.
    """
    texts = lambda *names: reduce(DataFrame.union, [spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.concat(F.lit(f"{t}/"), *k).alias("path"), "text") for t, k in names])
    first = texts(("benchmark", ["item_id"]), ("conversations", ["conv_id", F.lit("/"), "turn"]))
    every = first.union(texts(("documents", ["doc_id"])))
    kept, out = None, []
    for load, (paths, rules) in enumerate([(first, 1), (every, 1), (every, 1), (every, 2)], 1):
        new = materialize(scan(paths, kept, rules), f"ledger-{load}")
        kept = new if kept is None else kept.union(new)
        one, zero = F.lit(1).alias("one"), F.lit(0)
        of_paths = report(paths, kept, rules).select(one, zero.alias("scanned"), (F.col("spans") != "").cast("int").alias("flagged"))
        counted = of_paths.union(new.select(F.lit(0), F.lit(1), F.lit(0)))
        sums = [F.coalesce(F.sum(c), zero).cast("long").alias(n) for c, n in (("one", "n_paths"), ("scanned", "n_scanned"), ("flagged", "n_flagged"))]
        out.append(counted.agg(*sums).select(F.lit(load).cast("long").alias("load"), "n_paths", "n_scanned", "n_flagged"))
    return reduce(DataFrame.union, out)


HISTORY_SQL = r"""
WITH t AS (SELECT 1 AS l, coalesce(text, '') AS text FROM benchmark UNION ALL SELECT 1, coalesce(text, '') FROM conversations UNION ALL SELECT 2, coalesce(text, '') FROM documents),
f AS (SELECT l, text, regexp_matches(text, '[0-9a-f]{32}') OR regexp_matches(text, 'AKIA[A-Z0-9]{12}') OR len(list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) > 0 AS flagged FROM t),
b AS (SELECT text, min(l) AS l FROM t GROUP BY text)
SELECT 1::BIGINT AS load, count(*) AS n_paths, (SELECT count(*) FROM b WHERE l = 1) AS n_scanned, count(*) FILTER (flagged) AS n_flagged FROM f WHERE l = 1
UNION ALL SELECT x.load, count(*), CASE x.load WHEN 2 THEN (SELECT count(*) FROM b WHERE l = 2) WHEN 3 THEN 0 ELSE (SELECT count(*) FROM b) END, count(*) FILTER (flagged) FROM f, (VALUES (2::BIGINT), (3), (4)) AS x(load) GROUP BY x.load
"""
