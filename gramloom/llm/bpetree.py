"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved down to leaves, leaves are split by the vocabulary's pattern
and every match is encoded by the ranks; halves are then joined pairwise up the
tree.  Both levels re-encode only a window at the seam:

* Matches: the left half's last matches may have ended, or been chosen, only
  because the text ended at the cut.  Matching restarts before them on the
  joined text and goes on until it ends where a match of the right half ends.  The pattern looks ahead, never
  behind, so from such a boundary on the right half's matches stand.
* Ranks: a match longer than a leaf is halved too.  Its seam window grows until
  both outer seams hold, meaning that the two tokens at each seam, encoded
  together, give themselves again.  A token sequence in which every neighbouring
  pair does so is the BPE encoding of its bytes, so tokens outside are final.

Decoding concatenates token bytes up a tree.  Each executor worker loads the
rank file once per task; the vocabulary path is a parameter of every function.

Defined results: null text is the empty text, with no tokens; nothing is
truncated; a null doc_id and repeated rows pass through unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import spread
from .textscan import chunks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 4096
LEAF_BYTES = 48
KNOWN_MATCHES = 200_000
#: Characters from its start that decide a match besides those it takes and the next: the pattern's contractions have three.
LOOK = 3


class Vocabulary:
    """Ranks of one file; encodes matches, texts and decodes ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def merge(self, raw: bytes) -> list[bytes]:
        """Merge the neighbours of lowest rank, leftmost first, until none has a rank."""
        if len(raw) > 4 * LEAF_BYTES:
            return self.merge_window(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks, big = self.ranks, len(self.tokens)
        near = [ranks.get(a + b, big) for a, b in zip(parts, parts[1:], strict=False)]
        while near and (low := min(near)) < big:
            i = near.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], big)
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], big)
        return parts

    def merge_window(self, raw: bytes) -> list[bytes]:
        """``merge`` with a heap over linked positions, for seam windows that grew long."""
        ranks, n = self.ranks, len(raw)
        size, before, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, width = heapq.heappop(heap)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != width:
                continue
            size[i], size[j] = width, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := ranks.get(raw[a : a + size[a] + size[b]])) is not None:
                    heapq.heappush(heap, (r, a, size[a] + size[b]))
        return [raw[i : i + s] for i, s in enumerate(size) if s]

    def firm(self, a: bytes, b: bytes) -> bool:
        """Whether two neighbouring tokens, encoded together, give themselves again."""
        return self.merge(a + b) == [a, b]

    def tree(self, raw: bytes) -> list[bytes]:
        """Tokens of a long match: halves joined over a growing seam window."""
        if len(raw) <= LEAF_BYTES:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right:
            return left + right
        if self.firm(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = left[max(0, len(left) - width) :], right[:width]
            window = self.merge(b"".join(a + b))
            out, rest = left[: len(left) - len(a)], right[len(b) :]
            if (not out or self.firm(out[-1], window[0])) and (not rest or self.firm(window[-1], rest[0])):
                return out + window + rest
            width *= 2

    def match_ids(self, piece: str) -> bytes:
        """Ids of one match as little-endian unsigned 32-bit integers."""
        raw = piece.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else [self.ranks[t] for t in self.tree(raw)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def matches(self, text: str) -> list[str]:
        """The pattern's matches over the text, by halving and re-matching at seams."""
        if len(text) <= LEAF_CHARS:
            return self.pattern.findall(text)
        half = len(text) // 2
        left, right = self.matches(text[:half]), self.matches(text[half:])
        at = half
        while left and (at == half or at + LOOK > half):
            at -= len(left.pop())
        end, skip = half, 0  # end: where the right half's first `skip` matches end
        while at < len(text):
            if at == end:
                break
            found = self.pattern.match(text, at)
            left.append(found.group())
            at = found.end()
            while end < at:
                end += len(right[skip])
                skip += 1
        left.extend(right[skip:])
        return left

    def encode(self, text: str) -> bytes:
        known, out = self.known, []
        for piece in self.matches(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.match_ids(piece)
                if len(piece) <= LEAF_BYTES:
                    if len(known) >= KNOWN_MATCHES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_CHARS:
            tokens = self.tokens
            return b"".join([tokens[i] for i in ids.tolist()])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
    return Vocabulary(path, pattern)


def _mapped(docs: DataFrame, path: str, schema: str, row) -> DataFrame:
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        vocab = vocabulary(path)
        for ids, texts in chunks(batches):
            columns = zip(*(row(vocab, t) for t in texts), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(list(c)) for c in columns)], names=names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` (ids: little-endian unsigned 32-bit integers) of every row of ``docs(doc_id, text)``."""

    def row(vocab, raw):
        ids = vocab.encode(raw.decode())
        return len(ids) // 4, ids

    docs = spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return _mapped(docs, path or public_tokenizers.path(VOCABULARY), "doc_id long, n_tokens long, ids binary", row)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, decoded`` (bytes) of ``encoded(doc_id, ids)``; null ids decode to nothing."""

    def row(vocab, raw):
        return (vocab.decode(np.frombuffer(raw, dtype="<u4")),)

    return _mapped(encoded.select("doc_id", "ids"), path or public_tokenizers.path(VOCABULARY), "doc_id long, decoded binary", row)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode and decode in one pass, ids never leave the task."""

    def row(vocab, raw):
        ids = vocab.encode(raw.decode())
        back = vocab.decode(np.frombuffer(ids, dtype="<u4"))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    docs = spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return _mapped(docs, path or public_tokenizers.path(VOCABULARY), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def op3_bpetree(spark, sf_dir: str) -> DataFrame:
    """Digest of ``round_trip`` over the whole ``documents`` table."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
