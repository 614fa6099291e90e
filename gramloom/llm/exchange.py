"""Blocks of texts, and packed messages between them and the owners of hashed keys.

An owner holds the keys whose hash falls to it, whatever block they come from.
A block sends each distinct key once, packed with the others for the same
owner, so a key that a third of all texts hold costs its owner one entry per
block, and owners are even whatever the keys are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .textscan import U

BLOCK_BYTES = 6 << 20
OWNER_BYTES = 8 << 20
ROW_GROUP = 16 << 20
#: For tables with rows of megabytes: by default Parquet first looks at the size of a page or row group after 100 rows, which may be hundreds of MB.
WIDE = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1}
PIECE = 64 << 20


def laid(block: int, ids: list, texts: list[bytes]) -> dict:
    """Texts end to end, compressed: the JVM sorts, sends and holds rows of a block several times over."""
    return {"sizes": list(map(len, texts)), "texts": pa.compress(b"".join(texts), "zstd", asbytes=True)}


LAID = {"sizes": pa.list_(pa.int64()), "texts": pa.binary()}


def blocks(docs: DataFrame, limit: int = BLOCK_BYTES, lay=laid, kinds: dict = LAID) -> DataFrame:
    """Written table ``block, n_bytes, ids`` and the columns ``kinds`` of ``lay``: the rows of ``docs(doc_id, text)``, about ``limit`` bytes together, as they are laid end to end if not told otherwise.

    The number of a block is written with it, so a lost task changes no number that a later stage relies on.
    """

    def run(batches):
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row():
            columns = {"block": pa.array([number], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64()))}
            own = lay(number, ids, texts)
            return pa.RecordBatch.from_pydict(columns | {name: pa.array([own[name]], kind) for name, kind in kinds.items()})

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
                size += len(texts[-1])
                if size >= limit:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield row()

    more = "".join(f", {name} {'binary' if kind == pa.binary() else 'array<long>'}" for name, kind in kinds.items())
    found = docs.mapInArrow(run, "block long, n_bytes long, ids array<long>" + more)
    return materialize(found, "blocks", compression="zstd", **WIDE)


def owners_of(table: DataFrame, each: int = OWNER_BYTES) -> int:
    """Owners for the keys of a table of blocks: one for every ``each`` bytes of text."""
    return max(1, -(-(table.agg(F.sum("n_bytes")).first()[0] or 0) // each))


def unpacked(batches: Iterable) -> Iterator[tuple[int, list, list[bytes]]]:
    """(block, ids, texts) of every row of a table of blocks."""
    for batch in batches:
        for block, ids, sizes, raw in zip(*(batch.column(c) for c in ("block", "ids", "sizes", "texts")), strict=True):
            edge = np.concatenate([[0], np.cumsum(sizes.values.to_numpy(zero_copy_only=False))]).astype(np.int64).tolist()
            raw = pa.decompress(raw.as_buffer(), edge[-1], "zstd")
            yield block.as_py(), ids.as_py(), [raw[a:b].to_pybytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]


def owner(keys: np.ndarray, owners: int) -> np.ndarray:
    return (keys % U(owners)).astype(np.int64)


def range_owner(keys: np.ndarray, owners: int) -> np.ndarray:
    """Owners of equal ranges of mixed keys: keys in order are in order of owner too."""
    return (((keys >> U(32)) * U(owners)) >> U(32)).astype(np.int64)


def shares(keys: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, keys of it) of every ``range_owner`` of keys in order."""
    size = np.bincount(range_owner(keys, owners), minlength=1)
    to = np.flatnonzero(size)
    return to, size[to]


def dealt(to: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(owner, places) of every owner that occurs in ``to``; places keep their order."""
    order = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.diff(to[order], prepend=-1))
    return [(int(to[part[0]]), part) for part in np.split(order, edge[1:])] if len(to) else []


def packed(schema: str, rows: list[dict]) -> pa.Table:
    """Rows of a schema of longs and binaries; arrays become bytes, absent columns null."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    value = lambda x: x.tobytes() if isinstance(x, np.ndarray) else x
    return pa.table({name: pa.array([value(r.get(name)) for r in rows], kinds[kind]) for name, kind in fields})


def arrays(column, dtype) -> list[np.ndarray]:
    """The arrays of a binary column."""
    return [np.frombuffer(x.as_buffer(), dtype=dtype) if x.is_valid else np.zeros(0, dtype) for x in column]


def _edges(chunk) -> np.ndarray:
    """Byte offsets of the rows of a binary array."""
    wide = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
    return np.frombuffer(chunk.buffers()[1], dtype=wide)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, wide)


def _chunks(column) -> list:
    return column.chunks if isinstance(column, pa.ChunkedArray) else [column]


def joined(column, dtype) -> np.ndarray:
    """The arrays of a binary column as one array; nulls have no elements."""
    parts = [np.zeros(0, np.uint8)]
    for chunk in _chunks(column):
        edge, data = _edges(chunk), chunk.buffers()[2]
        if data is not None:
            parts.append(np.frombuffer(data, dtype=np.uint8)[edge[0] : edge[-1]])
    return np.concatenate(parts).view(dtype)


def sizes_of(column, dtype) -> np.ndarray:
    """Elements of each array of a binary column."""
    return np.concatenate([np.zeros(0, np.int64), *(np.diff(_edges(chunk)).astype(np.int64) // np.dtype(dtype).itemsize for chunk in _chunks(column))])


def narrow(counts: np.ndarray, least: int = 1) -> np.ndarray:
    """Counts, none below 0, in the fewest bytes that hold each of them, ``least`` or more."""
    kind = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
    return counts.astype(kind if kind.itemsize >= least else f"u{least}")


def widened(raw: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` counts that ``narrow`` left as the bytes ``raw``; no bytes are counts of 0."""
    return raw.view(f"u{len(raw) // n}").astype(np.int64) if len(raw) else np.zeros(n, np.int64)


def counts_of(column, sizes: np.ndarray) -> np.ndarray:
    """The counts of a binary column as one array; row k has ``sizes[k]``, each row as narrow as it was sent."""
    if np.array_equal(sizes_of(column, np.uint8), 4 * sizes):
        return joined(column, np.uint32).astype(np.int64)
    return np.concatenate([np.zeros(0, np.int64), *(widened(raw, n) for raw, n in zip(arrays(column, np.uint8), sizes.tolist(), strict=True))])


def grouped(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in order of ``to``, distinct values of ``to``, places of each); places of one value keep their order."""
    order = np.argsort(to, kind="stable")
    head = np.flatnonzero(np.diff(to[order], prepend=-1))
    return order, to[order[head]], np.diff(np.append(head, len(to)))


def cut(schema: str, sizes: np.ndarray, fewer: dict[str, np.ndarray] | None = None, **columns: np.ndarray) -> pa.Table:
    """Rows of a schema of longs and binaries, absent columns null.

    Row k holds the next ``sizes[k]`` elements of the array of every binary
    column and element k of every other; a column of ``fewer`` has sizes of its
    own there, none above ``sizes``.  A column is one buffer for every
    ``PIECE`` bytes or so, however many rows they are.
    """
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    edges = {name: np.concatenate([[0], np.cumsum(n)]).astype(np.int64) for name, n in {"": sizes, **(fewer or {})}.items()}
    edge = edges[""]
    width = {name: columns[name].nbytes // max(1, len(columns[name])) for name, kind in fields if kind == "binary" and name in columns}
    head = np.flatnonzero(np.diff(edge[1:] * max(width.values()) // PIECE, prepend=-1))

    def column(name: str, kind: str, a: int, b: int) -> pa.Array:
        if name not in columns:
            return pa.nulls(b - a, kinds[kind])
        if kind == "long":
            return pa.array(columns[name][a:b], pa.int64())
        edge = edges.get(name, edges[""])
        at = ((edge[a : b + 1] - edge[a]) * width[name]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(columns[name][edge[a] : edge[b]]))])

    batches = [pa.RecordBatch.from_arrays([column(name, kind, a, b) for name, kind in fields], names=[name for name, _ in fields]) for a, b in zip(head, np.append(head[1:], len(sizes))[: len(head)], strict=True)]
    return pa.Table.from_batches(batches, pa.schema([(name, kinds[kind]) for name, kind in fields]))
