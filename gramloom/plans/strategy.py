"""Choice of a physical plan from dimensions, which the driver knows without a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that a broadcast operand may have: 16 to 32 MB of (index, value) rows.
BROADCAST_CELLS = 1_000_000
#: Multiplications beyond which a dense product goes by blocks.
BLOCK_WORK = 50_000_000
BLOCK = 256


def small(df: DataFrame, cells: int) -> DataFrame:
    """Broadcast a side whose shape bounds it; leave the choice to Catalyst beyond."""
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df


def product_plan(m: int, k: int, n: int) -> str:
    """``broadcast``: coordinate join against a broadcast side; ``join``: shuffled coordinate join; ``block``: dense blocks."""
    if m * k * n > BLOCK_WORK and min(m, k, n) >= BLOCK:
        return "block"
    return "broadcast" if min(m * k, k * n) <= BROADCAST_CELLS else "join"

#: Tiles of the edge of a product's group: 64 accumulators of 512 KB (1 MB if complex) a task.
EDGE = 8


def grouping(rows: int, ks: int, cols: int, cores: int) -> tuple[int, int]:
    """Edge of a product's groups in tiles, and slabs of k, for rows x ks by ks x cols tiles.

    Every core gets a group where the shape has as many result tiles or steps of k; of the choices that do, the one
    that sends the fewest tiles: A once a column of groups, B once a row of them, the sums once a slab beyond the first.
    """
    rows, ks, cols, best = max(1, rows), max(1, ks), max(1, cols), None
    wanted = min(cores, rows * cols * ks)
    for edge in range(1, EDGE + 1):
        down, across = -(-rows // edge), -(-cols // edge)
        slabs = min(ks, -(-wanted // (down * across)))
        slabs = -(-ks // -(-ks // slabs))  # none of them empty
        sent = rows * ks * across + ks * cols * down + (slabs * rows * cols if slabs > 1 else 0)
        idle = max(0, wanted - down * across * slabs)
        if best is None or (idle, sent) < best[:2]:
            best = (idle, sent, edge, slabs)
    return best[2], best[3]
