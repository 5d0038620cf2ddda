"""A varied subset of given size, chosen systematically along a Hilbert curve.

Each record's features are quantised to a grid, whose cells are numbered along a Hilbert curve,
so that cells near each other on the curve are alike. Records that look alike share a cell, and
a cell counts once however many it holds. The distinct cells are sorted by their number, and
evenly spaced ones are chosen, one best record each. If there are fewer cells than records are
wanted, every cell gives its best, then evenly spaced cells their second best, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.operators.ordered import ranked, running_sum
from arbora.session import cut

#: Bits of the largest grid whose table of cells (number, rows, rows before: 48 MB) is sent to every task.
MOST_SENT = 21


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of grid points, one column a dimension, 0 to 2**bits - 1 each."""
    x = [points[:, i].astype(np.int64).copy() for i in range(points.shape[1])]
    d = len(x)
    if d * bits > 62:
        raise ValueError("the curve's numbers must fit 62 bits")
    # from the top bit down, undo the turns and mirrorings of the sub-cubes
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for i in range(d):
            turned = (x[i] & high) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[d - 1] >> level) & 1, flip ^ ((1 << level) - 1), flip)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | (((x[i] ^ flip) >> level) & 1)
    return key


def with_cells(df: DataFrame, features: list[str], bits: int, keep: list[str]) -> DataFrame:
    """(keep, cell): rows with the curve number of their cell; features are whole numbers from 0, clipped to the grid, null as 0."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    most = (1 << bits) - 1
    grid = [F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(F.col(f).cast("int"), F.lit(0)))).alias(f"_x{i}") for i, f in enumerate(features)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = np.stack([b.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(features))], 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(hilbert_keys(points, bits))], [*keep, "cell"])

    return df.select(*keep, *grid).mapInArrow(run, f"{kinds}, cell bigint")


def select_varied(df: DataFrame, record: str, features: list[str], size: int, *, quality: str | None = None, bits: int = 3) -> DataFrame:
    """(record, cell, cell_rows, turn): ``size`` records that cover the cells evenly, or all if there are fewer.

    ``turn`` is 1 for a cell's best record, 2 for its second and so on; the best has the largest
    ``quality`` (null is least), then the smallest ``record``. Rows with a null record are left out; a record
    that is repeated counts as often. At most ``2**(bits * len(features))`` cells exist, whatever the size of the
    data. Their rows are counted and their bests found before anything is shuffled.
    """
    if size < 1:
        return df.select(record).limit(0).select(F.col(record), *(F.lit(0).cast(t).alias(c) for c, t in (("cell", "bigint"), ("cell_rows", "bigint"), ("turn", "int"))))
    q = F.coalesce(F.col(quality).cast("double"), F.lit(float("-inf"))) if quality else F.lit(0.0)
    placed = with_cells(df.where(F.col(record).isNotNull()).withColumn("_q", q), features, bits, [record, "_q"])
    placed = cut(placed)
    best = F.struct((-F.col("_q")).alias("q"), F.col(record).alias("r"))
    cells = cut(placed.groupBy("cell").agg(F.count("*").alias("cell_rows"), F.min(best).alias("best")))
    m = cells.count()
    if size <= m:
        picked = evenly(cells, "cell", size, m)
        return picked.select(F.col("best.r").alias(record), "cell", "cell_rows", F.lit(1).alias("turn"))
    # whole turns for all cells that have so many records, then one turn for evenly spaced cells
    turns, left, cells_left = _turns(cells, size)
    # a row's turn is its place among all rows in the order of cells, less the rows of the cells before
    before = running_sum(cells, ["cell"], F.col("cell_rows"), "upto").select("cell", "cell_rows", (F.col("upto") - F.col("cell_rows")).alias("before"))
    placed, _ = ranked(placed.withColumn("_order", -F.col("_q")), ["cell", "_order", record])
    # the table of cells is bounded by the grid
    with_turn = placed.join(F.broadcast(before) if bits * len(features) <= MOST_SENT else before, "cell")
    turned = with_turn.withColumn("turn", (F.col("rank") - F.col("before") + 1).cast("int")).where(F.col("turn") <= turns + 1)
    whole = turned.where(F.col("turn") <= turns)
    out = whole
    if left and cells_left:
        last = evenly(cells.where(F.col("cell_rows") > turns), "cell", left, cells_left).select("cell")
        out = whole.unionByName(turned.where(F.col("turn") == turns + 1).join(last, "cell", "left_semi"))
    return out.select(record, "cell", "cell_rows", "turn")


def _turns(cells: DataFrame, size: int) -> tuple[int, int, int]:
    """Whole turns that ``size`` pays for, what is left of it, and the cells of the next turn (0: none)."""
    by = cells.groupBy("cell_rows").agg(F.count("*").alias("cells")).withColumn("_order", -F.col("cell_rows"))
    steps = running_sum(by, ["_order"], F.col("cells"), "n").orderBy("cell_rows").select("cell_rows", "n")
    turns, left = 0, size
    for s in steps.toLocalIterator():  # n cells have at least cell_rows rows
        whole = min(s["cell_rows"] - turns, left // s["n"])
        turns, left = turns + whole, left - whole * s["n"]
        if turns < s["cell_rows"]:
            return turns, left, s["n"]
    return turns, 0, 0


def evenly(df: DataFrame, key: str, size: int, rows: int) -> DataFrame:
    """``size`` of the ``rows`` rows, evenly spaced in the order of ``key``, from the middle of each stretch.

    The order is global without bringing the rows together: the rows of each range partition are
    counted, and a row's rank is the rows before its partition plus its place in it.
    """
    placed = cut(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, total = {}, 0
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row a partition
        before[r["p"]] = total
        total += r["count"]
    start: Column = F.lit(None).cast("bigint")
    if before:
        start = F.element_at(F.create_map(*(x for p, n in before.items() for x in (F.lit(p), F.lit(n).cast("bigint")))), part)
    rank = start + F.col("_at").bitwiseAND((1 << 33) - 1)
    # row r is chosen if a point (i + 1/2) * rows / size falls on it, for some whole i
    size_ = F.lit(size).cast("bigint")

    def points(r: Column) -> Column:  # points below r
        return F.greatest(F.lit(0), F.floor((2 * size_ * r - rows + 2 * rows - 1) / F.lit(2 * rows)))

    return placed.withColumn("_r", rank).where(points(F.col("_r") + 1) > points(F.col("_r"))).drop("_at", "_r")
