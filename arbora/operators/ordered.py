"""Global ranks and running sums without bringing the rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.session import cut


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def _part() -> Column:
    return F.shiftright("_at", 33)


def _offset(before: dict[int, int]) -> Column:
    if not before:
        return F.lit(0).cast("bigint")
    return F.element_at(F.create_map(*(x for p, n in before.items() for x in (F.lit(p), F.lit(n).cast("bigint")))), _part())


def ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``rank`` from 0 in the given order, and the number of rows.

    Rows are sorted by range; a row's rank is the rows of the partitions before its own, of which only one count each reaches the
    driver, and its place in its partition.
    """
    placed = _placed(df, order)
    before, total = {}, 0
    for r in placed.groupBy(_part().alias("p")).count().orderBy("p").collect():
        before[r["p"]] = total
        total += r["count"]
    return placed.withColumn("rank", _offset(before) + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at"), total


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and with this one, in the given order."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    placed = _placed(df.withColumn("_v", F.coalesce(value.cast("bigint"), F.lit(0))), order)
    before, total = {}, 0
    for r in placed.groupBy(_part().alias("p")).agg(F.sum("_v").alias("s")).orderBy("p").collect():
        before[r["p"]] = total
        total += r["s"]
    rows = placed.withColumn("_b", _offset(before))
    kept = [c for c in df.columns]
    schema = T.StructType([*df.schema, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            p = b.column("_at").to_numpy() >> 33
            v, base = b.column("_v").to_numpy(), b.column("_b").to_numpy()
            out = np.empty(b.num_rows, np.int64)
            edge = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), b.num_rows]
            for i, j in zip(edge, edge[1:]):
                if p[i] != part:
                    part, so_far = p[i], 0
                c = np.cumsum(v[i:j]) + so_far
                so_far = int(c[-1])
                out[i:j] = c + base[i:j]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out)], [*kept, name])

    return rows.mapInArrow(run, schema)
