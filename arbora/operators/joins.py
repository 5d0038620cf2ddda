"""Joins on keys that may hold a large part of all rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that stay together; a key with more is spread.
TOGETHER = 4096


#: Places over which left rows without a key are spread, where they are kept.
LOOSE = 64


def split_join(left: DataFrame, right: DataFrame, on: str | list[str], spread: str, *, how: str = "inner", together: int | None = None) -> DataFrame:
    """The inner or left join on the columns ``on``. The left rows of a key with many go to many tasks by a hash of ``spread``, and its right rows to each of them.

    Null keys meet nothing. No other column may stand on both sides.
    """
    keys = [on] if isinstance(on, str) else on
    most = together or TOGETHER
    if how == "inner":
        left = left.dropna(subset=keys)
    count = left.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    parts = count.select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    loose = F.when(reduce(or_, (F.col(k).isNull() for k in keys)), LOOSE).otherwise(1)
    a = left.join(parts, keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", loose)).cast("int")).drop("_parts")
    b = right.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return a.join(b, [*keys, "_part"], how).drop("_part")
