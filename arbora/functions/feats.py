"""FEATS strings as sets of key-value pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feats_pairs(c: Column) -> Column:
    """Sorted array of (k, v): items between bars that have a ``=``, split at the first one, trimmed; ``_``, empty and null give none."""
    items = F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.instr(x, "=") > 0)
    return F.array_sort(F.transform(items, _pair))


def _pair(x: Column) -> Column:
    return F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)).alias("v"))
