"""Parent-child rows to full hierarchies by pointer doubling.

Every node holds a pointer to its parent. In each round the pointer is replaced by the
pointer's pointer, so after r rounds it spans 2**r arcs, and the path segments of both
halves are joined. After ceil(log2(n)) + 1 rounds of a tree with n nodes, whatever still
points at a node hangs on a cycle.

Trees of ordinary size are co-located by one shuffle and doubled many trees at a time on
arrays. A tree above ``giant`` nodes is never brought into one task: it is doubled by
distributed self-joins on (tree, node). Nodes that have reached their root leave the rounds, and those
whose pointers meet in one node, as all of a wide tree do in its root, are spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.operators.joins import split_join
from arbora.session import cut

GIANT = 200_000


def whole_number(c: Column) -> Column:
    """The string as a bigint if it is plain digits, else null."""
    return F.when(c.rlike(r"^[0-9]{1,18}$"), c.try_cast("bigint"))


def hierarchy(df: DataFrame, tree: str, node: str, parent: str, label: str | None = None, *, cycles_only: bool = False, giant: int = GIANT) -> DataFrame:
    """One row per node: ``tree, node, parent, depth, root, path, label_path, n_descendants, cyclic, cycle_id``.

    ``node`` and ``parent`` are bigint columns. A chain ends at parent 0, at a null parent and
    at a parent that is no node of the tree; such a node is its own root, with depth 0. ``path``
    runs from the root to the node itself, ``label_path`` names the same nodes by ``label``.
    A node from which the chain never ends has ``cyclic`` true, null depth, root, path and
    ``n_descendants``, and in ``cycle_id`` the smallest node of the cycle it ends in.
    Rows with a null tree or node are no nodes. Repeated (tree, node) rows count once, with the
    smallest parent, then label; null sorts first. Empty input gives no rows. Other columns
    are not read.
    ``cycles_only`` gives ``tree, node, cycle_id`` of cyclic nodes and builds no paths.
    """
    lab = F.col(label).cast("string") if label and not cycles_only else F.lit(None).cast("string")
    rows = df.select(F.col(tree).alias("tree"), F.col(node).cast("bigint").alias("node"), F.when(F.col(parent) != 0, F.col(parent).cast("bigint")).alias("parent"), lab.alias("label")).where("tree is not null and node is not null")
    if cycles_only:
        rows = rows.drop("label")
    big = rows.groupBy("tree").count().where(F.col("count") > giant).select("tree", "count")
    largest = big.agg(F.max("count")).first()[0]
    if largest is None:
        return _packed(rows, cycles_only)
    big = cut(big)
    small = _packed(rows.join(big, "tree", "left_anti"), cycles_only)
    return small.unionByName(_doubled(rows.join(big.select("tree"), "tree", "left_semi"), int(largest), cycles_only))


def descendants(h: DataFrame) -> DataFrame:
    """(tree, ancestor, descendant, distance) of a hierarchy, one row per pair; cyclic nodes have none."""
    at = h.where(~F.col("cyclic")).select("tree", "node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return at.where(F.col("at") < F.col("depth")).select("tree", "ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("at")).cast("int").alias("distance"))


# ------------------------------------------------------------------ many trees on arrays


def _schema(tree_type: T.DataType, cycles_only: bool) -> T.StructType:
    s = T.StructType().add("tree", tree_type).add("node", "long")
    if cycles_only:
        return s.add("cycle_id", "long")
    s = s.add("parent", "long").add("depth", "integer").add("root", "long").add("path", T.ArrayType(T.LongType()))
    return s.add("label_path", T.ArrayType(T.StringType())).add("n_descendants", "long").add("cyclic", "boolean").add("cycle_id", "long")


def _packed(rows: DataFrame, cycles_only: bool) -> DataFrame:
    order = ["tree", "node", "parent"] + ([] if cycles_only else ["label"])
    placed = rows.repartition("tree").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_trees(batches):
            yield from _double_arrays(t, cycles_only).to_batches()

    return placed.mapInArrow(run, _schema(rows.schema["tree"].dataType, cycles_only))


def whole_trees(batches: Iterator[pa.RecordBatch], key: str = "tree") -> Iterator[pa.Table]:
    """Tables that end where a tree ends, of batches sorted by tree."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        last = b.num_rows - 1
        changed = np.flatnonzero(pc.not_equal(k, k[last]).to_numpy(zero_copy_only=False))
        if kept and kept[-1].column(key)[-1].as_py() != k[0].as_py():
            yield pa.Table.from_batches(kept)
            kept = []
        if len(changed):
            end = int(changed[-1]) + 1
            yield pa.Table.from_batches([*kept, b.slice(0, end)])
            kept = [b.slice(end)]
        else:
            kept.append(b)
    if kept:
        yield pa.Table.from_batches(kept)


def _gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each (start, length), end to end."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


def _double_arrays(t: pa.Table, cycles_only: bool) -> pa.Table:
    t = t.combine_chunks()
    tree = t.column("tree").combine_chunks()
    node = t.column("node").to_numpy()
    new_tree = np.ones(len(node), bool)
    if len(node) > 1:
        new_tree[1:] = pc.not_equal(tree[1:], tree[:-1]).to_numpy(zero_copy_only=False)
    first = new_tree.copy()
    first[1:] |= node[1:] != node[:-1]
    keep = np.flatnonzero(first)
    ordinal = np.cumsum(new_tree)[keep]
    node = node[keep]
    parent = t.column("parent").combine_chunks().take(pa.array(keep))
    linked = np.asarray(parent.is_valid())
    up = parent.fill_null(0).to_numpy(zero_copy_only=False)
    n = len(node)
    # rank of (tree, node) pairs: nodes are sorted, so a parent is found by bisection over one combined key
    values = np.unique(node)
    span = len(values) + 1
    key = ordinal * span + np.searchsorted(values, node)
    where = np.searchsorted(values, up)
    known = linked & (where < len(values))
    known[known] = values[where[known]] == up[known]
    want = ordinal * span + where
    at = np.searchsorted(key, want)
    known &= at < n
    known[known] = key[at[known]] == want[known]
    ptr = np.full(n + 1, n)
    ptr[:n][known] = at[known]
    parent_of = ptr[:n].copy()

    largest = int(np.bincount(ordinal).max()) if n else 0
    rounds = (max(1, math.ceil(math.log2(largest))) + 1) if largest > 1 else 1
    low = np.append(node, np.iinfo(np.int64).max)
    steps = (ptr != n).astype(np.int64)
    top = np.where(ptr == n, np.arange(n + 1), ptr)  # the furthest node seen so far
    for _ in range(rounds):
        if not (ptr[:n] != n).any():
            break
        low = np.minimum(low, low[ptr])
        steps = steps + np.where(ptr == n, 0, steps[ptr])
        top = np.where(ptr == n, top, top[ptr])
        ptr = ptr[ptr]
    cyclic = ptr[:n] != n
    names = tree.take(pa.array(keep))
    cycle = pa.array(low[ptr[:n]], mask=~cyclic)
    if cycles_only:
        hit = pa.array(np.flatnonzero(cyclic))
        return pa.table({"tree": names.take(hit), "node": pa.array(node).take(hit), "cycle_id": cycle.take(hit)})

    # path segments: the second half is the node's own, the first half its pointer's
    ptr = np.append(np.where(cyclic, n, parent_of), n)
    ptr[:n][(ptr[:n] != n) & np.append(cyclic, True)[ptr[:n]]] = n
    lens = np.append((~cyclic).astype(np.int64), 0)
    offs = np.concatenate([[0], np.cumsum(lens)])
    vals = np.flatnonzero(~cyclic)
    while (ptr[:n] != n).any():
        both = np.empty((n + 1, 2), np.int64)
        both[:, 0], both[:, 1] = offs[:-1][ptr], offs[:-1]
        size = np.empty((n + 1, 2), np.int64)
        size[:, 0], size[:, 1] = np.where(ptr == n, 0, lens[ptr]), lens
        vals = vals[_gather(both.ravel(), size.ravel())]
        lens = size.sum(1)
        offs = np.concatenate([[0], np.cumsum(lens)])
        ptr = ptr[ptr]
    own = np.bincount(vals, minlength=n)[:n] - 1
    mask = pa.array(cyclic)

    def lists(v: pa.Array) -> pa.Array:
        out = pa.ListArray.from_arrays(pa.array(offs[: n + 1].astype(np.int32)), v)
        return pc.if_else(mask, pa.scalar(None, out.type), out)

    labels = t.column("label").combine_chunks().take(pa.array(keep))
    return pa.table(
        {
            "tree": names,
            "node": pa.array(node),
            "parent": parent,
            "depth": pa.array(steps[:n].astype(np.int32), mask=cyclic),
            "root": pa.array(np.append(node, 0)[top[:n]], mask=cyclic),
            "path": lists(pa.array(node[vals])),
            "label_path": lists(labels.take(pa.array(vals))),
            "n_descendants": pa.array(own, mask=cyclic),
            "cyclic": mask,
            "cycle_id": cycle,
        }
    )


# ------------------------------------------------------------------ giant trees by joins


def _doubled(rows: DataFrame, largest: int, cycles_only: bool) -> DataFrame:
    lab = F.lit(None).cast("string") if cycles_only else F.col("label")
    one = rows.groupBy("tree", "node").agg(F.min(F.struct(F.col("parent"), lab.alias("label"))).alias("s")).select("tree", "node", "s.parent", "s.label")
    ids = one.select("tree", F.col("node").alias("parent"), F.lit(True).alias("found"))
    s = split_join(one, ids, ["tree", "parent"], "node", how="left").select("tree", "node", "parent", F.when(F.col("found"), F.col("parent")).alias("ptr"), F.col("node").alias("low"), F.when(F.col("found"), F.col("parent")).alias("top"), F.array("node").alias("path"), F.array("label").alias("labels"))
    if cycles_only:
        s = s.drop("path", "labels", "top")
    s = cut(s)
    done = s.where("ptr is null")
    going = s.where("ptr is not null")
    for _ in range(math.ceil(math.log2(max(2, largest))) + 1):
        if going.isEmpty():
            break
        every = done.unionByName(going)
        o = every.select("tree", F.col("node").alias("ptr"), *(F.col(c).alias("o_" + c) for c in s.columns if c not in ("tree", "node", "parent")))
        cols = ["tree", "node", "parent", F.col("o_ptr").alias("ptr"), F.least("low", "o_low").alias("low")]
        if not cycles_only:
            cols += [F.coalesce("o_top", "top").alias("top"), F.concat("o_path", "path").alias("path"), F.concat("o_labels", "labels").alias("labels")]
        new = cut(split_join(going, o, ["tree", "ptr"], "node").select(*cols))
        done = done.unionByName(new.where("ptr is null"))
        going = new.where("ptr is not null")
    s = done.unionByName(going)
    on = s.select("tree", F.col("node").alias("ptr"), F.col("low").alias("cycle_id"))
    bad = split_join(going.select("tree", "node", "parent", "ptr"), on, ["tree", "ptr"], "node")
    if cycles_only:
        return bad.select("tree", "node", "cycle_id")
    good = done
    own = good.select("tree", F.explode("path").alias("node")).groupBy("tree", "node").count()
    good = good.join(own, ["tree", "node"]).select("tree", "node", "parent", (F.size("path") - 1).alias("depth"), F.coalesce("top", "node").alias("root"), "path", F.col("labels").alias("label_path"), (F.col("count") - 1).alias("n_descendants"), F.lit(False).alias("cyclic"), F.lit(None).cast("bigint").alias("cycle_id"))
    none = {"depth": "int", "root": "bigint", "path": "array<bigint>", "label_path": "array<string>", "n_descendants": "bigint"}
    return good.unionByName(bad.select("tree", "node", "parent", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.lit(True).alias("cyclic"), "cycle_id"))
