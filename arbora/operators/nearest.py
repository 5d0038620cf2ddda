"""The nearest sentences of many targets at once, over all candidates.

Candidates with the same profile (label sets and numbers) have the same score, so only the first few
of a profile by ``sent_idx`` can be among a target's nearest; the others are dropped map-side. The targets are
sent to the tasks in blocks of ``BLOCK``. Each task scores its profiles against the block as matrices and keeps
the nearest of each target; those of all tasks are ranked once more. No score is estimated and no candidate skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from arbora.session import cut

#: Targets in one block.
BLOCK = 10_000
#: Targets and profiles scored at once.
TARGETS = 1024
ROWS = 1024
#: Scores are compared to so many decimals.
DECIMALS = 9

#: The weight of each label of a target, by (column, label).
Weigh = Callable[[Row], dict[tuple[str, str], float]]
#: What a number of the candidates (a row) and of the targets (a column) adds.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


class _Targets:
    """One block of different target profiles, as matrices."""

    def __init__(self, rows: list[Row], weigh: Weigh, numbers: list[str]):
        self.n = len(rows)
        weights = [weigh(r) for r in rows]
        self.at: dict[tuple[str, str], int] = {}
        for w in weights:
            for x in w:
                self.at.setdefault(x, len(self.at))
        self.weights = [(np.array([self.at[x] for x in w], np.int64), np.array(list(w.values()), np.float64)) for w in weights]
        self.numbers = {c: np.array([r[c] for r in rows], np.float64) for c in numbers}

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first target, weights by target and label) of ``TARGETS`` each."""
        for a in range(0, self.n, TARGETS):
            own = self.weights[a : a + TARGETS]
            w = np.zeros((len(own), len(self.at)))
            for i, (at, x) in enumerate(own):
                w[i, at] = x
            yield a, w


class _Best:
    """The best ``most`` candidates of each target so far."""

    def __init__(self, targets: _Targets, sets: list[str], near: dict[str, Near], most: int):
        self.targets, self.sets, self.near, self.most = targets, sets, near, most
        self.parts = list(targets.parts())
        self.at, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(targets.n, -np.inf)

    def add(self, b: pa.RecordBatch) -> None:
        known = self.targets.at
        x = np.zeros((b.num_rows, len(known)))
        for s in self.sets:
            for i, labels in enumerate(b.column(s).to_pylist()):
                for y in labels:
                    j = known.get((s, y))
                    if j is not None:
                        x[i, j] = 1
        numbers = {c: b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in self.near}
        members = b.column("members").to_pylist()
        size = np.array([len(m) for m in members])
        first = np.cumsum(size) - size
        ids = np.array([i for m in members for i in m], np.int64)
        got = [(self.at, self.id, self.score)]
        for a, w in self.parts:
            s = w @ x.T
            for c, f in self.near.items():
                s += f(numbers[c][None, :], self.targets.numbers[c][a : a + len(w), None])
            least = self.least[a : a + len(w)]
            if b.num_rows >= self.most and np.isneginf(least).any():
                least = np.maximum(least, np.partition(s, -self.most, axis=1)[:, -self.most])
            t, c = np.nonzero(s >= least[:, None] - 10.0 ** (1 - DECIMALS))
            n = size[c]
            ends = np.cumsum(n)
            each = np.repeat(first[c] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
            got.append((np.repeat(t + a, n), ids[each], np.repeat(np.round(s[t, c], DECIMALS), n)))
        at, i, score = (np.concatenate(z) for z in zip(*got))
        order = np.lexsort((i, -score, at))
        at, i, score = at[order], i[order], score[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
        keep = rank < self.most
        self.at, self.id, self.score = at[keep], i[keep], score[keep]
        last = rank == self.most - 1
        self.least[at[last]] = score[last]


def nearest(candidates: DataFrame, targets: DataFrame, k: int, *, sets: list[str], near: dict[str, Near], weigh: Weigh) -> DataFrame:
    """(target, sent_idx, score): of each target the k candidates with the largest score, the first of equals.

    A score is the weight of the labels that both have in the columns ``sets``, plus what each number of ``near`` adds. Both frames
    have ``sent_idx`` and these columns; a target is never its own candidate.
    """
    profile = [*sets, *near]
    by = Window.partitionBy(*profile).orderBy("sent_idx")
    few = candidates.select("sent_idx", *profile).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k + 1)
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(few.groupBy(*profile).agg(F.collect_list("sent_idx").alias("members")).repartition(tasks, *profile))
    out: DataFrame | None = None
    for block in _blocks(targets.select("sent_idx", *profile)):
        part = _search(rows, block, k, sets, near, weigh)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return candidates.limit(0).select(F.col("sent_idx").alias("target"), "sent_idx", F.lit(0.0).alias("score"))
    return out


def _blocks(targets: DataFrame) -> Iterator[list[Row]]:
    block: list[Row] = []
    for r in targets.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def _search(rows: DataFrame, block: list[Row], k: int, sets: list[str], near: dict[str, Near], weigh: Weigh) -> DataFrame:
    spark = rows.sparkSession
    at: dict[tuple, int] = {}
    different: list[Row] = []
    asked = []
    for r in block:
        p = (*(tuple(r[s]) for s in sets), *(r[c] for c in near))
        if p not in at:
            at[p] = len(different)
            different.append(r)
        asked.append((at[p], r["sent_idx"]))
    sent = spark.sparkContext.broadcast(_Targets(different, weigh, list(near)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(sent.value, sets, near, k + 1)  # one more, as a target may be among its own
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                best.add(b.slice(a, ROWS))
        yield pa.RecordBatch.from_arrays([pa.array(best.at), pa.array(best.id), pa.array(best.score)], ["at", "sent_idx", "score"])

    found = rows.mapInArrow(run, "at bigint, sent_idx bigint, score double")
    order = [F.desc("score"), F.asc("sent_idx")]
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("at").orderBy(*order))).where(F.col("_n") <= k + 1).drop("_n")
    pairs = found.join(spark.createDataFrame(asked, "at bigint, target bigint"), "at").where("sent_idx <> target")
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy(*order))).where(F.col("_n") <= k).select("target", "sent_idx", "score")
