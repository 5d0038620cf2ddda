"""Few-shot selection: seeded draws, greedy cover, similarity, strata, ranks and arcs.

Order decides ties everywhere; it is the order of ``sent_idx`` (and ``id`` within a sentence).
All strategies give the whole corpus where at least as many examples are wanted as there are.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from arbora.operators.frames import arcs as arcs_of
from arbora.operators.nearest import nearest
from arbora.operators.ordered import ranked
from arbora.operators.statistics import document_frequency, length_bucket, pattern_counts, rare_values, relation_counts
from arbora.session import cut

# The order of relations, and what a pattern seen twice adds to an arc's clarity.
USUAL = 3
PRIORITY = ["subj", "comp:obj", "comp:obl", "mod", "det", "conj", "flat"]
STRATEGIES = ("random", "diversity", "coverage", "stratified", "complexity")
#: A bound for the turns of the greedy strategies, each of which is a job.
MOST_TURNS = 10_000
#: A bound for the labels of a corpus, which the greedy strategies keep on the driver.
MOST_LABELS = 100_000


# ------------------------------------------------------------------------------ seeded draws


def _mixed(seed: int, *keys: str) -> Column:
    """A digest of the seed and the keys, by which rows come in an order of their own; any engine can make it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def drawn(n: int, k: int, seed: int) -> list[int]:
    """The positions that CPython's generator draws from n, in the order drawn."""
    return random.Random(seed).sample(range(n), min(k, n))


def random_selection(df: DataFrame, k: int, seed: int = 42, order: str = "sent_idx") -> DataFrame:
    """(all columns, draw): rows at the positions that Python's ``random.sample`` draws, draw from 0."""
    r, n = ranked(df, [order])
    at = drawn(n, k, seed)
    places = df.sparkSession.createDataFrame(list(zip(at, range(len(at)))), "rank bigint, draw int")
    return r.join(places, "rank").drop("rank")


#: Rows up to which a split can follow Python's own shuffle, whose permutation is made on the driver.
MOST_SHUFFLED = 2_000_000


def train_test_split(df: DataFrame, share: float = 0.2, seed: int = 42, order: str = "sent_idx", like_python: bool = False) -> DataFrame:
    """``df`` with ``part``: rows shuffled by seed, the first ``int(n * (1 - share))`` for training.

    The permutation is made of a hash, so no list of rows is needed on the driver. ``like_python`` takes that of
    ``random.shuffle`` instead, for at most ``MOST_SHUFFLED`` rows.
    """
    if like_python:
        r, n = ranked(df, [order])
        if n > MOST_SHUFFLED:
            raise ValueError(f"more than {MOST_SHUFFLED} rows")
        at = list(range(n))
        random.Random(seed).shuffle(at)
        train = df.sparkSession.createDataFrame([(i, "train") for i in at[: int(n * (1 - share))]], "rank bigint, part string")
        return r.join(train, "rank", "left").withColumn("part", F.coalesce("part", F.lit("test"))).drop("rank")
    mixed = df.withColumn("_h", _mixed(seed, order))
    r, n = ranked(mixed, ["_h", order])
    return r.withColumn("part", F.when(F.col("rank") < int(n * (1 - share)), "train").otherwise("test")).drop("rank", "_h")


# ------------------------------------------------------------------------------ greedy strategies


def _labels(df: DataFrame) -> dict[str, int]:
    rows = df.limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    return {r["value"]: r["df"] for r in rows}


def _new(column: str, covered: set[str]) -> Column:
    if not covered:
        return F.col(column)
    return F.array_except(F.col(column), F.array(*(F.lit(x) for x in sorted(covered))))


def _without(features: DataFrame, chosen: list) -> DataFrame:
    return features.where(~F.col("sent_idx").isin([r["sent_idx"] for r in chosen])) if chosen else features


def _chosen(features: DataFrame, chosen: list) -> DataFrame:
    """(sent_idx, turn) of the chosen rows."""
    kind = features.schema["sent_idx"].dataType.simpleString()
    rows = [(r["sent_idx"], i) for i, r in enumerate(chosen)]
    return features.sparkSession.createDataFrame(rows, f"sent_idx {kind}, turn int")


def coverage_selection(features: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(sent_idx, turn): greedy cover of relations, rare ones weighing more.

    Each turn is one aggregate over the features with what is covered so far as literals. Only the winner
    of a turn comes to the driver.
    """
    if k > MOST_TURNS:
        raise ValueError(f"more than {MOST_TURNS} turns")
    features = cut(features)
    if k >= features.count():
        return features.select("sent_idx", F.lit(None).cast("int").alias("turn"))
    df = _labels(document_frequency(gold, "deprel"))
    weight = F.create_map(*(x for r in sorted(df) for x in (F.lit(r), F.lit(1.0 / (df[r] + 1)))))
    chosen: list = []
    covered: set[str] = set()
    for _ in range(k):
        fresh = F.aggregate(_new("relations", covered), F.lit(0.0), lambda acc, r: acc + F.coalesce(weight[r], F.lit(0.0)))
        score = fresh + F.col("gloss_coverage") * 0.5
        if chosen:
            mean = sum(r["n_tokens"] for r in chosen) / len(chosen)
            score = score + F.least(F.abs(F.col("n_tokens") - mean) / mean, F.lit(0.5))
        best = _best(_without(features, chosen), score)
        if best is None:
            break
        chosen.append(best)
        covered |= set(best["relations"])
    return _chosen(features, chosen)


def _best(rows: DataFrame, score: Column):
    """The row with the largest score, the first of equals."""
    s = rows.withColumn("_s", F.round(score, 9))
    r = s.agg(F.max_by(F.struct("sent_idx", "relations", "tags", "n_tokens"), F.struct("_s", (-F.col("sent_idx")).alias("o"))).alias("b")).first()
    return r["b"]


def diversity_selection(features: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(sent_idx, turn): first sentences with rare relations that add a label, in order, then the most new labels.

    In the first phase, too, each turn finds the next sentence by an aggregate: the first one behind the last chosen that has a rare
    relation and adds a relation or a tag.
    """
    if k > MOST_TURNS:
        raise ValueError(f"more than {MOST_TURNS} turns")
    features = cut(features)
    if k >= features.count():
        return features.select("sent_idx", F.lit(None).cast("int").alias("turn"))
    rare = sorted(_labels(rare_values(document_frequency(gold, "deprel"))))
    chosen: list = []
    rel: set[str] = set()
    tags: set[str] = set()

    def take(r) -> None:
        chosen.append(r)
        rel.update(r["relations"])
        tags.update(r["tags"])

    after = None
    while rare and len(chosen) < k:
        rows = features.where(F.arrays_overlap("relations", F.array(*map(F.lit, rare))) & ((F.size(_new("relations", rel)) > 0) | (F.size(_new("tags", tags)) > 0)))
        if after is not None:
            rows = rows.where(F.col("sent_idx") > after)
        r = rows.agg(F.min_by(F.struct("sent_idx", "relations", "tags", "n_tokens"), "sent_idx").alias("b")).first()["b"]
        if r is None:
            break
        take(r)
        after = r["sent_idx"]
    while len(chosen) < k:
        score = 2.0 * F.size(_new("relations", rel)) + F.size(_new("tags", tags)) + 0.3 * F.col("gloss_coverage")
        lengths = sorted({r["n_tokens"] for r in chosen})
        near = F.exists(F.array(*map(F.lit, lengths)), lambda n: F.abs(F.col("n_tokens") - n) < 3) if lengths else F.lit(False)
        r = _best(_without(features, chosen), score + F.when(near, 0.0).otherwise(0.1))
        if r is None:
            break
        take(r)
    return _chosen(features, chosen)


# ------------------------------------------------------------------------------ ranks and strata


def stratified_selection(features: DataFrame, k: int, corrected: bool = False) -> DataFrame:
    """The k sentences with the fewest relations, then glosses, then tokens.

    ``corrected`` takes ``k // 4`` (1 at least) of each length bucket first, those with the most relations, then glosses, then the least
    complexity, and fills the rest in the order above.
    """
    plain = [F.size("relations"), F.col("gloss_coverage"), F.col("n_tokens"), F.col("sent_idx")]
    if not corrected:
        return features.orderBy(*plain).limit(k)
    f = features.withColumn("bucket", length_bucket(F.col("n_tokens")))
    each = max(1, k // 4)
    best = None
    for b in ("short", "medium", "long", "very_long"):
        top = f.where(F.col("bucket") == b).orderBy(F.desc(F.size("relations")), F.desc("gloss_coverage"), "complexity", "sent_idx").limit(each)
        best = top if best is None else best.unionByName(top)
    best = cut(best.withColumn("_in", F.lit(True)))
    rest = f.join(best.select("sent_idx"), "sent_idx", "left_anti").orderBy(*plain).limit(max(0, k - best.count()))
    return best.drop("_in", "bucket").unionByName(rest.drop("bucket")).limit(k)


def complexity_selection(features: DataFrame, k: int) -> DataFrame:
    """Sentences at even ranks of complexity; the middle for one, the quarters for two."""
    r, n = ranked(features, ["complexity", "sent_idx"])
    if k >= n:
        return r.drop("rank")
    want = [n // 2] if k == 1 else [n // 4, 3 * n // 4] if k == 2 else [min(i * (n // k), n - 1) for i in range(k)]
    return r.where(F.col("rank").isin(want)).drop("rank")


def similar_sentences(features: DataFrame, gold: DataFrame, target: int, k: int) -> DataFrame:
    """(sent_idx, similarity): the k sentences most like the target; the target's few labels go into the plan as literals."""
    t = features.where(F.col("sent_idx") == target).first()
    if t is None:
        return features.limit(0).select("sent_idx", F.lit(0.0).alias("similarity"))
    df = _labels(document_frequency(gold, "deprel"))
    rel = sorted(t["relations"])
    weight = sum((F.when(F.array_contains("relations", r), F.lit(1.0 / (df.get(r, 0) + 1))).otherwise(0.0) for r in rel), F.lit(0.0))
    tags = F.size(F.array_intersect("tags", F.array(*map(F.lit, t["tags"])))) if t["tags"] else F.lit(0)
    near = lambda c, x: 1.0 / (1.0 + F.abs(F.col(c) - F.lit(x)))
    score = 3.0 * weight + 2.0 * tags + near("n_tokens", t["n_tokens"]) + near("complexity", t["complexity"]) + 0.5 * near("gloss_coverage", t["gloss_coverage"])
    return features.select("sent_idx", F.round(score, 9).alias("similarity")).orderBy(F.desc("similarity"), "sent_idx").limit(k)


def similar_sentences_each(features: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(target, sent_idx, similarity): for each row of ``targets`` the k rows of ``features`` most like it, itself left out.

    Both are frames of sentence features; relations weigh as in ``similar_sentences``, by how many rows of ``features`` have them.
    """
    df = _labels(features.select(F.explode("relations").alias("value")).groupBy("value").agg(F.count("*").alias("df")))

    def weigh(t: Row) -> dict[tuple[str, str], float]:
        return {("relations", r): 3.0 / (df.get(r, 0) + 1) for r in t["relations"]} | {("tags", x): 2.0 for x in t["tags"]}

    near = {c: partial(_inverse, w) for c, w in (("n_tokens", 1.0), ("complexity", 1.0), ("gloss_coverage", 0.5))}
    return nearest(features, targets, k, sets=["relations", "tags"], near=near, weigh=weigh).withColumnRenamed("score", "similarity")


def _inverse(weight: float, own: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return weight / (1.0 + np.abs(own - wanted))


# ------------------------------------------------------------------------------ arcs


def with_pattern_counts(arcs: DataFrame) -> DataFrame:
    """``arcs`` with ``pattern_n``: how often its relation joins its two tags."""
    return arcs.join(pattern_counts(arcs).withColumnRenamed("n", "pattern_n"), ["deprel", "upos", "head_upos"])


def clarity() -> Column:
    """How well an arc shows its relation: short sentence, usual tags, glosses, short arc."""
    s = F.when(F.col("n_tokens") <= 10, (10 - F.col("n_tokens")) * 2).otherwise(0)
    s = s + F.when(F.col("pattern_n") >= 2, USUAL).otherwise(0) + F.when(F.col("gloss") != "", 2).otherwise(0) + F.when(F.col("head_gloss") != "", 2).otherwise(0)
    return s + F.when(F.col("distance") <= 3, 1).otherwise(0)


_ARC = ["deprel", "sent_idx", "id", "form", "head", "head_form"]


def best_arcs(arcs: DataFrame) -> DataFrame:
    """The clearest arc of each relation, the first of equals.

    How often a pattern stands changes the score of all its arcs alike, so the best of each pattern is found with its count,
    then the best pattern: two map-side combined aggregates over one reading of the arcs.
    """
    a = arcs.withColumn("pattern_n", F.lit(0)).withColumn("score", clarity())
    key = F.struct((-F.col("score")).alias("s"), "sent_idx", "id")
    of = a.groupBy("deprel", "upos", "head_upos").agg(F.count("*").alias("n"), F.min_by(F.struct("sent_idx", "id", "form", "head", "head_form", "score"), key).alias("b"))
    of = of.select("deprel", "n", "b.*").withColumn("score", F.col("score") + F.when(F.col("n") >= 2, USUAL).otherwise(0))
    best = of.groupBy("deprel").agg(F.min_by(F.struct("sent_idx", "id", "form", "head", "head_form", "score"), key).alias("b"))
    return best.select("deprel", "b.*")


def frequent_arcs(arcs: DataFrame, k: int) -> DataFrame:
    """The clearest arcs of the k relations with the most arcs."""
    top = relation_counts(arcs).orderBy(F.desc("n"), "deprel").limit(k)
    return best_arcs(arcs).join(top, "deprel")


def diverse_arcs(arcs: DataFrame, k: int) -> DataFrame:
    """The clearest arcs of the relations that matter most, then of others by name."""
    b = best_arcs(arcs)
    at = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("deprel"))
    return b.orderBy(F.when(at > 0, at).otherwise(len(PRIORITY) + 1), "deprel").limit(k)


def challenging_arcs(arcs: DataFrame, k: int) -> DataFrame:
    """Long arcs, arcs of tags seen once, arcs of longer sentences; the k hardest of those above 3."""
    a = with_pattern_counts(arcs)
    s = F.when(F.col("distance") > 3, F.col("distance")).otherwise(0) + F.when(F.col("pattern_n") == 1, 3).otherwise(0) + F.when(F.col("n_tokens") > 8, 2).otherwise(0)
    return a.withColumn("score", s.cast("bigint")).where("score > 3").select(*_ARC, "score").orderBy(F.desc("score"), "sent_idx", "id").limit(k)


def similar_arcs(arcs: DataFrame, gold: DataFrame, target: int, k: int) -> DataFrame:
    """Arcs of the sentences most like the target in length and tags, the target itself left out."""
    per = gold.groupBy("sent_idx").agg(F.count("*").alias("n"), F.collect_set("upos").alias("tags"))
    t = per.where(F.col("sent_idx") == target).first()
    if t is None:
        return arcs.limit(0).select(*_ARC, F.lit(0.0).alias("score"))
    length = 1 - F.abs(F.col("n") - t["n"]) / F.lit(max(t["n"], 10))
    tags = F.size(F.array_intersect("tags", F.array(*map(F.lit, sorted(t["tags"]))))) / F.lit(len(t["tags"]))
    s = per.where(F.col("sent_idx") != target).select("sent_idx", F.round(0.4 * length + 0.6 * tags, 9).alias("score"))
    return arcs.join(s, "sent_idx").select(*_ARC, "score").orderBy(F.desc("score"), "sent_idx", "id").limit(k)


def arc_features(gold: DataFrame) -> DataFrame:
    """(sent_idx, n, tags, has_arc) by which ``similar_arcs_each`` compares sentences."""
    linked = F.arrays_overlap(F.collect_set(F.when(F.col("head") > 0, F.col("head"))), F.collect_set("id"))
    return gold.groupBy("sent_idx").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("upos")).alias("tags"), linked.alias("has_arc"))


def similar_arcs_each(gold: DataFrame, features: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(target, arc, score): for each row of ``targets`` the first k arcs of the sentences most like it, itself left out.

    ``features`` and ``targets`` are frames of ``arc_features``. All arcs of a sentence have its score, so k sentences with
    an arc hold the first k arcs, and only their tokens are read as arcs.
    """
    weigh = lambda t: {("tags", x): 0.6 / len(t["tags"]) for x in t["tags"]}
    found = cut(nearest(features.where("has_arc"), targets, k, sets=["tags"], near={"n": _relative}, weigh=weigh))
    a = arcs_of(gold.join(found.select("sent_idx").distinct(), "sent_idx", "left_semi")).select(*_ARC)
    by = Window.partitionBy("target").orderBy(F.desc("score"), "sent_idx", "id")
    return found.join(a, "sent_idx").withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k).select("target", *_ARC, "score")


def _relative(own: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return 0.4 * (1.0 - np.abs(own - wanted) / np.maximum(wanted, 10))


def random_arcs(arcs: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k arcs by a seeded hash."""
    return arcs.select(*_ARC).orderBy(_mixed(seed, "sent_idx", "id"), "sent_idx", "id").limit(k)


# ------------------------------------------------------------------------------ dispatch


def placed_selection(name: str, features: DataFrame, gold: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(sent_idx, place): the choice of a strategy with the place at which each example was chosen; an unknown name is an error."""

    def ranked_few(df: DataFrame, *order: Column | str) -> DataFrame:  # k rows at most
        return df.select("sent_idx", F.row_number().over(Window.orderBy(*order)).alias("place"))

    if name == "random":
        return random_selection(features, k, seed).select("sent_idx", F.col("draw").alias("place"))
    if name in ("diversity", "coverage"):
        chosen = (diversity_selection if name == "diversity" else coverage_selection)(features, gold, k)
        return chosen.select("sent_idx", F.coalesce("turn", F.lit(0)).alias("place"))
    if name == "stratified":
        return ranked_few(stratified_selection(features, k), F.size("relations"), "gloss_coverage", "n_tokens", "sent_idx")
    if name == "complexity":
        return ranked_few(complexity_selection(features, k), "complexity", "sent_idx")
    raise ValueError(f"unknown selection strategy: {name}")


def sentence_strategy(name: str) -> Callable[..., DataFrame]:
    """A strategy over features, gold and k; an unknown name is an error. ``similarity`` needs targets: see ``similar_sentences_each``."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown selection strategy: {name}")
    return lambda f, g, k: placed_selection(name, f, g, k).select("sent_idx")


def arc_strategy(name: str, target: int | None = None) -> Callable[..., DataFrame]:
    """A strategy over arcs, gold and k; an unknown name, or ``similar`` without a target, is random."""
    if name == "similar" and target is not None:
        return lambda a, g, k: similar_arcs(a, g, target, k).select(*_ARC)
    known: dict[str, Callable[..., DataFrame]] = {
        "diverse": lambda a, g, k: diverse_arcs(a, k).select(*_ARC),
        "frequent": lambda a, g, k: frequent_arcs(a, k).select(*_ARC),
        "challenging": lambda a, g, k: challenging_arcs(a, k).select(*_ARC),
    }
    return known.get(name, lambda a, g, k: random_arcs(a, k))
