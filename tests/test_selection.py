"""Selections that SQL does not check: seeded draws, splits, small corpora, dispatch."""

import random

import pytest
from pyspark.sql import functions as F

from arbora.operators import frames, selection, statistics


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for s in range(20):
        for i in range(1, rng.randint(3, 30)):
            rows.append((n, s, str(i), f"w{rng.randint(0, 9)}", "l", rng.choice(["NOUN", "VERB", "*"]), "_", str(rng.randint(0, i)), rng.choice(["subj", "mod", "det", "root", "rare" if s == 7 else "mod"]), "Gloss=x"))
            n += 1
    t = spark.createDataFrame(rows, "row_id bigint, sent_idx bigint, id string, form string, lemma string, upos string, feats string, head string, deprel string, misc string")
    g = frames.gold_tokens(t).cache()
    return g, frames.sentence_features(g).cache()


def test_draws_are_pythons(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(50)], "sent_idx bigint")
    for seed, k in ((42, 5), (7, 12), (1, 80)):
        want = [i * 3 for i in random.Random(seed).sample(range(50), min(k, 50))]
        assert [r["sent_idx"] for r in selection.random_selection(df, k, seed).orderBy("draw").collect()] == want


def test_split(spark):
    df = spark.range(103).withColumnRenamed("id", "sent_idx")
    s = selection.train_test_split(df)
    assert {r["part"]: r["count"] for r in s.groupBy("part").count().collect()} == {"train": int(103 * 0.8), "test": 103 - int(103 * 0.8)}
    assert s.exceptAll(selection.train_test_split(df.repartition(7))).count() == 0
    at = list(range(103))
    random.Random(42).shuffle(at)
    own = selection.train_test_split(df, like_python=True)
    assert {r["sent_idx"] for r in own.where("part = 'train'").collect()} == set(at[: int(103 * 0.8)])


@pytest.mark.parametrize("name", ["random", "diversity", "coverage", "stratified", "complexity"])
def test_sentence_strategies(corpus, name):
    g, f = corpus
    for k in (1, 2, 5, 20, 99):
        got = [r["sent_idx"] for r in selection.sentence_strategy(name)(f, g, k).collect()]
        assert len(got) == min(k, 20) == len(set(got))
    assert selection.sentence_strategy(name)(f.limit(0), g.limit(0), 3).count() == 0


def test_unknown_strategy():
    with pytest.raises(ValueError):
        selection.sentence_strategy("similarity")


@pytest.mark.parametrize("name", ["diverse", "frequent", "challenging", "similar", "anything"])
def test_arc_strategies(corpus, name):
    g, _ = corpus
    a = frames.arcs(g)
    got = selection.arc_strategy(name, target=3)(a, g, 4).collect()
    assert 0 < len(got) <= 4
    assert name != "similar" or all(r["sent_idx"] != 3 for r in got)
    assert selection.arc_strategy(name, target=3)(a.limit(0), g.limit(0), 4).count() == 0


def test_quality_of_nothing(corpus):
    g, f = corpus
    assert statistics.selection_quality(f.limit(0), f).count() == 0
    assert statistics.selection_quality(f, f.limit(0)).count() == 0
    q = statistics.selection_quality(f.limit(1), f).first()
    assert q["complexity_std"] == 0 and q["num_examples"] == 1


def test_diversity_takes_the_rare_first(corpus):
    g, f = corpus
    rare = statistics.rare_values(statistics.document_frequency(g, "deprel"))
    assert [r["value"] for r in rare.collect()] == ["rare"]
    first = selection.diversity_selection(f, g, 3).orderBy("turn").first()
    assert first["sent_idx"] == 7


def test_missing_heads_make_no_arcs(spark):
    t = spark.createDataFrame([(1, 1, "1", "a", "a", "X", "_", "9", "mod", "_"), (2, 1, "2", "b", "b", "X", "_", "1", "mod", "_")], "row_id bigint, sent_idx bigint, id string, form string, lemma string, upos string, feats string, head string, deprel string, misc string")
    a = frames.arcs(frames.gold_tokens(t)).collect()
    assert [(r["id"], r["head_form"], r["prev_form"], r["next_form"], r["position"], r["distance"]) for r in a] == [(2, "a", "a", None, 0.5, 1)]


def test_glosses(spark):
    df = spark.createDataFrame([("*Gloss=a*b|c",), ("*Gloss=a*b",), ("*Gloss=a",), ("Gloss=a|b",), ("_",), ("",)], "misc string")
    got = [(r["a"], r["c"]) for r in df.select(frames.starred_gloss(F.col("misc")).alias("a"), frames.gloss(F.col("misc")).alias("c")).collect()]
    assert got == [("a*b", "a*b"), ("a", "a*b"), ("a", "a"), ("", "a"), ("", ""), ("", "")]
