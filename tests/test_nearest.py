"""Searches for many targets give what a search for each target alone gives."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from arbora.operators import frames, nearest, selection
from arbora.plans import corpus_queries

DATA = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def gold(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for s in range(60):
        alike = s % 3 == 0  # a third of the sentences have one profile
        for i in range(1, 8 if alike else rng.randint(2, 25)):
            upos, rel = ("NOUN", "mod") if alike else (rng.choice(["NOUN", "VERB", "ADV", "*"]), rng.choice(["subj", "mod", "det", "root", f"r{s % 7}", "*"]))
            head = 0 if s % 10 == 4 else rng.randint(0, i)  # some have no arc
            rows.append((n, s, str(i), f"w{n}", "l", upos, "_", str(head), rel, rng.choice(["_", "x*Gloss=y"])))
            n += 1
    t = spark.createDataFrame(rows, "row_id bigint, sent_idx bigint, id string, form string, lemma string, upos string, feats string, head string, deprel string, misc string")
    return frames.gold_tokens(t).cache()


@pytest.mark.parametrize("block", [nearest.BLOCK, 4])
def test_each_target(gold, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "ROWS", 9)
    f = frames.sentence_features(gold).cache()
    asked = F.col("sent_idx") % 5 == 0
    for k in (3, 99):
        got = {}
        for r in selection.similar_sentences_each(f, f.where(asked), k).orderBy("target", F.desc("similarity"), "sent_idx").collect():
            got.setdefault(r["target"], []).append((r["sent_idx"], r["similarity"]))
        assert sorted(got) == list(range(0, 60, 5))
        for t in (0, 5, 25, 55):
            alone = selection.similar_sentences(f, gold, t, 99).collect()
            assert got[t] == [(r[0], pytest.approx(r[1], abs=2e-9)) for r in alone if r[0] != t][:k]


def test_arcs_of_each_target(gold):
    p = selection.arc_features(gold).cache()
    got = {}
    for r in selection.similar_arcs_each(gold, p, p.where(F.col("sent_idx") % 5 == 0), 4).collect():
        got.setdefault(r["target"], []).append(tuple(r)[1:-1])
    assert sorted(got) == list(range(0, 60, 5))
    a = frames.arcs(gold)
    for t in (0, 5, 55):
        assert sorted(got[t]) == sorted(tuple(r)[:-1] for r in selection.similar_arcs(a, gold, t, 4).collect())


def test_no_targets(gold):
    f = frames.sentence_features(gold)
    assert selection.similar_sentences_each(f, f.limit(0), 3).count() == 0
    assert selection.similar_sentences_each(f.limit(0), f.limit(2), 3).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["similarity_search", "similar_arcs_search"])
def test_all_targets_of_the_tables(spark, name):
    want = spark.read.parquet(f"{DATA}/tokens.parquet").where("sent_idx % 100 = 0 and id rlike '^[0-9]+$'").select("sent_idx").distinct().count()
    n = corpus_queries.QUERIES[name](spark, str(DATA)).groupBy("target").count().collect()
    assert len(n) == want > 1 and {r["count"] for r in n} == {10}
