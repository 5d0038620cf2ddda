"""Pairs that share nothing but a phrase which stands in very many texts."""

import random

import pytest

from arbora.llm import overlap
from arbora.llm.overlap import common_words, split_overlap


def near(a, b, differ=0.25):
    most = max(len(a), len(b))
    return most - common_words(a, b) < differ * most


def changed(rng, ws, vocabulary, n):
    ws = list(ws)
    for _ in range(n):
        i = rng.randrange(len(ws))
        kind = rng.choice(["replace", "drop", "add", "move"])
        if kind == "replace":
            ws[i] = rng.choice(vocabulary)
        elif kind == "drop":
            del ws[i]
        elif kind == "add":
            ws.insert(i, rng.choice(vocabulary))
        else:
            ws.insert(rng.randrange(len(ws)), ws.pop(i))
    return ws


@pytest.fixture(scope="module")
def formulaic():
    """Texts around one formula, each with a copy that keeps runs of two words besides it, and copies changed anywhere."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bdgklmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    formula, rows = ["garano", "mulike", "tosade"], []

    def add(ws, split):
        rows.append((len(rows), " ".join(ws), split))

    for i in range(40):
        w = rng.sample(vocabulary, 12)
        two = [w[0:2], w[2:4], w[4:6]]
        if i % 2:  # 9 words, shared runs 2, 3, 2
            text = lambda x, y: [*two[0], x, *formula, y, *two[1]]
        else:  # 13 words, shared runs 2, 3, 3, 2
            text = lambda x, y: [*two[0], x, *formula, y, *formula, x + "z", *two[1]]
        add(text(w[6], w[7]), "train")
        add(text(w[8], w[9]), rng.choice(["dev", "test"]))
        more = [*rng.sample(vocabulary, rng.choice([6, 10, 17, 30, 44, 52])), *formula]
        add(more, "train")
        add(changed(rng, more, vocabulary, rng.randint(1, len(more) // 5)), "dev")
    return rows


@pytest.mark.parametrize("hot", [overlap.HOT, 1])
def test_hot_seeds_lose_no_pair(spark, formulaic, monkeypatch, hot):
    real = overlap.near_classes
    monkeypatch.setattr(overlap, "near_classes", lambda c, differ: real(c, differ=differ, hot=hot))
    w = {i: t.split() for i, t, _ in formulaic}
    want = {(i, j) for i, _, s in formulaic for j, _, z in formulaic if s == "train" and z != "train" and near(w[i], w[j])}
    got = {(r[0], r[1]) for r in split_overlap(spark.createDataFrame(formulaic, "sent_idx bigint, text string, split string")).collect()}
    assert len(want) >= 60 and want == got


def test_rare_keys_meet():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    rank = {x: i for i, x in enumerate(vocabulary[:9])}
    for differ in (0.1, 0.25, 0.5, 0.8):
        met = 0
        for _ in range(3000):
            a = [rng.choice(vocabulary) for _ in range(rng.randint(3, 80))]
            b = changed(rng, a, vocabulary, rng.randint(1, max(1, len(a) // 3)))
            if len(b) >= 3 and near(a, b, differ):
                met += 1
                assert set(overlap.rare_keys(a, rank, differ)) & set(overlap.rare_keys(b, rank, differ)), (a, b)
        assert met > 300


@pytest.mark.parametrize("hot", [overlap.HOT, 6, 1])
def test_short_words_and_moved_words_lose_no_pair(spark, monkeypatch, hot):
    """Words of two letters, texts from four words on, every kind of change up to the bar, and partitions that cut intervals."""
    real = overlap.near_classes
    monkeypatch.setattr(overlap, "near_classes", lambda c, differ: real(c, differ=differ, hot=hot))
    monkeypatch.setattr(overlap, "HELD", 20)
    rng = random.Random(5)
    vocabulary = [a + b for a in "bdgklm" for b in "aeiou"]
    rows = []
    for _ in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 6, 8, 9, 12, 13, 16, 30]))]
        rows.append((len(rows), " ".join(w), "train"))
        rows.append((len(rows), " ".join(changed(rng, w, vocabulary, rng.randint(1, max(1, len(w) // 4)))), rng.choice(["dev", "test"])))
    w = {i: t.split() for i, t, _ in rows}
    want = {(i, j) for i, _, s in rows for j, _, z in rows if s == "train" and z != "train" and ("".join(w[i]) == "".join(w[j]) or near(w[i], w[j]))}
    got = [(r[0], r[1]) for r in split_overlap(spark.createDataFrame(rows, "sent_idx bigint, text string, split string").repartition(3)).collect()]
    assert len(want) > 90 and sorted(got) == sorted(want)


def test_two_words_are_enough():
    """Of two texts below the bar, some optimal alignment has a run of two words, whatever the changes."""
    rng = random.Random(8)
    met = 0
    for _ in range(4000):
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 40))]
        b = changed(rng, a, "abcdefghijklmnopqrstuvwxyz", rng.randint(1, max(1, len(a) // 4)))
        if near(a, b):
            met += 1
            assert set(zip(a, a[1:])) & set(zip(b, b[1:])), (a, b)
    assert met > 1000


def test_copies_in_pieces(spark, monkeypatch):
    """A class of many copies: all pairs come out, and the counts are those of the pairs."""
    monkeypatch.setattr(overlap, "TOGETHER", 7)
    rows = [(i, "A text that stands here very often", "train" if i % 3 else "dev", "s") for i in range(90)] + [(900, "a text that stood here very often", "test", "z"), (901, None, "dev", "z")]
    df = spark.createDataFrame(rows, "sent_idx bigint, text string, split string, source string")
    got = [tuple(r) for r in split_overlap(df).collect()]
    assert len(got) == len(set(got)) == 60 * 30 + 60
    counts = sorted(tuple(r) for r in overlap.overlap_counts(df, ["split", "source"]).collect())
    assert counts == [("dev", "s", 1800, 1800, 30), ("test", "z", 60, 0, 1)]
    assert overlap.overlap_counts(df.limit(0), ["split"]).count() == 0
