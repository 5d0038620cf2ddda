"""Passages in columns of any table, in attributes and in angle brackets."""

import random

from arbora.llm.leaks import find_leaks

rng = random.Random(3)
WORDS = ["".join(rng.choice("bdgklmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
ITEM = rng.sample(WORDS, 36)
PASSAGE = " ".join(ITEM)
OTHER = " ".join(rng.sample(WORDS, 60))


TEXTS = [
    f"17\twol\t{PASSAGE}\n18\twol\t{OTHER}",
    f"id\tlang\ttext\n17\t{OTHER}\t{PASSAGE}\t0",
    "".join(f"{i}\twol\t{' '.join(ITEM[i : i + 6])}\n" for i in range(0, 36, 6)),
    f'<a title="{PASSAGE}">{OTHER}</a>',
    f"{OTHER} <{PASSAGE}> {OTHER}",
    "".join(f"{i}\t{w}\t{w}x\tNOUN\t_\t_\t0\troot\t_\tGloss=y\n" for i, w in enumerate(ITEM, 1)),
    " ".join(f"<b>{w}</b>" for w in ITEM),
    PASSAGE,
]


def leaks(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    return find_leaks(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()


def test_found_in_any_layout(spark):
    got = leaks(spark, [*TEXTS, OTHER, ""], [(7, PASSAGE)])
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, 7) for i in range(len(TEXTS))]
    assert all(r["share"] >= 0.5 for r in got)


def test_phrases_in_markup_are_no_leak(spark):
    text = f"17\twol\t{' '.join(ITEM[:5])}\t{OTHER}\n<b title='{' '.join(ITEM[9:13])}'>{OTHER}</b>"
    assert not leaks(spark, [text], [(7, PASSAGE)])


def test_short_items_from_the_floor_on(spark):
    """Items of 16 letters and more that stand inside a document are all found, fewer letters are a phrase."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(n))
    items, docs = [], []
    for n in (15, 16, 17, 18, 19, 20, 30):
        for _ in range(60):
            t = letters(n)
            items.append((len(items), f"{t[:5]} {t[5:9]} {t[9:]}"))
            docs.append(f"{letters(rng.randint(0, 90))} {t[:5]} {t[5:9]} {t[9:]} {letters(rng.randint(0, 90))}")
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(spark, docs, items))
    assert got == [(i, i) for i in range(60, len(items))]


def test_repeated_runs(spark):
    """A text that repeats a few letters has hits on every diagonal and is still one pair."""
    ha, ho = "ha ha " * 1500, "ho ho ho, and a little more of it. " * 40
    got = leaks(spark, [ha, ho, ha + ho, "ha ha ha", "x " * 4000], [(1, ha), (2, ho), (3, "ha ha " * 30)])
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 1), (0, 3), (1, 2), (2, 1), (2, 2), (2, 3)}
    assert all(r["share"] == 1.0 for r in got)


def test_hot_fingerprints_are_spread(spark, monkeypatch):
    """One passage in a third of all documents, with every key in pieces of five rows; extra and clashing columns are not read."""
    from arbora.operators import joins

    monkeypatch.setattr(joins, "TOGETHER", 5)
    docs = [(i, PASSAGE if i % 3 == 0 else " ".join(rng.sample(WORDS, 40)), 3, 4) for i in range(90)]
    d = spark.createDataFrame([*docs, (None, PASSAGE, 3, 4)], "doc_id bigint, text string, item int, h int")
    b = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE + " " + OTHER), (3, OTHER), (1, PASSAGE), (None, OTHER)], "item_id bigint, text string")
    got = [(r["doc_id"], r["item_id"]) for r in find_leaks(d, b).collect()]
    assert sorted(got, key=str) == sorted([(i, 1) for i in range(0, 90, 3)] + [(None, 1)], key=str)


def test_bitmap_that_lets_all_pass(spark, monkeypatch):
    """More fingerprints than bits: slower, but the same rows."""
    from arbora.llm import leaks as module

    monkeypatch.setattr(module, "MOST_BITS", 6)
    got = leaks(spark, [*TEXTS, OTHER], [(7, PASSAGE)])
    assert sorted(r["doc_id"] for r in got) == list(range(len(TEXTS)))
