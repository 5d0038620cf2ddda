"""The consistent form and the term counts."""

import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arbora.llm import ngrams
from arbora.llm.script import DRAWN, TWINS, Fold, Transducer, fold_table, inconsistent, mapping, plain_pattern, twins, words

CASES = {
    "Ｆｉdｒoｒ": "Fidror",
    "са": "ca",
    "Ξυδωλα": "Ξυδωλα",
    "фозджил": "фозджил",
    "t‌ém": "tém",
    "tém": "tém",
    "ọ́": "ọ́",
    "о̣́k": "ọ́k",
    "wuuﬁ": "wuufi",
    "Kingadu": "Kingadu",
    "½ di12²": "½ di12²",
    "h﻿u　a  b": "hu a  b",
    "kanɡa": "kanga",
    "；": ";",
    "ё": "ë",
    "Дылафо cа": "Дылафо ca",
    "​": "",
    "": "",
    "e‍́": "é",
    "ا‌ب": "اب",
    "ɓɗƙŋṣ": "ɓɗƙŋṣ",
    "ԚUEEN": "QUEEN",
    "Ԝater": "Water",
    "Ӏdea": "Idea",
    "Үsa": "Ysa",
    "ѵery": "very",
    "Ϲat": "Cat",
    "ϲat": "cat",
    "Ѵиктор": "Ѵиктор",
    "ЁЇΆϊ": "ËÏÁϊ".replace("ϊ", "ï"),
    "Ꭺxe օr": "Axe or",
    "Հայ": "Հայ",
}


@pytest.mark.parametrize("s", CASES)
def test_consistent_form(s):
    form = Transducer()
    assert form(s) == CASES[s]
    assert form(form(s)) == CASES[s]


def test_mapping_has_no_conflicts():
    m = mapping()
    assert not any(x in m for t in m.values() for x in t)
    assert set(DRAWN) <= set(m)


@pytest.mark.parametrize("c", sorted(twins()))
def test_every_twin(c):
    """Alone, in a Latin word, and in a word that is not Latin."""
    form = Transducer()
    assert form(c) == twins()[c] and form(f"x{c}x") == unicodedata.normalize("NFC", f"x{twins()[c]}x")
    assert form(f"ж{c}") == unicodedata.normalize("NFC", f"ж{c}")


def test_twins_have_no_conflicts():
    assert not twins().keys() & mapping().keys()
    assert not any(x in twins() or x in mapping() for t in twins().values() for x in t)
    assert set(TWINS) < set(twins())


def test_every_source_of_the_mapping():
    form = Transducer()
    for c, t in mapping().items():
        latin = "".join(twins().get(x, x) for x in t)  # a bold Greek letter, say, that has a twin
        assert form(c) == unicodedata.normalize("NFC", latin if len(t) == 1 else t), hex(ord(c))


def test_plain_letters_are_consistent():
    form = Transducer()
    python = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", plain_pattern())
    seen = [chr(cp) for cp in range(0x3000) if re.match(python[:-1] + r"\Z", chr(cp))]
    assert set("abzAZ019 ,.;éñŋƙ×€"[:-1]) <= set(seen) and not set("аά​Ａﬁ") & set(seen)
    for c in seen:
        assert form(c) == c, hex(ord(c))
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(seen) for _ in range(6))
        assert form(t) == t


def test_one_pass_is_enough():
    rng = random.Random(3)
    pool = list(mapping())[:400] + list(TWINS) + [chr(c) for c in range(0x300, 0x330)] + list("abcéọñ .,1ξдب​　")
    form = Transducer(keep=50)
    for _ in range(3000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))
        t = form(s)
        assert form(t) == t
        assert unicodedata.is_normalized("NFC", t)
        assert not any(c in mapping() for c in t)


def test_inconsistent(spark):
    rows = [(1, "са", None, "x"), (2, "plain", "tém", "x"), (2, "plain", "tém", "x"), (3, "", "é", "x"), (4, "a" * 70_000 + "​", None, None)]
    df = spark.createDataFrame(rows, "row_id bigint, form string, lemma string, clean string")
    got = Counter((r["field"], r["rec_id"], r["clean"][:5]) for r in inconsistent(df, "row_id", ["form", "lemma"]).collect())
    assert got == {("form", 1, "ca"): 1, ("lemma", 2, "tém"): 2, ("form", 4, "aaaaa"): 1}
    assert inconsistent(df.limit(0), "row_id", ["form"]).count() == 0


def test_fold():
    f = Fold()
    assert words("Tém, TÉM​ tém—ｔｅｍ", f) == ["tem"] * 4
    t = fold_table()
    for c in "aAéÉŋŊ ,\n1１сСﬁ":
        assert chr(t[ord(c)]) == (f[ord(c)][:1] or "\0")


# ------------------------------------------------------------------------------ counts


def brute(rows, n):
    """Every row starts its n-grams, which go on with the least term of each next position."""
    occ, rec = Counter(), {}
    at = {}
    for r, p, t in rows:
        if r is not None and t is not None and p is not None:
            at[r, p] = min(t, at.get((r, p), t))
    for r, p, t in rows:
        if r is None or t is None:
            continue
        g = (t,)
        for k in range(1, n + 1):
            occ[k, g] += 1
            rec.setdefault((k, g), set()).add(r)
            if p is None or (r, p + k) not in at:
                break
            g = (*g, at[r, p + k])
    return {key: (c, len(rec[key])) for key, c in occ.items()}


@pytest.mark.parametrize("n, long", [(1, 10**6), (2, 10**6), (3, 10**6), (8, 10**6), (3, 3), (8, 3)])
def test_ngram_counts(spark, monkeypatch, n, long):
    monkeypatch.setattr(ngrams, "LONG", long)
    monkeypatch.setattr(ngrams, "STRETCH", 16)
    rng = random.Random(n)
    rows = [(7, p, t) for p, t in enumerate("aabababbbabaab" * 9)] + [(7, None, "a"), (7, None, "b")]  # a long record
    rows += [(rng.choice([1, 2, 3, 4, 5, None]) if i % 9 == 0 else i // 7, i % 7, rng.choice(["hot", "hot", "hot", "a", "b", "", None])) for i in range(400)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "rec bigint, pos int, term string, k int, gram string")
    got = {(r["k"], tuple(r["gram"].split(ngrams.JOINT))): (r["occurrences"], r["records"]) for r in ngrams.ngram_counts(df, "rec", "pos", "term", n).collect()}
    assert got == brute(rows, n)


def test_fields_and_levels_from_one_array(spark):
    rng = random.Random(5)
    rows = [(i // 9, i % 9, rng.choice("xyz"), rng.choice(["p", "q", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "r bigint, p int, a string, b string")
    every = ngrams.gram_counts(df, "r", ["a", "b"], 4, position=F.col("p")).collect()
    for f, i in (("a", 2), ("b", 3)):
        assert {(r["k"], tuple(r["gram"].split(ngrams.JOINT))): (r["occurrences"], r["records"]) for r in every if r["field"] == f} == brute([(x[0], x[1], x[i]) for x in rows], 4)
    some = ngrams.gram_counts(df, "r", ["a", "b"], 4, position=F.col("p"), levels=[1, 3]).collect()
    assert sorted(some) == sorted(r for r in every if r["k"] in (1, 3))
    assert ngrams.gram_counts(df.limit(0), "r", ["a"], 4, position=F.col("p")).count() == 0


def test_term_counts_and_marks(spark):
    rows = [(s, "hot" if s % 3 else f"w{s}", None if s % 2 else "X") for s in range(1, 101)] + [(1, "hot", "X")] * 5 + [(None, "hot", "X")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "sent_idx bigint, form string, upos string, term string")
    c = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in ngrams.marked(ngrams.term_counts(df, "sent_idx", ["form", "upos"]), ngrams.record_total(df, "sent_idx")).collect()}
    assert c["form", "hot"] == (67 + 5, 67, "common")
    assert c["form", "w3"] == (1, 1, "rare")
    assert c["upos", "X"] == (50 + 5, 51, "common")
    assert ngrams.term_counts(df.limit(0), "sent_idx", ["form"]).count() == 0


def test_any_character_may_stand_in_a_term(spark):
    odd = ["a\x1fb", "\x1e", "\x1e0", "\x1e1\x1f", "", None, "\x1f", "plain|$1"]
    df = spark.createDataFrame([(i, x, y) for i, x in enumerate(odd) for y in odd], "r bigint, a string, b string")
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in ngrams.term_counts(df, "r", ["a", "b"]).collect()}
    assert got == {("a", x): (8, 1) for x in odd if x is not None} | {("b", x): (8, 8) for x in odd if x is not None}


def test_exactly_a_fifth_is_not_common(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else f"b{i}") for i in range(35)], "r bigint, t string")
    m = ngrams.marked(ngrams.term_counts(df, "r", ["t"]), 35).where("term = 'a'").first()
    assert m["records"] == 7 and m["mark"] is None
