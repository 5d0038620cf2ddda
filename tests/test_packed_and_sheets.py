"""Packed fields and annotation sheets against hand-made cases and an independent parser."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.functions.packed import explode_items, items
from arbora.sources.sheets import fields, loaded, parse_records, reasons, rejected

CASES = {
    "Tense=Past|Mood=Ind": ["Tense=Past", "Mood=Ind"],
    ' Case=Nom;NounClass=Bantu1 ': ["Case=Nom", "NounClass=Bantu1"],
    "Person=2, PronType=Dem|": ["Person=2", "PronType=Dem"],
    'Mood="Ind"|;PronType=Art|;Case=Acc,Dat': ["Mood=Ind", "PronType=Art", "Case=Acc,Dat"],
    'Gloss="say ""take"""|NoSpaceAfter=Yes': ['Gloss=say "take"', "NoSpaceAfter=Yes"],
    '"Gloss=say ""take""" Note=check': ['Gloss=say "take"', "Note=check"],
    "Gloss = eat ; NoSpaceAfter = Yes": ["Gloss=eat", "NoSpaceAfter=Yes"],
    'Gloss="take=1|see"': ["Gloss=take=1|see"],
    'Gloss = "x=1"; A=b': ["Gloss=x=1", "A=b"],
    "Gloss=to go|A=b": ["Gloss=to go", "A=b"],
    "Number[psor]=Sing¦Tense=Fut": ["Number[psor]=Sing", "Tense=Fut"],
    "Gloss=school/know NoSpaceAfter=Yes": ["Gloss=school/know", "NoSpaceAfter=Yes"],
    "||A=b||": ["A=b"],
    "Gloss=a=b|C=d": ["Gloss=a=b", "C=d"],
    'Gloss="never ends|A=b': ['Gloss="never ends', "A=b"],
    "A=(x;B=1)|C=2": ["A=(x;B=1)", "C=2"],
    "A={[a=1|b=2]; (c,D=3)}|C=2": ["A={[a=1|b=2]; (c,D=3)}", "C=2"],
    "A=(x;B=1|C=2": ["A=(x", "B=1", "C=2"],
    "A=:)|B=:(|C=1": ["A=:)", "B=:(", "C=1"],
    'A=:(|B="x)|Y=1"|C=2': ["A=:(", "B=x)|Y=1", "C=2"],
    'A=("x)";Y=1)|C=2': ['A=("x)";Y=1)', "C=2"],
    "A=" + "(" * 30_000 + ")" * 29_000 + "|B=1": ["A=" + "(" * 30_000 + ")" * 29_000, "B=1"],
    r"A=x\|B=y": ["A=x|B=y"],
    r"A=x\\|B=y": ["A=x\\", "B=y"],
    r"A=\"x|B=\"y\"": ['A="x', 'B="y"'],
    r'A="x\"|Y=1"|B=a\b': ['A=x"|Y=1', r"B=a\b"],
    r"A=\(x;B=1)": ["A=(x", "B=1)"],
    "": [],
    "_": [],
    "no key at all": [],
}


@pytest.mark.parametrize("s", CASES)
def test_items(s):
    assert items(s) == CASES[s]


keys = st.sampled_from(["Case", "Gloss", "Number[psor]", "NoSpaceAfter", "Ŋéw"])
values = st.text(st.sampled_from("abcXYZ.0123é"), min_size=1, max_size=6)
quoted = st.text(st.sampled_from('ab|;, =/"c'), min_size=1, max_size=8).map(str.strip).filter(bool)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(keys, values, quoted, st.sampled_from(["plain", "value", "item", "blanks"])), min_size=1, max_size=5), st.sampled_from(["|", ";", ", ", " ", " / ", "¦", "｜", "||", "|;"]))
def test_items_round_trip(parts, between):
    packed, want = [], []
    for k, v, q, style in parts:
        if style == "plain":
            packed.append(f"{k}={v}")
            want.append(f"{k}={v}")
        elif style == "blanks":
            packed.append(f"{k} = {v}")
            want.append(f"{k}={v}")
        else:
            twice = q.replace('"', '""')
            packed.append(f'{k}="{twice}"' if style == "value" else '"' + f"{k}={q}".replace('"', '""') + '"')
            want.append(f"{k}={q}")
    if any(s == "item" and q.startswith('"') for _, _, q, s in parts):
        return  # a whole item in quotes whose value looks quoted itself
    assert items(between.join(packed)) == want


def test_explode_items(spark):
    rows = [(1, "A=b|C=d", None, "x"), (2, "A=b", "_", "x"), (2, "A=b;C=d", "", "x"), (3, None, "A=" + "y" * 50_000 + "|B=c", "x")]
    df = spark.createDataFrame(rows, "row_id bigint, feats string, misc string, field string")
    got = {(r["row_id"], r["field"], r["pos"], r["val"][:6]) for r in explode_items(df, "row_id", ["feats", "misc"], at_least=2).collect()}
    assert got == {(1, "feats", 1, "A=b"), (1, "feats", 2, "C=d"), (2, "feats", 1, "A=b"), (2, "feats", 2, "C=d"), (3, "misc", 1, "A=yyyy"), (3, "misc", 2, "B=c")}
    assert explode_items(df.limit(0), "row_id", ["feats"]).count() == 0
    assert explode_items(df, "row_id", ["feats", "misc"]).count() == 7


def test_pieces(spark):
    from arbora.functions.packed import pieces

    cases = {"a;b;c": ["a", "b", "c"], ' "a;b" | c,, d ': ["a;b", "c", "d"], "x(1;2)/y": ["x(1;2)", "y"], r"a\;b;c": ["a;b", "c"], "a b": ["a b"], '"say ""x"""|y': ['say "x"', "y"], "": [], None: [], ";;": []}
    assert {k: pieces(k) for k in cases} == cases
    df = spark.createDataFrame([(1, "a;b"), (2, "c"), (3, None)], "k bigint, s string")
    assert sorted((r["k"], r["pos"], r["val"]) for r in explode_items(df, "k", ["s"], keyed=False).collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    assert explode_items(df, "k", ["s"], keyed=False, at_least=2).count() == 2


def naive_fields(line):
    """Character by character; None where quoting is broken."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, buf = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        buf, i = buf + '"', i + 2
                        continue
                    i += 1
                    break
                buf, i = buf + line[i], i + 1
            if i < len(line) and line[i] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            buf = line[i:j]
            if '"' in buf:
                return None
            i = j
        out.append(buf)
        if i >= len(line):
            return out
        i += 1


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from('ab"\t\t"" ,\r\n'), max_size=14))
def test_fields(line):
    import csv

    try:
        got = fields(line)
    except csv.Error:
        got = None
    assert got == naive_fields(line)


GOOD = ["1", "f", "l", "NOUN", "_", "_", "0", "root", "_", "_"]


def changed(**at):
    r = list(GOOD)
    for k, v in at.items():
        r[int(k[1:])] = v
    return r


def test_reasons():
    labels = frozenset({"root", "mod"})
    assert reasons(GOOD, labels) == []
    assert reasons(GOOD[:9], labels) == ["columns"]
    assert reasons(changed(c0="0", c6="-1", c7="rot"), labels) == ["id", "head", "deprel"]
    assert reasons(changed(c0="2-3", c6="_", c7="_"), labels) == []
    assert reasons(changed(c0="3-2", c6="_", c7="_"), labels) == ["id", "head", "deprel"]
    assert reasons(changed(c0="0-2"), labels) == ["id"]
    for bad in ("1.0", "１", " 1", "", "ID", "1-", "-3"):
        assert "id" in reasons(changed(c0=bad), labels)
    assert reasons(changed(c0="007"), labels) == []


def test_parse_records(spark):
    lines = ["# note", "", "  ", None, "\t".join(GOOD), "\t".join(GOOD), "\t".join(GOOD[:9]), '"' + "\t".join(GOOD), "\t".join(changed(c6="x", c7="")), "\t".join(changed(c1='"a\tb"')), "x" * 300_000, "\t".join(changed(c0="2-3", c6="_", c7="_"))]
    df = spark.createDataFrame([(i, s, "clash", "clash") for i, s in enumerate(lines)], "line_id bigint, raw_text string, record string, reasons string")
    labels = spark.createDataFrame([("root", "a"), ("root", "b"), (None, "c")], "label string, kind string")
    p = parse_records(df, labels)
    assert {(r[0], r[1]) for r in rejected(p).collect()} == {(6, "columns"), (7, "quoting"), (8, "head"), (8, "deprel"), (10, "columns")}
    good = {r["line_id"]: r for r in loaded(p).collect()}
    assert set(good) == {4, 5, 9, 11}
    assert good[9]["form"] == "a\tb" and good[11]["id"] == 2 and good[11]["id_end"] == 3 and good[11]["head"] is None
    assert rejected(parse_records(df.limit(0), labels)).count() == 0


def test_random_lines(spark):
    rng = random.Random(2)
    lines = ["\t".join(rng.choice(["1", '"a"', 'b"', "_", "0", "root", '"x', ""]) for _ in range(rng.choice([9, 10, 10, 11]))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, raw_text string")
    labels = spark.createDataFrame([("root",)], "label string")
    got = {}
    for r in rejected(parse_records(df, labels)).collect():
        got.setdefault(r[0], []).append(r[1])
    for i, s in enumerate(lines):
        if not s.strip():
            continue
        f = naive_fields(s)
        want = ["quoting"] if f is None else reasons(f, frozenset({"root"}))
        assert sorted(got.get(i, [])) == sorted(want)


def naive_records(texts):
    """Lines joined while a quoted field has no end."""
    out, held = [], None
    for i, s in texts:
        if held is None and (s.startswith("#") or not s.strip()):
            out.append((i, s))
            continue
        held = (i, s) if held is None else (held[0], held[1] + "\n" + s)
        parts, is_open, at = held[1], False, 0
        while at <= len(parts):
            if parts.startswith('"', at):
                j, is_open = at + 1, True
                while j < len(parts):
                    if parts[j] == '"' and parts[j + 1 : j + 2] == '"':
                        j += 2
                    elif parts[j] == '"':
                        is_open = False
                        break
                    else:
                        j += 1
                if is_open:
                    break
                at = j
            n = parts.find("\t", at)
            if n < 0:
                break
            at = n + 1
        if not is_open:
            out.append(held)
            held = None
    return out + ([held] if held else [])


def test_assembled(spark, monkeypatch):
    """Records over lines, cut by ranges anywhere, against one that reads each file through."""
    from arbora.sources import sheets

    rng = random.Random(4)
    rows = []
    for f in ("a", "b", "c"):
        rows += [(f, i, "\t".join(rng.choice(["x", '"y', 'z"', '"w"', '""', "# n", ""]) for _ in range(rng.randint(1, 3)))) for i in range(120)]
    df = spark.createDataFrame([*rows, *rows[:5], ("d", 1, None), (None, 1, "x"), ("d", None, "x")], "file_name string, line_no int, raw_text string")
    want = {(f, i): s for f in "abc" for i, s in naive_records([(i, s) for g, i, s in rows if g == f])} | {("d", 1): ""}
    got = {(r[0], r[1]): r[2] for r in sheets.assembled(df.repartition(7)).collect()}
    assert got == want
    assert max(s.count("\n") for s in want.values()) > 2
    labels = spark.createDataFrame([("root",)], "label string")
    two = spark.createDataFrame([("f", 1, "1\t\"a"), ("f", 2, 'b\"\t' + "\t".join(GOOD[2:])), ("f", 3, "\t".join(GOOD)), ("f", 4, '"never')], "file_name string, line_no bigint, raw_text string")
    p = parse_records(sheets.assembled(two), labels, line="line_no")
    assert sorted((r["line_no"], r["form"]) for r in loaded(p, "line_no").collect()) == [(1, "a\nb"), (3, "f")]
    assert [tuple(r) for r in rejected(p, "line_no").collect()] == [(4, "quoting")]
    monkeypatch.setattr(sheets, "MOST_LINES", 5)
    long = spark.createDataFrame([("f", 0, "x")] + [("f", i, '"open' if i == 1 else "y") for i in range(1, 20)], "file_name string, line_no bigint, raw_text string")
    assert sorted((r[1], r[2]) for r in sheets.assembled(long).collect()) == [(0, "x"), (1, '"open'), *((i, "y") for i in range(2, 20))]
    assert sheets.assembled(df.limit(0)).count() == 0
