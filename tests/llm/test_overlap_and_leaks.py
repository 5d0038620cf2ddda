"""Cross-split overlap and benchmark leaks against all pairs and planted passages."""

import random
from itertools import product

import pytest

from arbora.llm import overlap
from arbora.llm.leaks import find_leaks, hashes, letters, winnow
from arbora.llm.overlap import common_words, split_overlap
from arbora.llm.script import Fold, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_words():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
        b = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
        assert common_words(a, b) == lcs(a, b)


def brute(rows):
    f = Fold()
    out = set()
    w = {i: words(t, f) for i, t, s in rows if t is not None}
    for (i, ti, si), (j, tj, sj) in product(rows, rows):
        if ti is None or tj is None or si != "train" or sj in ("train", None) or not w[i] or not w[j]:
            continue
        a, b = w[i], w[j]
        m = max(len(a), len(b))
        if "".join(a) == "".join(b) or m - lcs(a, b) < 0.25 * m:
            out.add((i, j))
    return out


def vary(rng, ws, vocabulary):
    ws = list(ws)
    for _ in range(max(1, len(ws) // 8)):
        i = rng.randrange(len(ws))
        kind = rng.choice(["replace", "misspell", "drop", "add", "move"])
        if kind == "replace":
            ws[i] = rng.choice(vocabulary)
        elif kind == "misspell":
            ws[i] = ws[i] + "x"
        elif kind == "drop" and len(ws) > 1:
            del ws[i]
        elif kind == "add":
            ws.insert(i, rng.choice(vocabulary))
        elif kind == "move":
            ws.insert(rng.randrange(len(ws)), ws.pop(i))
    return ws


@pytest.mark.parametrize("hot", [overlap.HOT, 0])
def test_split_overlap(spark, monkeypatch, hot):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("bdgklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    rows, n = [], 0
    for _ in range(120):
        ws = [rng.choice(vocabulary) for _ in range(rng.choice([5, 6, 8, 9, 12, 16, 24]))]
        rows.append((n, " ".join(ws), "train"))
        if rng.random() < 0.6:
            v = vary(rng, ws, vocabulary) if rng.random() < 0.7 else ws
            text = " ".join(v)
            text = rng.choice([text, text.upper() + "!", text.replace("a", "á"), text.replace(" ", ", "), text.replace(" ", "  ")])
            rows.append((n + 1, text, rng.choice(["dev", "test"])))
        n += 2
    hot_text = " ".join(vocabulary[:10])
    rows += [(1000 + i, hot_text, rng.choice(["train", "dev"])) for i in range(40)]  # a third of all rows
    rows += [(2000, None, "train"), (2001, "", "dev"), (2002, "?!", "train"), (2003, "...", "dev"), (2004, hot_text, None), (2005, "to hu", "train"), (2006, "To, hu", "test")]
    if hot == 0:
        real = overlap.near_classes
        monkeypatch.setattr(overlap, "near_classes", lambda c, differ: real(c, differ=differ, hot=1))
    df = spark.createDataFrame([(*r, 5, "clash", "clash") for r in rows], "sent_idx bigint, text string, split string, class int, words string, record string")
    got = [(r[0], r[1]) for r in split_overlap(df).collect()]
    assert len(got) == len(set(got))
    want = brute(rows)
    assert set(got) == want
    assert split_overlap(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------ leaks


def test_winnowing_guarantee():
    rng = random.Random(4)
    for k, w in ((16, 4), (13, 4), (5, 9), (1, 2)):
        guarantee(rng, k, w)


def guarantee(rng, k, w):
    shared = "".join(rng.choice("abcdefgh") for _ in range(k + w - 1))
    for _ in range(50):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 50))) + shared + "".join(rng.choice("abcdefgh") for _ in range(30))
        ha = hashes(letters(a), k)
        fingerprint = set(ha[winnow(ha, w)].tolist())
        hs = hashes(letters(shared), k)
        assert len(hs) == w and fingerprint & set(hs[winnow(hs, w)].tolist())
    assert len(hashes(letters("ab"), 3)) == len(hashes(letters(""), k)) == 0


def plant():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("bdgklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(600)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.randint(40, 70)) for _ in range(12)]
    docs, want = [], set()

    def add(text, *leaked):
        want.update((len(docs), i) for i in leaked)
        docs.append(text)

    for i, it in enumerate(items):
        pre, post = " ".join(say(80)), " ".join(say(60))
        add(f"{pre} {' '.join(it)} {post}", i)
        add(f"{pre}\n> " + "\n> ".join(" ".join(it[j : j + 6]) for j in range(0, len(it), 6)).upper(), i)
        add(pre + " " + " ".join(f"<b>{x}</b>&nbsp;" if j % 5 == 0 else x + "," for j, x in enumerate(it)), i)
        add(pre + " " + " ".join(rng.choice(vocabulary) if j % 8 == 3 else x for j, x in enumerate(it)), i)
        half = it[: int(len(it) * 0.65)]
        add(" ".join(half[: len(half) // 2]) + " " + " ".join(say(300)) + " " + " ".join(half[len(half) // 2 :]), i)
        add("".join(f"{j}\t{x}\t{x}\tNOUN\t_\t_\t0\troot\t_\t_\n" for j, x in enumerate(it, 1)), i)
        add(" ".join(it).replace("a", "а").replace("o", "ó"), i)  # the Cyrillic letter
        add(pre + " " + " ".join(it[:7]) + " " + post)
        mixed = list(it)
        rng.shuffle(mixed)
        add(pre + " " + " ".join(mixed))
        add(" ".join(x for j in range(0, len(it), 5) for x in (*it[j : j + 5], *say(120))))
    add(" ".join(items[0]) + " . " + " ".join(items[1]), 0, 1)
    return [" ".join(i) for i in items], docs, want


def test_find_leaks(spark):
    items, docs, want = plant()
    rows = [(i, t, "clash") for i, t in enumerate(docs)] + [(900, None, ""), (901, "", ""), (0, docs[0], "again"), (902, "word " * 40_000 + items[3], "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None), (98, ""), (97, "short")], "item_id bigint, text string")
    expected = sorted([*want, (0, 0), (902, 3)])
    assert sorted((r[0], r[1]) for r in find_leaks(d, b).select("doc_id", "item_id").collect()) == expected
    assert find_leaks(d.limit(0), b).count() == 0
    assert find_leaks(d, b.limit(0)).count() == 0
