"""Quality labels on held-out synthetic texts, the varied subset and packing by their promises."""

import random
from collections import Counter

import numpy as np
import pytest

from arbora.llm import quality
from arbora.llm.packing import VOCABULARY, best_fit, pack, tokenizer
from arbora.llm.quality import Moves, text_quality, viterbi
from arbora.llm.subset import evenly, hilbert_keys, select_varied

COMMON = [("aaa", w) for w in "ka le mu so ti ra ne wo bi du fa go".split()] + [("bbb", w) for w in "the of and to in is that for on with as at".split()]


def make(rng):
    """(text, label) of invented kinds."""
    vocabulary = ["".join(rng.choice("bdgklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(500)]

    def sentence():
        lang = rng.choice(["aaa", "bbb"])
        common = [w for x, w in COMMON if x == lang]
        return [rng.choice(common) if rng.random() < 0.42 else rng.choice(vocabulary) for _ in range(rng.randint(8, 16))]

    def prose(n):
        return " ".join(" ".join(s).capitalize() + rng.choice(".?!") for s in (sentence() for _ in range(n)))

    word = lambda: rng.choice(vocabulary)
    n = rng.randint(4, 14)
    yield prose(n), "prose"
    t = prose(n).split()
    yield "\n".join(" ".join(t[i : i + 9]) for i in range(0, len(t), 9)), "prose"
    yield prose(n).lower().replace(".", ""), "prose"
    yield prose(n + 6) + "\n" + "\n".join(f"- {word()}" for _ in range(6)), "prose"
    yield "\n".join(f"{i}. {word()} {word()}" for i in range(1, 25)), "other"
    yield "\n".join(f"{word()};{word()};{rng.randint(1, 999)};yes" for _ in range(25)), "other"
    yield "\n".join(f"{i}\t{word()}\t{word()}\tNOUN\t_\t_\t{i - 1}\tmod\t_\t_" for i in range(1, 25)), "other"
    yield (" ".join(sentence()) + ".\n") * 15, "other"
    yield (" ".join(sentence()) + ". ") * 15, "other"
    yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(900)), "other"
    yield ", ".join(word() for _ in range(120)), "other"
    yield "".join(c if rng.random() > 0.12 else rng.choice(["Ã±", "ï¿½", "â€™", "�"]) for c in prose(n)), "other"
    yield "".join(f'<div class="{word()}"><a id="n{i}">{word()}</a></div>' for i in range(60)), "other"


def test_held_out_accuracy(spark):
    rng = random.Random(11)
    cases = [c for _ in range(40) for c in make(rng)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string, label string, n_words int")
    common = spark.createDataFrame(COMMON, "lang string, word string")
    got = {r["doc_id"]: r["label"] for r in text_quality(docs, common).collect()}
    right = sum((got[i] == "prose") == (label == "prose") for i, (_, label) in enumerate(cases))
    assert right / len(cases) >= 0.98


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n "), (4, "x"), (4, "x"), (5, "ka le mu " * 60_000)], "doc_id bigint, text string")
    common = spark.createDataFrame([*COMMON, (None, "x"), ("aaa", None)], "lang string, word string")
    rows = text_quality(docs, common).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1}
    by = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3):
        assert by[i]["n_words"] == 0 and by[i]["label"] == "junk" and by[i]["prose_share"] == 0
    assert by[5]["n_words"] == 180_000 and by[5]["label"] == "junk"
    assert text_quality(docs.limit(0), common).count() == 0
    assert text_quality(docs, common.limit(0)).count() == 6


def test_statistics_by_hand(spark):
    common = spark.createDataFrame(COMMON, "lang string, word string")
    docs = spark.createDataFrame([(1, "Ka bo le, 12.\nNo end here")], "doc_id bigint, text string")
    r = text_quality(docs, common).first()
    assert (r["n_words"], r["n_lines"]) == (7, 2)
    assert r["ended_lines_share"] == 0.5
    assert abs(r["mean_word_length"] - (2 + 2 + 2 + 2 + 2 + 3 + 4) / 7) < 1e-9
    dark = len("Kabole,12.Noendhere")
    assert abs(r["symbol_ratio"] - 2 / dark) < 1e-9 and abs(r["digit_ratio"] - 2 / dark) < 1e-9
    assert abs(r["common_word_share"] - 2 / 7) < 1e-9


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    k = len(quality.START)
    lengths = np.array([1, 4, 2, 3])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    e = np.log(rng.random((lengths.sum(), k)))
    moves = Moves(np.log(rng.dirichlet(np.ones(k))), np.log(rng.dirichlet(np.ones(k), k)))
    path = viterbi(e, first, lengths, moves)
    for f, n in zip(first, lengths):
        score = lambda p: moves.start[p[0]] + sum(e[f + i, s] for i, s in enumerate(p)) + sum(moves.step[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(product(range(k), repeat=int(n)), key=score)
        assert tuple(path[f : f + n]) == best


def test_training_counts():
    k = len(quality.START)
    path = np.array([0, 0, 0, 1, 1, 0, 2] * 4000, np.int8)
    m = Moves.untrained().after(path, np.arange(0, len(path), 7))
    assert np.allclose(np.exp(m.start).sum(), 1) and np.allclose(np.exp(m.step).sum(1), 1)
    assert np.exp(m.start)[0] > 0.95
    assert abs(np.exp(m.step)[0, 0] - 2 / 4) < 0.02 and abs(np.exp(m.step)[1, 0] - 1 / 2) < 0.03
    assert np.exp(m.step)[k - 1, k - 1] == pytest.approx(quality.STAY)


# ------------------------------------------------------------------------------ subset


@pytest.mark.parametrize("d,bits", [(2, 3), (3, 2), (4, 2), (7, 1)])
def test_hilbert_curve(d, bits):
    from itertools import product

    pts = np.array(list(product(range(1 << bits), repeat=d)))
    k = hilbert_keys(pts, bits)
    assert sorted(k) == list(range(len(pts)))
    steps = np.abs(np.diff(pts[np.argsort(k)], axis=0)).sum(1)
    assert (steps == 1).all()


def grid_rows():
    rng = random.Random(3)
    rows = [(i, 1, 1, 0.5) for i in range(400)]  # most records look alike
    rows += [(1000 + i, rng.randint(0, 7), rng.randint(0, 7), rng.choice([None, 0.1, 0.9])) for i in range(200)]
    return rows + [(5000, None, 99, 1.0), (None, 2, 2, 1.0)]


@pytest.mark.parametrize("size", [0, 1, 10, 40, 64, 150, 601, 5000])
def test_select_varied(spark, size):
    rows = grid_rows()
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], "id bigint, x int, y int, q double, cell int, turn int")
    out = select_varied(df, "id", ["x", "y"], size, quality="q").collect()
    real = [r for r in rows if r[0] is not None]
    assert len(out) == min(size, len(real))
    assert len({r["id"] for r in out}) == len(out)
    cell = {r[0]: (min(7, max(0, r[1] or 0)), min(7, max(0, r[2] or 0))) for r in real}
    held = Counter(cell.values())
    used = Counter(cell[r["id"]] for r in out)
    if size <= len(held):
        assert all(n == 1 for n in used.values())
    elif size < len(real):
        top = max(used.values())
        assert all(n >= min(held[c], top - 1) for c, n in used.items()) and len(used) == len(held)
    best = {}
    for r in real:
        key = (-(r[3] if r[3] is not None else float("-inf")), r[0])
        best[cell[r[0]]] = min(best.get(cell[r[0]], key), key)
    for r in out:
        assert r["cell_rows"] == held[cell[r["id"]]]
        if r["turn"] == 1:
            assert best[cell[r["id"]]][1] == r["id"]


def test_evenly(spark):
    df = spark.range(97).withColumnRenamed("id", "k")
    for size in (1, 2, 7, 50, 97):
        got = sorted(r["k"] for r in evenly(df, "k", size, 97).collect())
        assert got == sorted({int((i + 0.5) * 97 / size) for i in range(size)}) and len(got) == size


# ------------------------------------------------------------------------------ packing


def check_bins(lengths, groups, sources, capacity, bins, apart=None):
    load, copies, who = Counter(), {}, {}
    for n, g, s, b in zip(lengths, groups, sources, bins):
        load[b] += n
        copies.setdefault(b, Counter())[g] += 1
        who.setdefault(b, set()).add(s)
    assert max(load.values()) <= capacity
    for x, bad in (apart or {}).items():
        for b, names in who.items():
            assert not (x in names and any(bad >> y & 1 for y in names))
    return load, copies


def test_best_fit():
    rng = random.Random(5)
    lengths = [min(512, int(rng.expovariate(1 / 90)) + 1) for _ in range(3000)]
    groups = [i if rng.random() < 0.7 else rng.randint(10_000, 10_100) for i in range(3000)]
    sources = [rng.randint(0, 5) for _ in range(3000)]
    bins = best_fit(lengths, groups, sources, 512)
    load, copies = check_bins(lengths, groups, sources, 512, bins)
    assert all(n == 1 for c in copies.values() for n in c.values())
    assert sum(lengths) / (512 * len(load)) > 0.98
    apart = {0: 0b10, 1: 0b1}
    check_bins(lengths, groups, sources, 512, best_fit(lengths, groups, sources, 512, apart), apart)


def test_best_fit_hot_group():
    """A third of all items are copies: they never meet, and what else there is fills their bins."""
    rng = random.Random(6)
    lengths = [100] * 1000 + [rng.randint(1, 200) for _ in range(2000)]
    groups = [7] * 1000 + list(range(100, 2100))
    bins = best_fit(lengths, groups, [0] * 3000, 1000)
    load, copies = check_bins(lengths, groups, [0] * 3000, 1000, bins)
    assert all(c[7] <= 1 for c in copies.values()) and len(load) == 1000


def test_best_fit_soft():
    """With ``spare``, copies are kept apart while there are bins, and fill does not suffer."""
    rng = random.Random(6)
    lengths = [100] * 1000 + [rng.randint(1, 200) for _ in range(2000)]
    groups = [7] * 1000 + list(range(100, 2100))
    bins = best_fit(lengths, groups, [0] * 3000, 1000, spare=200)
    load, copies = check_bins(lengths, groups, [0] * 3000, 1000, bins)
    assert len(load) <= 1.02 * sum(lengths) / 1000 + 1
    assert sum(c[7] > 0 for c in copies.values()) >= 0.4 * len(load)


def test_best_fit_is_tightest():
    """Against a search over all bins: each item goes to the least room that holds it without a conflict."""
    rng = random.Random(9)
    for _ in range(60):
        lengths = [rng.randint(0, 30) for _ in range(60)]
        groups = [rng.randint(0, 25) for _ in range(60)]
        sources = [rng.randint(0, 3) for _ in range(60)]
        apart = rng.choice([{}, {0: 0b10, 1: 0b1}, {2: 0b1000, 3: 0b100}])
        bins = best_fit(lengths, groups, sources, 40, apart)
        check_bins(lengths, groups, sources, 40, bins, apart)
        room, held = [], []
        for i in sorted(range(60), key=lambda i: (-lengths[i], groups[i], i)):
            fits = [r for r, h in zip(room, held) if r >= lengths[i] and not any(groups[j] == groups[i] or apart.get(sources[i], 0) >> sources[j] & 1 for j in h)]
            if bins[i] == len(room):
                assert not fits
                room.append(40)
                held.append([])
            else:
                assert room[bins[i]] == min(fits)
            room[bins[i]] -= lengths[i]
            held[bins[i]].append(i)


def test_copies_and_repeated_ids_keep_to_the_capacity(spark):
    """Thirty copies of one text come in thirty sequences, and rows of one id, cut alike, share no sequence."""
    rows = [(i, "alpha beta gamma", "a") for i in range(30)] + [(100 + i, "one two three four", "b") for i in range(30)] + [(1, "word " * 25, "a"), (1, "word " * 25, "a")]
    out = pack(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), spark.createDataFrame([("m", 10)], "model_name string, capacity int")).collect()
    load, first, other = Counter(), Counter(), Counter()
    for r in out:
        load[r["sequence"]] += r["n_tokens"]
        first[r["sequence"]] += r["doc_id"] < 30 and r["doc_id"] != 1
        other[r["sequence"]] += r["doc_id"] >= 100
    assert max(load.values()) <= 10 and max(first.values()) == 1 and max(other.values()) == 1


def test_empty_and_zero():
    assert best_fit([], [], [], 10) == []
    assert len(set(best_fit([0, 0, 10], [1, 2, 3], [0, 0, 0], 10))) == 1


def test_pack(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "ñuum", "x1"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["word " * 3000, texts[0], texts[0], ""]
    rows = [(i, t, rng.choice(["a", "b", None])) for i, t in enumerate(texts)] + [(999, None, "a"), (5, "again", "a")]
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id bigint, text string, source string, sequence string, capacity int")
    windows = spark.createDataFrame([("m", 128), ("n", 50)], "model_name string, capacity int")
    out = pack(docs, windows, block=100).collect()
    t = tokenizer(VOCABULARY)
    need = Counter()
    for i, s, _ in rows:
        if s is not None:
            need[i] += len(t.encode_ordinary(s))
    for model, cap in (("m", 128), ("n", 50)):
        mine = [r for r in out if r["model_name"] == model]
        got, load, spans = Counter(), Counter(), {}
        for r in mine:
            got[r["doc_id"]] += r["n_tokens"]
            load[r["sequence"]] += r["n_tokens"]
            if r["n_tokens"]:
                spans.setdefault(r["sequence"], []).append((r["at"], r["at"] + r["n_tokens"]))
            assert r["first_token"] == r["piece"] * cap
        assert got == need and {r["doc_id"] for r in mine} == {i for i, s, _ in rows if s is not None}
        assert max(load.values()) <= cap
        for s in spans.values():
            s.sort()
            assert all(a[1] <= b[0] for a, b in zip(s, s[1:]))
        pieces = Counter(r["doc_id"] for r in mine)
        assert all(pieces[i] == 1 for i, s, _ in rows if s is not None and i != 5 and len(t.encode_ordinary(s)) <= cap)
    assert pack(docs.limit(0), windows).count() == 0
    assert pack(docs, windows.limit(0)).count() == 0
