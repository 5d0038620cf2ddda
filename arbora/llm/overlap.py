"""Records of evaluation splits that stand, exactly or almost, in the training split.

Texts are compared by look and case, without punctuation and accents. Texts equal in that form,
spaces aside, are one class, and only classes are searched, so copies cost nothing. Over the
class texts a partitioned suffix array is laid: the suffixes at all words, a word being a number by its hash, sorted globally by
range. The common prefixes of neighbours, counted in words, give its intervals: all suffixes
that begin with the same words, from two words on. An interval with both sides names the places
at which classes share a span; spans of a pair at places too far apart for its few changes
are passed over, and of the pairs that remain the shared spans are merged in order into the
coverage of both texts, which decides.

Why two words are enough: two texts that differ in less than a quarter of their words have more common words
than runs of common words, even if each change is a word moved elsewhere, so one run has two words.

An interval of more than ``HOT`` suffixes is not paired; its longer prefixes are, as far as they
are smaller. Where hot intervals cover so much of a text that it could share nothing else with another,
the text joins once more by its rarest words: a pair that differs in few enough words has two
of them in common (see ``rare_keys``). So no pair is lost, however common its phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.script import Fold, words
from arbora.operators.joins import split_join
from arbora.session import stored

#: Words that a shared span has at least.
SPAN = 2
#: Words by which suffixes are sorted, as numbers. Only intervals above ``HOT`` are read deeper than ``SPAN``.
DEPTH = 4
#: Suffixes of the largest interval that is paired. It chooses between two ways that both lose nothing.
HOT = 500
#: Of classes under hot intervals, texts of at most so many words are paired by two rare words, others by one.
LONG = 48
#: The words whose frequency is known when words are ordered by rarity; all others count as rare.
FREQUENT = 10_000
#: A pair counts if less than this share of its words differs.
DIFFER = 0.25
#: The largest share for which a shared span of two words is certain.
CERTAIN = 0.25
#: Rows of one key that stay together in a join; keys with more are split.
TOGETHER = 4096
#: Rows of an unfinished interval that a task keeps in memory.
HELD = 100_000


def folded(df: DataFrame, record: str, text: str, keep: list[str]) -> DataFrame:
    """(record, keep, words, n, sig): texts by look and case, words joined by spaces, with their number and signature; those without a word are left out."""
    read = df.select(F.col(record).alias("record"), *keep, F.col(text).alias("text")).where("record is not null and text is not null")
    kinds = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in ("record", *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold()
        known: dict[str, int] = {}
        for b in batches:
            split = [words(t, fold) for t in b.column("text").to_pylist()]
            out = [pa.array([" ".join(ws) for ws in split], pa.string()), pa.array([len(ws) for ws in split], pa.int32()), pa.array([signature(ws, known) for ws in split], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], [*b.schema.names[:-1], "words", "n", "sig"])

    return read.mapInArrow(run, f"{kinds}, words string, n int, sig bigint").where("n > 0")


# ------------------------------------------------------------------------------ rows to be paired

#: What a row tells of its class, by which most pairs that are too different are seen without their texts.
_ABOUT = ("class", "meta", "sig")
_ABOUT_KIND = "class bigint, meta bigint, sig bigint"


def _meta(at: Column) -> Column:
    """A place, the number of words (28 bits each) and the sides of a class in one number, as fewer columns cost less to move."""
    side = F.col("train").cast("bigint") * 2 + F.col("other").cast("bigint")
    return F.shiftleft(at.cast("bigint"), 30).bitwiseOR(F.shiftleft(F.col("n").cast("bigint"), 2)).bitwiseOR(side)


_AT, _N, _TRAIN, _OTHER = "shiftright(meta, 30)", "(shiftright(meta, 2) & 268435455)", "(meta & 2) > 0", "(meta & 1) > 0"


def signature(ws: list[str], known: dict[str, int]) -> int:
    """64 parities over the words: those of two texts differ at most once for each word that only one has."""
    if len(known) > 200_000:
        known.clear()
    s = 0
    for w in ws:
        b = known.get(w)
        if b is None:
            b = known[w] = 1 << (xxhash.xxh64_intdigest(w) & 63)
        s ^= b
    return s - (1 << 64) if s >> 63 else s


def suffixes(classes: DataFrame) -> DataFrame:
    """(k1, k2, class, meta, sig): the suffix at every word that has ``SPAN`` words, as far as it is sorted by.

    ``k1`` holds the numbers of its first two words, ``k2`` those of the next two, 0 behind the end. Different words of one
    number, if there are any, only make more rows to be looked at.
    """
    word = lambda i: F.get("_h", i)
    some = lambda i: F.coalesce(word(i).bitwiseAND((1 << 24) - 1).bitwiseOR(1), F.lit(0)).cast("bigint")
    k1 = lambda i: F.shiftleft(word(i).cast("bigint"), 32).bitwiseOR(word(i + 1).cast("bigint").bitwiseAND((1 << 32) - 1))
    k2 = lambda i: F.shiftleft(some(i + 2), 24).bitwiseOR(some(i + 3))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - SPAN), lambda i: F.struct(k1(i).alias("k1"), k2(i).alias("k2")))
    rows = classes.where(F.col("n") >= SPAN).withColumn("_h", F.transform(F.split("words", " "), lambda w: F.hash(w)))
    return rows.select(F.posexplode(cut).alias("at", "s"), "class", "n", "train", "other", "sig").select("s.k1", "s.k2", "class", _meta(F.col("at")).alias("meta"), "sig")


# ------------------------------------------------------------------------------ the array's intervals


def _words_of(t: pa.Table) -> np.ndarray:
    """Numbers of the words of each suffix, 0 behind its end."""
    k1, k2 = (t.column(c).to_numpy().view(np.uint64) for c in ("k1", "k2"))
    return np.stack([k1 >> np.uint64(32), k1 & np.uint64((1 << 32) - 1), k2 >> np.uint64(24), k2 & np.uint64((1 << 24) - 1)], 1)


def _common(m: np.ndarray) -> np.ndarray:
    """Words of the common prefix of each suffix with the one before it; 0 for the first."""
    out = np.zeros(len(m), np.int64)
    same = np.ones(max(0, len(m) - 1), bool)
    for d in range(m.shape[1]):
        same = same & (m[1:, d] == m[:-1, d])
        if d >= SPAN:
            same &= m[1:, d] > 0
        out[1:] += same
    return out


def _node(m: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """A number for the first words of each suffix, as many as its depth says."""
    h = depth.astype(np.uint64)
    with np.errstate(over="ignore"):
        for d in range(m.shape[1]):
            h = (h ^ np.where(d < depth, m[:, d], np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _intervals(t: pa.Table, hot: int, left: bool, right: bool, loose: bool = False) -> pa.RecordBatch:
    """The rows (node, depth, open, hot, class, meta, sig) that a stretch of the array gives, which is sorted by ``k1``.

    A suffix stands for the widest of its intervals with at most ``hot`` suffixes and, as a ``hot`` row, for the narrowest one above that.
    ``left`` and ``right`` tell that the stretch may go on there; of intervals at such an end the
    true size is not known, so all of them that are small here are given, as ``open``. ``loose`` tells that of any interval.
    """
    t = t.combine_chunks()
    order = np.lexsort((t.column("k2").to_numpy(), t.column("k1").to_numpy()))
    m = _words_of(t)[order]
    size = SPAN + (m[:, SPAN:] > 0).sum(1)
    common = _common(m)
    n = len(common)
    meta = t.column("meta").to_numpy()[order]
    train, other = meta & 2 > 0, meta & 1 > 0
    alive = np.ones(n, bool)
    heat = np.zeros(n, np.int64)
    got: list[tuple[np.ndarray, int, bool]] = []
    for d in range(SPAN, DEPTH + 1):
        alive &= size >= d
        if not alive.any():
            break
        starts = np.flatnonzero(common < d)
        members = np.diff(np.append(starts, n))
        both = np.logical_or.reduceat(train, starts) & np.logical_or.reduceat(other, starts)
        end = np.full(len(starts), loose)
        end[0] |= left
        end[-1] |= right
        big = members > hot
        each = lambda x: np.repeat(x, members)  # noqa: E731, B023
        got.append((np.flatnonzero(alive & each(~end & ~big & both)), d, False))
        got.append((np.flatnonzero(alive & each(end & ~big)), d, True))
        heat[alive & each(big & (both | end))] = d
        alive &= each(end | big & both)
    hotrows = np.flatnonzero(heat)
    row = np.concatenate([*(g[0] for g in got), hotrows]).astype(np.int64)
    depth = np.concatenate([*(np.full(len(g[0]), g[1]) for g in got), heat[hotrows]]).astype(np.int32)
    open_ = np.concatenate([*(np.full(len(g[0]), g[2]) for g in got), np.zeros(len(hotrows), bool)])
    is_hot = np.arange(len(row)) >= len(row) - len(hotrows)
    own = [t.column(c).combine_chunks().take(pa.array(order[row])) for c in _ABOUT]
    return pa.RecordBatch.from_arrays([pa.array(_node(m[row], depth)), pa.array(depth), pa.array(open_), pa.array(is_hot), *own], ["node", "depth", "open", "hot", *_ABOUT])


def intervals(rows: DataFrame, hot: int) -> DataFrame:
    """(node, depth, open, hot, class, meta, sig) of all suffixes in intervals with both sides; see ``_intervals``.

    The array is ranged over (suffix, class), so no interval has to fit one task. Within a range Spark sorts by the first
    two words, whose numbers fit its radix sort, and each stretch by all.
    """
    array = rows.repartitionByRange("k1", "k2", "class").sortWithinPartitions("k1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last interval waits for the next batch, but for a long one, which is above ``hot`` anyway
        held: pa.Table | None = None
        left = loose = False
        first = True
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            k1 = t.column("k1").to_numpy()
            last = int(np.flatnonzero(np.concatenate([[True], k1[1:] != k1[:-1]]))[-1])
            if last:
                yield _intervals(t.slice(0, last), hot, left or first, False, loose)
                left = loose = first = False
            held = t.slice(last)
            if held.num_rows > max(HELD, hot):
                yield _intervals(held, hot, True, True, True)
                held, left, loose = None, True, True
        if held is not None and held.num_rows:
            yield _intervals(held, hot, left or first, True, loose)

    return array.mapInArrow(run, f"node bigint, depth int, open boolean, hot boolean, {_ABOUT_KIND}")


# ------------------------------------------------------------------------------ texts under hot intervals


def changes(n: int, differ: float) -> int:
    """The most words in which a text of n words can differ from another that is no longer."""
    d = int(differ * n)
    return d if d < differ * n else d - 1


def rare_keys(ws: list[str], rank: dict[str, int], differ: float) -> Iterator[str]:
    """Keys of which any two texts that differ in less than ``differ`` share one.

    ``rank`` has the frequent words, the most frequent first. With all words ordered by rarity, a repeated one as new ones, and d
    words that may differ, the first m words that both texts share are among the first d + m of either. So texts
    of up to ``LONG`` words have all pairs of the first d + 2; where one is longer, the other has
    more than ``(1 - differ) * LONG`` words, and both have each of the first d + 1.
    """
    seen: dict[str, int] = {}
    order = []
    for w in ws:
        n = seen[w] = seen.get(w, -1) + 1
        order.append((-rank.get(w, FREQUENT), f"{w}\x01{n}"))
    order.sort()
    d = changes(len(ws), differ)
    pairs = LONG if differ <= 0.5 else 0  # two words in common at least
    if len(ws) <= pairs:
        for (_, x), (_, y) in combinations(order[: d + 2], 2):
            yield f"\x05{x}\x05{y}"
    if len(ws) > (1 - differ) * pairs:
        for _, x in order[: d + 1]:
            yield f"\x06{x}"


def rare_rows(classes: DataFrame, differ: float) -> DataFrame:
    """(node, class, meta, sig): the keys by rare words of all class texts."""
    count = classes.select(F.explode(F.split("words", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    rank = {r["w"]: i for i, r in enumerate(count.orderBy(F.desc("n"), "w").limit(FREQUENT).collect())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [list(rare_keys(text.split(" "), rank, differ)) for text in b.column("words").to_pylist()]
            take = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            node = [xxhash.xxh64_intdigest(k) - (1 << 63) for own in keys for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), *(b.column(c).take(take) for c in _ABOUT)], ["node", *_ABOUT])

    return classes.select("words", "class", _meta(F.lit(0)).alias("meta"), "sig").mapInArrow(run, f"node bigint, {_ABOUT_KIND}")


@lru_cache(10_000)
def least_covered(n: int, differ: float) -> int:
    """Words under hot intervals from which a text of n words may have a partner with which it shares no other span.

    With another text of m words, m not below n, it has l words in common at least, in n + m - 2 l + 1
    runs at most. A run is one word, or lies under hot intervals.
    """
    return min(2 * m - 3 * changes(m, differ) - n - 1 for m in range(n, n + 5))


def under_hot(spans: DataFrame, differ: float) -> DataFrame:
    """The classes that hot intervals (at, depth) cover so far that they must be paired by rare words."""
    own = spans.groupBy("class").agg(F.first(F.expr(_N)).alias("n"), F.array_sort(F.collect_list(F.struct(F.expr(_AT).alias("at"), "depth"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, s in zip(b.column("n").to_pylist(), b.column("s").to_pylist()):
                covered = end = 0
                for x in s:
                    to = x["at"] + x["depth"]
                    covered += max(0, to - max(end, x["at"]))
                    end = max(end, to)
                keep.append(covered >= least_covered(n, differ))
            yield b.select(["class"]).filter(pa.array(keep, pa.bool_()))

    return own.mapInArrow(run, "class bigint")


def common_words(a: list[str], b: list[str]) -> int:
    """Words in the longest common sequence of shared spans, by one bit a word."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


# ------------------------------------------------------------------------------ pairs


def _candidates(differ: float) -> Column:
    """Whether two rows of one node may belong to a pair: too few words lie before or behind the span, or are missing, for more."""
    most = differ * F.greatest("n", "n_b")
    before, behind = F.abs(F.col("at") - F.col("at_b")), F.abs((F.col("n") - F.col("at")) - (F.col("n_b") - F.col("at_b")))
    odd = F.bit_count(F.col("sig").bitwiseXOR(F.col("sig_b")))
    return (F.col("class") != F.col("class_b")) & (before < most) & (behind < most) & (odd < 2 * most - F.abs(F.col("n") - F.col("n_b")))


def _met(rows: DataFrame, differ: float, split: bool = False) -> DataFrame:
    """(a, b): classes that meet in a node, the training side first. ``split`` is for nodes of any size."""
    read = {"at": F.expr(_AT), "n": F.expr(_N), "class": F.col("class"), "sig": F.col("sig")}
    left = rows.where(_TRAIN).select("node", *(v.alias(k) for k, v in read.items()))
    right = rows.where(_OTHER).select("node", *(v.alias(k + "_b") for k, v in read.items()))
    met = split_join(left, right, "node", "class") if split else left.join(right, "node")
    return met.where(_candidates(differ)).select(F.col("class").alias("a"), F.col("class_b").alias("b"))


def near_classes(classes: DataFrame, *, differ: float = DIFFER, hot: int = HOT) -> DataFrame:
    """(train_class, other_class, n_train, n_other): different classes whose texts differ in less than ``differ`` of their words."""
    nodes = stored(intervals(suffixes(classes), hot))
    cols = ["node", "depth", *_ABOUT]
    open_ = nodes.where("open")
    size = open_.groupBy("node").agg(F.count("*").alias("_n"), F.bool_or(F.expr(_TRAIN)).alias("_t"), F.bool_or(F.expr(_OTHER)).alias("_o")).where("_t and _o")
    small = open_.join(size.where(F.col("_n") <= hot), "node").select(*cols)
    large = open_.join(size.where(F.col("_n") > hot), "node").select(*cols)
    pairs = _met(nodes.where("not open and not hot").select(*cols).unionByName(small), differ)
    if differ > CERTAIN:
        held: DataFrame | None = classes
    else:
        flagged = stored(under_hot(nodes.where("hot").select(*cols).unionByName(large), differ))
        held = None if flagged.isEmpty() else stored(classes.join(flagged, "class", "left_semi"))
    if held is not None:
        pairs = pairs.unionByName(_met(stored(rare_rows(held, differ)), differ, split=True))
    text = lambda x, n: classes.select(F.col("class").alias(x), F.col("words").alias(f"words_{x}"), n)
    both = pairs.distinct().join(text("a", "n_train"), "a").join(text("b", "n_other"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("words_a").to_pylist(), b.column("words_b").to_pylist()):
                p, q = x.split(" "), y.split(" ")
                most = max(len(p), len(q))
                keep.append(most - common_words(p, q) < differ * most)
            yield b.select(["a", "b", "n_train", "n_other"]).filter(pa.array(keep, pa.bool_()))

    kept = both.select("a", "b", "n_train", "n_other", "words_a", "words_b").mapInArrow(run, "a bigint, b bigint, n_train bigint, n_other bigint")
    return kept.select(F.col("a").alias("train_class"), F.col("b").alias("other_class"), "n_train", "n_other")


def class_overlap(df: DataFrame, *, record: str = "sent_idx", text: str = "text", split: str = "split", train: str = "train", differ: float = DIFFER, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (train_class, other_class, exact, n_train, n_other) and members (record, keep, in_train, class, n_train, n_other).

    A class holds all records with one text by look and case, spaces and punctuation aside, and ``n_train`` and ``n_other`` count them
    by side: in a link those of its training class and of its other class, in a member those of its own. A class with both sides is linked with itself,
    which is ``exact``. A null split belongs to no side; null texts and texts without letters and digits are in no class.
    """
    keep = keep or []
    side = df.where(F.col(split).isNotNull()).withColumn("_in_train", F.col(split) == train)
    letters = F.translate("words", " ", "")
    f = folded(side, record, text, ["_in_train", *keep])
    keyed = stored(f.withColumn("k1", F.xxhash64(letters)).withColumn("k2", F.xxhash64(F.concat(F.lit("#"), letters))))
    t, o = F.count_if("_in_train"), F.count_if(~F.col("_in_train"))
    found = keyed.groupBy("k1", "k2").agg(F.min(F.struct("record", "words", "n", "sig")).alias("m"), t.alias("n_train"), o.alias("n_other"))
    classes = stored(found.select("k1", "k2", F.col("m.record").cast("bigint").alias("class"), "m.words", "m.n", "m.sig", "n_train", "n_other", (F.col("n_train") > 0).alias("train"), (F.col("n_other") > 0).alias("other")))
    near = near_classes(classes, differ=differ)
    equal = classes.where("train and other").select(F.col("class").alias("train_class"), F.col("class").alias("other_class"), "n_train", "n_other")
    links = equal.withColumn("exact", F.lit(True)).unionByName(near.withColumn("exact", F.lit(False)))
    members = keyed.drop("words", "n", "sig").join(classes.select("k1", "k2", "class", "n_train", "n_other"), ["k1", "k2"])
    return links, members.select("record", *keep, F.col("_in_train").alias("in_train"), "class", "n_train", "n_other")


def _chunk(n: str) -> Column:
    return F.pmod(F.xxhash64("record"), F.ceil(F.col(n) / TOGETHER)).cast("int")


def split_overlap(df: DataFrame, *, record: str = "sent_idx", text: str = "text", split: str = "split", train: str = "train", differ: float = DIFFER) -> DataFrame:
    """(train_record, other_record, exact): all pairs of a training row and a row of another split with the same text.

    ``exact`` is true where the texts are equal by look and case, spaces and punctuation aside;
    otherwise they differ in less than ``differ`` of their words, a moved word counting once. A null split belongs to no side; null
    texts and texts without letters and digits overlap with none; repeated rows count each. Every such pair is found, however
    many texts share its words. Classes of many copies are put together in pieces of ``TOGETHER`` records.
    """
    links, members = class_overlap(df, record=record, text=text, split=split, train=train, differ=differ)
    pieces = lambda n: F.sequence(F.lit(0), F.ceil(F.col(n) / TOGETHER).cast("int") - 1)
    cut = links.withColumn("_t", F.explode(pieces("n_train"))).withColumn("_o", F.explode(pieces("n_other"))).drop("n_train", "n_other")
    trains = members.where("in_train").select(F.col("record").alias("train_record"), F.col("class").alias("train_class"), _chunk("n_train").alias("_t"))
    others = members.where("not in_train").select(F.col("record").alias("other_record"), F.col("class").alias("other_class"), _chunk("n_other").alias("_o"))
    return cut.join(trains, ["train_class", "_t"]).join(others, ["other_class", "_o"]).select("train_record", "other_record", "exact")


def overlap_counts(df: DataFrame, by: list[str], *, record: str = "sent_idx", text: str = "text", split: str = "split", train: str = "train", differ: float = DIFFER) -> DataFrame:
    """(by, n_pairs, n_exact, n_sentences): overlapping pairs and records of other splits, from the counts of classes; no pair of records is made."""
    links, members = class_overlap(df, record=record, text=text, split=split, train=train, differ=differ, keep=by)
    own = links.groupBy(F.col("other_class").alias("class")).agg(F.sum("n_train").alias("pairs"), F.sum(F.when(F.col("exact"), F.col("n_train")).otherwise(0)).alias("exact"))
    held = members.where("not in_train").groupBy("class", *by).agg(F.count("*").alias("n"), F.count_distinct("record").alias("records"))
    return held.join(own, "class").groupBy(*by).agg(F.sum(F.col("n") * F.col("pairs")).alias("n_pairs"), F.sum(F.col("n") * F.col("exact")).alias("n_exact"), F.sum("records").alias("n_sentences"))
