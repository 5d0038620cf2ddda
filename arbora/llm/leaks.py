"""Held-out passages inside a corpus, by winnowed fingerprints that are joined and extended to passages.

Texts are reduced to their letters and digits by look and case, so layout, markup, spaces,
punctuation and accents do not count. Of every ``WINDOW`` neighbouring hashes of ``K`` letters
the smallest is a fingerprint, of documents and of items alike. A shared stretch of ``FLOOR`` letters
therefore always gives a hit. Fingerprints of both sides are joined by a shuffle, whatever the number of
items, and the corpus is read once; a bitmap of the items' fingerprints, of bounded size, keeps the
documents' other ones out of it. A pair's hits name diagonals, along which equal stretches are
looked up and chained in order, and an item counts as leaked if the chain covers enough of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.script import fold_table
from arbora.operators.joins import split_join
from arbora.session import stored

K = 13
WINDOW = 4
#: A stretch of so many letters is always found; items with fewer are phrases, which are no case.
FLOOR = K + WINDOW - 1
#: Bits of the largest bitmap of items' fingerprints. With more fingerprints it lets more pass, and nothing is lost.
MOST_BITS = 26
#: Bits of the bitmap that a fingerprint must meet.
PROBES = 3
#: Code points handled at once in a task.
CHUNK = 1_500_000
#: Shorter equal stretches are not chained.
LEAST_RUN = 12
#: Stretches further apart than this, on either side, start another passage.
NEAR = 120
#: What starting another passage costs, in letters: scattered phrases never pay for it.
PASSAGE_COST = 40

_TAG = re.compile(r"<[^<>\n]{1,300}>")
_ENTITY = re.compile(r"&#?\w{1,8};")
#: A row of ten columns with an id and a head, as in CoNLL-U.
_ROW = re.compile(r"(?m)^[0-9][0-9.-]*\t([^\t\n]*)\t(?:[^\t\n]*\t){4}(?:[0-9]+|_)\t[^\t\n]*\t[^\t\n]*\t[^\t\n]*$")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """The text without markup; of token tables only the forms. What this takes away is searched by ``readings``."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if "\t" in text:
        text = _ROW.sub(r"\1", text)
    return text


def readings(text: str) -> list[str]:
    """The text without markup and, where that took away letters of tags or rows, also with all of them."""
    clean = plain(text)
    whole = _ENTITY.sub(" ", text) if "&" in text else text
    return [clean] if clean == whole else [clean, whole]


def letters(text: str) -> np.ndarray:
    """Codes of the letters and digits of a text, 32 at spaces and all else."""
    codes = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return codes[codes != 0]


def hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of the k letters from each position on: those of lengths that are powers of two, put together."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * _BASE
    h ^= h >> np.uint64(29)
    out, have = h[:0], 0
    n, base = 1, _BASE
    with np.errstate(over="ignore"):
        while True:
            if k & n:
                most = max(0, len(codes) - have - n + 1)
                out = out[:most] * base + h[have : have + most] if have else h
                have += n
            if n * 2 > k:
                break
            h = h[:-n] * base + h[n:] if len(h) > n else h[:0]
            base = base * base
            n *= 2
        out = out ^ (out >> np.uint64(31))
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The positions whose hash is the smallest of some window of neighbours."""
    n = len(h) - window + 1
    if n <= 0:
        return np.arange(len(h))
    least = h[:n].copy()
    for j in range(1, window):
        np.minimum(least, h[j : j + n], out=least)
    picked = np.zeros(len(h), bool)
    for j in range(window):
        picked[j : j + n] |= h[j : j + n] == least
    return np.flatnonzero(picked)


class Item:
    """The letters and words of an item."""

    def __init__(self, text: str):
        c = letters(plain(text))
        gap = c == 32
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
        before = np.concatenate([[0], np.cumsum(~gap)])  # letters before each place
        self.start, self.end = before[edge[::2]], before[edge[1::2]]
        self.codes = c[~gap]

    def share(self, begin: np.ndarray, size: np.ndarray) -> float:
        """The share of the words that lie in the stretches."""
        cover = np.zeros(len(self.codes) + 1, np.int64)
        for i, n in zip(begin.tolist(), size.tolist()):
            cover[i : i + n] = 1
        total = np.concatenate([[0], np.cumsum(cover)])
        whole = total[self.end] - total[self.start] == self.end - self.start
        return float(whole.mean()) if len(whole) else 0.0

    def covered(self, doc: np.ndarray, diagonals: np.ndarray) -> float:
        """The share of the item's words in the best chain of equal stretches on the diagonals (place in the document less place in the item)."""
        code = self.codes
        found = []
        for d in diagonals.tolist():
            lo, hi = max(0, -d), min(len(code), len(doc) - d)
            if hi - lo < LEAST_RUN:
                continue
            same = np.concatenate([[False], code[lo:hi] == doc[lo + d : hi + d], [False]])
            edge = np.flatnonzero(same[1:] != same[:-1])
            a, b = edge[::2], edge[1::2]
            long = b - a >= LEAST_RUN
            a, n = a[long] + lo, (b - a)[long]
            if len(n) and n[0] == len(code):
                return 1.0
            found.append(np.stack([a + d, a, n], 1))
        runs = np.concatenate([*found, np.zeros((0, 3), np.int64)])
        if not len(runs):
            return 0.0
        at, of, size = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))].T
        score, back = size.astype(float), np.full(len(size), -1)
        for j in range(1, len(size)):
            ends_at, ends_of = at[:j] + size[:j], of[:j] + size[:j]
            lap = np.maximum(0, np.maximum(ends_at - at[j], ends_of - of[j]))
            far = (at[j] - ends_at > NEAR) | (of[j] - ends_of > NEAR)
            s = np.where((of[:j] < of[j]) & (lap < size[j]), score[:j] + size[j] - lap - far * PASSAGE_COST, -np.inf)
            i = j - 1 - int(np.argmax(s[::-1]))
            if s[i] > score[j]:
                score[j], back[j] = s[i], i
        chain = []
        j = int(np.argmax(score))
        while j >= 0:
            chain.append(j)
            j = int(back[j])
        return self.share(of[chain], size[chain])


def diagonals(met: list[dict], item_size: int, doc_size: int) -> np.ndarray:
    """All differences between places of one fingerprint in the document and in the item."""
    seen = np.zeros(item_size + doc_size + 1, bool)
    for m in met:
        at, of = np.array(m["at"]), np.array(m["of"])
        if len(of) <= len(at):
            for p in of.tolist():
                seen[at - p + item_size] = True
        else:
            for p in at.tolist():
                seen[p - of + item_size] = True
    return np.flatnonzero(seen) - item_size


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of runs of texts that hold about ``most`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


_PLACES = pa.list_(pa.int32())


def _grouped(row: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.ListArray]:
    """(row, hash, places) of every different hash of a row."""
    order = np.lexsort((at, h, row))
    row, h, at = row[order], h[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(row) else np.zeros(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(at, pa.int32()))
    return row[first], pa.array(h[first].view(np.int64)), places


def item_prints(items: DataFrame, k: int, window: int) -> DataFrame:
    """(item, h, of, n_letters): the fingerprints of each item with their places; ``items`` has (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [Item(t).codes for t in b.column("text").to_pylist()]
            size = np.array([len(c) for c in codes], np.int64)
            prints = [hashes(c, k) if len(c) >= k + window - 1 else np.zeros(0, np.uint64) for c in codes]
            at = [winnow(h, window) for h in prints]
            row = np.repeat(np.arange(len(at)), [len(x) for x in at])
            row, h, of = _grouped(row, np.concatenate([h[x] for h, x in zip(prints, at)]), np.concatenate(at))
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(row)), h, of, pa.array(size[row], pa.int32())], ["item", "h", "of", "n_letters"])

    return items.select("item", "text").mapInArrow(run, "item bigint, h bigint, of array<int>, n_letters int")


def bitmap(prints: DataFrame) -> np.ndarray:
    """The bits that ``PROBES`` stretches of each fingerprint name: 64 times as many bits as fingerprints, but ``2**MOST_BITS`` at most."""
    n = prints.count()
    bits = max(6, min(MOST_BITS, n.bit_length() + 6))
    low = F.explode(F.array(*(F.shiftrightunsigned("h", i * 64 // PROBES).bitwiseAND((1 << bits) - 1) for i in range(PROBES))))
    words = prints.select(low.alias("low")).groupBy(F.shiftright("low", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))")).alias("w"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words.toLocalIterator():
        out[r["at"]] = r["w"]
    return out


def _maybe(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of the hashes all of whose bits are set."""
    at = np.arange(len(h))
    mask = np.uint64(len(words) * 64 - 1)
    for i in range(PROBES):
        low = (h[at] >> np.uint64(i * 64 // PROBES)) & mask
        at = at[(words[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)).astype(np.int64)) & 1 == 1]
    return at


def _doc_prints(docs: DataFrame, known: np.ndarray, k: int, window: int) -> DataFrame:
    """(uid, id, reading, letters, prints) of the readings of documents with a fingerprint in the bitmap; ``docs`` has (uid, id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for b in batches:
            for start, part in chunks(b.column("text").to_pylist()):
                read = [readings(t) for t in part]
                whose = np.array([start + i for i, r in enumerate(read) for _ in r])
                turn = np.array([j for r in read for j in range(len(r))])
                codes = [letters(x) for r in read for x in r]
                codes = [c[c != 32] for c in codes]
                ends = np.cumsum([len(c) for c in codes])
                stream = np.concatenate(codes)
                found, hs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for a in range(0, len(stream), CHUNK):
                    h = hashes(stream[a : a + CHUNK + k + window - 2], k)
                    at = winnow(h, window)
                    h = h[at]
                    hit = _maybe(words, h)
                    found.append(at[hit] + a)
                    hs.append(h[hit])
                at, h = np.concatenate(found), np.concatenate(hs)
                if not len(at):
                    continue
                row = np.searchsorted(ends, at, "right")
                inside = at + k <= ends[row]
                at, h, row = at[inside], h[inside], row[inside]
                one = np.unique(row * np.int64(len(stream) + 1) + at, return_index=True)[1]  # chunks overlap
                at, h, row = at[one], h[one], row[one]
                if not len(at):
                    continue
                row_, h_, places = _grouped(row, h, at - np.concatenate([[0], ends])[row])
                first = np.flatnonzero(np.concatenate([[True], row_[1:] != row_[:-1]]))
                prints = pa.ListArray.from_arrays(pa.array(np.append(first, len(row_)), pa.int32()), pa.StructArray.from_arrays([h_, places], ["h", "at"]))
                rows = row_[first]
                take = pa.array(whose[rows])
                text = [codes[i].astype("<u4").tobytes().decode("utf-32-le") for i in rows.tolist()]
                yield pa.RecordBatch.from_arrays([b.column("uid").take(take), b.column("id").take(take), pa.array(turn[rows], pa.int32()), pa.array(text, pa.string()), prints], ["uid", "id", "reading", "letters", "prints"])

    return docs.mapInArrow(run, f"uid bigint, id {kind}, reading int, letters string, prints array<struct<h: bigint, at: array<int>>>")


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, window: int = WINDOW, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, share): every document that holds at least ``least`` of an item's words.

    The words must stand in the item's order, as one passage or a few, of stretches one of which has ``k + window - 1`` letters
    (16), and hit one fingerprint at least for every ``2 * (k + window) / least`` letters (68) of the item. Null and empty texts hold
    nothing, items of fewer than 16 letters are never found. A document that is repeated gives its rows each time,
    an item that is repeated counts once. Whole texts are read, once for all items; only documents with hits are shuffled.
    """
    named = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    asked = stored(named.withColumn("item", F.monotonically_increasing_id()))
    prints = stored(item_prints(asked, k, window))
    read = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    hit = stored(_doc_prints(read, bitmap(prints), k, window))
    met = split_join(hit.select("uid", "reading", F.inline("prints")), prints, "h", "uid")
    pairs = met.groupBy("uid", "reading", "item").agg(F.collect_list(F.struct("at", "of")).alias("met"), F.sum(F.size("of")).alias("n"), F.first("n_letters").alias("n_letters"))
    pairs = pairs.where(F.col("n") * (k + window) >= 0.5 * least * F.col("n_letters")).select("uid", "reading", "item", "met")
    # the letters come last, so that those of a document with many items are moved once
    both = pairs.join(asked, "item").join(hit.select("uid", "reading", "id", "letters"), ["uid", "reading"]).select("uid", "id", "item_id", "letters", "text", "met")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Item] = {}
        for b in batches:
            keep, shares = [], []
            for i in range(b.num_rows):
                t = b.column("text")[i].as_py()
                item = known.get(t)
                if item is None:
                    if len(known) > 1000:
                        known.clear()
                    item = known[t] = Item(t)
                doc = np.frombuffer(b.column("letters")[i].as_py().encode("utf-32-le"), np.uint32)
                share = item.covered(doc, diagonals(b.column("met")[i].as_py(), len(item.codes), len(doc)))
                if share >= least:
                    keep.append(i)
                    shares.append(share)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("uid", "id", "item_id")), pa.array(shares, pa.float64())], ["uid", "id", "item_id", "share"])

    found = both.mapInArrow(run, f"uid bigint, id {kind}, item_id bigint, share double")
    one = found.groupBy("uid", "item_id").agg(F.first("id").alias(doc_id), F.max("share").alias("share"))
    return one.select(doc_id, "item_id", "share")
