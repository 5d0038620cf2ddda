"""Per-document text statistics and prose, list, table and junk shares, by a hidden Markov model.

A text is cut into segments: lines, long lines again after so many words. A segment's
statistics are counts (common words of the best language among its words, words that repeat a
five-word run seen before in the text, delimiters, digits and damaged characters among its
characters, its number of words). Each state gives them binomial or tabled chances, the states
are sticky, and the likeliest state sequence labels the segments. All documents of a chunk
are decoded side by side.

The texts are read once; the segments' statistics are stored, nine numbers each. On them the chances of states to begin
and to follow each other are trained, on all documents, by counting over the likeliest labels and drawing the result to the stated chances.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.leaks import chunks
from arbora.llm.script import Fold, fold_table, words
from arbora.session import stored

STATES = ("prose", "list", "table", "junk")
#: A bound for the reference table of common words, which is sent to every task.
MOST_WORDS = 1_000_000
#: Words in a segment of a long line.
SEGMENT = 25
#: Words of a repeated run.
RUN = 5
#: Segments on either side that help to choose the language, and the weight of the segment itself.
AROUND = 3
OWN = 4

# The model. Hidden states with their label, and by state the chances that a word
# is a common one, that it ends a run seen before, that a character is a delimiter, a digit,
# damaged, or part of a tag; then of 0, 1, 2 to 3, 4 to 6, and more words in a segment.
HIDDEN = ("prose", "list", "table", "heap", "damaged", "markup", "repeated")
LABEL = (0, 1, 2, 3, 3, 3, 3)
COMMON = (0.40, 0.05, 0.08, 0.04, 0.25, 0.12, 0.38)
AGAIN = (0.03, 0.06, 0.10, 0.05, 0.03, 0.10, 0.75)
DELIMITER = (0.005, 0.03, 0.15, 0.03, 0.01, 0.05, 0.01)
DIGIT = (0.006, 0.02, 0.10, 0.06, 0.01, 0.03, 0.02)
DAMAGED = (0.0005, 0.001, 0.001, 0.005, 0.06, 0.001, 0.001)
TAG = (0.02, 0.01, 0.02, 0.01, 0.01, 0.60, 0.01)
N_WORDS = (
    (0.02, 0.03, 0.07, 0.13, 0.75),
    (0.02, 0.30, 0.40, 0.18, 0.10),
    (0.02, 0.10, 0.28, 0.30, 0.30),
    (0.03, 0.17, 0.15, 0.15, 0.50),
    (0.02, 0.03, 0.07, 0.13, 0.75),
    (0.15, 0.25, 0.25, 0.15, 0.20),
    (0.02, 0.03, 0.07, 0.13, 0.75),
)
SHOWN = (COMMON, AGAIN, DELIMITER, DIGIT, DAMAGED, TAG)
# Where training starts, and what it is drawn to by so many steps of its own.
STAY = 0.88
START = (0.46, 0.14, 0.14, 0.08, 0.06, 0.06, 0.06)
PRIOR = 200
#: Chances are trained on all documents in so many rounds.
ROUNDS = 3
#: The share that a stated chance of what a state shows keeps beside the trained one. There are no labelled documents, and
#: without labels trained ones drift: at 0.9 every eighth table of a treebank's documents became junk. So they stay as stated.
STATED = 1.0
#: Segments decoded at once in a task.
DECODED = 40_000
#: Binomial evidence of one segment counts as of so many trials at most: words and characters of a line are no independent draws.
TRIALS = 40

_TAG = re.compile(r"<[^<>\n]{1,300}>|&#?\w{1,8};")
_DELIMITERS = "|;\t_=<>{}[]()→–»#:/\\@~^*+"
_DAMAGED = "�ÃÂ¿â€™ï½¢ð"
_END = ".!?…。！？"


@lru_cache(1)
def _classes() -> np.ndarray:
    """Bit flags of code points: 1 newline, 2 delimiter, 4 digit, 8 damaged, 16 sentence end, 32 blank, 64 letter, 128 symbol."""
    t = np.zeros(0x110000, np.uint8)
    for cp in range(0x30000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if c.isspace():
            t[cp] |= 32
        elif kind[0] in "LM":
            t[cp] |= 64
        elif kind == "Nd":
            t[cp] |= 4
        elif kind[0] in "PSC":
            t[cp] |= 128
        if kind == "Cc" and not c.isspace() or 0x80 <= cp < 0xA0 or kind == "Co":
            t[cp] |= 8
    t[0x30000:] = 64
    for c in _DELIMITERS:
        t[ord(c)] |= 2
    for c in _DAMAGED:
        t[ord(c)] |= 8
    for c in _END:
        t[ord(c)] |= 16
    t[10] |= 1
    return t


def _binomial(k: np.ndarray, n: np.ndarray, p: tuple[float, ...]) -> np.ndarray:
    """Log-likelihood by state, at most TRIALS trials."""
    scale = np.minimum(1.0, TRIALS / np.maximum(n, 1))
    p_ = np.array(p)
    return (k * scale)[:, None] * np.log(p_) + ((n - k) * scale)[:, None] * np.log1p(-p_)


class Moves(NamedTuple):
    """Log-chances of a state to come first, and to follow another, and the chances of what a state shows (None: as stated)."""

    start: np.ndarray
    step: np.ndarray
    shown: np.ndarray | None = None  # by statistic and state
    sizes: np.ndarray | None = None  # by state and number of words

    @staticmethod
    def untrained() -> "Moves":
        k = len(START)
        step = np.full((k, k), (1 - STAY) / (k - 1))
        np.fill_diagonal(step, STAY)
        return Moves(np.log(np.array(START)), np.log(step))

    def after(self, path: np.ndarray, first: np.ndarray) -> "Moves":
        """The chances by counts over labelled sequences, drawn to the untrained ones."""
        return Moves.of(moves_in(path, first))

    @staticmethod
    def of(counts: np.ndarray) -> "Moves":
        """The chances by the counts that ``moves_in``, or ``counts_in``, gives, drawn to the untrained ones."""
        k = len(START)
        base = Moves.untrained()
        start = counts[:k] + PRIOR * np.exp(base.start)
        step = counts[k : k + k * k].reshape(k, k) + PRIOR * np.exp(base.step)
        moves = Moves(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)))
        rest = counts[k + k * k :]
        if not len(rest):
            return moves
        hits, trials = rest[: 12 * k].reshape(2, 6, k).astype(float)
        sizes = rest[12 * k :].reshape(k, -1).astype(float)
        mixed = lambda stated, got, n: np.where(n > 0, STATED * stated + (1 - STATED) * got / np.maximum(n, 1), stated)
        shown = np.clip(mixed(np.array(SHOWN), hits, trials), 1e-5, 1 - 1e-5)
        return moves._replace(shown=shown, sizes=mixed(np.array(N_WORDS), sizes, sizes.sum(1, keepdims=True)))


def moves_in(path: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each state comes first, then how often each follows each, in labelled sequences."""
    k = len(START)
    inner = np.ones(len(path), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    return np.concatenate([np.bincount(path[first], minlength=k), np.bincount(path[at - 1].astype(np.int64) * k + path[at], minlength=k * k)])


def viterbi(evidence: np.ndarray, first: np.ndarray, length: np.ndarray, moves: Moves) -> np.ndarray:
    """The likeliest state of every row; the rows of a sequence stand together."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    back = np.zeros(evidence.shape, np.int8)
    v = evidence[first] + moves.start
    ends = np.zeros(len(first), np.int64)
    most = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(1, most + 1), "right")  # sequences with so many rows
    for t in range(1, most):
        n = alive[t]
        ends[n : alive[t - 1]] = v[n : alive[t - 1]].argmax(1)
        s = v[:n, :, None] + moves.step
        b = s.argmax(1)
        v = np.take_along_axis(s, b[:, None, :], 1)[:, 0] + evidence[first[:n] + t]
        back[first[:n] + t] = b
    if most:
        ends[: len(v)] = v.argmax(1)
    path = np.zeros(len(evidence), np.int8)
    state = ends
    for t in range(most - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        path[at] = state[:n]
        state = state.copy()
        state[:n] = back[at, state[:n]]
    return path


#: What is kept of a segment: common words, words, repeats, delimiters, digits, damaged characters, characters without tags, tag characters, characters.
SEG = 9
#: Where the hits and the trials of each statistic of ``SHOWN`` stand.
_HITS, _TRIALS = (0, 2, 3, 4, 5, 7), (1, 1, 6, 6, 6, 8)


def _size(seg: np.ndarray) -> np.ndarray:
    return np.digitize(seg[:, 1], [1, 2, 4, 7])


def evidence(seg: np.ndarray, moves: Moves) -> np.ndarray:
    """Log-likelihood of each segment by state."""
    shown = np.array(SHOWN) if moves.shown is None else moves.shown
    sizes = np.array(N_WORDS) if moves.sizes is None else moves.sizes
    out = np.log(np.maximum(sizes, 1e-5)).T[_size(seg)]
    for hit, trial, p in zip(_HITS, _TRIALS, shown):
        out += _binomial(seg[:, hit], seg[:, trial], p)
    return out


def decoded(seg: np.ndarray, length: np.ndarray, moves: Moves) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest state of each segment, and the first segment of each sequence that has any; sequences stand one behind the other."""
    first = np.cumsum(length) - length
    has = length > 0
    return viterbi(evidence(seg, moves), first[has], length[has], moves), first[has]


def counts_in(seg: np.ndarray, length: np.ndarray, moves: Moves) -> np.ndarray:
    """``moves_in`` over the likeliest labels, then by statistic and state thousandths of hits and of trials, and segments by state and number of words."""
    k = len(START)
    path, first = decoded(seg, length, moves)
    shown = np.zeros((2, 6, k), np.int64)
    for i, (hit, trial) in enumerate(zip(_HITS, _TRIALS)):
        n = seg[:, trial].astype(float)
        weight = 1000 * np.minimum(1.0, TRIALS / np.maximum(n, 1))
        for j, x in enumerate((seg[:, hit] * weight, n * weight)):
            shown[j, i] = np.bincount(path, weights=np.rint(x), minlength=k)
    sizes = np.bincount(path.astype(np.int64) * len(N_WORDS[0]) + _size(seg), minlength=k * len(N_WORDS[0]))
    return np.concatenate([moves_in(path, first), shown.ravel(), sizes])


N_COUNTS = len(START) * (len(START) + 1 + 12 + len(N_WORDS[0]))


class Model:
    """Common words by language, and what is needed to take the statistics of texts."""

    def __init__(self, common: list[tuple[str, str]], moves: Moves | None = None):
        self.moves = moves or Moves.untrained()
        fold = Fold()
        number = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in common}))}
        self.n = max(1, len(number))
        of: dict[str, set[int]] = {}
        for lang, w in common:
            for x in words(w, fold):
                of.setdefault(x, set()).add(number[lang])
        # words with the same languages share one list of them; list 0 is empty
        lists: dict[tuple[int, ...], int] = {(): 0}
        self.known = {w: lists.setdefault(tuple(sorted(x)), len(lists)) for w, x in of.items()}
        self.list_size = np.array([len(x) for x in lists], np.int64)
        self.list_first = np.cumsum(self.list_size) - self.list_size
        self.langs = np.array([x for y in lists for x in y], np.int64)
        self.flags = _classes()
        self.fold = fold_table().copy()
        self.fold[10] = 10
        for cp in (9, 11, 12, 13, 0x85, 0x2028, 0x2029):
            self.fold[cp] = 32

    def chunks(self, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
        """Texts that are measured at once: fewer where there are very many languages."""
        return chunks(texts, 600_000 * 64 // max(64, self.n))

    def count(self, texts: list[str]) -> np.ndarray:
        """``counts_in`` of the texts."""
        _, seg, length = self.measure(texts)
        return counts_in(seg, length, self.moves)

    def measure(self, texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Statistics of each text by name (see ``text_quality``), the rows of all segments, and each text's number of segments."""
        docs = len(texts)
        tagged = [_TAG.sub(lambda m: "\x01" * len(m.group()), t) if "<" in t or "&" in t else t for t in texts]
        code = np.frombuffer("\n".join(tagged).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
        tag = code == 1
        flag = self.flags[code]
        newline = code == 10
        sizes = np.array([len(t) for t in texts])
        doc_end = np.cumsum(sizes + 1) - 1  # each text's closing newline
        # lines
        line_end = np.flatnonzero(newline)
        line_start = np.concatenate([[0], line_end[:-1] + 1])
        line_doc = np.searchsorted(doc_end, line_end, "left")
        full = np.add.reduceat(((flag & 32) == 0) & ~newline, line_start) > 0  # lines with anything but blanks

        # words: runs of folded letters
        folded = np.where(tag, np.uint32(32), self.fold[code])
        kept = np.flatnonzero(folded != 0)
        f = folded[kept]
        gap = (f == 32) | (f == 10)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
        a, b = edge[::2], edge[1::2]
        text = f.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split()
        n_words = len(a)
        if len(text) != n_words:  # a letter that Python takes for a blank
            text = ["".join(map(chr, f[i:j])) for i, j in zip(a.tolist(), b.tolist())]
        get = self.known.get
        known = np.fromiter([get(w, 0) for w in text], np.int64, n_words)
        word_at = kept[a] if n_words else np.zeros(0, np.int64)
        word_line = np.searchsorted(line_end, word_at, "left")
        word_doc = line_doc[word_line] if n_words else np.zeros(0, np.int64)

        # words that end a run of RUN words seen before in the same text
        ids = np.fromiter(map(hash, text), np.int64, n_words).astype(np.uint64)
        again = np.zeros(n_words, bool)
        if n_words >= RUN:
            with np.errstate(over="ignore"):
                h = word_doc[RUN - 1 :].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for j in range(RUN):
                    h = (h ^ ids[j : n_words - RUN + 1 + j]) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(31)
            same_doc = word_doc[RUN - 1 :] == word_doc[: n_words - RUN + 1]
            order = np.argsort(h, kind="stable")
            dup = np.concatenate([[False], h[order][1:] == h[order][:-1]])
            seen = np.zeros(len(h), bool)
            seen[order] = dup
            again[RUN - 1 :] = seen & same_doc

        # segments: full lines, cut after every SEGMENT words
        rank = np.arange(n_words) - np.searchsorted(word_line, word_line, "left") if n_words else np.zeros(0, np.int64)
        cuts = word_at[(rank > 0) & (rank % SEGMENT == 0)]
        seg_start = np.union1d(line_start[full], cuts)
        if not len(seg_start):
            zero = np.zeros(docs)
            return {k: zero.astype(np.int64) if k[:2] == "n_" else zero for k in STATISTICS}, np.zeros((0, SEG), np.int32), np.zeros(docs, np.int64)
        seg_doc = np.searchsorted(doc_end, seg_start, "left")
        bounds = np.append(seg_start, len(code))

        def total(x: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
            return c[bounds[1:]] - c[bounds[:-1]]

        dark = (flag & 32) == 0
        chars = total(dark)
        word_seg = np.searchsorted(seg_start, word_at, "right") - 1
        seg_words = np.bincount(word_seg, minlength=len(seg_start))
        many = self.list_size[known]
        ends = np.cumsum(many)
        lang = self.langs[np.repeat(self.list_first[known] - ends + many, many) + np.arange(ends[-1] if n_words else 0)]
        by_lang = np.bincount(np.repeat(word_seg, many) * self.n + lang, minlength=len(seg_start) * self.n).reshape(-1, self.n)
        doc_first = np.searchsorted(seg_doc, np.arange(docs), "left")
        doc_len = np.searchsorted(seg_doc, np.arange(docs), "right") - doc_first
        c = np.concatenate([np.zeros((1, self.n)), np.cumsum(by_lang, 0)])
        i = np.arange(len(seg_start))
        lo = np.maximum(i - AROUND, doc_first[seg_doc])
        hi = np.minimum(i + AROUND + 1, doc_first[seg_doc] + doc_len[seg_doc])
        best = (c[hi] - c[lo] + OWN * by_lang).argmax(1)
        common = by_lang[i, best]
        repeats = np.bincount(word_seg, weights=again, minlength=len(seg_start))
        tags = total(tag)
        plain = ~tag
        damage = [total((flag & bit > 0) & plain) for bit in (2, 4, 8)]
        seg = np.stack([common, seg_words, repeats, *damage, chars - tags, tags, chars], 1).astype(np.int32)
        weight = np.bincount(seg_doc, weights=chars, minlength=docs)
        per_doc = lambda x: np.bincount(seg_doc, weights=x, minlength=docs)
        nw = np.bincount(word_doc, minlength=docs)
        length = np.bincount(word_doc, weights=b - a, minlength=docs) if n_words else np.zeros(docs)
        closed = self._closed(flag, line_start[full], line_end[full])
        lines = np.bincount(line_doc[full], minlength=docs)
        out = {
            "n_words": nw.astype(np.int64),
            "n_lines": lines.astype(np.int64),
            "mean_word_length": length / np.maximum(nw, 1),
            "symbol_ratio": per_doc(total(flag & 128 > 0)) / np.maximum(weight, 1),
            "digit_ratio": per_doc(total(flag & 4 > 0)) / np.maximum(weight, 1),
            "ended_lines_share": np.bincount(line_doc[full], weights=closed, minlength=docs) / np.maximum(lines, 1),
            "common_word_share": per_doc(common) / np.maximum(nw, 1),
            "repeated_share": np.bincount(word_doc, weights=again, minlength=docs) / np.maximum(nw, 1),
        }
        return out, seg, doc_len

    @staticmethod
    def _closed(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the last dark character of each line ends a sentence."""
        dark = np.flatnonzero((flag & 32) == 0)
        last = dark[np.searchsorted(dark, end, "left") - 1]
        return (flag[last] & 16 > 0).astype(np.int64)


STATISTICS = ("n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "ended_lines_share", "common_word_share", "repeated_share")


def scanned(docs: DataFrame, known: list[tuple[str, str]], doc_id: str, text: str) -> DataFrame:
    """(id, STATISTICS, seg): the statistics of each text, and those of its segments one behind the other."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} {'bigint' if c[:2] == 'n_' else 'double'}" for c in STATISTICS) + ", seg array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(known)
        for b in batches:
            for start, part in model.chunks([t or "" for t in b.column("text").to_pylist()]):
                got, seg, length = model.measure(part)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length * SEG)]), pa.int32()), pa.array(seg.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(start, len(part)), *(pa.array(got[c]) for c in STATISTICS), lists], ["id", *STATISTICS, "seg"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _parts(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, segments, their number by row) of runs of rows with about ``DECODED`` segments."""
    lists = b.column("seg")
    offset = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy()
    start = 0
    while start < b.num_rows:
        end = max(start + 1, int(np.searchsorted(offset, offset[start] + DECODED * SEG, "right")) - 1)
        end = min(end, b.num_rows)
        yield start, flat[offset[start] : offset[end]].reshape(-1, SEG), np.diff(offset[start : end + 1]) // SEG
        start = end


def trained_on(segments: DataFrame) -> Moves:
    """The chances, fitted to the likeliest labels of the segments of all documents, ``ROUNDS`` times.

    Each task gives one row a count; only their sums reach the driver.
    """
    moves = Moves.untrained()
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], moves: Moves = moves) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(N_COUNTS, np.int64)
            for b in batches:
                for _, seg, length in _parts(b):
                    counts += counts_in(seg, length, moves)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

        total = np.zeros(N_COUNTS, np.int64)
        for at, n in segments.select("seg").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n")).collect():
            total[at] = n
        moves = Moves.of(total)
    return moves


def trained(docs: DataFrame, known: list[tuple[str, str]], text: str = "text") -> Moves:
    """``trained_on`` the segments of all whole documents, which are read once."""
    read = docs.where(F.length(text) > 0)
    return trained_on(stored(scanned(read, known, text, text).select("seg")))


def text_quality(docs: DataFrame, common: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the statistics, the share of each label, and ``label``.

    Shares are of the characters that are no blanks. ``label`` is ``prose`` where prose has at
    least half, else the largest of the others (ties in the order list, table, junk). A null text,
    an empty one and one of blanks only have zero statistics and the label ``junk``. Repeated rows give a
    row each. ``common`` (lang, word) is a reference table of at most ``MOST_WORDS`` rows, of any number of languages;
    the language is found from the words, a document's own label of it is not used. Whole texts
    are read, once; no text is shuffled. How labels follow each other is trained on all documents (see ``trained_on``).
    """
    known = [(r[0], r[1]) for r in common.select("lang", "word").where("lang is not null and word is not null").limit(MOST_WORDS + 1).collect()]
    if len(known) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    segments = stored(scanned(docs, known, doc_id, text))
    moves = trained_on(segments)
    kind = docs.schema[doc_id].dataType.simpleString()
    shares = [f"{s}_share" for s in STATES]
    cols = [*STATISTICS, *shares]
    schema = f"`{doc_id}` {kind}, " + ", ".join(f"{c} {'bigint' if c[:2] == 'n_' else 'double'}" for c in cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share = np.zeros((len(STATES), b.num_rows))
            for start, seg, length in _parts(b):
                state = np.array(LABEL)[decoded(seg, length, moves)[0]]
                row = np.repeat(np.arange(len(length)), length)
                chars = seg[:, 8].astype(float)
                weight = np.maximum(np.bincount(row, weights=chars, minlength=len(length)), 1)
                for j in range(len(STATES)):
                    share[j, start : start + len(length)] = np.bincount(row, weights=chars * (state == j), minlength=len(length)) / weight
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", *STATISTICS)), *(pa.array(x) for x in share)], [doc_id, *cols])

    measured = segments.mapInArrow(run, schema)
    others = F.greatest(*(F.col(s) for s in shares[1:]))
    label = F.when((F.col("prose_share") >= 0.5), "prose").when(F.col("n_lines") == 0, "junk")
    for s, name in zip(shares[1:], STATES[1:]):
        label = label.when(F.col(s) == others, name)
    return measured.withColumn("label", label)
