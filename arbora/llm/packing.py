"""Texts into sequences of fixed capacity, by best fit under conflicts.

Texts are measured in tokens of a public tokenizer and spread over blocks by a hash, so that no
block is large and no source or group of copies fills one. In a block, the items are taken
from the longest to the shortest. Bins are ordered by the room they have left: each room has a bitmap of its
bins, and each source and each group of copies a bitmap of the bins it is in. For an item the search starts at the least room
that holds it and goes on to the next one until a bin without conflict is found; else a new bin opens.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.leaks import letters
from arbora.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how texts are split before byte pairs are merged.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of a block. More items fill the sequences a little better, fewer keep tasks smaller.
BLOCK = 20_000
#: A bound for the vocabulary file, which is sent to every task.
MOST_VOCABULARY = 64_000_000


@lru_cache(2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str):
    """The tokenizer of a vocabulary file."""
    data = Path(path).read_bytes()
    if len(data) > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MOST_VOCABULARY} bytes")
    return _encoding(data)


def sized(docs: DataFrame, doc_id: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, copies): each text's length, and a number that copies by look and case share. The vocabulary is read by the driver."""
    tokenizer(vocabulary)
    data = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    read = read.where("doc_id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _encoding(data.value)
        for b in batches:
            n, group = [], []
            for s in b.column("text").to_pylist():
                n.append(len(t.encode_ordinary(s)))
                c = letters(s)
                group.append(xxhash.xxh64_intdigest(c[c != 32].tobytes()) - (1 << 63))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int32()), pa.array(group, pa.int64())], ["doc_id", "source", "n_tokens", "copies"])

    return read.mapInArrow(run, "doc_id bigint, source string, n_tokens int, copies bigint")


def best_fit(lengths: list[int], groups: list[int], sources: list[int], capacity: int, apart: dict[int, int] | None = None, spare: int | None = None) -> list[int]:
    """The bin of each item. Lengths are at most ``capacity``.

    ``groups`` and ``sources`` number the groups of copies and the sources. Two items of one group never share a bin, and sources
    never do that ``apart`` names: it has for a source the bitmap of the sources it must not meet.
    Of several bins with the least room, one without the item's source is preferred. With ``spare``, copies are only
    kept apart while no more bins are open than the items need and one in ``spare`` more.
    """
    need = max(1, math.ceil(sum(lengths) / capacity))
    budget = need + need // spare + 1 if spare else None
    times: dict[int, int] = {}
    for g in groups:
        times[g] = times.get(g, 0) + 1
    # copies that need about as many bins as there must be come first, and the others fill these
    order = sorted(range(len(lengths)), key=lambda i: (2 * times[groups[i]] < need, -lengths[i], groups[i], i))
    apart = apart or {}
    at_room = [0] * (capacity + 1)  # bitmaps of bins
    of_group = {g: 0 for g, n in times.items() if n > 1}
    of_source = [0] * (max(sources, default=0) + 1)
    filled = 0  # bitmap of the rooms that some bin has
    bins = 0
    out = [0] * len(lengths)
    last, go_on = None, 0  # the last item's group and length, and the room below which it found no free bin

    def search(room: int, closed: int, met: int) -> tuple[int, int]:
        """(bin, its room): the tightest bin from this room on that is not closed, -1 if there is none."""
        while room <= capacity:
            rest = filled >> room
            if not rest:
                break
            room += (rest & -rest).bit_length() - 1
            free = at_room[room] & ~closed
            if free:
                return ((free & ~met) or free).bit_length() - 1, room
            room += 1
        return -1, capacity

    for i in order:
        n, g, source = lengths[i], groups[i], sources[i]
        own = of_group.get(g, 0)
        bad = apart.get(source, 0)
        foe = 0
        while bad:
            foe |= of_source[(bad & -bad).bit_length() - 1] if (bad & -bad).bit_length() <= len(of_source) else 0
            bad &= bad - 1
        start = max(n, go_on) if (g, n) == last and g in of_group and not foe else n
        found, room = search(start, own | foe, of_source[source])
        go_on = n if foe else room if found >= 0 else capacity + 1
        if found < 0 and own and budget is not None and bins >= budget:
            found, room = search(n, foe, of_source[source])
        if found < 0:
            found, room = bins, capacity
            bins += 1
        else:
            at_room[room] &= ~(1 << found)
            if not at_room[room]:
                filled &= ~(1 << room)
        one = 1 << found
        if g in of_group:
            of_group[g] |= one
        of_source[source] |= one
        at_room[room - n] |= one
        filled |= 1 << (room - n)
        last = (g, n)
        out[i] = found
    return out


def pack(docs: DataFrame, windows: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, apart: list[tuple[str, str]] | None = None, block: int = BLOCK, spare: int | None = None) -> DataFrame:
    """(model_name, capacity, doc_id, piece, first_token, n_tokens, sequence, at): where every text comes to stand.

    ``windows`` has the columns model_name and capacity; the texts are packed for each. A text of at most
    ``capacity`` tokens is one piece. A longer one is cut into full pieces, each its own sequence, and one
    that holds the rest. ``first_token`` is where the piece starts in its text, ``at`` where it starts in its sequence.
    ``sequence`` is unique for a model. Copies of a text, by look and case, never share a sequence, nor do the pairs of sources in
    ``apart``; ``spare`` lets copies meet where that takes more sequences than the texts need and one in ``spare`` more. Empty texts are pieces of no tokens; null texts are left out, a
    null source is one of its own. Repeated rows with one ``doc_id`` are packed each.
    """
    caps = windows.select("model_name", F.col("capacity").cast("int").alias("capacity")).where("capacity > 0")
    s = cut(sized(docs, doc_id, text, source, vocabulary))
    blocks = max(1, math.ceil(s.count() / block))
    rows = s.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).cast("int"))
    each = _for_each(rows, caps)
    full = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0).cast("int")
    each = each.withColumn("full", full).withColumn("rest", (F.col("n_tokens") - F.col("full") * F.col("capacity")).cast("int"))
    # full pieces fill a sequence each
    own = each.where("full > 0").select(
        "model_name", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), "row"
    )
    own = own.select(
        "model_name", "capacity", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"), F.concat_ws("-", F.lit("d"), "row", "piece").alias("sequence"), F.lit(0).alias("at")
    )
    items = each.where("rest > 0 or full = 0").select("model_name", "capacity", "block", "doc_id", "source", "copies", "full", "rest")
    pairs = apart or []

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("rest", "ascending")])
        capacity = t.column("capacity")[0].as_py()
        names = t.column("source").to_pylist()
        number = {x: i for i, x in enumerate(sorted(set(names), key=lambda x: (x is not None, x or "")))}
        no: dict[int, int] = {}
        for x, y in pairs:
            if x in number and y in number:
                no[number[x]] = no.get(number[x], 0) | 1 << number[y]
                no[number[y]] = no.get(number[y], 0) | 1 << number[x]
        lengths = t.column("rest").to_pylist()
        bins = np.array(best_fit(lengths, t.column("copies").to_pylist(), [number[x] for x in names], capacity, no, spare), np.int64)
        order = np.argsort(bins, kind="stable")
        size = np.array(lengths, np.int64)[order]
        start = np.cumsum(size) - size
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        at = np.empty(len(bins), np.int64)
        at[order] = start - np.maximum.accumulate(np.where(first, start, 0))
        full = t.column("full").to_numpy()
        block_no = t.column("block")[0].as_py()
        return pa.table(
            {
                "model_name": t.column("model_name"),
                "capacity": t.column("capacity"),
                "doc_id": t.column("doc_id"),
                "piece": pa.array(full.astype(np.int32)),
                "first_token": pa.array((full * capacity).astype(np.int32)),
                "n_tokens": t.column("rest"),
                "sequence": pa.array([f"b-{block_no}-{b}" for b in bins.tolist()], pa.string()),
                "at": pa.array(at.astype(np.int32)),
            }
        )

    packed = items.groupBy("model_name", "capacity", "block").applyInArrow(run, "model_name string, capacity int, doc_id bigint, piece int, first_token int, n_tokens int, sequence string, at int")
    return own.unionByName(packed)


def _for_each(rows: DataFrame, caps: DataFrame) -> DataFrame:
    """Each row once for every window; windows are few by nature, and more than a thousand are refused."""
    known = caps.limit(1001).collect()
    if len(known) > 1000:
        raise ValueError("more than 1000 windows")
    one = F.array(*(F.struct(F.lit(r["model_name"]).cast("string").alias("model_name"), F.lit(r["capacity"]).alias("capacity")) for r in known)) if known else F.array().cast("array<struct<model_name:string,capacity:int>>")
    return rows.select("*", F.explode(one).alias("_w")).select(*rows.columns, "_w.model_name", "_w.capacity")
