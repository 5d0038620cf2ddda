"""Annotation sheets line by line: typed token rows, and the damaged records with every reason."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.session import cut

COLUMNS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
#: A bound for the reference table of labels, which is sent to every task.
MOST_LABELS = 100_000

_ID = re.compile(r"0*[1-9][0-9]*")
_RANGE = re.compile(r"([0-9]+)-([0-9]+)")
_WHOLE = re.compile(r"[0-9]+")


def fields(line: str) -> list[str]:
    """The fields of one tab-separated record; ``csv.Error`` where its quoting is broken.

    The strict reader refuses a quote without an end and text behind a closing one. It takes a quote within an
    unquoted field for a letter; such a field is refused afterwards. Line ends are letters of a field like others.
    """
    ends = [c for c in "\r\n" if c in line]
    if ends:  # the reader would end the record there, so other characters stand in
        free = (chr(c) for c in range(0xE000, 0xF900) if chr(c) not in line)
        stand = dict(zip(ends, free))
        there, back = str.maketrans(stand), str.maketrans({v: k for k, v in stand.items()})
        line = line.translate(there)
    record = next(csv.reader([line], delimiter="\t", quotechar='"', doublequote=True, strict=True), None) or [""]
    if '"' in line:
        at = 0
        for f in record:
            quotes = f.count('"')
            if line.startswith('"', at):
                at += 2 + quotes
            elif quotes:
                raise csv.Error("a quote inside an unquoted field")
            at += len(f) + 1
    return [f.translate(back) for f in record] if ends else record


def reasons(record: list[str], labels: frozenset[str]) -> list[str]:
    """What keeps a record of ten fields from being loaded; empty if nothing does."""
    if len(record) != len(COLUMNS):
        return ["columns"]
    out = []
    span = _RANGE.fullmatch(record[0])
    span_ok = bool(span) and 0 < int(span[1]) < int(span[2])
    if not span_ok and not _ID.fullmatch(record[0]):
        out.append("id")
    if not _WHOLE.fullmatch(record[6]) and not (span_ok and record[6] == "_"):
        out.append("head")
    if record[7] not in labels and not (span_ok and record[7] == "_"):
        out.append("deprel")
    return out


# ------------------------------------------------------------------------------ records over several lines

#: Lines of the longest record. A quote that is still open behind them is broken, and its lines stand for themselves.
MOST_LINES = 1000
_CLOSING = re.compile(r'(?:[^"]|"")*+"')


def left_open(line: str, is_open: bool) -> bool:
    """Whether a quoted field goes on behind the line, by whether one goes on before it."""
    at = 0
    if not is_open and (line[:1] == "#" or not line.strip()):
        return False
    while True:
        if is_open or line.startswith('"', at):
            m = _CLOSING.match(line, at if is_open else at + 1)
            if not m:
                return True
            at, is_open = m.end(), False
        at = line.find("\t", at) + 1
        if not at:
            return False


def assembled(lines: DataFrame, *, file: str = "file_name", order: str = "line_no", text: str = "raw_text") -> DataFrame:
    """(file, order, text): the lines of each file put together to records while a quote is open, with the place of the first.

    A quote opens at the start of a field only; comments and blank lines open none. Lines are ranged over (file, order),
    and what a range does to an open and to a closed quote is one row for the driver, so a file of any size is read by
    many tasks. Lines received twice count once, null texts are blank lines, rows with a null file or place are left out. A
    record above ``MOST_LINES`` lines comes out line by line.
    """
    one = lines.where(F.col(file).isNotNull() & F.col(order).isNotNull()).groupBy(F.col(file).alias("file"), F.col(order).cast("bigint").alias("at")).agg(F.coalesce(F.min(text), F.lit("")).alias("text"))
    placed = cut(one.repartitionByRange("file", "at").sortWithinPartitions("file", "at").withColumn("_p", F.spark_partition_id()))

    def walk(batches: Iterator[pa.RecordBatch], start: dict[int, tuple[bool, int | None]] | None) -> Iterator[tuple[pa.RecordBatch, list]]:
        """Batches with the first line of each line's record, or the states behind the range from a closed and from an open quote."""
        name, states = None, []
        for b in batches:
            heads = []
            for p, f, at, s in zip(*(b.column(c).to_pylist() for c in ("_p", "file", "at", "text"))):
                if not states:
                    states, name = ([start.get(p, (False, None))] if start is not None else [(False, None), (True, None)]), f
                if f != name:
                    states, name = [(False, None)] * len(states), f
                states = [(left_open(s, o), h if o else at) for o, h in states]
                heads.append(states[0][1])
            yield b, heads if start is not None else [name, states]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, p = None, None, None
        for b, (name, states) in walk(batches, None):
            if b.num_rows:
                first = b.column("file")[0].as_py() if p is None else first
                p, last = b.column("_p")[0].as_py(), (name, states)
        if p is not None:
            name, ((o0, h0), (o1, h1)) = last
            yield pa.RecordBatch.from_pylist([{"p": p, "first": first, "last": name, "o0": o0, "h0": h0, "o1": o1, "h1": h1}], pa.schema([("p", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("o0", pa.bool_()), ("h0", pa.int64()), ("o1", pa.bool_()), ("h1", pa.int64())]))

    start: dict[int, tuple[bool, int | None]] = {}
    before, open_, head = None, False, None
    for r in placed.mapInArrow(summed, "p int, first string, last string, o0 boolean, h0 bigint, o1 boolean, h1 bigint").orderBy("p").collect():
        if r["first"] != before:
            open_, head = False, None
        start[r["p"]] = (open_, head)
        o, h = (r["o1"], r["h1"]) if open_ else (r["o0"], r["h0"])
        before, open_, head = r["last"], o, head if h is None else h

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, heads in walk(batches, start):
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(heads, pa.int64()), b.column("at"), b.column("text")], ["file", "head", "at", "text"])

    rows = placed.mapInArrow(headed, "file string, head bigint, at bigint, text string")
    long = rows.groupBy("file", "head").agg(F.count("*").alias("n")).where(F.col("n") > MOST_LINES).withColumn("_long", F.lit(True)).drop("n")
    rows = rows.join(long, ["file", "head"], "left").withColumn("head", F.when(F.col("_long"), F.col("at")).otherwise(F.col("head")))
    whole = rows.groupBy("file", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias(text))
    return whole.select(F.col("file").alias(file), F.col("head").alias(order), text)


def parse_records(lines: DataFrame, labels: DataFrame, *, line: str = "line_id", text: str = "raw_text") -> DataFrame:
    """(line, record, reasons): every token record of ``lines``, one row each.

    ``labels`` is a reference table with a ``label`` column; it must hold at most
    ``MOST_LABELS`` rows, as it is sent to every task. Blank lines, null texts and lines starting
    with ``#`` are no records. ``record`` is the array of unquoted fields, null where quoting is
    broken; ``reasons`` is empty for a good record. A text is one record, line ends within it included (``assembled`` makes
    such records of lines). Lines received twice are kept apart by
    ``line``. Empty input gives no rows; other columns are not read.
    """
    known = [r[0] for r in labels.select("label").where("label is not null").distinct().limit(MOST_LABELS + 1).collect()]
    if len(known) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    valid = frozenset(known)
    kind = lines.schema[line].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            records: list[list[str] | None] = []
            why: list[list[str]] = []
            for s in b.column("text").to_pylist():
                try:
                    record = fields(s)
                except csv.Error:
                    records.append(None)
                    why.append(["quoting"])
                    continue
                records.append(record)
                why.append(reasons(record, valid))
            kinds = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("line"), pa.array(records, kinds), pa.array(why, kinds)], [line, "record", "reasons"])

    records = lines.select(F.col(line).alias("line"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S") & ~F.startswith("text", F.lit("#")))
    return records.mapInArrow(run, f"`{line}` {kind}, record array<string>, reasons array<string>")


def rejected(parsed: DataFrame, line: str = "line_id") -> DataFrame:
    """(line, reason): one row for each reason of each damaged record."""
    return parsed.select(line, F.explode("reasons").alias("reason"))


def loaded(parsed: DataFrame, line: str = "line_id") -> DataFrame:
    """The good records as typed rows: ``id`` and ``head`` int, ``id_end`` int on ranges, else null; head ``_`` is null."""
    good = parsed.where(F.size("reasons") == 0)
    cols = {c: F.col("record")[i] for i, c in enumerate(COLUMNS)}
    ends = F.split(cols["id"], "-")
    typed = {"id": ends[0].try_cast("int"), "id_end": F.when(F.size(ends) > 1, F.element_at(ends, -1).try_cast("int")), "head": cols["head"].try_cast("int")}
    rest = {c: v for c, v in cols.items() if c not in typed}
    order = ["id", "id_end", *COLUMNS[1:]]
    return good.select(line, *(((typed | rest)[c]).alias(c) for c in order))
