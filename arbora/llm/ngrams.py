"""How often every term or n-gram occurs and in how many records, by a partitioned suffix array.

A suffix begins at every row and is cut after ``n`` terms. Within a record its different suffixes are
sorted, and of each it is noted how many terms it has in common with the one before it: so far, the
record has shown these terms already. All records' suffixes are then added up, sorted globally by range,
and the common prefixes of neighbours give the intervals of all levels at once: the suffixes that begin with the
same k terms are one interval, their number is the n-gram's occurrence count, and that number less
the suffixes whose record has shown the k terms already is its record count.

Equal suffixes are added up before they are shuffled, so a term that holds a third of all rows is a
few rows; a record of more than ``LONG`` rows is cut at places and by first terms. An interval that is
cut by a partition's end comes in parts, whose counts just add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Between the terms of an n-gram; as a control character it stands in no term.
JOINT = "\x1f"
_ESCAPE = "\x1e"
#: Rows of a record that one task takes; a longer record is spread.
LONG = 1_000_000
#: Places of a long record that one task takes.
STRETCH = 65_536


def _terms(n: int) -> list[str]:
    return [f"t{k}" for k in range(1, n + 1)]


def _escaped(c: Column) -> Column:
    """A term without ``JOINT``, and not null."""
    rare = F.contains(c, F.lit(_ESCAPE)) | F.contains(c, F.lit(JOINT))
    return F.coalesce(F.when(rare, F.replace(F.replace(c, F.lit(_ESCAPE), F.lit(_ESCAPE + "1")), F.lit(JOINT), F.lit(_ESCAPE + "2"))).otherwise(c), F.lit(_ESCAPE + "0"))


def _plain(c: Column) -> Column:
    rare = F.replace(F.replace(c, F.lit(_ESCAPE + "2"), F.lit(JOINT)), F.lit(_ESCAPE + "1"), F.lit(_ESCAPE))
    return F.when(c == _ESCAPE + "0", F.lit(None)).when(F.contains(c, F.lit(_ESCAPE)), rare).otherwise(c)


def suffixes(df: DataFrame, record: str, fields: list[str], n: int, position: Column | None, spread: bool) -> DataFrame:
    """(record, field, t1..tn): the suffix at every row of each field, cut after ``n`` terms, null behind its end.

    A suffix goes on with the least term of the next position. A null term, and a null position, end it.
    ``spread`` cuts records into stretches of positions, each with the first rows of the next one.
    """
    at = F.lit(None).cast("bigint") if position is None else position.cast("bigint")
    # one string for all fields is shuffled in fewer bytes
    packed = F.concat_ws(JOINT, *(_escaped(F.col(f).cast("string")) for f in fields))
    base = df.select(F.col(record).alias("record"), at.alias("_at"), packed.alias("_f")).where("record is not null")
    by = ["record"]
    own = F.lit(True)
    if n > 1 and spread:
        at_, part = F.col("_at"), F.floor(F.col("_at") / STRETCH)
        ahead = (F.pmod(at_, F.lit(STRETCH)) < n - 1) & at_.isNotNull()
        base = base.withColumn("_x", F.explode(F.when(ahead, F.array(F.struct(part.alias("part"), F.lit(True).alias("own")), F.struct((part - 1).alias("part"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(part.alias("part"), F.lit(True).alias("own"))))))
        base = base.select("*", F.col("_x.part").alias("_part"), F.col("_x.own").alias("_own")).drop("_x")
        by, own = ["record", "_part"], F.col("_own")
    part = F.split("_f", JOINT)
    base = base.repartition(*by).select("record", "_at", *(c for c in base.columns if c in ("_part", "_own")), *(_plain(part[i]).alias(f"f{i}") for i in range(len(fields))))
    chain: list[list[Column]] = []
    w = Window.partitionBy(*by).orderBy("_at")
    for i in range(len(fields)):
        terms = [F.col(f"f{i}")]
        for k in range(1, n):
            nxt = F.min(f"f{i}").over(w.rangeBetween(k, k))
            terms.append(F.when(F.col("_at").isNotNull(), nxt))
        chain.append(terms)
    named = base.select("record", own.alias("_own"), *(c.alias(f"f{i}_{k}") for i, terms in enumerate(chain) for k, c in enumerate(terms)))
    each = []
    for i, f in enumerate(fields):
        terms, alive = [], F.lit(True)
        for k, name in enumerate(_terms(n)):
            c = F.col(f"f{i}_{k}")
            alive = alive & c.isNotNull()
            terms.append((c if k == 0 else F.when(alive, c)).alias(name))
        each.append(F.struct(F.lit(f).alias("field"), *terms))
    rows = named.where("_own").select("record", F.explode(F.array(*each)).alias("x")).select("record", "x.*")
    return rows.where("t1 is not null")


def _common(n: int, w) -> Column:
    """Terms of the common prefix of a row's suffix with the one before it."""
    out, same = F.lit(0), F.lit(True)
    for t in _terms(n):
        same = same & F.coalesce(F.col(t) == F.lag(t).over(w), F.lit(False))
        out = out + same.cast("int")
    return out


def suffix_counts(rows: DataFrame, n: int, levels: list[int]) -> DataFrame:
    """(field, t1..tn, occurrences, rk..): every different suffix, how often it stands, and for each level k in how many records it is the first with its k terms."""
    t = _terms(n)
    own = rows.groupBy("record", "field", *t).agg(F.count("*").alias("c"))
    if n > 1:
        w = Window.partitionBy("record", "field", "t1").orderBy(*t[1:])
        own = own.withColumn("m", _common(n, w))
    else:
        own = own.withColumn("m", F.lit(0))
    return own.groupBy("field", *t).agg(F.sum("c").alias("occurrences"), *(F.count_if(F.col("m") < k).alias(f"r{k}") for k in levels))


def intervals(counts: DataFrame, n: int, levels: list[int]) -> DataFrame:
    """(field, k, gram, occurrences, records) of the intervals of these levels, from one array of suffixes."""
    t = _terms(n)
    array = counts.repartitionByRange("field", *t).sortWithinPartitions("field", *t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            same = pc.equal(b.column("field")[1:], b.column("field")[:-1]).to_numpy(zero_copy_only=False)
            occurrences = b.column("occurrences").to_numpy()
            for k in range(1, max(levels) + 1):
                c = b.column(f"t{k}")
                same = same & pc.equal(c[1:], c[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
                if k not in levels:
                    continue
                starts = np.flatnonzero(np.concatenate([[True], ~same]))
                total = [np.add.reduceat(x, starts) for x in (occurrences, b.column(f"r{k}").to_numpy())]
                there = c.take(pa.array(starts)).is_valid().to_numpy(zero_copy_only=False)  # the others have ended before k terms
                take = pa.array(starts[there])
                terms = [b.column(x).take(take) for x in t[:k]]
                gram = terms[0] if k == 1 else pc.binary_join_element_wise(*terms, JOINT)
                level = pa.array(np.full(len(take), k, np.int32))
                yield pa.RecordBatch.from_arrays([b.column("field").take(take), level, gram, *(pa.array(x[there]) for x in total)], ["field", "k", "gram", "occurrences", "records"])

    parts = array.mapInArrow(run, "field string, k int, gram string, occurrences bigint, records bigint")
    return parts.groupBy("field", "k", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def record_sizes(df: DataFrame, record: str) -> tuple[int, int]:
    """The number of distinct records, and the rows of the largest."""
    r = df.where(F.col(record).isNotNull()).groupBy(record).agg(F.count("*").alias("n")).agg(F.count("*").alias("records"), F.max("n").alias("most")).first()
    return r["records"], r["most"] or 0


def gram_counts(df: DataFrame, record: str, fields: list[str], n: int, *, position: Column | None = None, levels: list[int] | None = None, longest: int | None = None) -> DataFrame:
    """(field, k, gram, occurrences, records) of all n-grams of 1 to ``n`` terms of each named column, or of the ``levels`` among them.

    ``gram`` joins its terms by ``JOINT``. The next term is that of the next whole number in ``position``; of several
    rows there, the least term that is not null. Every row starts a suffix, repeated ones too; a null term and a null position end one; null
    records are left out; the empty string is a term like any other. Other columns are not read. ``longest`` is the
    rows of the largest record, where it is known.
    """
    if position is None and n > 1:
        raise ValueError("n-grams of several terms need positions")
    most = record_sizes(df, record)[1] if longest is None and n > 1 else longest or 0
    levels = levels or list(range(1, n + 1))
    return intervals(suffix_counts(suffixes(df, record, fields, n, position, most > LONG), n, levels), n, levels)


def term_counts(df: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """(field, term, occurrences, records) of every distinct value of the named columns.

    Null terms and null records are not counted; the empty string is a term like any other;
    repeated rows count each as occurrences and once as records. Other columns are not read.
    """
    return gram_counts(df, record, fields, 1).select("field", F.col("gram").alias("term"), "occurrences", "records")


def ngram_counts(df: DataFrame, record: str, position: str, term: str, n: int) -> DataFrame:
    """(k, gram, occurrences, records) of all n-grams of 1 to n consecutive terms of one column; see ``gram_counts``."""
    return gram_counts(df, record, [term], n, position=F.col(position)).drop("field")


def marked(counts: DataFrame, n_records: int, *, rare_below: int = 3, common_share: float = 0.2) -> DataFrame:
    """``counts`` with ``mark``: ``rare``, ``common`` or null."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") / F.lit(max(n_records, 1)) > common_share, "common")
    return counts.withColumn("mark", mark)


def record_total(df: DataFrame, record: str) -> int:
    """The number of distinct records."""
    return record_sizes(df, record)[0]
