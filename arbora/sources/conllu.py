"""CoNLL-U under three reading conventions, and the smaller line formats around it.

Files are read by lines, so one large file is read by many tasks. A line's block is the number of
blank lines before it, a running sum over ranges of lines; headers are gathered per block. All three
conventions share that scan and differ in a thin projection:

* ``A`` keeps blocks with an id and a text; a range or decimal id becomes 0, a head that is no number 0;
  glosses stand behind ``*Gloss=`` and translations in a header ``# text*en``.
* ``B`` keeps every block; ids with ``.`` or ``-`` are no tokens; rows without a whole-number head are no gold rows.
* ``C`` keeps blocks with an id; ids with ``-`` are no tokens, nor are ids that are no number; a head that is no number is 0;
  glosses stand behind ``Gloss=``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.frames import gloss, starred_gloss
from arbora.operators.ordered import running_sum

COLUMNS = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]
#: Column 5 is the head and column 9 the gloss in the table that models are asked for.
MODEL_COLUMNS = ["id", "form", "lemma", "upos", "feats", "head", "deprel", "deps", "misc", "gloss"]


# ------------------------------------------------------------------------------ lines


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_name, line_no, raw_text) of text files; line_no is the line's place in the file, growing but with gaps."""
    text = spark.read.text(paths)
    at = F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return text.select(F.col("_metadata.file_path").alias("file_name"), at.alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("raw_text"))


def string_lines(spark: SparkSession, text: str, name: str = "") -> DataFrame:
    """The same of a string."""
    return spark.createDataFrame([(name, i, x) for i, x in enumerate(text.split("\n"))], "file_name string, line_no bigint, raw_text string")


def numbered(lines: DataFrame) -> DataFrame:
    """(file_name, line_no, raw_text, block): non-blank lines, ``block`` numbering them between blank lines over all files.

    A line that was received twice counts once. Null texts are blank lines.
    """
    one = lines.groupBy("file_name", "line_no").agg(F.min("raw_text").alias("raw_text"))
    blank = ~F.coalesce(F.col("raw_text"), F.lit("")).rlike(r"\S")
    b = running_sum(one, ["file_name", "line_no"], blank.cast("int"), "block")
    return b.where(~blank)


def _header(line: Column, prefix: str) -> Column:
    return F.when(F.startswith(line, F.lit(prefix)), F.trim(F.regexp_extract(line, r"^[^=]*=(.*)$", 1)))


def sentences(lines: DataFrame, dialect: str) -> DataFrame:
    """(file_name, block, first_line, sent_id, text, text_en, n_tokens) of the blocks that the convention keeps.

    The last header of a kind counts.
    """
    _known(dialect)
    return _sentences(numbered(lines), dialect)


def _sentences(b: DataFrame, dialect: str) -> DataFrame:
    """As ``sentences``, of numbered lines."""
    line = F.trim("raw_text") if dialect == "A" else F.col("raw_text")
    note = F.startswith(line, F.lit("#"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    tight = " =" if dialect == "C" else ""
    sent_id, text_en = _header(line, "# sent_id" + tight), _header(line, "# text*en" if dialect == "A" else "# text_en" + tight)
    text = F.when(~F.startswith(line, F.lit("# text_en")) & ~F.startswith(line, F.lit("# text*en")), _header(line, "# text" + (" =" if dialect != "B" else "")))
    g = b.groupBy("file_name", "block").agg(
        F.min("line_no").alias("first_line"),
        last(sent_id).alias("sent_id"),
        last(text).alias("text"),
        last(text_en).alias("text_en"),
        F.count_if(~note & _token_line(line, dialect)).alias("n_tokens"),
    )
    keep = {"A": "sent_id is not null and text is not null and n_tokens > 0", "B": "true", "C": "sent_id is not null and n_tokens > 0"}[dialect]
    return g.where(keep).withColumn("text_en", F.coalesce("text_en", F.lit(""))) if dialect != "B" else g


def _known(dialect: str) -> None:
    if dialect not in ("A", "B", "C"):
        raise ValueError(f"unknown convention: {dialect}")


def _token_line(line: Column, dialect: str) -> Column:
    f = F.split(line, "\t")
    if dialect == "A":
        return F.size(f) >= 10
    if dialect == "B":
        return (F.size(f) >= 2) & ~f[0].rlike(r"[.-]") & f[0].rlike(r"^\s*[+]?[0-9]{1,9}\s*$")
    return (F.size(f) >= 10) & f[0].rlike(r"^\s*[+]?[0-9]{1,9}\s*$")


def tokens(lines: DataFrame, dialect: str) -> DataFrame:
    """(file_name, block, line_no, id, form, lemma, upos, feats, head, deprel, gloss) of the kept blocks' tokens.

    Under ``B`` every token comes out; those without a whole-number head or with less than ten columns have a null head and are no gold rows.
    """
    _known(dialect)
    b = numbered(lines)
    if dialect != "B":  # which keeps every block
        b = b.join(_sentences(b, dialect).select("file_name", "block"), ["file_name", "block"], "left_semi")
    line = F.trim("raw_text") if dialect == "A" else F.col("raw_text")
    b = b.where(~F.startswith(line, F.lit("#")) & _token_line(line, dialect)).withColumn("f", F.split(line, "\t"))
    at = lambda i: F.try_element_at("f", F.lit(i + 1))
    number = lambda c: F.when(c.rlike(r"^\s*[+-]?[0-9]{1,9}\s*$"), F.trim(c).try_cast("int"))
    head = number(at(6))
    if dialect == "B":
        head = F.when(F.size("f") >= 10, head)
    else:
        head = F.coalesce(head, F.lit(0))
    misc = at(9)
    g = {"A": starred_gloss(misc), "B": F.lit(""), "C": gloss(misc)}[dialect]
    out = [F.coalesce(number(at(0)), F.lit(0)).alias("id"), *(at(i).alias(c) for i, c in ((1, "form"), (2, "lemma"), (3, "upos"), (5, "feats"))), head.alias("head"), at(7).alias("deprel"), g.alias("gloss")]
    return b.select("file_name", "block", "line_no", *out)


def gold_rows(lines: DataFrame) -> DataFrame:
    """Tokens under ``B`` that have all ten columns and a whole-number head."""
    return tokens(lines, "B").where("head is not null").drop("gloss")


def load_splits(spark: SparkSession, paths: dict[str, str], dialect: str = "A") -> DataFrame:
    """Tokens of the split files with ``split``; a file that is missing gives no rows."""
    out = None
    for split, path in paths.items():
        if not path_exists(spark, path):
            continue
        t = tokens(read_lines(spark, path), dialect).withColumn("split", F.lit(split))
        out = t if out is None else out.unionByName(t)
    if out is None:
        out = tokens(string_lines(spark, ""), dialect).withColumn("split", F.lit(None).cast("string"))
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def sample_lines(spark: SparkSession) -> DataFrame:
    """A corpus of three sentences with 26 tokens, the first one cut off, so that a head lies beyond its last token."""
    rows = [
        ("s1", "The old man who lives near the big river sells fish , bread and more", "Le vieil homme qui vit près du grand fleuve vend du poisson , du pain et plus", "The DET 3 det|old ADJ 3 mod|man NOUN 29 subj|who PRON 5 subj|lives VERB 3 mod|near ADP 5 udep|the DET 9 det|big ADJ 9 mod|river NOUN 6 comp:obj|sells VERB 3 mod|fish NOUN 10 comp:obj|, PUNCT 13 punct|bread NOUN 11 conj"),
        ("s2", "We read three old books last night .", "Nous avons lu trois vieux livres hier soir .", "We PRON 2 subj|read VERB 0 root|three NUM 5 mod|old ADJ 5 mod|books NOUN 2 comp:obj|last ADJ 7 mod|night NOUN 2 udep|. PUNCT 2 punct"),
        ("s3", "Come and see us !", "Viens nous voir !", "Come VERB 0 root|and CCONJ 3 cc|see VERB 1 conj|us PRON 3 comp:obj|! PUNCT 1 punct"),
    ]
    text = []
    for sent_id, s, en, toks in rows:
        text += [f"# sent_id = {sent_id}", f"# text = {s}", f"# text_en = {en}"]
        for i, t in enumerate(toks.split("|"), 1):
            w, p, h, r = t.split(" ")
            text.append(f"{i}\t{w}\t{w.lower()}\t{p}\t_\t_\t{h}\t{r}\t_\tGloss={w.lower()}")
        text.append("")
    return string_lines(spark, "\n".join(text), "sample")


# ------------------------------------------------------------------------------ small formats


def model_table(blocks: DataFrame, key: Iterable[str] = ("key",), text: str = "block") -> DataFrame:
    """(key, row, MODEL_COLUMNS, ok): rows of the tables that models return, after three header lines.

    A row without exactly ten columns, or whose id or head is no whole number, has ``ok`` false and nulls.
    """
    lines = F.filter(F.split(F.trim(F.col(text)), "\n"), lambda x: x.rlike(r"\S"))
    rows = blocks.select(*key, F.posexplode(F.slice(lines, F.lit(4), F.size(lines))).alias("row", "line")).withColumn("f", F.split("line", "\t"))
    whole = lambda i: F.trim(F.try_element_at("f", F.lit(i))).rlike(r"^[+-]?[0-9]{1,9}$")
    ok = (F.size("f") == 10) & whole(1) & whole(6)
    out = [F.when(F.col("ok"), F.trim(F.col("f")[i]).try_cast("int") if c in ("id", "head") else F.col("f")[i]).alias(c) for i, c in enumerate(MODEL_COLUMNS)]
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).select(*key, "row", *out, "ok")


def read_pos_list(lines: DataFrame) -> DataFrame:
    """(file_name, block, line_no, form, upos) of ``FORM UPOS`` lines; blank lines end a sentence."""
    f = F.split(F.trim("raw_text"), " +")
    return numbered(lines).select("file_name", "block", "line_no", f[0].alias("form"), F.try_element_at(f, F.lit(2)).alias("upos"))


def row_pairs(lines: DataFrame, skip: int = 2) -> DataFrame:
    """(file_name, pair, joined): behind the first ``skip`` lines each pair as ``second TAB first``; an odd last line is left out.

    ``line_no`` counts from 1 without gaps.
    """
    n = F.col("line_no") - F.lit(skip + 1)
    first = F.max(F.when(n % 2 == 0, F.col("raw_text")))
    second = F.max(F.when(n % 2 == 1, F.trim("raw_text")))
    g = lines.where(n >= 0).groupBy("file_name", F.floor(n / 2).alias("pair")).agg(first.alias("a"), second.alias("b"))
    return g.where("b is not null").select("file_name", "pair", F.concat_ws("\t", "b", "a").alias("joined"))


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Experiment results written as JSON, one document a file."""
    return spark.read.option("multiLine", True).json(pattern)
