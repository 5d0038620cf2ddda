"""The subpackage's queries, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import ngrams
from arbora.llm.leaks import find_leaks
from arbora.llm.overlap import class_overlap, overlap_counts, split_overlap
from arbora.llm.packing import pack
from arbora.llm.quality import text_quality
from arbora.llm.script import inconsistent
from arbora.llm.subset import select_varied
from arbora.session import table

FIELDS = ["form", "upos", "deprel"]
#: Terms by which suffixes are told apart where single terms are counted.
TERM_DEPTH = 2
#: Dimensions of the grid on which training sentences are compared, 0 to 7 each.
GRID = ["x_length", "x_tags", "x_relations", "x_nominal", "x_verbal", "x_core", "x_modifying"]


def sentence_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_idx, the grid, quality) of the training sentences with their tokens.

    Repeated rows of a token count once, ranges do not count. Quality falls with the share of tokens without
    a usable tag or relation, and is better with a text and a translation.
    """
    t = table(spark, sf_dir, "tokens").where(F.col("id").rlike("^[0-9]{1,9}$")).select("sent_idx", "id", "upos", "deprel")
    one = t.repartition("sent_idx").groupBy("sent_idx", "id").agg(F.min("upos").alias("upos"), F.min("deprel").alias("deprel"))
    n = F.count("*")
    share = lambda c: F.count_if(c) / n
    whole = F.col("upos").rlike("^[A-Z]+$") & F.col("deprel").rlike("^[a-z]")
    f = one.groupBy("sent_idx").agg(
        n.alias("n"),
        F.size(F.collect_set("upos")).alias("tags"),
        F.size(F.collect_set("deprel")).alias("relations"),
        share(F.col("upos").isin("NOUN", "PROPN", "PRON")).alias("nominal"),
        share(F.col("upos").isin("VERB", "AUX")).alias("verbal"),
        share(F.col("deprel").rlike("^(comp|subj)")).alias("core"),
        share(F.col("deprel").rlike("^(mod|udep|det|appos)")).alias("modifying"),
        share(whole).alias("whole"),
    )
    s = table(spark, sf_dir, "sentences").where("split = 'train'").select("sent_idx", F.col("text").isNotNull().cast("int").alias("has_text"), F.col("text_en").isNotNull().cast("int").alias("has_en"))
    step = lambda c, width: F.floor(F.col(c) / F.lit(width)).cast("int")
    return s.join(f, "sent_idx").select(
        "sent_idx",
        F.floor(F.log2("n")).cast("int").alias("x_length"),
        step("tags", 2).alias("x_tags"),
        step("relations", 3).alias("x_relations"),
        step("nominal", 0.125).alias("x_nominal"),
        step("verbal", 0.125).alias("x_verbal"),
        step("core", 0.125).alias("x_core"),
        step("modifying", 0.125).alias("x_modifying"),
        (F.col("whole") + F.col("has_text") + 0.25 * F.col("has_en")).alias("quality"),
    )


def p1_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A varied hundredth of the training sentences, each with its cell, the cell's sentences and its turn in it."""
    grid = sentence_grid(spark, sf_dir)
    size = table(spark, sf_dir, "sentences").where("split = 'train'").count() // 100
    return select_varied(grid, "sent_idx", GRID, size, quality="quality")


def p1_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A varied set of 64 examples from the training sentences."""
    return select_varied(sentence_grid(spark, sf_dir), "sent_idx", GRID, 64, quality="quality").select("sent_idx", "cell")


def _at() -> Column:
    """The place of a token: its id where that is a whole number."""
    return F.when(F.col("id").rlike("^[0-9]{1,9}$"), F.col("id").cast("bigint"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of single terms, of an array of suffixes of ``TERM_DEPTH`` terms."""
    t = table(spark, sf_dir, "tokens")
    records, longest = ngrams.record_sizes(t, "sent_idx")
    c = ngrams.gram_counts(t, "sent_idx", FIELDS, TERM_DEPTH, position=_at(), levels=[1], longest=longest)
    return ngrams.marked(c.withColumnRenamed("gram", "term"), records)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are too rare or too common."""
    return _terms(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its rows, sentences and mark."""
    return _terms(spark, sf_dir).select("field", "term", F.col("occurrences").alias("n_rows"), F.col("records").alias("n_sentences"), "mark")


def _grams(spark: SparkSession, sf_dir: str, fields: list[str], n: int) -> DataFrame:
    t = table(spark, sf_dir, "tokens").where(_at().isNotNull()).withColumn("at", _at())
    one = t.groupBy("sent_idx", "at").agg(*(F.min(f).alias(f) for f in fields))
    c = ngrams.gram_counts(one, "sent_idx", fields, n, position=F.col("at"))
    return c.select("field", "k", F.replace("gram", F.lit(ngrams.JOINT), F.lit(" ")).alias("gram"), F.col("occurrences").alias("n_rows"), F.col("records").alias("n_sentences"))


def p2_upos_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all tag sequences of one to eight tokens."""
    return _grams(spark, sf_dir, ["upos"], 8).drop("field")


def p2_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all sequences of one to three forms, tags and relations."""
    return _grams(spark, sf_dir, FIELDS, 3)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and another sentence with the same text."""
    found = split_overlap(table(spark, sf_dir, "sentences"))
    return found.select(F.least("train_record", "other_record").alias("sent_a"), F.greatest("train_record", "other_record").alias("sent_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs and sentences of each evaluation split and source."""
    return overlap_counts(table(spark, sf_dir, "sentences"), ["split", "source"])


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with the class of its text, that class's rows of either side, and the classes of the other side it is linked with."""
    links, members = class_overlap(table(spark, sf_dir, "sentences"))
    ends = links.select(F.col("train_class").alias("class"), F.lit(True).alias("in_train")).unionByName(links.select(F.col("other_class").alias("class"), F.lit(False).alias("in_train")))
    n = ends.groupBy("class", "in_train").agg(F.count("*").alias("n_links"))
    return members.join(n, ["class", "in_train"], "left").select(F.col("record").alias("sent_idx"), "class", "n_train", "n_other", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, lemmas and texts that are not in the consistent form, in that form."""
    t = inconsistent(table(spark, sf_dir, "tokens"), "row_id", ["form", "lemma"])
    return t.unionByName(inconsistent(table(spark, sf_dir, "sentences"), "sent_idx", ["text"]))



def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "model_windows"))


def p8_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence and place of every document, for every model."""
    return _packed(spark, sf_dir)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences, tokens and the share of the room that is used, for every model."""
    g = _packed(spark, sf_dir).groupBy("model_name", "capacity").agg(F.count_distinct("sequence").alias("n_sequences"), F.sum("n_tokens").alias("n_tokens"))
    return g.withColumn("fill", F.col("n_tokens") / (F.col("n_sequences") * F.col("capacity")))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that they leak."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked benchmark items with the documents that leak them and the largest share of an item."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("share").alias("most_words"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly no prose."""
    return _quality(spark, sf_dir).where("label <> 'prose'").select("doc_id")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and label of every document."""
    return _quality(spark, sf_dir)


QUERIES = {f.__name__: f for f in (p1_subset, p1_few_shot, p2_found, p2_terms, p2_upos_ngrams, p2_ngrams, p3_found, p3_report, p3_classes, p7_found, p8_sequences, p8_fill, p9_found, p9_items, p10_found, p10_statistics)}
