"""Corpus statistics: frequencies, co-occurrence, rarity, arc patterns, validation, selection quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.operators.frames import gloss
from arbora.operators.ordered import ranked


def document_frequency(gold: DataFrame, column: str) -> DataFrame:
    """(value, df): sentences that hold each value at least once; ``*`` is no value."""
    return gold.where(F.col(column) != "*").groupBy(F.col(column).alias("value")).agg(F.count_distinct("sent_idx").alias("df"))


def cooccurrence(features: DataFrame) -> DataFrame:
    """(relation, with_relation, n_sentences): ordered pairs of different relations of a sentence.

    A sentence has as many relations as the label set at most, so the pairs are made within a row and counted map-side.
    """
    pairs = features.select(F.explode("relations").alias("relation"), "relations").select("relation", F.explode("relations").alias("with_relation"))
    return pairs.where("relation <> with_relation").groupBy("relation", "with_relation").agg(F.count("*").alias("n_sentences"))


def rare_values(df: DataFrame, below: float = 0.05) -> DataFrame:
    """The values of a document-frequency table whose share of the total is below ``below``.

    The total is one number, so the table is never brought into one task.
    """
    total = df.agg(F.sum("df")).first()[0] or 1
    share = F.col("df") / F.lit(int(total))
    return df.where(share < below).withColumn("share", F.round(share, 9))


def relation_counts(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("deprel").agg(F.count("*").alias("n"))


def pattern_counts(arcs: DataFrame) -> DataFrame:
    """(deprel, upos, head_upos, n)."""
    return arcs.groupBy("deprel", "upos", "head_upos").agg(F.count("*").alias("n"))


def form_pairs(arcs: DataFrame) -> DataFrame:
    """(deprel, form, head_form, n): the pairs of forms of each relation with their counts."""
    return arcs.groupBy("deprel", "form", "head_form").agg(F.count("*").alias("n"))


def corpus_validation(gold: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row of counts: sentences, tokens, with a gloss, with a root, with a translation, malformed (a head beyond the last token)."""
    per = gold.groupBy("sent_idx").agg(
        F.count("*").alias("n"),
        F.bool_or(gloss(F.col("misc")) != "").alias("has_gloss"),
        F.bool_or((F.col("deprel") == "root") | (F.col("head") == 0)).alias("has_root"),
        F.max("head").alias("top"),
    )
    s = sentences.select("sent_idx", F.coalesce(F.trim("text_en") != "", F.lit(False)).alias("has_en"))
    j = s.join(per, "sent_idx", "left")
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return j.agg(
        F.count("*").alias("total_sentences"),
        F.sum(F.coalesce("n", F.lit(0))).alias("total_tokens"),
        yes(F.col("has_gloss")).alias("sentences_with_glosses"),
        yes(F.col("has_root")).alias("sentences_with_root"),
        yes(F.col("has_en")).alias("sentences_with_translation"),
        yes(F.col("top") > F.col("n")).alias("malformed_sentences"),
    )


def length_bucket(n: Column) -> Column:
    return F.when(n <= 5, "short").when(n <= 15, "medium").when(n <= 25, "long").otherwise("very_long")


def bucket_medians(features: DataFrame) -> DataFrame:
    """(bucket, n, median_complexity): the middle, or the mean of the two middle ones, of each length bucket.

    Found by global ranks, so no bucket has to keep its values in one task; there are four buckets.
    """
    f = features.select(length_bucket(F.col("n_tokens")).alias("bucket"), "complexity", "sent_idx")
    r, _ = ranked(f, ["bucket", "complexity", "sent_idx"])
    of = r.groupBy("bucket").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    at = F.col("rank") - F.col("first")
    middle = r.join(F.broadcast(of), "bucket").where((at == F.floor((F.col("n") - 1) / 2)) | (at == F.floor(F.col("n") / 2)))
    return middle.groupBy("bucket").agg(F.first("n").alias("n"), F.round(F.avg("complexity"), 9).alias("median_complexity"))


def selection_quality(chosen: DataFrame, test: DataFrame) -> DataFrame:
    """One row on how chosen sentences serve test ones, both as features; no row if either is empty.

    ``complexity_std`` is the population's, 0 for one sentence.
    """
    rel = lambda f: f.select(F.explode("relations").alias("r")).distinct()
    a, b = rel(chosen), rel(test)
    both = a.join(b, "r").agg(F.count("*").alias("both"))
    n_test, n_chosen = b.agg(F.count("*").alias("n_test")), a.agg(F.count("*").alias("n_chosen"))
    c = chosen.agg(F.avg("n_tokens").alias("avg_sentence_length"), F.avg("gloss_coverage").alias("avg_gloss_coverage"), F.coalesce(F.stddev_pop("complexity"), F.lit(0.0)).alias("complexity_std"), F.count("*").alias("num_examples"))
    # aggregates without keys are one row each and are joined on a constant
    one = [x.withColumn("_k", F.lit(1)) for x in (both, n_test, n_chosen, c)]
    j = one[0]
    for x in one[1:]:
        j = j.join(x, "_k")
    return j.where("num_examples > 0 and n_test > 0").select(
        F.round(F.col("both") / F.col("n_test"), 9).alias("relation_coverage"),
        F.col("n_chosen").alias("relation_diversity"),
        *(F.round(x, 9).alias(x) for x in ("avg_sentence_length", "avg_gloss_coverage", "complexity_std")),
        "num_examples",
    )
