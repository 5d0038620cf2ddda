"""The frames that scorers, statistics and selections start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPERIMENT = ["model_name", "prompt_template"]


def or_blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("_"))


def gold_tokens(tokens: DataFrame) -> DataFrame:
    """One row per (sent_idx, id) with a whole-number id from 1, typed.

    Of repeated rows the one with the smallest ``row_id`` stays. Null annotations are ``_``; a head that is no
    whole number is 0 and has ``head_ok`` false; ranges such as ``6-7`` are no tokens. The result is
    partitioned by sentence, so that later grouping by sentence needs no shuffle.
    """
    t = tokens.where(F.col("id").rlike("^[0-9]{1,9}$") & F.col("sent_idx").isNotNull())
    t = t.select("sent_idx", F.col("id").cast("int").alias("id"), "row_id", "form", "lemma", "upos", "feats", "head", "deprel", "misc").where("id > 0")
    cols = ["form", "lemma", "upos", "feats", "head", "deprel", "misc"]
    one = t.repartition("sent_idx").groupBy("sent_idx", "id").agg(F.min_by(F.struct(*cols), "row_id").alias("t")).select("sent_idx", "id", "t.*")
    number = F.col("head").rlike("^[0-9]{1,9}$")
    return one.select(
        "sent_idx",
        "id",
        or_blank("form").alias("form"),
        or_blank("lemma").alias("lemma"),
        or_blank("upos").alias("upos"),
        or_blank("feats").alias("feats"),
        F.coalesce(F.when(number, F.col("head").cast("int")), F.lit(0)).alias("head"),
        F.coalesce(number, F.lit(False)).alias("head_ok"),
        or_blank("deprel").alias("deprel"),
        or_blank("misc").alias("misc"),
    )


def answers(predictions: DataFrame, keep: str = "last") -> DataFrame:
    """One usable answer per experiment, sentence and token: the last or the first that came.

    An answer without a head, relation or token is not usable.
    """
    p = predictions.where("predicted_head is not null and predicted_relation is not null and token_id is not null and sent_idx is not null")
    pick = F.max_by if keep == "last" else F.min_by
    one = p.groupBy(*EXPERIMENT, "sent_idx", "token_id").agg(pick(F.struct("predicted_head", "predicted_relation"), "pred_id").alias("a"))
    return one.select(*EXPERIMENT, "sent_idx", F.col("token_id").alias("id"), F.col("a.predicted_head").alias("pred_head"), F.trim("a.predicted_relation").alias("pred_deprel"))


def aligned(gold: DataFrame, answer: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Gold tokens of every sentence an experiment was asked about, each with its answer or nulls.

    ``asked`` has the experiments' sentences; without it, those with a usable answer count. Answers
    to tokens that gold does not have are left out.
    """
    if asked is None:
        asked = answer.select(*EXPERIMENT, "sent_idx").distinct()
    g = gold.join(asked, "sent_idx")
    return g.join(answer.withColumn("answered", F.lit(True)), [*EXPERIMENT, "sent_idx", "id"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def gloss(misc: Column) -> Column:
    """The gloss in MISC, up to the next bar; empty if there is none."""
    return F.trim(F.regexp_extract(misc, r"Gloss=([^|]*)", 1))


def starred_gloss(misc: Column) -> Column:
    """The gloss behind ``*Gloss=``: up to the next bar, else the next star, else the end."""
    rest = F.regexp_extract(misc, r"(?s)\*Gloss=(.*)$", 1)
    return F.trim(F.when(F.instr(rest, "|") > 0, F.substring_index(rest, "|", 1)).otherwise(F.substring_index(rest, "*", 1)))


def sentence_features(gold: DataFrame) -> DataFrame:
    """(sent_idx, relations, tags, n_tokens, gloss_coverage, complexity); ``*`` is no relation and no tag."""
    has_gloss = F.when(starred_gloss(F.col("misc")) != "", 1.0).otherwise(0.0)
    f = gold.groupBy("sent_idx").agg(
        F.array_sort(F.collect_set(F.when(F.col("deprel") != "*", F.col("deprel")))).alias("relations"),
        F.array_sort(F.collect_set(F.when(F.col("upos") != "*", F.col("upos")))).alias("tags"),
        F.count("*").alias("n_tokens"),
        F.avg(has_gloss).alias("gloss_coverage"),
    )
    score = 0.3 * F.col("n_tokens") + 0.4 * F.size("relations") + 0.2 * F.size("tags") + 0.1 * F.col("gloss_coverage")
    return f.withColumn("complexity", F.round(score, 9))


def arcs(gold: DataFrame) -> DataFrame:
    """Tokens with a head above 0 that is a token, with the head and the context of the token.

    ``position`` is (id - 1) / length, ``distance`` the tokens from the token to its head. An arc to a missing head is left out.
    """
    w = "partition by sent_idx order by id"
    t = gold.select(
        "*",
        gloss(F.col("misc")).alias("gloss"),
        F.expr(f"lag(form) over ({w})").alias("prev_form"),
        F.expr(f"lead(form) over ({w})").alias("next_form"),
        F.expr("count(*) over (partition by sent_idx)").alias("n_tokens"),
    )
    h = gold.select("sent_idx", F.col("id").alias("head"), F.col("form").alias("head_form"), F.col("upos").alias("head_upos"), gloss(F.col("misc")).alias("head_gloss"))
    a = t.where("head > 0").join(h, ["sent_idx", "head"])
    return a.withColumn("position", (F.col("id") - 1) / F.col("n_tokens")).withColumn("distance", F.abs(F.col("id") - F.col("head")))
