"""Scores of answers against gold: three scorers with different averaging, kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.feats import feats_pairs
from arbora.operators.frames import EXPERIMENT

KEYS = [*EXPERIMENT, "sent_idx"]
SCORES = ["uas", "las", "la"]
#: Labels of a full confusion table.
MOST_LABELS = 2000


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _head() -> Column:
    return F.coalesce(F.col("head") == F.col("pred_head"), F.lit(False))


def _label() -> Column:
    return F.coalesce(F.col("deprel") == F.col("pred_deprel"), F.lit(False))


def sentence_scores(a: DataFrame) -> DataFrame:
    """Attachment scores of every sentence. Missing answers count as wrong; the root is the last token with head 0 among the answered ones."""
    n = F.count("*")
    gold_root = F.max(F.when(F.col("answered") & (F.col("head") == 0), F.col("id")))
    pred_root = F.max(F.when(F.col("answered") & (F.col("pred_head") == 0), F.col("id")))
    return a.groupBy(*KEYS).agg(
        (F.count_if(_head()) / n).alias("uas"),
        (F.count_if(_head() & _label()) / n).alias("las"),
        (F.count_if(_label()) / n).alias("la"),
        F.coalesce(gold_root == pred_root, F.lit(False)).alias("root_correct"),
        F.bool_and(_head() & _label()).alias("complete_match"),
        n.alias("num_tokens"),
        F.count_if(~(_head() & _label())).alias("num_errors"),
    )


def failed_scores(gold: DataFrame, failed: DataFrame) -> DataFrame:
    """The rows of sentences whose answer could not be read: zero scores over their tokens, one error."""
    n = gold.groupBy("sent_idx").agg(F.count("*").alias("num_tokens"))
    zero = {c: F.lit(0.0) for c in SCORES} | {c: F.lit(False) for c in ("root_correct", "complete_match")}
    return failed.select(*KEYS).distinct().join(n, "sent_idx").select(*KEYS, *(v.alias(c) for c, v in zero.items()), "num_tokens", F.lit(1).cast("bigint").alias("num_errors"))


def macro_scores(s: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Plain means over sentences."""
    by = EXPERIMENT if by is None else by
    m = s.groupBy(*by).agg(*(F.round(F.avg(c), 9).alias(c) for c in SCORES), F.round(F.avg(F.col("root_correct").cast("int")), 9).alias("root_accuracy"), F.round(F.avg(F.col("complete_match").cast("int")), 9).alias("complete_match"), F.count("*").alias("n_sentences"))
    return m


def token_errors(a: DataFrame) -> DataFrame:
    """One row per wrong or missing answer."""
    e = a.where(~(_head() & _label()))
    kind = F.when(~F.col("answered"), "missing_prediction").otherwise("incorrect_dependency")
    return e.select(*KEYS, "id", F.when(F.col("answered"), F.col("form")).alias("form"), kind.alias("error_type"), F.col("head").alias("gold_head"), F.col("deprel").alias("gold_deprel"), "pred_head", "pred_deprel")


def error_histogram(errors: DataFrame) -> DataFrame:
    return errors.groupBy(*EXPERIMENT, "error_type").agg(F.count("*").alias("n"))


def per_relation(a: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every gold relation, by label alone.

    A relation's predictions are counted over answers to gold tokens; relations that gold lacks are left out.
    The label counts of either side are two aggregates of one pass: each row stands once for
    its gold and once for its predicted label.
    """
    by = EXPERIMENT if by is None else by
    sides = F.array(
        F.struct(F.col("deprel").alias("relation"), F.lit(1).alias("total"), F.lit(0).alias("predicted"), _label().cast("int").alias("correct")),
        F.struct(F.col("pred_deprel").alias("relation"), F.lit(0).alias("total"), F.lit(1).alias("predicted"), F.lit(0).alias("correct")),
    )
    c = a.select(*by, F.explode(sides).alias("x")).select(*by, "x.*").where("relation is not null").groupBy(*by, "relation").agg(F.sum("total").alias("support"), F.sum("predicted").alias("predicted"), F.sum("correct").alias("correct"))
    p, r = ratio(F.col("correct"), F.col("predicted")), ratio(F.col("correct"), F.col("support"))
    return c.where("support > 0").select(*by, "relation", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1(p, r), 9).alias("f1"), "support")


def confusion(a: DataFrame) -> DataFrame:
    """(gold, predicted, n); ``MISSING`` stands for no answer."""
    return a.groupBy(*EXPERIMENT, F.col("deprel").alias("gold"), F.coalesce("pred_deprel", F.lit("MISSING")).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(a: DataFrame, labels: list[str]) -> DataFrame:
    """One row per gold label, one column per predicted one, over all experiments."""
    m = a.select(F.col("deprel").alias("gold"), F.coalesce("pred_deprel", F.lit("MISSING")).alias("predicted"))
    return m.groupBy("gold").pivot("predicted", labels).count().na.fill(0, labels)


def full_confusion(c: DataFrame) -> DataFrame:
    """(gold, predicted, n) over all experiments for every pair of labels that stand on either side, n 0 where they never meet.

    The labels are a set of bounded size: more than ``MOST_LABELS`` are refused, as the pairs are their square.
    """
    sum_ = c.groupBy("gold", "predicted").agg(F.sum("n").alias("n"))
    labels = sum_.select(F.explode(F.array("gold", "predicted")).alias("gold")).distinct()
    known = sorted(r[0] for r in labels.limit(MOST_LABELS + 1).collect())
    if len(known) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    every = labels.select("gold", F.explode(F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")).alias("predicted"))
    return every.join(sum_, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def top_confused(c: DataFrame, most: int = 15) -> DataFrame:
    """The part of a confusion table between the ``most`` gold labels with the most tokens, the larger first; ties by name."""
    total = c.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "label").limit(most)
    sum_ = c.groupBy("gold", "predicted").agg(F.sum("n").alias("n"))
    return sum_.join(total.select(F.col("label").alias("gold")), "gold", "left_semi").join(total.select(F.col("label").alias("predicted")), "predicted", "left_semi").select("gold", "predicted", "n")


# --------------------------------------------------------------- token rows against token rows


def complete_only(a: DataFrame) -> DataFrame:
    """Rows of sentences in which every gold token has an answer. A sentence's rows are looked at together, so what gave them is evaluated once."""
    return a.withColumn("_all", F.bool_and("answered").over(Window.partitionBy(*KEYS))).where("_all").drop("_all")


def micro_counts(a: DataFrame, *, ignore_punct: bool = True, by: list[str] | None = None) -> DataFrame:
    """Counts over tokens for tags, lemmas, heads, labels and features, and what derives from them.

    Needs ``pred_upos``, ``pred_lemma`` and ``pred_feats`` beside the answers. A label counts only under a right head.
    Lemmas are compared in lower case, empty ones as ``_``; features as sets of pairs.
    """
    by = EXPERIMENT if by is None else by
    if ignore_punct:
        a = a.where("upos <> 'PUNCT'")
    # each side's pairs are made once; as a column of its own they are not made again for each count
    a = a.withColumns({"_gold_feats": F.array_distinct(feats_pairs(F.col("feats"))), "_pred_feats": F.array_distinct(feats_pairs(F.col("pred_feats")))})
    a = a.withColumn("_both", F.size(F.array_intersect("_gold_feats", "_pred_feats")))
    lemma = lambda c: F.lower(F.when(F.coalesce(F.col(c), F.lit("")) == "", "_").otherwise(F.col(c)))
    c = a.groupBy(*by).agg(
        F.count("*").alias("tokens_considered"),
        F.count_if(F.col("upos") == F.col("pred_upos")).alias("upos_correct"),
        F.count_if(lemma("lemma") == lemma("pred_lemma")).alias("lemma_correct"),
        F.count_if(_head()).alias("uas_correct"),
        F.count_if(_head() & _label()).alias("las_correct"),
        F.sum("_both").alias("feats_tp"),
        F.sum(F.size("_pred_feats") - F.col("_both")).alias("feats_fp"),
        F.sum(F.size("_gold_feats") - F.col("_both")).alias("feats_fn"),
    )
    n = F.greatest(F.col("tokens_considered"), F.lit(1))
    prec = F.col("feats_tp") / F.greatest(F.col("feats_tp") + F.col("feats_fp"), F.lit(1))
    rec = F.col("feats_tp") / F.greatest(F.col("feats_tp") + F.col("feats_fn"), F.lit(1))
    derived = {"upos_accuracy": F.col("upos_correct") / n, "lemma_accuracy": F.col("lemma_correct") / n, "uas": F.col("uas_correct") / n, "las": F.col("las_correct") / n, "feats_precision": prec, "feats_recall": rec, "feats_f1": f1(prec, rec)}
    return c.select("*", *(F.round(v, 9).alias(k) for k, v in derived.items()))


def asymmetric_relations(a: DataFrame) -> DataFrame:
    """Relations by tp, fp and fn: right only with head and label; a wrong label is one fp of its own, a wrong head alone is none."""
    ok = _head() & _label()
    sides = F.array(
        F.struct(F.col("deprel").alias("relation"), ok.cast("int").alias("tp"), F.lit(0).alias("fp"), (~ok).cast("int").alias("fn")),
        F.struct(F.when(~_label(), F.col("pred_deprel")).alias("relation"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")),
    )
    c = a.select(*EXPERIMENT, F.explode(sides).alias("x")).select(*EXPERIMENT, "x.*").where("relation is not null").groupBy(*EXPERIMENT, "relation").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*EXPERIMENT, "relation", "tp", "fp", "fn", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1(p, r), 9).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def macro_f1(relations: DataFrame) -> DataFrame:
    """The mean F1 of the relations that gold has."""
    return relations.where("support > 0").groupBy(*EXPERIMENT).agg(F.round(F.avg("f1"), 9).alias("macro_f1"), F.count("*").alias("n_relations"))


def token_accuracy(a: DataFrame) -> DataFrame:
    """Heads, labels, both, and the kinds of error over all tokens."""
    n = F.count("*")
    return a.groupBy(*EXPERIMENT).agg(
        n.alias("total_tokens"),
        F.round(F.count_if(_head()) / n, 9).alias("uas"),
        F.round(F.count_if(_head() & _label()) / n, 9).alias("las"),
        F.round(F.count_if(_label()) / n, 9).alias("relation_accuracy"),
        F.count_if(~_head() & _label()).alias("head_error"),
        F.count_if(_head() & ~_label()).alias("rel_error"),
        F.count_if(~_head() & ~_label()).alias("head_and_rel_error"),
    )


def count_mismatches(gold: DataFrame, answer: DataFrame) -> DataFrame:
    """(experiment, sent_idx, n_gold, n_answered, error): the answered sentences whose tokens are not as many as gold's."""
    n = gold.groupBy("sent_idx").agg(F.count("*").alias("n_gold"))
    m = answer.groupBy(*KEYS).agg(F.count("*").alias("n_answered"))
    return m.join(n, "sent_idx").where("n_gold <> n_answered").select(*KEYS, "n_gold", "n_answered", F.lit("Token count mismatch").alias("error"))


def by_place(gold: DataFrame, answer: DataFrame) -> DataFrame:
    """Gold tokens and answers of a sentence side by side, the first with the first and so on, whatever ids they have.

    Only sentences with as many answers as tokens have rows; the others are ``count_mismatches``.
    """
    place = lambda df, keys: df.withColumns({"place": F.row_number().over(Window.partitionBy(*keys).orderBy("id")), "_n": F.count("*").over(Window.partitionBy(*keys))})
    g = place(gold, ["sent_idx"])
    p = place(answer, KEYS).drop("id")
    return g.join(p, ["sent_idx", "place", "_n"]).drop("_n").withColumn("answered", F.lit(True))


def skip_reasons(checked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sentences_total, sentences_evaluated, invalid, mismatch, exception) of answered tables.

    ``checked`` has ``message`` (the first check that a table fails, or null), ``n_rows`` (null where it could not be read) and
    ``n_gold``. A valid table that could not be read is an exception, one with another number of rows a mismatch.
    """
    why = F.when(F.col("message").isNotNull(), "invalid").when(F.col("n_rows").isNull(), "exception").when(F.col("n_rows") != F.col("n_gold"), "mismatch").otherwise("evaluated")
    n = lambda x: F.count_if(F.col("_why") == x)
    return checked.withColumn("_why", why).groupBy(*keys).agg(F.count("*").alias("sentences_total"), n("evaluated").alias("sentences_evaluated"), *(n(x).alias(x) for x in ("invalid", "mismatch", "exception")))


def coverage(a: DataFrame) -> DataFrame:
    """Sentences in all, evaluated (every token answered) and skipped."""
    s = a.groupBy(*KEYS).agg(F.bool_and("answered").alias("all"))
    return s.groupBy(*EXPERIMENT).agg(F.count("*").alias("sentences_total"), F.count_if("all").alias("sentences_evaluated"), F.count_if(~F.col("all")).alias("sentences_skipped"))
