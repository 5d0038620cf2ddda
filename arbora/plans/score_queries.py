"""Scores of the predictions table against gold, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import frames, scoring
from arbora.plans import experiments as X
from arbora.plans import reports
from arbora.plans import sql as S
from arbora.session import stored, table

E = ["model_name", "prompt_template"]


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return frames.gold_tokens(table(spark, d, "tokens"))


def _aligned(spark: SparkSession, d: str, keep: str = "last") -> DataFrame:
    return frames.aligned(_gold(spark, d), frames.answers(table(spark, d, "predictions"), keep))


def sentence_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.sentence_scores(_aligned(spark, d)).withColumns({c: F.round(c, 9) for c in scoring.SCORES})


def macro_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.macro_scores(scoring.sentence_scores(_aligned(spark, d)))


def root_accuracy(spark: SparkSession, d: str) -> DataFrame:
    s = sentence_scores(spark, d)
    return s.groupBy("model_name").agg(F.count_if("root_correct").alias("n_right"), F.count("*").alias("n"))


def complete_match(spark: SparkSession, d: str) -> DataFrame:
    return sentence_scores(spark, d).groupBy(*E).agg(F.count_if("complete_match").alias("n_complete"), F.min("num_errors").alias("least_errors"))


def token_errors(spark: SparkSession, d: str) -> DataFrame:
    return scoring.token_errors(_aligned(spark, d))


def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    return scoring.error_histogram(token_errors(spark, d))


def per_relation_prf(spark: SparkSession, d: str) -> DataFrame:
    return scoring.per_relation(_aligned(spark, d, "first"))


def confusion_long(spark: SparkSession, d: str) -> DataFrame:
    return scoring.confusion(_aligned(spark, d, "first"))


def confusion_top(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_confused(confusion_long(spark, d))


def confusion_full(spark: SparkSession, d: str) -> DataFrame:
    return scoring.full_confusion(confusion_long(spark, d))


PIVOT = ["MISSING", "comp:obj", "mod", "punct", "root", "subj", "udep"]


def confusion_pivot(spark: SparkSession, d: str) -> DataFrame:
    m = scoring.confusion_matrix(_aligned(spark, d, "first"), PIVOT)
    return m.select("gold", *(F.col(f"`{c}`").alias("p_" + c.replace(":", "_")) for c in PIVOT))


def libc_relations(spark: SparkSession, d: str) -> DataFrame:
    return scoring.asymmetric_relations(scoring.complete_only(_aligned(spark, d)))


def libc_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return scoring.token_accuracy(scoring.complete_only(_aligned(spark, d)))


def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return scoring.macro_f1(libc_relations(spark, d))


def baseline_tags(spark: SparkSession, d: str) -> DataFrame:
    """(form, pred_upos, pred_lemma, pred_feats): what each form has most often in training, the least of equals."""
    return _baseline(spark, d).drop("n")


def _baseline(spark: SparkSession, d: str) -> DataFrame:
    """``baseline_tags`` with the number of tokens of each form."""
    train = table(spark, d, "sentences").where("split = 'train'").select("sent_idx")
    g = _gold(spark, d).join(train, "sent_idx", "left_semi")
    fields = ["upos", "lemma", "feats"]
    long = g.select("form", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields))).alias("x"))
    n = long.groupBy("form", "x.field", "x.value").agg(F.count("*").alias("n"))
    best = {c: F.min_by("value", F.when(F.col("field") == c, F.struct(-F.col("n"), "value"))).alias("pred_" + c) for c in fields}
    return n.groupBy("form").agg(*best.values(), (F.sum("n") / len(fields)).cast("bigint").alias("n"))


#: The most frequent forms, which are sent to every task; all others are joined by a shuffle, and none of them is hot.
SENT_FORMS = 1000


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    a = scoring.complete_only(_aligned(spark, d).where("head_ok"))
    names = ["pred_upos", "pred_lemma", "pred_feats"]
    b = stored(_baseline(spark, d))
    often = b.orderBy(F.desc("n"), "form").limit(SENT_FORMS).select("form", F.struct(*names).alias("_often"))
    a = a.join(F.broadcast(often), "form", "left")
    # rows that have their tags meet nothing in the second join, and are spread
    loose = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("sent_idx", "id"), F.lit(1024)).cast("string"))
    a = a.withColumn("_key", F.when(F.col("_often").isNull(), F.col("form")).otherwise(loose))
    j = a.join(b.select(F.col("form").alias("_key"), F.struct(*names).alias("_rest")), "_key", "left").withColumn("_tags", F.coalesce("_often", "_rest"))
    return j.select(*(c for c in a.columns if c[0] != "_"), *(F.coalesce(f"_tags.{c}", F.lit("_")).alias(c) for c in names))


def micro_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.micro_counts(_tagged(spark, d))


def micro_scores_with_punct(spark: SparkSession, d: str) -> DataFrame:
    return scoring.micro_counts(_tagged(spark, d), ignore_punct=False)


def count_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Answered sentences that have more or fewer answers than tokens."""
    return scoring.count_mismatches(_gold(spark, d), frames.answers(table(spark, d, "predictions")))


def place_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy with tokens and answers put side by side in order."""
    return scoring.token_accuracy(scoring.by_place(_gold(spark, d), frames.answers(table(spark, d, "predictions"))))


def evaluation_coverage(spark: SparkSession, d: str) -> DataFrame:
    return scoring.coverage(_aligned(spark, d))


def grid_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return X.grouped_means(macro_scores(spark, d), "model_name", "prompt_template")


def best_experiment(spark: SparkSession, d: str) -> DataFrame:
    return X.best_experiment(macro_scores(spark, d), E)


def comparison_flags(spark: SparkSession, d: str) -> DataFrame:
    return X.compare(macro_scores(spark, d)).select(*E, "uas", "las", "best_uas", "best_las")


def relation_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.relation_lines(per_relation_prf(spark, d), E)


def relation_report_by_name(spark: SparkSession, d: str) -> DataFrame:
    return reports.relation_lines(libc_relations(spark, d), E, by_name=True)


def summary_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary(macro_scores(spark, d), per_relation_prf(spark, d), error_histogram(spark, d), E)


_SENT = (
    S.aligned()
    + """,
ss AS (SELECT model_name, prompt_template, sent_idx, avg(h_ok::INT) AS uas, avg((h_ok AND l_ok)::INT) AS las, avg(l_ok::INT) AS la,
       coalesce(max(CASE WHEN answered AND head = 0 THEN id END) = max(CASE WHEN answered AND pred_head = 0 THEN id END), false) AS root_correct,
       bool_and(h_ok AND l_ok) AS complete_match, count(*) AS num_tokens, count(*) FILTER (NOT (h_ok AND l_ok)) AS num_errors
       FROM al GROUP BY 1, 2, 3),
ms AS (SELECT model_name, prompt_template, round(avg(uas), 9) AS uas, round(avg(las), 9) AS las, round(avg(la), 9) AS la, round(avg(root_correct::INT), 9) AS root_accuracy,
       round(avg(complete_match::INT), 9) AS complete_match, count(*) AS n_sentences FROM ss GROUP BY 1, 2)
"""
)
_PRF = (
    S.aligned("ASC")
    + """,
sides AS (SELECT model_name, prompt_template, deprel AS relation, 1 AS t, 0 AS p, l_ok::INT AS c FROM al
          UNION ALL SELECT model_name, prompt_template, pred_deprel, 0, 1, 0 FROM al WHERE pred_deprel IS NOT NULL),
r AS (SELECT model_name, prompt_template, relation, sum(t)::BIGINT AS support, CASE WHEN sum(p) > 0 THEN sum(c)::DOUBLE / sum(p) ELSE 0 END AS pr,
      CASE WHEN sum(t) > 0 THEN sum(c)::DOUBLE / sum(t) ELSE 0 END AS re FROM sides GROUP BY 1, 2, 3)
"""
)
_CONF = S.aligned("ASC") + ", c AS (SELECT model_name, prompt_template, deprel AS gold, coalesce(pred_deprel, 'MISSING') AS predicted, count(*) AS n FROM al GROUP BY 1, 2, 3, 4)\n"
_FULL = S.aligned() + ",\nfull_s AS (SELECT model_name, prompt_template, sent_idx FROM al GROUP BY 1, 2, 3 HAVING bool_and(answered)), fa AS (SELECT al.* FROM al JOIN full_s USING (model_name, prompt_template, sent_idx))\n"
_LIBC = (
    _FULL
    + """,
sd AS (SELECT model_name, prompt_template, deprel AS relation, (h_ok AND l_ok)::INT AS tp, 0 AS fp, (NOT (h_ok AND l_ok))::INT AS fn FROM fa
       UNION ALL SELECT model_name, prompt_template, pred_deprel, 0, 1, 0 FROM fa WHERE NOT l_ok),
cn AS (SELECT model_name, prompt_template, relation, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM sd GROUP BY 1, 2, 3),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM cn),
lr AS (SELECT model_name, prompt_template, relation, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1, tp + fn AS support FROM pr)
"""
)


def _micro(where: str) -> str:
    pairs = lambda c: f"list_distinct(list_transform(list_filter(string_split({c}, '|'), lambda x: contains(x, '=')), lambda x: trim(split_part(x, '=', 1)) || '=' || trim(substr(x, instr(x, '=') + 1))))"
    lemma = lambda c: f"lower(CASE WHEN {c} = '' THEN '_' ELSE {c} END)"
    best = lambda c: f"b_{c} AS (SELECT form, {c} AS pred_{c} FROM (SELECT form, {c}, row_number() OVER (PARTITION BY form ORDER BY count(*) DESC, {c}) AS rn FROM tr GROUP BY form, {c}) WHERE rn = 1)"
    return (
        S.aligned()
        + f""",
hk AS (SELECT * FROM al WHERE head_ok),
full_s AS (SELECT model_name, prompt_template, sent_idx FROM hk GROUP BY 1, 2, 3 HAVING bool_and(answered)),
tr AS (SELECT g.* FROM gold g JOIN sentences s ON s.sent_idx = g.sent_idx AND s.split = 'train'),
{best("upos")}, {best("lemma")}, {best("feats")},
tg AS (SELECT hk.*, coalesce(pred_upos, '_') AS pred_upos, coalesce(pred_lemma, '_') AS pred_lemma, coalesce(pred_feats, '_') AS pred_feats
       FROM hk JOIN full_s USING (model_name, prompt_template, sent_idx) LEFT JOIN b_upos USING (form) LEFT JOIN b_lemma USING (form) LEFT JOIN b_feats USING (form) {where}),
fp AS (SELECT *, {pairs("feats")} AS gf, {pairs("pred_feats")} AS pf FROM tg),
c AS (SELECT model_name, prompt_template, count(*) AS tokens_considered, count(*) FILTER (upos = pred_upos) AS upos_correct, count(*) FILTER ({lemma("lemma")} = {lemma("pred_lemma")}) AS lemma_correct,
      count(*) FILTER (h_ok) AS uas_correct, count(*) FILTER (h_ok AND l_ok) AS las_correct, sum(len(list_intersect(gf, pf)))::BIGINT AS feats_tp,
      sum(len(list_filter(pf, lambda x: NOT list_contains(gf, x))))::BIGINT AS feats_fp, sum(len(list_filter(gf, lambda x: NOT list_contains(pf, x))))::BIGINT AS feats_fn FROM fp GROUP BY 1, 2),
x AS (SELECT *, feats_tp::DOUBLE / greatest(feats_tp + feats_fp, 1) AS p, feats_tp::DOUBLE / greatest(feats_tp + feats_fn, 1) AS r, greatest(tokens_considered, 1)::DOUBLE AS n FROM c)
SELECT model_name, prompt_template, tokens_considered, upos_correct, lemma_correct, uas_correct, las_correct, feats_tp, feats_fp, feats_fn, round(upos_correct / n, 9) AS upos_accuracy,
  round(lemma_correct / n, 9) AS lemma_accuracy, round(uas_correct / n, 9) AS uas, round(las_correct / n, 9) AS las, round(p, 9) AS feats_precision, round(r, 9) AS feats_recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS feats_f1 FROM x"""
    )


SQL = {
    "sentence_scores": _SENT + "SELECT * REPLACE (round(uas, 9) AS uas, round(las, 9) AS las, round(la, 9) AS la) FROM ss",
    "macro_scores": _SENT + "SELECT * FROM ms",
    "root_accuracy": _SENT + "SELECT model_name, count(*) FILTER (root_correct) AS n_right, count(*) AS n FROM ss GROUP BY 1",
    "complete_match": _SENT + "SELECT model_name, prompt_template, count(*) FILTER (complete_match) AS n_complete, min(num_errors) AS least_errors FROM ss GROUP BY 1, 2",
    "token_errors": S.aligned() + "SELECT model_name, prompt_template, sent_idx, id, CASE WHEN answered THEN form END AS form, CASE WHEN answered THEN 'incorrect_dependency' ELSE 'missing_prediction' END AS error_type, head AS gold_head, deprel AS gold_deprel, pred_head, pred_deprel FROM al WHERE NOT (h_ok AND l_ok)",
    "error_histogram": S.aligned() + "SELECT model_name, prompt_template, CASE WHEN answered THEN 'incorrect_dependency' ELSE 'missing_prediction' END AS error_type, count(*) AS n FROM al WHERE NOT (h_ok AND l_ok) GROUP BY 1, 2, 3",
    "per_relation_prf": _PRF + "SELECT model_name, prompt_template, relation, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f1, support FROM r WHERE support > 0",
    "confusion_long": _CONF + "SELECT * FROM c",
    "confusion_top": _CONF + ", top AS (SELECT gold AS label FROM c GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 15) SELECT gold, predicted, sum(n)::BIGINT AS n FROM c WHERE gold IN (SELECT label FROM top) AND predicted IN (SELECT label FROM top) GROUP BY 1, 2",
    "confusion_full": _CONF + ", s AS (SELECT gold, predicted, sum(n)::BIGINT AS n FROM c GROUP BY 1, 2), l AS (SELECT gold AS label FROM s UNION SELECT predicted FROM s) SELECT a.label AS gold, b.label AS predicted, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN s ON s.gold = a.label AND s.predicted = b.label",
    "count_mismatches": f"WITH {S.GOLD},{S.answers('ans', 'DESC')}, g AS (SELECT sent_idx, count(*) AS n_gold FROM gold GROUP BY 1), a AS (SELECT model_name, prompt_template, sent_idx, count(*) AS n_answered FROM ans GROUP BY 1, 2, 3) SELECT model_name, prompt_template, sent_idx, n_gold, n_answered, 'Token count mismatch' AS error FROM a JOIN g USING (sent_idx) WHERE n_gold <> n_answered",
    "place_accuracy": f"WITH {S.GOLD},{S.answers('ans', 'DESC')}, g AS (SELECT *, row_number() OVER (PARTITION BY sent_idx ORDER BY id) AS place, count(*) OVER (PARTITION BY sent_idx) AS size FROM gold), a AS (SELECT *, row_number() OVER (PARTITION BY model_name, prompt_template, sent_idx ORDER BY id) AS place, count(*) OVER (PARTITION BY model_name, prompt_template, sent_idx) AS size FROM ans), fa AS (SELECT a.model_name, a.prompt_template, g.head = a.pred_head AS h_ok, g.deprel = a.pred_deprel AS l_ok FROM g JOIN a USING (sent_idx, place, size)) SELECT model_name, prompt_template, count(*) AS total_tokens, round(avg(h_ok::INT), 9) AS uas, round(avg((h_ok AND l_ok)::INT), 9) AS las, round(avg(l_ok::INT), 9) AS relation_accuracy, count(*) FILTER (NOT h_ok AND l_ok) AS head_error, count(*) FILTER (h_ok AND NOT l_ok) AS rel_error, count(*) FILTER (NOT h_ok AND NOT l_ok) AS head_and_rel_error FROM fa GROUP BY 1, 2",
    "confusion_pivot": _CONF + "SELECT gold, " + ", ".join(f"coalesce(sum(n) FILTER (predicted = '{c}'), 0)::BIGINT AS p_{c.replace(':', '_')}" for c in PIVOT) + " FROM c GROUP BY 1",
    "libc_relations": _LIBC + "SELECT * FROM lr",
    "libc_accuracy": _FULL + "SELECT model_name, prompt_template, count(*) AS total_tokens, round(avg(h_ok::INT), 9) AS uas, round(avg((h_ok AND l_ok)::INT), 9) AS las, round(avg(l_ok::INT), 9) AS relation_accuracy, count(*) FILTER (NOT h_ok AND l_ok) AS head_error, count(*) FILTER (h_ok AND NOT l_ok) AS rel_error, count(*) FILTER (NOT h_ok AND NOT l_ok) AS head_and_rel_error FROM fa GROUP BY 1, 2",
    "macro_f1": _LIBC + "SELECT model_name, prompt_template, round(avg(f1), 9) AS macro_f1, count(*) AS n_relations FROM lr WHERE support > 0 GROUP BY 1, 2",
    "micro_scores": _micro("WHERE upos <> 'PUNCT'"),
    "micro_scores_with_punct": _micro(""),
    "evaluation_coverage": S.aligned() + ", s AS (SELECT model_name, prompt_template, sent_idx, bool_and(answered) AS done FROM al GROUP BY 1, 2, 3) SELECT model_name, prompt_template, count(*) AS sentences_total, count(*) FILTER (done) AS sentences_evaluated, count(*) FILTER (NOT done) AS sentences_skipped FROM s GROUP BY 1, 2",
    "grid_grouping_sets": _SENT + "SELECT model_name, prompt_template, round(avg(las), 9) AS mean_las, round(avg(uas), 9) AS mean_uas, count(*) AS n FROM ms GROUP BY GROUPING SETS ((model_name), (prompt_template), ())",
    "best_experiment": _SENT + "SELECT model_name, prompt_template, las, uas FROM ms ORDER BY las DESC, model_name, prompt_template LIMIT 1",
    "comparison_flags": _SENT + "SELECT model_name, prompt_template, uas, las, uas = max(uas) OVER () AS best_uas, las = max(las) OVER () AS best_las FROM ms",
    "baseline_tags": f"WITH {S.GOLD}, tr AS (SELECT g.* FROM gold g JOIN sentences s ON s.sent_idx = g.sent_idx AND s.split = 'train'), "
    + ", ".join(f"b_{c} AS (SELECT form, {c} AS pred_{c} FROM (SELECT form, {c}, row_number() OVER (PARTITION BY form ORDER BY count(*) DESC, {c}) AS rn FROM tr GROUP BY form, {c}) WHERE rn = 1)" for c in ("upos", "lemma", "feats"))
    + " SELECT form, pred_upos, pred_lemma, pred_feats FROM b_upos JOIN b_lemma USING (form) JOIN b_feats USING (form)",
}
_LINE = "printf('%-15s %-10.3f %-10.3f %-10.3f %-10d', relation, precision, recall, f1, support)"
SQL |= {
    "relation_report": f"SELECT model_name, prompt_template, row_number() OVER (PARTITION BY model_name, prompt_template ORDER BY f1 DESC, relation) AS place, {_LINE} AS line FROM ({SQL['per_relation_prf']})",
    "relation_report_by_name": f"SELECT model_name, prompt_template, row_number() OVER (PARTITION BY model_name, prompt_template ORDER BY relation) AS place, {_LINE} AS line FROM ({SQL['libc_relations']})",
}
_TITLE = "WOLOF DEPENDENCY PARSING EVALUATION REPORT"
_TOP = [f"'{x}'" for x in ("", _TITLE, "=" * len(_TITLE), "")] + ["'Model Name: ' || model_name", "'Prompt Template: ' || prompt_template"] + [f"'{x}'" for x in ("", "OVERALL PERFORMANCE", "-" * 19)]
_TOP += [f"printf('{f}', {c})" for f, c in reports.OVERALL] + [f"'{x}'" for x in ("", "PER-RELATION PERFORMANCE", "-" * 24, reports.TABLE, reports.RULE)]
SQL["summary_report"] = f"""WITH m AS ({SQL['macro_scores']}), ln AS ({SQL['relation_report']}), hs AS ({SQL['error_histogram']}),
rw AS (SELECT model_name, prompt_template, string_agg(line, chr(10) ORDER BY place) AS rows FROM ln GROUP BY 1, 2),
kd AS (SELECT model_name, prompt_template, string_agg(error_type || ': ' || n, chr(10) ORDER BY error_type || ': ' || n) AS kinds FROM hs GROUP BY 1, 2)
SELECT model_name, prompt_template, {" || chr(10) || ".join(_TOP)} || chr(10) || coalesce(rows, '') || chr(10)
  || coalesce(chr(10) || 'ERROR ANALYSIS' || chr(10) || '{"-" * 14}' || chr(10) || kinds || chr(10), '') AS report
FROM m LEFT JOIN rw USING (model_name, prompt_template) LEFT JOIN kd USING (model_name, prompt_template)"""
QUERIES = {k: globals()[k] for k in SQL}
