"""Statistics of the corpus and few-shot selections from its training split, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.feats import feats_pairs
from arbora.operators import frames, selection, statistics
from arbora.plans import sql as S
from arbora.session import cut, table


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return frames.gold_tokens(table(spark, d, "tokens"))


def _train(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentences").where("split = 'train'").select("sent_idx")
    return _gold(spark, d).join(s, "sent_idx", "left_semi")


def _features(spark: SparkSession, d: str) -> DataFrame:
    return frames.sentence_features(_train(spark, d))


def _arcs(spark: SparkSession, d: str) -> DataFrame:
    return frames.arcs(_train(spark, d))


def sentence_features(spark: SparkSession, d: str) -> DataFrame:
    f = frames.sentence_features(_gold(spark, d))
    return f.select("sent_idx", F.array_join("relations", " ").alias("relations"), F.array_join("tags", " ").alias("tags"), "n_tokens", F.round("gloss_coverage", 9).alias("gloss_coverage"), "complexity")


def feats_items(spark: SparkSession, d: str) -> DataFrame:
    """How often each feature has each value."""
    p = _gold(spark, d).select(F.explode(feats_pairs(F.col("feats"))).alias("p"))
    return p.groupBy("p.k", "p.v").agg(F.count("*").alias("n"))


def relation_docfreq(spark: SparkSession, d: str) -> DataFrame:
    return statistics.document_frequency(_train(spark, d), "deprel")


def pos_docfreq(spark: SparkSession, d: str) -> DataFrame:
    return statistics.document_frequency(_train(spark, d), "upos")


def relation_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return statistics.cooccurrence(_features(spark, d))


def rare_relations(spark: SparkSession, d: str) -> DataFrame:
    return statistics.rare_values(relation_docfreq(spark, d))


def rare_relation_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that hold a rare relation."""
    g = _train(spark, d)
    rare = statistics.rare_values(statistics.document_frequency(g, "deprel")).select(F.col("value").alias("deprel"))
    return g.join(rare, "deprel", "left_semi").select("sent_idx").distinct()


def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return statistics.relation_counts(_arcs(spark, d))


def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    return statistics.pattern_counts(_arcs(spark, d))


def form_pairs(spark: SparkSession, d: str) -> DataFrame:
    return statistics.form_pairs(_arcs(spark, d))


def arc_context(spark: SparkSession, d: str) -> DataFrame:
    a = frames.arcs(_gold(spark, d))
    return a.select("sent_idx", "id", "form", "head_form", "head_upos", "prev_form", "next_form", "n_tokens", F.round("position", 9).alias("position"), "distance", "gloss", "head_gloss")


def corpus_validation(spark: SparkSession, d: str) -> DataFrame:
    return statistics.corpus_validation(_gold(spark, d), table(spark, d, "sentences"))


def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return statistics.bucket_medians(frames.sentence_features(_gold(spark, d)))


def complexity_ranks(spark: SparkSession, d: str) -> DataFrame:
    return selection.complexity_selection(_features(spark, d), 7).select("sent_idx", "complexity")


def stratified_fill(spark: SparkSession, d: str) -> DataFrame:
    return selection.stratified_selection(_features(spark, d), 12).select("sent_idx", "n_tokens")


def stratified_corrected(spark: SparkSession, d: str) -> DataFrame:
    return selection.stratified_selection(_features(spark, d), 12, corrected=True).select("sent_idx", "n_tokens")


def coverage_greedy(spark: SparkSession, d: str) -> DataFrame:
    return selection.coverage_selection(_features(spark, d), _train(spark, d), 4)


def diversity_greedy(spark: SparkSession, d: str) -> DataFrame:
    return selection.diversity_selection(_features(spark, d), _train(spark, d), 6)


def random_pick(spark: SparkSession, d: str) -> DataFrame:
    """Ten training sentences at the places that a seeded generator draws."""
    s = table(spark, d, "sentences").where("split = 'train'").select("sent_idx")
    return selection.random_selection(s, 10)


def split_by_seed(spark: SparkSession, d: str) -> DataFrame:
    """All sentences, four fifths of them for training."""
    return selection.train_test_split(table(spark, d, "sentences").select("sent_idx"))


def _first_test(spark: SparkSession, d: str) -> int:
    return table(spark, d, "sentences").where("split = 'test'").agg(F.min("sent_idx")).first()[0]


def similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    """The training sentences most like the first test sentence."""
    target = _first_test(spark, d)
    g = _gold(spark, d)
    s = table(spark, d, "sentences").where((F.col("split") == "train") | (F.col("sent_idx") == target)).select("sent_idx")
    f = frames.sentence_features(g.join(s, "sent_idx", "left_semi"))
    return selection.similar_sentences(f, _train(spark, d), target, 11).where(F.col("sent_idx") != target)


def similar_arcs(spark: SparkSession, d: str) -> DataFrame:
    target = _first_test(spark, d)
    g = _gold(spark, d)
    s = table(spark, d, "sentences").where((F.col("split") == "train") | (F.col("sent_idx") == target)).select("sent_idx")
    g = g.join(s, "sent_idx", "left_semi")
    return selection.similar_arcs(frames.arcs(g), g, target, 10)


#: Targets of the searches are the sentences whose ``sent_idx`` it divides.
EVERY = 100


def _searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The tokens of all targets and training sentences; (sent_idx, train, target) of these."""
    asked = F.col("sent_idx") % EVERY == 0
    s = table(spark, d, "sentences").select("sent_idx", F.coalesce(F.col("split") == "train", F.lit(False)).alias("train"), asked.alias("target")).where("train or target")
    return _gold(spark, d).join(s, "sent_idx", "left_semi"), s


def similarity_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten training sentences most like each target."""
    g, s = _searched(spark, d)
    f = cut(frames.sentence_features(g).join(s, "sent_idx"))
    return selection.similar_sentences_each(f.where("train"), f.where("target"), 10)


def similar_arcs_search(spark: SparkSession, d: str) -> DataFrame:
    """The first ten arcs of the training sentences most like each target."""
    g, s = _searched(spark, d)
    f = cut(selection.arc_features(g).join(s, "sent_idx"))
    return selection.similar_arcs_each(g, f.where("train"), f.where("target"), 10)


def best_arcs(spark: SparkSession, d: str) -> DataFrame:
    return selection.best_arcs(_arcs(spark, d))


def frequent_arcs(spark: SparkSession, d: str) -> DataFrame:
    return selection.frequent_arcs(_arcs(spark, d), 8)


def diverse_arcs(spark: SparkSession, d: str) -> DataFrame:
    return selection.diverse_arcs(_arcs(spark, d), 12)


def challenging_arcs(spark: SparkSession, d: str) -> DataFrame:
    return selection.challenging_arcs(_arcs(spark, d), 20)


def random_arcs(spark: SparkSession, d: str) -> DataFrame:
    return selection.random_arcs(_arcs(spark, d), 10)


def selection_quality(spark: SparkSession, d: str) -> DataFrame:
    """How the stratified choice serves the test split."""
    test = table(spark, d, "sentences").where("split = 'test'").select("sent_idx")
    g = _gold(spark, d).join(test, "sent_idx", "left_semi")
    chosen = selection.stratified_selection(_features(spark, d), 12, corrected=True)
    return statistics.selection_quality(chosen, frames.sentence_features(g))


# ------------------------------------------------------------------------------ SQL

_G = f"WITH {S.GOLD}"
_T = f"WITH {S.GOLD.replace('gold AS', 'gold_all AS')}, gold AS (SELECT g.* FROM gold_all g JOIN sentences s ON s.sent_idx = g.sent_idx AND s.split = 'train')"
_TF = f"{_T}, {S.FEATURES}"
_TA = f"{_T}, {S.ARCS}"
_DF = ", df AS (SELECT deprel AS value, count(DISTINCT sent_idx) AS df FROM gold WHERE deprel <> '*' GROUP BY 1)"
_RARE = _DF + ", rare AS (SELECT value, df, df::DOUBLE / (SELECT sum(df) FROM df) AS share FROM df WHERE df::DOUBLE / (SELECT sum(df) FROM df) < 0.05)"
_PAT = ", pat AS (SELECT deprel, upos, head_upos, count(*) AS pattern_n FROM arcs GROUP BY 1, 2, 3), ap AS (SELECT arcs.*, pattern_n FROM arcs JOIN pat USING (deprel, upos, head_upos))"
_BEST = _PAT + """, sc AS (SELECT *, CASE WHEN n_tokens <= 10 THEN (10 - n_tokens) * 2 ELSE 0 END + CASE WHEN pattern_n >= 2 THEN 3 ELSE 0 END + CASE WHEN gloss <> '' THEN 2 ELSE 0 END
  + CASE WHEN head_gloss <> '' THEN 2 ELSE 0 END + CASE WHEN distance <= 3 THEN 1 ELSE 0 END AS score FROM ap),
ba AS (SELECT deprel, sent_idx, id, form, head, head_form, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY deprel ORDER BY score DESC, sent_idx, id) AS rn FROM sc) WHERE rn = 1)"""
_STRAT = """, bk AS (SELECT *, CASE WHEN n_tokens <= 5 THEN 'short' WHEN n_tokens <= 15 THEN 'medium' WHEN n_tokens <= 25 THEN 'long' ELSE 'very_long' END AS bucket FROM features),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY len(relations) DESC, gloss_coverage DESC, complexity, sent_idx) AS rn FROM bk) WHERE rn <= 3),
stc AS (SELECT sent_idx, relations, gloss_coverage, complexity, n_tokens FROM st UNION ALL
        (SELECT sent_idx, relations, gloss_coverage, complexity, n_tokens FROM bk WHERE sent_idx NOT IN (SELECT sent_idx FROM st) ORDER BY len(relations), gloss_coverage, n_tokens, sent_idx LIMIT greatest(0, 12 - (SELECT count(*) FROM st))))"""
_TARGET = "(SELECT min(sent_idx) FROM sentences WHERE split = 'test')"


def _both(extra: str) -> str:
    return f"WITH {S.GOLD.replace('gold AS', 'gold_all AS')}, gold AS (SELECT g.* FROM gold_all g JOIN sentences s ON s.sent_idx = g.sent_idx AND (s.split = 'train' OR s.sent_idx = {_TARGET})), {extra}"


def _coverage_sql(k: int) -> str:
    out = _TF + _DF + ", w AS (SELECT value, 1.0::DOUBLE / (df + 1) AS w FROM df), c0 AS (SELECT NULL::BIGINT AS sent_idx, -1 AS turn WHERE false)"
    for i in range(k):
        out += f""",
k{i} AS (SELECT DISTINCT unnest(relations) AS r FROM features WHERE sent_idx IN (SELECT sent_idx FROM c{i})),
f{i} AS (SELECT sent_idx, sum(w) AS fresh FROM (SELECT sent_idx, unnest(relations) AS r FROM features) JOIN w ON w.value = r WHERE r NOT IN (SELECT r FROM k{i}) GROUP BY 1),
m{i} AS (SELECT avg(n_tokens) AS m FROM features WHERE sent_idx IN (SELECT sent_idx FROM c{i})),
b{i} AS (SELECT f.sent_idx, round(coalesce(fresh, 0) + gloss_coverage * 0.5::DOUBLE + coalesce(least(abs(n_tokens - m) / m, 0.5::DOUBLE), 0), 9) AS s FROM features f LEFT JOIN f{i} USING (sent_idx), m{i} WHERE f.sent_idx NOT IN (SELECT sent_idx FROM c{i})),
c{i + 1} AS (SELECT * FROM c{i} UNION ALL (SELECT sent_idx, {i} FROM b{i} ORDER BY s DESC, sent_idx LIMIT 1))"""
    return out + f" SELECT sent_idx, turn FROM c{k}"


def _diversity_sql(k: int) -> str:
    out = _TF + _RARE + ", c0 AS (SELECT NULL::BIGINT AS sent_idx, -1 AS turn WHERE false)"
    for i in range(k):
        out += f""",
k{i} AS (SELECT coalesce(list(DISTINCT r), []) AS r FROM (SELECT unnest(relations) AS r FROM features WHERE sent_idx IN (SELECT sent_idx FROM c{i}))),
t{i} AS (SELECT coalesce(list(DISTINCT r), []) AS t FROM (SELECT unnest(tags) AS r FROM features WHERE sent_idx IN (SELECT sent_idx FROM c{i}))),
n{i} AS (SELECT f.*, len(list_filter(relations, lambda x: NOT list_contains(r, x))) AS nr, len(list_filter(tags, lambda x: NOT list_contains(t, x))) AS nt FROM features f, k{i}, t{i} WHERE f.sent_idx NOT IN (SELECT sent_idx FROM c{i})),
p{i} AS (SELECT min(sent_idx) AS sent_idx FROM n{i} WHERE nr + nt > 0 AND list_has_any(relations, (SELECT list(value) FROM rare)) AND sent_idx > coalesce((SELECT max(sent_idx) FROM c{i}), -1)),
q{i} AS (SELECT sent_idx FROM n{i} ORDER BY round(2.0::DOUBLE * nr + nt + 0.3::DOUBLE * gloss_coverage + CASE WHEN EXISTS (SELECT 1 FROM features z WHERE z.sent_idx IN (SELECT sent_idx FROM c{i}) AND abs(z.n_tokens - n{i}.n_tokens) < 3) THEN 0 ELSE 0.1::DOUBLE END, 9) DESC, sent_idx LIMIT 1),
c{i + 1} AS (SELECT * FROM c{i} UNION ALL SELECT coalesce((SELECT sent_idx FROM p{i}), (SELECT sent_idx FROM q{i})), {i})"""
    return out + f" SELECT sent_idx, turn FROM c{k}"


_VALID = f"""{_G}, per AS (SELECT sent_idx, count(*) AS n, bool_or({S.GLOSS} <> '') AS g, bool_or(deprel = 'root' OR head = 0) AS r, max(head) AS top FROM gold GROUP BY 1)
SELECT count(*) AS total_sentences, coalesce(sum(n), 0)::BIGINT AS total_tokens, count(*) FILTER (g) AS sentences_with_glosses, count(*) FILTER (r) AS sentences_with_root,
       count(*) FILTER (trim(text_en) <> '') AS sentences_with_translation, count(*) FILTER (top > n) AS malformed_sentences FROM sentences LEFT JOIN per USING (sent_idx)"""

_EVERY = f"sent_idx % {EVERY} = 0"
_SIMILAR = f"""{_G}, {S.FEATURES}, tg AS (SELECT * FROM features WHERE {_EVERY}), tr AS (SELECT f.* FROM features f JOIN sentences s USING (sent_idx) WHERE split = 'train'),
trr AS (SELECT sent_idx, unnest(relations) AS r FROM tr), dr AS (SELECT r, count(*) AS df FROM trr GROUP BY 1), tgr AS (SELECT sent_idx, unnest(relations) AS r FROM tg),
rel AS (SELECT a.sent_idx AS target, b.sent_idx, sum(3.0::DOUBLE / (df + 1)) AS w FROM tgr a JOIN trr b USING (r) JOIN dr USING (r) GROUP BY 1, 2),
tgt AS (SELECT sent_idx, unnest(tags) AS t FROM tg), trt AS (SELECT sent_idx, unnest(tags) AS t FROM tr),
tag AS (SELECT a.sent_idx AS target, b.sent_idx, 2.0::DOUBLE * count(*) AS w FROM tgt a JOIN trt b USING (t) GROUP BY 1, 2),
sc AS (SELECT a.sent_idx AS target, b.sent_idx, round(coalesce(rel.w, 0) + coalesce(tag.w, 0) + 1.0::DOUBLE / (1 + abs(a.n_tokens - b.n_tokens)) + 1.0::DOUBLE / (1 + abs(a.complexity - b.complexity))
  + 0.5::DOUBLE / (1 + abs(a.gloss_coverage - b.gloss_coverage)), 9) AS similarity FROM tg a JOIN tr b ON a.sent_idx <> b.sent_idx
  LEFT JOIN rel ON rel.target = a.sent_idx AND rel.sent_idx = b.sent_idx LEFT JOIN tag ON tag.target = a.sent_idx AND tag.sent_idx = b.sent_idx)
SELECT target, sent_idx, similarity FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, sent_idx) AS rn FROM sc) WHERE rn <= 10"""
_SIMILAR_ARCS = f"""{_G}, {S.ARCS}, f AS (SELECT sent_idx, count(*) AS n, list(DISTINCT upos) AS tags FROM gold GROUP BY 1), tg AS (SELECT * FROM f WHERE {_EVERY}),
tr AS (SELECT f.* FROM f JOIN sentences s USING (sent_idx) WHERE split = 'train'),
sc AS (SELECT a.sent_idx AS target, b.sent_idx, round(0.4::DOUBLE * (1 - abs(b.n - a.n)::DOUBLE / greatest(a.n, 10)) + 0.6::DOUBLE * len(list_intersect(a.tags, b.tags)) / len(a.tags), 9) AS score FROM tg a JOIN tr b ON a.sent_idx <> b.sent_idx)
SELECT target, deprel, sent_idx, id, form, head, head_form, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, sent_idx, id) AS rn FROM sc JOIN arcs USING (sent_idx)) WHERE rn <= 10"""
SQL = {
    "random_arcs": f"{_TA} SELECT deprel, sent_idx, id, form, head, head_form FROM arcs ORDER BY md5('42|' || sent_idx || '|' || id), sent_idx, id LIMIT 10",
    "split_by_seed": "SELECT sent_idx, CASE WHEN row_number() OVER (ORDER BY md5('42|' || sent_idx), sent_idx) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM sentences",
    "similarity_search": _SIMILAR,
    "similar_arcs_search": _SIMILAR_ARCS,
    "sentence_features": f"{_G}, {S.FEATURES} SELECT sent_idx, array_to_string(relations, ' ') AS relations, array_to_string(tags, ' ') AS tags, n_tokens, round(gloss_coverage, 9) AS gloss_coverage, complexity FROM features",
    "feats_items": f"{_G}, i AS (SELECT unnest(list_filter(string_split(feats, '|'), lambda x: contains(x, '='))) AS x FROM gold) SELECT trim(split_part(x, '=', 1)) AS k, trim(substr(x, instr(x, '=') + 1)) AS v, count(*) AS n FROM i GROUP BY 1, 2",
    "relation_docfreq": _T + _DF + " SELECT value, df FROM df",
    "pos_docfreq": _T + " SELECT upos AS value, count(DISTINCT sent_idx) AS df FROM gold WHERE upos <> '*' GROUP BY 1",
    "relation_cooccurrence": _T + ", d AS (SELECT DISTINCT sent_idx, deprel FROM gold WHERE deprel <> '*') SELECT a.deprel AS relation, b.deprel AS with_relation, count(*) AS n_sentences FROM d a JOIN d b ON a.sent_idx = b.sent_idx AND a.deprel <> b.deprel GROUP BY 1, 2",
    "rare_relations": _T + _RARE + " SELECT value, df, round(share, 9) AS share FROM rare",
    "rare_relation_sentences": _T + _RARE + " SELECT DISTINCT sent_idx FROM gold WHERE deprel IN (SELECT value FROM rare)",
    "relation_counts": _TA + " SELECT deprel, count(*) AS n FROM arcs GROUP BY 1",
    "pattern_counts": _TA + " SELECT deprel, upos, head_upos, count(*) AS n FROM arcs GROUP BY 1, 2, 3",
    "form_pairs": _TA + " SELECT deprel, form, head_form, count(*) AS n FROM arcs GROUP BY 1, 2, 3",
    "arc_context": f"{_G}, {S.ARCS} SELECT sent_idx, id, form, head_form, head_upos, prev_form, next_form, n_tokens, round(position, 9) AS position, distance, gloss, head_gloss FROM arcs",
    "corpus_validation": _VALID,
    "length_buckets": f"{_G}, {S.FEATURES} SELECT CASE WHEN n_tokens <= 5 THEN 'short' WHEN n_tokens <= 15 THEN 'medium' WHEN n_tokens <= 25 THEN 'long' ELSE 'very_long' END AS bucket, count(*) AS n, round(median(complexity), 9) AS median_complexity FROM features GROUP BY 1",
    "complexity_ranks": _TF + ", r AS (SELECT *, row_number() OVER (ORDER BY complexity, sent_idx) - 1 AS rk, count(*) OVER () AS n FROM features) SELECT sent_idx, complexity FROM r WHERE rk % (n // 7) = 0 AND rk // (n // 7) < 7",
    "stratified_fill": _TF + " SELECT sent_idx, n_tokens FROM features ORDER BY len(relations), gloss_coverage, n_tokens, sent_idx LIMIT 12",
    "stratified_corrected": _TF + _STRAT + " SELECT sent_idx, n_tokens FROM stc",
    "coverage_greedy": _coverage_sql(4),
    "diversity_greedy": _diversity_sql(6),
    "similarity_topk": _both(S.FEATURES)
    + f""", tr AS (SELECT g.* FROM gold_all g JOIN sentences s ON s.sent_idx = g.sent_idx AND s.split = 'train'),
df AS (SELECT deprel AS value, count(DISTINCT sent_idx) AS df FROM tr WHERE deprel <> '*' GROUP BY 1), t AS (SELECT * FROM features WHERE sent_idx = {_TARGET}),
rw AS (SELECT f.sent_idx, sum(1.0::DOUBLE / (coalesce(df.df, 0) + 1)) AS w FROM (SELECT sent_idx, unnest(relations) AS r FROM features) f JOIN (SELECT unnest(relations) AS r FROM t) x USING (r) LEFT JOIN df ON df.value = f.r GROUP BY 1),
s AS (SELECT f.sent_idx, round(3.0::DOUBLE * coalesce(w, 0) + 2.0::DOUBLE * len(list_intersect(f.tags, t.tags)) + 1.0::DOUBLE / (1 + abs(f.n_tokens - t.n_tokens)) + 1.0::DOUBLE / (1 + abs(f.complexity - t.complexity))
      + 0.5::DOUBLE / (1 + abs(f.gloss_coverage - t.gloss_coverage)), 9) AS similarity FROM features f LEFT JOIN rw USING (sent_idx), t)
SELECT * FROM (SELECT sent_idx, similarity FROM s ORDER BY similarity DESC, sent_idx LIMIT 11) WHERE sent_idx <> {_TARGET}""",
    "similar_arcs": _both(S.ARCS)
    + f""", per AS (SELECT sent_idx, count(*) AS n, list(DISTINCT upos) AS tags FROM gold GROUP BY 1), t AS (SELECT * FROM per WHERE sent_idx = {_TARGET}),
s AS (SELECT p.sent_idx, round(0.4::DOUBLE * (1 - abs(p.n - t.n) / greatest(t.n, 10)::DOUBLE) + 0.6::DOUBLE * (len(list_intersect(p.tags, t.tags)) / len(t.tags)::DOUBLE), 9) AS score FROM per p, t WHERE p.sent_idx <> t.sent_idx)
SELECT deprel, sent_idx, id, form, head, head_form, score FROM arcs JOIN s USING (sent_idx) ORDER BY score DESC, sent_idx, id LIMIT 10""",
    "best_arcs": _TA + _BEST + " SELECT * FROM ba",
    "frequent_arcs": _TA + _BEST + ", top AS (SELECT deprel, count(*) AS n FROM arcs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) SELECT ba.*, n FROM ba JOIN top USING (deprel)",
    "diverse_arcs": _TA + _BEST + " SELECT * FROM ba ORDER BY coalesce(nullif(list_position(['subj', 'comp:obj', 'comp:obl', 'mod', 'det', 'conj', 'flat'], deprel), 0), 8), deprel LIMIT 12",
    "challenging_arcs": _TA + _PAT + ", s AS (SELECT *, (CASE WHEN distance > 3 THEN distance ELSE 0 END + CASE WHEN pattern_n = 1 THEN 3 ELSE 0 END + CASE WHEN n_tokens > 8 THEN 2 ELSE 0 END)::BIGINT AS score FROM ap) SELECT deprel, sent_idx, id, form, head, head_form, score FROM s WHERE score > 3 ORDER BY score DESC, sent_idx, id LIMIT 20",
    "selection_quality": _TF
    + _STRAT
    + """, te AS (SELECT DISTINCT deprel AS r FROM gold_all g JOIN sentences s ON s.sent_idx = g.sent_idx AND s.split = 'test' WHERE deprel <> '*'), ch AS (SELECT DISTINCT unnest(relations) AS r FROM stc)
SELECT round((SELECT count(*) FROM ch JOIN te USING (r))::DOUBLE / (SELECT count(*) FROM te), 9) AS relation_coverage, (SELECT count(*) FROM ch) AS relation_diversity, round(avg(n_tokens), 9) AS avg_sentence_length,
       round(avg(gloss_coverage), 9) AS avg_gloss_coverage, round(coalesce(stddev_pop(complexity), 0), 9) AS complexity_std, count(*) AS num_examples FROM stc""",
}
QUERIES = {k: globals()[k] for k in (*SQL, "random_pick")}
