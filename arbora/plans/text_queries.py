"""Reading, prompting, answering and comparing, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import frames, responses
from arbora.plans import experiments as X
from arbora.plans import prompts as P
from arbora.plans import sql as S
from arbora.plans import templates as T
from arbora.sources import answers, conllu, sinks
from arbora.session import table

KEYS = ["model_name", "prompt_template", "sent_idx"]


# ------------------------------------------------------------------------------ CoNLL-U


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_lines").select("file_name", "line_no", "raw_text")


def conllu_a_sentences(spark: SparkSession, d: str) -> DataFrame:
    return conllu.sentences(_lines(spark, d), "A").drop("block")


def conllu_b_sentences(spark: SparkSession, d: str) -> DataFrame:
    return conllu.sentences(_lines(spark, d), "B").drop("block")


def conllu_c_sentences(spark: SparkSession, d: str) -> DataFrame:
    return conllu.sentences(_lines(spark, d), "C").drop("block")


def conllu_a_tokens(spark: SparkSession, d: str) -> DataFrame:
    return conllu.tokens(_lines(spark, d), "A").drop("block")


def conllu_b_gold(spark: SparkSession, d: str) -> DataFrame:
    return conllu.gold_rows(_lines(spark, d)).drop("block")


def conllu_c_tokens(spark: SparkSession, d: str) -> DataFrame:
    return conllu.tokens(_lines(spark, d), "C").drop("block")


def row_pairs(spark: SparkSession, d: str) -> DataFrame:
    one = _lines(spark, d).groupBy("file_name", "line_no").agg(F.min("raw_text").alias("raw_text"))
    return conllu.row_pairs(one.where("raw_text <> ''"))


def conllu_written(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence as a CoNLL-U block, by its digest and length."""
    b = sinks.conllu_blocks(frames.gold_tokens(table(spark, d, "tokens")), table(spark, d, "sentences"))
    return b.select("sent_idx", F.md5("block").alias("digest"), F.length("block").cast("bigint").alias("length"))


# ------------------------------------------------------------------------------ answers


def rendered_answers(spark: SparkSession, d: str) -> DataFrame:
    """(experiment, sent_idx, response): the predictions as the text a model would write, a format for each template."""
    h, t = F.coalesce(F.col("predicted_head").cast("string"), F.lit("_")), F.col("token_id").cast("string")
    form, rel = F.coalesce("form", F.lit("_")), F.coalesce("predicted_relation", F.lit("_"))
    line = (
        F.when(F.col("prompt_template") == "basic", F.concat(t, F.lit(" "), form, F.lit(" -> "), h, F.lit(" "), rel))
        .when(F.col("prompt_template") == "detailed", F.concat(t, F.lit(" "), form, F.lit(" [X] -> "), h, F.lit(" "), rel, F.lit(" (guess)")))
        .when(F.col("prompt_template") == "multilingual", F.concat(t, F.lit(" | "), form, F.lit(" | "), h, F.lit(" | "), rel))
        .otherwise(F.concat(t, F.lit(". "), form, F.lit(" is "), rel, F.lit(" of "), h))
    )
    p = table(spark, d, "predictions").where("sent_idx is not null and token_id is not null").select(*KEYS, "pred_id", line.alias("line"))
    return p.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pred_id", "line"))), lambda x: x["line"]), "\n").alias("response"))


def response_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Every match in the rendered answers."""
    return responses.parse_responses(rendered_answers(spark, d), KEYS)


def response_winner(spark: SparkSession, d: str) -> DataFrame:
    r = rendered_answers(spark, d)
    return r.groupBy("prompt_template", responses.winner(F.col("response")).alias("format")).agg(F.count("*").alias("n"))


def response_failures(spark: SparkSession, d: str) -> DataFrame:
    return responses.parse_failures(rendered_answers(spark, d), KEYS)


def _said(spark: SparkSession, d: str) -> DataFrame:
    """Answers that tell their confidence."""
    line = F.concat(F.col("token_id").cast("string"), F.lit(" "), F.coalesce("form", F.lit("_")), F.lit(", Confidence: "), F.coalesce(F.format_string("%.3f", "confidence"), F.lit("n/a")))
    p = table(spark, d, "predictions").where("sent_idx is not null and token_id is not null").select(*KEYS, "pred_id", line.alias("line"))
    return p.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pred_id", "line"))), lambda x: x["line"]), "\n").alias("response"))


def response_confidence(spark: SparkSession, d: str) -> DataFrame:
    return responses.confidences(_said(spark, d), KEYS)


def _arrows(spark: SparkSession, d: str) -> DataFrame:
    g = frames.gold_tokens(table(spark, d, "tokens")).select("sent_idx", F.col("id").alias("predicted_head"), F.col("form").alias("to"))
    p = table(spark, d, "predictions").where("predicted_head is not null and predicted_relation is not null and form is not null")
    line = F.concat(F.lit("- "), "form", F.lit(" → "), F.coalesce("to", F.lit("ROOT")), F.lit(" ("), "predicted_relation", F.lit(")"))
    j = p.join(g, ["sent_idx", "predicted_head"], "left").select(*KEYS, "pred_id", line.alias("line"))
    return j.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pred_id", "line"))), lambda x: x["line"]), "\n").alias("response"))


def arrow_parse(spark: SparkSession, d: str) -> DataFrame:
    return responses.parse_arrows(_arrows(spark, d), frames.gold_tokens(table(spark, d, "tokens")), KEYS)


# ------------------------------------------------------------------------------ prompts


def _nested(spark: SparkSession, d: str, split: str) -> DataFrame:
    s = table(spark, d, "sentences").where(F.col("split") == split)
    g = frames.gold_tokens(table(spark, d, "tokens")).join(s.select("sent_idx"), "sent_idx", "left_semi")
    return P.nested(g, s)


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """Three examples: the first training sentences."""
    s = table(spark, d, "sentences").where("split = 'train'")
    t = table(spark, d, "tokens")
    with_tokens = t.where(F.col("id").rlike("^0*[1-9][0-9]{0,8}$")).join(s, "sent_idx", "left_semi").select("sent_idx").distinct()
    first = with_tokens.orderBy("sent_idx").limit(3)
    return P.nested(frames.gold_tokens(t.join(first, "sent_idx", "left_semi")), s).orderBy("sent_idx").limit(3)


def _prompt(spark: SparkSession, d: str, name: str) -> DataFrame:
    return P.Prompts().render(name, _nested(spark, d, "test"), _examples(spark, d))


def _digest(p: DataFrame) -> DataFrame:
    return p.select("sent_idx", F.md5("prompt").alias("digest"), F.length("prompt").cast("bigint").alias("length"))


TEMPLATES = ["basic", "detailed", "chain_of_thought", "multilingual", "gloss_focused", "few_shot_adaptive"]
FAMILY = ["basic", "step_by_step", "context_rich", "interactive"]


def _template_query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _digest(_prompt(spark, d, name))

    run.__name__ = f"prompt_{name}"
    return run


def _arrow_query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _digest(P.arrow_prompts(name, _nested(spark, d, "test"), _examples(spark, d)))

    run.__name__ = f"prompt_arrow_{name}"
    return run


def prompt_table(spark: SparkSession, d: str) -> DataFrame:
    return _digest(P.table_prompts(_nested(spark, d, "test"), "Wolof"))


def prompt_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The mean length of the prompts of two templates."""
    a = _prompt(spark, d, "basic").withColumn("template", F.lit("basic"))
    b = _prompt(spark, d, "gloss_focused").withColumn("template", F.lit("gloss_focused"))
    return X.prompt_lengths(a.unionByName(b), ["template"])


def prompt_summary(spark: SparkSession, d: str) -> DataFrame:
    n = _nested(spark, d, "test")
    return sinks.prompt_summary(P.Prompts().render("basic", n, _examples(spark, d)), n)


def dry_run(spark: SparkSession, d: str) -> DataFrame:
    r = answers.failed(answers.dry_run(_prompt(spark, d, "basic")))
    return r.select("sent_idx", F.length("response").cast("bigint").alias("length"), "is_error")


# ------------------------------------------------------------------------------ blocks


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """(sent_idx, block, n, forms): sentences as the table that models are asked for, heads and relations as stored."""
    t = table(spark, d, "tokens").where(F.col("id").rlike("^[0-9]{1,9}$"))
    t = t.withColumn("id", F.col("id").cast("int"))
    one = t.groupBy("sent_idx", "id").agg(F.min_by(F.struct("form", "lemma", "upos", "head", "deprel"), "row_id").alias("t")).select("sent_idx", "id", "t.*")
    b = lambda c: F.coalesce(c, F.lit("_"))
    row = F.concat_ws("\t", F.col("id").cast("string"), b("form"), b("lemma"), b("upos"), F.lit("_"), b("head"), b("deprel"), F.lit("_"), F.lit("_"), F.lit("Gloss="))
    g = one.groupBy("sent_idx").agg(F.array_sort(F.collect_list(F.struct("id", row.alias("row"), b("form").alias("form")))).alias("t"))
    s = table(spark, d, "sentences").select("sent_idx", F.coalesce("sent_id", F.lit("")).alias("sent_id"))
    head = F.concat(F.lit("# sent_id = "), "sent_id", F.lit("\n# text = x\n# text_en = x\n"))
    return s.join(g, "sent_idx").select("sent_idx", F.concat(head, F.array_join("t.row", "\n")).alias("block"), F.size("t").alias("n"), F.col("t.form").alias("forms"))


def block_validation(spark: SparkSession, d: str) -> DataFrame:
    answered = _blocks(spark, d).withColumn("block", P.extract_block(F.concat(F.lit("Sure:\n"), "block")))
    return P.check_blocks(answered, F.col("block"), F.col("n"), F.col("forms")).select("sent_idx", "message")


def model_table_rows(spark: SparkSession, d: str) -> DataFrame:
    t = conllu.model_table(_blocks(spark, d), ["sent_idx"])
    return t.select("sent_idx", "row", "id", "form", "upos", "head", "deprel", "ok")


# ------------------------------------------------------------------------------ experiments


def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    return X.grid(spark, X.COMPREHENSIVE).select("name", "model", "template", "strategy", "shots", "provider", "test_size")


def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    """What asking about every test text would cost with each model of the grid."""
    s = table(spark, d, "sentences").where("split = 'test' and text is not null").select("text")
    m = X.grid(spark, X.COMPREHENSIVE).select("model").distinct()
    models = [r["model"] for r in m.collect()] + ["claude-3-haiku", "other", "GPT-4o", "Claude-3-Opus-20240229"]
    each = s.select("text", F.explode(F.array(*map(F.lit, models))).alias("model_name"))
    return X.usage(each.withColumn("response", F.lit(None).cast("string")), prompt="text")


def provider_detect(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions").select("model_name").distinct()
    return p.select("model_name", X.provider(F.col("model_name")).alias("provider"), X.short_name(F.col("model_name")).alias("short"), X.display_name(F.col("model_name")).alias("shown"))


def batch_cost(spark: SparkSession, d: str) -> DataFrame:
    g = X.grid(spark, X.COMPREHENSIVE)
    return g.select("name", F.round(X.batch_cost(F.col("shots"), F.col("test_size"), X.price(F.col("model"), 0)), 9).alias("dollars"))


# ------------------------------------------------------------------------------ SQL

_BLOCKS = """WITH one AS (SELECT file_name, line_no, min(raw_text) AS raw_text FROM raw_lines GROUP BY 1, 2),
nb AS (SELECT *, trim(coalesce(raw_text, '')) = '' AS blank, sum((trim(coalesce(raw_text, '')) = '')::INT) OVER (ORDER BY file_name, line_no) AS block FROM one),
b AS (SELECT *, string_split(raw_text, chr(9)) AS f, {line} AS line FROM nb WHERE NOT blank),
"""


def _conllu_sql(dialect: str, want: str) -> str:
    """SQL of one reading convention."""
    line = "trim(raw_text)" if dialect == "A" else "raw_text"
    first = r"regexp_full_match({f}[1], '\s*\+?[0-9]{{1,9}}\s*')".format(f="{f}").replace("{{", "{").replace("}}", "}")
    is_token = {
        "A": "len({f}) >= 10",
        "B": "(len({f}) >= 2 AND NOT regexp_matches({f}[1], '[.-]') AND " + first + ")",
        "C": "(len({f}) >= 10 AND " + first + ")",
    }[dialect].replace("{f}", "fl")
    tight = " =" if dialect == "C" else ""
    head = lambda p: f"arg_max(CASE WHEN starts_with(line, '{p}') THEN trim(regexp_extract(line, '^[^=]*=(.*)$', 1)) END, CASE WHEN starts_with(line, '{p}') THEN line_no END)"
    text_p = "# text" + (" =" if dialect != "B" else "")
    text = f"arg_max(CASE WHEN starts_with(line, '{text_p}') AND NOT starts_with(line, '# text_en') AND NOT starts_with(line, '# text*en') THEN trim(regexp_extract(line, '^[^=]*=(.*)$', 1)) END, CASE WHEN starts_with(line, '{text_p}') AND NOT starts_with(line, '# text_en') AND NOT starts_with(line, '# text*en') THEN line_no END)"
    en = head("# text*en" if dialect == "A" else "# text_en" + tight)
    keep = {"A": "sent_id IS NOT NULL AND text IS NOT NULL AND n_tokens > 0", "B": "true", "C": "sent_id IS NOT NULL AND n_tokens > 0"}[dialect]
    sql = _BLOCKS.replace("{line}", line) + f"""l AS (SELECT *, string_split(line, chr(9)) AS fl FROM b),
g AS (SELECT file_name, block, min(line_no) AS first_line, {head("# sent_id" + tight)} AS sent_id, {text} AS text, {"coalesce(" + en + ", '')" if dialect != "B" else en} AS text_en,
      count(*) FILTER (NOT starts_with(line, '#') AND {is_token}) AS n_tokens FROM l GROUP BY 1, 2),
s AS (SELECT * FROM g WHERE {keep}),
tk AS (SELECT l.* FROM l JOIN s USING (file_name, block) WHERE NOT starts_with(line, '#') AND {is_token})
"""
    if want == "sentences":
        return sql + "SELECT file_name, first_line, sent_id, text, text_en, n_tokens FROM s"
    number = lambda i: f"CASE WHEN regexp_full_match(fl[{i}], '\\s*[+-]?[0-9]{{1,9}}\\s*') THEN TRY_CAST(trim(fl[{i}]) AS INT) END"
    hd = f"CASE WHEN len(fl) >= 10 THEN {number(7)} END" if dialect == "B" else f"coalesce({number(7)}, 0)"
    g = {"A": S.STARRED, "C": S.GLOSS, "B": "''"}[dialect].replace("misc", "fl[10]")
    sel = f"SELECT file_name, line_no, coalesce({number(1)}, 0) AS id, fl[2] AS form, fl[3] AS lemma, fl[4] AS upos, fl[6] AS feats, {hd} AS head, fl[8] AS deprel"
    if dialect == "B":
        return sql + f"SELECT * FROM ({sel} FROM tk) WHERE head IS NOT NULL"
    return sql + f"{sel}, {g} AS gloss FROM tk"


_ANSWER = """WITH rs AS (SELECT model_name, prompt_template, sent_idx, string_agg({line}, chr(10) ORDER BY pred_id) AS response FROM predictions WHERE sent_idx IS NOT NULL AND token_id IS NOT NULL GROUP BY 1, 2, 3)"""
_R = _ANSWER.replace(
    "{line}",
    """CASE prompt_template WHEN 'basic' THEN token_id || ' ' || coalesce(form, '_') || ' -> ' || coalesce(predicted_head::VARCHAR, '_') || ' ' || coalesce(predicted_relation, '_')
 WHEN 'detailed' THEN token_id || ' ' || coalesce(form, '_') || ' [X] -> ' || coalesce(predicted_head::VARCHAR, '_') || ' ' || coalesce(predicted_relation, '_') || ' (guess)'
 WHEN 'multilingual' THEN token_id || ' | ' || coalesce(form, '_') || ' | ' || coalesce(predicted_head::VARCHAR, '_') || ' | ' || coalesce(predicted_relation, '_')
 ELSE token_id || '. ' || coalesce(form, '_') || ' is ' || coalesce(predicted_relation, '_') || ' of ' || coalesce(predicted_head::VARCHAR, '_') END""",
)


def _re2(p: str) -> str:
    """A format for RE2, whose classes know ASCII only."""
    return "(?i)" + p.replace(r"\d", r"\p{Nd}").replace("'", "''")


def _matches_sql(name: str) -> str:
    p = _re2(responses.FORMATS[name])
    groups = [f"unnest(regexp_extract_all(response, '{p}', {i})) AS g{i}" for i in range(1, 6 if name == "reasoning" else 5)]
    return f"SELECT model_name, prompt_template, sent_idx, unnest(range(len(regexp_extract_all(response, '{p}', 1)))) AS rn, {', '.join(groups)}{'' if name == 'reasoning' else ', NULL AS g5'}, {list(responses.FORMATS).index(name)} AS fmt FROM rs"


_M = _R + ", mm AS (" + " UNION ALL ".join(_matches_sql(n) for n in responses.FORMATS) + """),
ok AS (SELECT model_name, prompt_template, sent_idx, fmt, row_number() OVER (PARTITION BY model_name, prompt_template, sent_idx, fmt ORDER BY rn) - 1 AS pos, TRY_CAST(g1 AS INT) AS token_id, g2 AS form, TRY_CAST(g3 AS INT) AS head, trim(g4) AS relation, coalesce(g5, '') AS reasoning
       FROM mm WHERE TRY_CAST(g1 AS INT) IS NOT NULL AND TRY_CAST(g3 AS INT) IS NOT NULL),
win AS (SELECT model_name, prompt_template, sent_idx, min(fmt) AS fmt FROM ok GROUP BY 1, 2, 3)
"""

_LAST = "SELECT sent_idx, form, max(id) AS id FROM gold GROUP BY 1, 2"
_ARROW = f"""WITH {S.GOLD},
rs AS (SELECT model_name, prompt_template, p.sent_idx, string_agg('- ' || p.form || ' → ' || coalesce(g.form, 'ROOT') || ' (' || predicted_relation || ')', chr(10) ORDER BY pred_id) AS response
       FROM predictions p LEFT JOIN gold g ON g.sent_idx = p.sent_idx AND g.id = p.predicted_head WHERE predicted_head IS NOT NULL AND predicted_relation IS NOT NULL AND p.form IS NOT NULL GROUP BY 1, 2, 3),
ln AS (SELECT model_name, prompt_template, sent_idx, unnest(string_split(trim(response), chr(10))) AS line, unnest(range(len(string_split(trim(response), chr(10))))) AS no FROM rs),
pt AS (SELECT *, regexp_extract(line, '{responses.ARROW}', 1) AS dep, regexp_extract(line, '{responses.ARROW}', 2) AS hd, regexp_extract(line, '{responses.ARROW}', 3) AS rel FROM ln WHERE contains(line, '→') AND contains(line, '(')),
lt AS ({_LAST}),
ar AS (SELECT pt.*, d.id AS dep_id, h.id AS to_id FROM pt JOIN lt d ON d.sent_idx = pt.sent_idx AND d.form = pt.dep LEFT JOIN lt h ON h.sent_idx = pt.sent_idx AND h.form = pt.hd WHERE dep <> ''),
tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name, prompt_template, sent_idx, dep_id ORDER BY no DESC) AS rn FROM ar WHERE to_id IS NOT NULL OR rel = 'root') WHERE rn = 1)
SELECT k.model_name, k.prompt_template, g.sent_idx, g.id, coalesce(t.to_id, 0) AS pred_head, coalesce(t.rel, 'root') AS pred_deprel
FROM gold g JOIN (SELECT DISTINCT model_name, prompt_template, sent_idx FROM rs) k USING (sent_idx)
LEFT JOIN tl t ON t.model_name = k.model_name AND t.prompt_template = k.prompt_template AND t.sent_idx = g.sent_idx AND t.dep_id = g.id"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TOKENS = f"""WITH {S.GOLD},
h AS (SELECT g.*, {S.GLOSS.replace("misc", "g.misc")} AS gloss, x.form AS hf, x.upos AS hu, s.split FROM (SELECT *, row_number() OVER () AS _ FROM gold) g JOIN sentences s USING (sent_idx) LEFT JOIN gold x ON x.sent_idx = g.sent_idx AND x.id = g.head),
"""
_agg = lambda e: f"coalesce(string_agg({e}, '' ORDER BY id), '')"
_NEST = (
    _TOKENS
    + f"""n AS (SELECT sent_idx, any_value(split) AS split,
 {_agg("id || ' ' || form || ' -> ' || head || ' ' || deprel || chr(10)")} AS plain,
 {_agg("id || ' ' || form || ' [' || upos || ']' || CASE WHEN gloss <> '' THEN ' (gloss: ' || gloss || ')' ELSE '' END || ' -> ' || head || ' ' || deprel || chr(10)")} AS detail,
 {_agg("id || ' ' || form || ' [' || upos || ']' || chr(10)")} AS target_tokens,
 {_agg("id || ' ' || form || ' [' || upos || ']' || CASE WHEN gloss <> '' THEN ' (gloss: ''' || gloss || ''')' ELSE '' END || chr(10)")} AS target_tokens_detailed,
 {_agg("id || '. ' || form || ' ↔ ' || CASE WHEN gloss <> '' THEN gloss ELSE '?' END || chr(10)")} AS target_alignment,
 {_agg("id || '. ' || form || ' ' || CASE WHEN upos <> '*' THEN '[' || upos || ']' ELSE '' END || ' → gloss: ''' || CASE WHEN gloss <> '' THEN gloss ELSE 'no gloss' END || '''' || chr(10)")} AS target_gloss_analysis,
 arg_min('- Main verb: ''' || form || ''' (gloss: ' || gloss || ')' || chr(10), id) FILTER (deprel = 'root' OR head = 0) AS main,
 string_agg(form, ', ' ORDER BY id) FILTER (contains(deprel, 'subj')) AS subj, string_agg(form, ', ' ORDER BY id) FILTER (contains(deprel, 'obj')) AS obj,
 {_agg("CASE WHEN head > 0 AND hf IS NOT NULL THEN '- ' || form || ' → ' || hf || ' (' || deprel || ')' || chr(10) WHEN head <= 0 AND deprel = 'root' THEN '- ' || form || ' (root)' || chr(10) ELSE '' END")} AS deps,
 string_agg(form || '(' || id || ')', ' ' ORDER BY id) AS with_ids, string_agg(id || chr(9) || form, chr(10) ORDER BY id) AS numbered_, count(*) AS n_tokens,
 string_agg(rn_form, chr(10) ORDER BY id) AS listed
 FROM (SELECT *, row_number() OVER (PARTITION BY sent_idx ORDER BY id) || chr(9) || form AS rn_form FROM h) GROUP BY 1),
m AS (SELECT n.*, s.sent_id, coalesce(s.text, '') AS target_text, coalesce(s.text_en, '') AS target_text_en FROM n JOIN sentences s USING (sent_idx)),
ex AS (SELECT *, 'Wolof: ' || target_text || chr(10) || 'English: ' || target_text_en || chr(10) || plain || chr(10) AS e_plain,
 'Wolof: ' || target_text || chr(10) || 'English: ' || target_text_en || chr(10) || 'Detailed analysis:' || chr(10) || detail || chr(10) AS e_detail,
 'Sentence: ' || target_text || ' (' || target_text_en || ')' || chr(10) || 'Analysis:' || chr(10) || coalesce(main, '') || coalesce('- Subject(s): ' || subj || chr(10), '') || coalesce('- Object(s): ' || obj || chr(10), '') || 'Dependencies:' || chr(10) || plain || chr(10) AS e_reason,
 'Sentence: "' || target_text || '"' || chr(10) || 'Translation: "' || target_text_en || '"' || chr(10) || 'Dependencies:' || chr(10) || deps || chr(10) AS e_deps
 FROM m WHERE split = 'train' ORDER BY sent_idx LIMIT 3),
xs AS (SELECT string_agg(e_plain, chr(10) ORDER BY sent_idx) AS plain_x, string_agg(e_detail, chr(10) ORDER BY sent_idx) AS detail_x, string_agg(e_reason, chr(10) ORDER BY sent_idx) AS reason_x,
 string_agg('Example ' || rk || ':' || chr(10) || e_deps, '' ORDER BY sent_idx) AS deps_x FROM (SELECT *, row_number() OVER (ORDER BY sent_idx) AS rk FROM ex)),
tg AS (SELECT m.*, plain_x, detail_x, reason_x, deps_x FROM m, xs WHERE split = 'test')
"""
)
_STYLE = {"basic": "plain_x", "chain_of_thought": "reason_x"}


def _template_sql(name: str) -> str:
    t = P._BUILT_IN[name]
    places = {"examples": _STYLE.get(t.style, "detail_x"), "examples_with_reasoning": "reason_x", "examples_crosslingual": "detail_x", "examples_gloss_focused": "detail_x", "adaptive_examples": "detail_x", "language": "'Wolof'", "LANGUAGE": "'WOLOF'"}
    parts = [(_q(p) if i % 2 == 0 else places.get(p, p)) for i, p in enumerate(re.split(r"\{(\w+)\}", t.text))]
    return _NEST + f", p AS (SELECT sent_idx, n_tokens, target_text, target_text_en, {' || '.join(parts)} AS prompt FROM tg)\n"


_DIGEST = "SELECT sent_idx, md5(prompt) AS digest, length(prompt) AS length FROM p"
_GUIDE = "".join(f"- {r}: {d}\n" for r, d in T.RELATIONS.items())
_ARROW_BASIC = _NEST + f", p AS (SELECT sent_idx, {_q(T.C_BASIC_HEAD.replace('{language}', 'Wolof') + _GUIDE + chr(10) + 'Examples:' + chr(10) + chr(10))} || deps_x || {_q('Now predict for:' + chr(10) + 'Sentence: ' + chr(34))} || target_text || {_q(chr(34) + chr(10) + 'Translation: ' + chr(34))} || target_text_en || {_q(chr(34) + T.C_BASIC_TAIL)} AS prompt FROM tg)\n"
_QUOTED = lambda title="Sentence": f"'{title}: \"' || target_text || '\"' || chr(10) || 'Translation: \"' || target_text_en || '\"' || chr(10)"
_ARC = "head > 0 AND hf IS NOT NULL"
_WHY = "VALUES " + ", ".join(f"({_q(a)}, {_q(b)}, {_q(r)}, {_q(d)})" for (a, b, r), d in T.PATTERNS.items())
_STEPS = "[" + ", ".join(map(_q, T.STEPS)) + "]"
#: The worked parts of the examples, each from the tokens in order.
_WORKED = (
    _NEST
    + f""", rt AS (SELECT sent_idx, arg_min(form, id) AS form, min(id) AS id FROM h WHERE head = 0 OR deprel = 'root' GROUP BY 1),
sl AS (SELECT sent_idx, 0 AS o, id, 'Main verb (root) = "' || form || '" (position ' || id || ')' AS line FROM rt
  UNION ALL SELECT sent_idx, list_position({_STEPS}, deprel), id, '"' || form || '" → "' || hf || '" (' || deprel || ')' FROM h WHERE {_ARC} AND list_contains({_STEPS}, deprel)),
sn AS (SELECT sent_idx, row_number() OVER (PARTITION BY sent_idx ORDER BY o, id) AS k, line FROM sl),
steps AS (SELECT sent_idx, string_agg('Step ' || k || ': ' || line || chr(10), '' ORDER BY k) AS steps FROM sn GROUP BY 1),
why AS (SELECT * FROM ({_WHY}) w(upos, hu, deprel, why)),
rs AS (SELECT sent_idx, string_agg(CASE WHEN {_ARC} THEN '- "' || form || '" (' || h.upos || ')' || CASE WHEN gloss <> '' THEN ' (gloss: ''' || gloss || ''')' ELSE '' END || ' → "' || hf || '" (' || h.hu || '): ' || coalesce(why, h.deprel || ' relationship based on context') || chr(10)
    WHEN head <= 0 AND h.deprel = 'root' THEN '- "' || form || '" (' || h.upos || '): main predicate of sentence' || chr(10) ELSE '' END, '' ORDER BY id) AS reasons,
  string_agg(CASE WHEN {_ARC} THEN form || '→' || hf || '(' || h.deprel || ')' WHEN head <= 0 AND h.deprel = 'root' THEN form || '(root)' END, ', ' ORDER BY id) AS brief
  FROM h LEFT JOIN why ON why.upos = h.upos AND why.hu = h.hu AND why.deprel = h.deprel GROUP BY 1),
ask AS (SELECT h.sent_idx, coalesce(any_value('Question 1: What is the main verb?' || chr(10) || 'Answer: "' || rt.form || '" at position ' || rt.id || chr(10) || chr(10)), '')
  || coalesce('Question 2: What are the subjects?' || chr(10) || 'Answer: ' || string_agg('"' || h.form || '"', ', ' ORDER BY h.id) FILTER (deprel = 'subj') || chr(10) || chr(10), '')
  || coalesce('Question 3: What are the objects?' || chr(10) || 'Answer: ' || string_agg('"' || h.form || '"', ', ' ORDER BY h.id) FILTER (contains(deprel, 'comp:obj')) || chr(10) || chr(10), '') AS questions
  FROM h LEFT JOIN rt ON rt.sent_idx = h.sent_idx GROUP BY 1),
xn AS (SELECT ex.*, coalesce(steps, '') AS steps, reasons, coalesce(brief, '') AS brief, questions, row_number() OVER (ORDER BY ex.sent_idx) AS rk FROM ex LEFT JOIN steps USING (sent_idx) LEFT JOIN rs USING (sent_idx) LEFT JOIN ask USING (sent_idx)),
xw AS (SELECT max({_QUOTED()} || 'Tokens: ' || with_ids || chr(10) || chr(10) || steps || chr(10)) FILTER (rk = 1) AS steps_x,
  max({_QUOTED()} || chr(10) || 'Linguistic Analysis:' || chr(10) || reasons || chr(10)) FILTER (rk = 1) AS long_x,
  coalesce(string_agg('Brief example: "' || target_text || '"' || chr(10) || 'Dependencies: ' || brief || chr(10) || chr(10), '' ORDER BY rk) FILTER (rk > 1), '') AS brief_x,
  max({_QUOTED("Example Sentence")} || chr(10) || questions || 'Final Dependencies:' || chr(10) || deps || chr(10)) FILTER (rk = 1) AS asked_x FROM xn)
"""
)
_SAY = lambda t: _q(t.replace("{language}", "Wolof"))
_KNOWN = "".join(f"- {a} + {b} → {r}: {d}\n" for (a, b, r), d in T.PATTERNS.items())
_ARROW_STEPS = _WORKED + f", p AS (SELECT sent_idx, {_SAY(T.C_STEPS_HEAD)} || steps_x || 'Now analyze step by step:' || chr(10) || {_QUOTED()} || 'Tokens: ' || with_ids || chr(10) || chr(10) || 'Your step-by-step analysis:' AS prompt FROM tg, xw)\n"
_ARROW_CONTEXT = _WORKED + f", p AS (SELECT sent_idx, {_SAY(T.C_CONTEXT_HEAD + _KNOWN)} || chr(10) || 'Example with Detailed Analysis:' || chr(10) || chr(10) || long_x || brief_x || 'Now analyze with detailed reasoning:' || chr(10) || {_QUOTED()} || chr(10) || 'Provide linguistic analysis and dependencies:' AS prompt FROM tg, xw)\n"
_ARROW_ASKED = _WORKED + f", p AS (SELECT sent_idx, {_SAY(T.C_INTERACTIVE_HEAD)} || asked_x || 'Now let''s analyze this sentence together:' || chr(10) || 'Sentence: \"' || target_text || '\"' || chr(10) || 'Translation: \"' || target_text_en || {_q(chr(34) + T.C_INTERACTIVE_TAIL)} AS prompt FROM tg, xw)\n"
_RULES = "\n".join(["", "", "Instructions:", "- Language: Wolof", "- Tokenize reasonably for the language.", "- Ensure exactly 10 TAB-separated columns per token row.", "- Use 0 ONLY as HEAD for the single root token.", "- Keep punctuation tokens.", "- KEEP THE EXACT TOKENIZATION below (same number/order of tokens and surface forms).", "Tokens:", ""])
_TABLE = _NEST + f", p AS (SELECT sent_idx, trim('# sent_id = ' || coalesce(sent_id, 'N/A') || chr(10) || '# text = ' || target_text || chr(10) || '# text_en = ' || target_text_en || {_q(_RULES)} || listed || {_q(chr(10) + '- Output only the final formatted block (no commentary).')}) AS prompt FROM tg)\n"

_BL = """WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_idx, CAST(id AS INT) ORDER BY row_id) AS rn FROM tokens WHERE regexp_full_match(id, '[0-9]{1,9}')) WHERE rn = 1),
r AS (SELECT sent_idx, CAST(id AS INT) AS id, coalesce(form, '_') AS form, coalesce(lemma, '_') AS lemma, coalesce(upos, '_') AS upos, coalesce(head, '_') AS head, coalesce(deprel, '_') AS deprel FROM one),
w AS (SELECT *, CAST(id AS VARCHAR) || chr(9) || form || chr(9) || lemma || chr(9) || upos || chr(9) || '_' || chr(9) || head || chr(9) || deprel || chr(9) || '_' || chr(9) || '_' || chr(9) || 'Gloss=' AS line,
      regexp_full_match(trim(head), '[+-]?[0-9]{1,9}') AS ok, row_number() OVER (PARTITION BY sent_idx ORDER BY id) AS rk FROM r)
"""

SQL = {
    "conllu_a_sentences": _conllu_sql("A", "sentences"),
    "conllu_b_sentences": _conllu_sql("B", "sentences"),
    "conllu_c_sentences": _conllu_sql("C", "sentences"),
    "conllu_a_tokens": _conllu_sql("A", "tokens"),
    "conllu_b_gold": _conllu_sql("B", "tokens"),
    "conllu_c_tokens": _conllu_sql("C", "tokens"),
    "row_pairs": "WITH one AS (SELECT file_name, line_no, min(raw_text) AS raw_text FROM raw_lines GROUP BY 1, 2 HAVING min(raw_text) <> ''), g AS (SELECT file_name, CAST((line_no - 3) // 2 AS BIGINT) AS pair, max(CASE WHEN (line_no - 3) % 2 = 0 THEN raw_text END) AS a, max(CASE WHEN (line_no - 3) % 2 = 1 THEN trim(raw_text) END) AS b FROM one WHERE line_no >= 3 GROUP BY 1, 2) SELECT file_name, pair, concat_ws(chr(9), b, a) AS joined FROM g WHERE b IS NOT NULL",
    "conllu_written": f"WITH {S.GOLD}, g AS (SELECT sent_idx, string_agg(id || chr(9) || form || chr(9) || lemma || chr(9) || upos || chr(9) || '_' || chr(9) || feats || chr(9) || head || chr(9) || deprel || chr(9) || '_' || chr(9) || misc, chr(10) ORDER BY id) AS t FROM gold GROUP BY 1), b AS (SELECT sent_idx, '# sent_id = ' || coalesce(sent_id, '') || chr(10) || '# text = ' || coalesce(text, '') || coalesce(chr(10) || '# text_en = ' || text_en, '') || chr(10) || t AS block FROM sentences JOIN g USING (sent_idx)) SELECT sent_idx, md5(block) AS digest, length(block) AS length FROM b",
    "rendered_answers": _R + " SELECT * FROM rs",
    "response_cascade": _M + "SELECT model_name, prompt_template, sent_idx, CAST(pos AS INT) AS pos, token_id, form, head, relation, reasoning FROM ok JOIN win USING (model_name, prompt_template, sent_idx, fmt)",
    "response_winner": _R + ", f AS (SELECT prompt_template, CASE " + " ".join(f"WHEN regexp_matches(response, '{_re2(p)}') THEN '{n}'" for n, p in responses.FORMATS.items()) + " END AS format FROM rs) SELECT prompt_template, format, count(*) AS n FROM f GROUP BY 1, 2",
    "response_failures": _M + "SELECT model_name, prompt_template, sent_idx FROM rs ANTI JOIN win USING (model_name, prompt_template, sent_idx)",
    "response_confidence": "WITH c AS (SELECT *, row_number() OVER (PARTITION BY model_name, prompt_template, sent_idx, token_id ORDER BY pred_id DESC) AS rn FROM predictions WHERE sent_idx IS NOT NULL AND token_id IS NOT NULL AND confidence IS NOT NULL) SELECT model_name, prompt_template, sent_idx, token_id, round(confidence, 3) AS confidence FROM c WHERE rn = 1",
    "arrow_parse": _ARROW,
    **{f"prompt_{n}": _template_sql(n) + _DIGEST for n in TEMPLATES},
    "prompt_arrow_basic": _ARROW_BASIC + _DIGEST,
    "prompt_arrow_step_by_step": _ARROW_STEPS + _DIGEST,
    "prompt_arrow_context_rich": _ARROW_CONTEXT + _DIGEST,
    "prompt_arrow_interactive": _ARROW_ASKED + _DIGEST,
    "prompt_table": _TABLE + _DIGEST,
    "prompt_lengths": _template_sql("basic") + "SELECT 'basic' AS template, round(avg(length(prompt)), 9) AS mean_length, count(*) AS n_prompts FROM p UNION ALL SELECT * FROM (" + _template_sql("gloss_focused") + "SELECT 'gloss_focused', round(avg(length(prompt)), 9), count(*) FROM p)",
    "prompt_summary": _template_sql("basic") + "SELECT sent_idx, length(prompt) AS prompt_length, target_text AS text, target_text_en AS translation, n_tokens AS num_tokens FROM p",
    "dry_run": _template_sql("basic") + "SELECT sent_idx, length(prompt) + 32 AS length, contains(prompt, 'ERROR') AS is_error FROM p",
    "block_validation": _BL
    + """, s AS (SELECT sent_idx, count(*) AS n, arg_min(line, rk) FILTER (NOT ok) AS bad, bool_and(id = rk) AS steps, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY rk) AS ids,
  bool_or(TRY_CAST(head AS INT) < 0 OR TRY_CAST(head AS INT) > cnt) AS far FROM (SELECT *, count(*) OVER (PARTITION BY sent_idx) AS cnt FROM w) GROUP BY 1)
SELECT sent_idx, CASE WHEN bad IS NOT NULL THEN 'ID/HEAD not int in row: `' || bad || '`' WHEN NOT steps THEN 'IDs not contiguous 1..N: [' || ids || ']' WHEN far THEN 'HEAD out of range 0..' || n END AS message FROM s JOIN sentences USING (sent_idx)""",
    "model_table_rows": _BL + "SELECT sent_idx, CAST(rk - 1 AS INT) AS row, CASE WHEN ok THEN id END AS id, CASE WHEN ok THEN form END AS form, CASE WHEN ok THEN upos END AS upos, CASE WHEN ok THEN TRY_CAST(trim(head) AS INT) END AS head, CASE WHEN ok THEN deprel END AS deprel, ok FROM w JOIN sentences USING (sent_idx)",
    "experiment_grid": "SELECT replace(replace(model, '-', '_'), '.', '_') || '_' || template || '_' || strategy || '_' || shots || 'shot' AS name, model, template, strategy, shots, 'openai' AS provider, 15 AS test_size FROM (SELECT unnest(['gpt-4o-mini', 'gpt-4o']) AS model) CROSS JOIN (SELECT unnest(['basic', 'detailed', 'gloss_focused']) AS template) CROSS JOIN (SELECT unnest(['random', 'diversity', 'coverage']) AS strategy) CROSS JOIN (SELECT unnest([2, 3, 5]) AS shots)",
    "cost_estimate": "WITH m AS (SELECT * FROM (VALUES ('gpt-4o-mini', 0.00015::DOUBLE, 0.0006::DOUBLE), ('gpt-4o', 0.005, 0.015), ('claude-3-haiku', 0.00025, 0.00125), ('other', 0.002, 0.006), ('GPT-4o', 0.005, 0.015), ('Claude-3-Opus-20240229', 0.015, 0.075)) v(model_name, ci, co)) SELECT model_name, count(*) AS n_requests, sum(length(text) // 4)::BIGINT AS n_tokens, round(sum((length(text) // 4) / 1000.0::DOUBLE * ci + 0.5::DOUBLE * co), 9) AS cost FROM sentences, m WHERE split = 'test' AND text IS NOT NULL GROUP BY 1",
    "provider_detect": "SELECT DISTINCT model_name, CASE WHEN contains(lower(model_name), 'claude') THEN 'anthropic' ELSE 'openai' END AS provider, replace(replace(model_name, '-', '_'), '.', '_') AS short, substr(string_split(model_name, '-')[-1], 1, 15) AS shown FROM predictions",
    "batch_cost": "SELECT replace(replace(model, '-', '_'), '.', '_') || '_' || template || '_' || strategy || '_' || shots || 'shot' AS name, round((shots * 200 + 300) * 15 * c / 1000, 9) AS dollars FROM (VALUES ('gpt-4o-mini', 0.00015::DOUBLE), ('gpt-4o', 0.005)) m(model, c) CROSS JOIN (SELECT unnest(['basic', 'detailed', 'gloss_focused']) AS template) CROSS JOIN (SELECT unnest(['random', 'diversity', 'coverage']) AS strategy) CROSS JOIN (SELECT unnest([2, 3, 5]) AS shots)",
}
_MADE = {q.__name__: q for q in (*map(_template_query, TEMPLATES), *map(_arrow_query, FAMILY))}
QUERIES = {k: _MADE.get(k) or globals()[k] for k in SQL}
