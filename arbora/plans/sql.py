"""Common table expressions of the checking SQL: the frames of ``arbora.operators.frames`` in plain SQL."""

GOLD = """
tok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_idx, id ORDER BY row_id) AS rn FROM tokens
        WHERE regexp_full_match(id, '[0-9]{1,9}') AND sent_idx IS NOT NULL) WHERE rn = 1 AND CAST(id AS INT) > 0),
gold AS (SELECT sent_idx, CAST(id AS INT) AS id, coalesce(form, '_') AS form, coalesce(lemma, '_') AS lemma, coalesce(upos, '_') AS upos,
         coalesce(feats, '_') AS feats, coalesce(misc, '_') AS misc,
         CASE WHEN regexp_full_match(head, '[0-9]{1,9}') THEN CAST(head AS INT) ELSE 0 END AS head,
         coalesce(regexp_full_match(head, '[0-9]{1,9}'), false) AS head_ok, coalesce(deprel, '_') AS deprel FROM tok)"""


def answers(name: str, order: str) -> str:
    return f"""
{name} AS (SELECT model_name, prompt_template, sent_idx, token_id AS id, predicted_head AS pred_head, trim(predicted_relation) AS pred_deprel
         FROM (SELECT *, row_number() OVER (PARTITION BY model_name, prompt_template, sent_idx, token_id ORDER BY pred_id {order}) AS rn
               FROM predictions WHERE predicted_head IS NOT NULL AND predicted_relation IS NOT NULL AND token_id IS NOT NULL AND sent_idx IS NOT NULL) WHERE rn = 1)"""


def aligned(order: str = "DESC") -> str:
    """WITH clause up to ``al``: gold tokens of asked sentences with their answers, the last or the first."""
    return f"""WITH {GOLD},{answers("ans", order)},
asked AS (SELECT DISTINCT model_name, prompt_template, sent_idx FROM ans),
al AS (SELECT k.model_name, k.prompt_template, g.*, a.pred_head, a.pred_deprel, a.id IS NOT NULL AS answered,
              coalesce(g.head = a.pred_head, false) AS h_ok, coalesce(g.deprel = a.pred_deprel, false) AS l_ok
       FROM gold g JOIN asked k ON g.sent_idx = k.sent_idx
       LEFT JOIN ans a ON a.model_name = k.model_name AND a.prompt_template = k.prompt_template AND a.sent_idx = g.sent_idx AND a.id = g.id)"""


GLOSS = "trim(regexp_extract(misc, 'Gloss=([^|]*)', 1))"
STARRED = "trim(CASE WHEN instr(regexp_extract(misc, '(?s)\\*Gloss=(.*)$', 1), '|') > 0 THEN split_part(regexp_extract(misc, '(?s)\\*Gloss=(.*)$', 1), '|', 1) ELSE split_part(regexp_extract(misc, '(?s)\\*Gloss=(.*)$', 1), '*', 1) END)"

FEATURES = f"""
feat AS (SELECT sent_idx, coalesce(list_sort(list(DISTINCT deprel) FILTER (deprel <> '*')), []) AS relations, coalesce(list_sort(list(DISTINCT upos) FILTER (upos <> '*')), []) AS tags,
         count(*) AS n_tokens, avg(CASE WHEN {STARRED} <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS gloss_coverage FROM gold GROUP BY 1),
features AS (SELECT *, round(0.3::DOUBLE * n_tokens + 0.4::DOUBLE * len(relations) + 0.2::DOUBLE * len(tags) + 0.1::DOUBLE * gloss_coverage, 9) AS complexity FROM feat)"""

ARCS = f"""
ctx AS (SELECT *, {GLOSS} AS gloss, lag(form) OVER w AS prev_form, lead(form) OVER w AS next_form, count(*) OVER (PARTITION BY sent_idx) AS n_tokens
        FROM gold WINDOW w AS (PARTITION BY sent_idx ORDER BY id)),
arcs AS (SELECT c.*, h.form AS head_form, h.upos AS head_upos, trim(regexp_extract(h.misc, 'Gloss=([^|]*)', 1)) AS head_gloss,
         (c.id - 1)::DOUBLE / c.n_tokens AS position, abs(c.id - c.head) AS distance
         FROM ctx c JOIN gold h ON h.sent_idx = c.sent_idx AND h.id = c.head WHERE c.head > 0)"""
