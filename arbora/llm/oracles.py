"""SQL that gives the same rows as the subpackage's queries, where SQL can."""

_TERMS = """
WITH long AS (
  SELECT 'form' AS field, form AS term, sent_idx FROM tokens
  UNION ALL SELECT 'upos', upos, sent_idx FROM tokens
  UNION ALL SELECT 'deprel', deprel, sent_idx FROM tokens),
c AS (SELECT field, term, count(*) AS n_rows, count(DISTINCT sent_idx) AS n_sentences
      FROM long WHERE term IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN n_sentences < 3 THEN 'rare'
                     WHEN 5 * n_sentences > (SELECT count(DISTINCT sent_idx) FROM tokens) THEN 'common' END AS mark FROM c)
"""



def _grams(fields: list[str], n: int) -> str:
    """All n-grams of consecutive tokens by joins of each length to the next."""
    ctes = ["t AS (SELECT sent_idx, CAST(id AS INT) AS id, " + ", ".join(f"min({f}) AS {f}" for f in fields) + " FROM tokens WHERE regexp_full_match(id, '[0-9]{1,9}') GROUP BY 1, 2)"]
    ctes.append("u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, sent_idx, id, {f} AS term FROM t WHERE {f} IS NOT NULL" for f in fields) + ")")
    ctes.append("g1 AS (SELECT field, sent_idx, id, term AS gram FROM u)")
    for k in range(2, n + 1):
        ctes.append(f"g{k} AS (SELECT a.field, a.sent_idx, a.id, a.gram || ' ' || b.term AS gram FROM g{k - 1} a JOIN u b ON a.field = b.field AND a.sent_idx = b.sent_idx AND b.id = a.id + {k - 1})")
    levels = " UNION ALL ".join(f"SELECT field, {k} AS k, gram, sent_idx FROM g{k}" for k in range(1, n + 1))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT field, k, gram, count(*) AS n_rows, count(DISTINCT sent_idx) AS n_sentences FROM ({levels}) GROUP BY 1, 2, 3"


SQL = {
    "p2_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_terms": _TERMS + "SELECT field, term, n_rows, n_sentences, mark FROM m",
    "p2_upos_ngrams": f"SELECT k, gram, n_rows, n_sentences FROM ({_grams(['upos'], 8)})",
    "p2_ngrams": _grams(["form", "upos", "deprel"], 3),
}
