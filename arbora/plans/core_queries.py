"""Queries of the core's data-cleaning operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.packed import explode_items
from arbora.operators.hierarchy import descendants, hierarchy, whole_number
from arbora.session import table
from arbora.sources.sheets import loaded, parse_records, rejected


def _arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tokens")
    return t.select("sent_idx", whole_number(F.col("id")).alias("id"), whole_number(F.col("head")).alias("head"), "deprel")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens whose heads never end, with the smallest id of the cycle they lead into."""
    h = hierarchy(_arcs(spark, sf_dir), "sent_idx", "id", "head", cycles_only=True)
    return h.select(F.col("tree").alias("sent_idx"), F.col("node").cast("int").alias("id"), F.col("cycle_id").cast("int").alias("cycle_id"))


def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every token."""
    h = hierarchy(_arcs(spark, sf_dir), "sent_idx", "id", "head", "deprel")
    return h.select(
        F.col("tree").alias("sent_idx"), F.col("node").alias("id"), "depth", "root", F.array_join("path", "/").alias("path"), F.array_join("label_path", "/", "_").alias("deprel_path"), "n_descendants", "cyclic", "cycle_id"
    )


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair of tokens, with the number of arcs between them."""
    d = descendants(hierarchy(_arcs(spark, sf_dir), "sent_idx", "id", "head"))
    return d.withColumnRenamed("tree", "sent_idx")


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "label_set").where("kind = 'deprel'")
    return parse_records(table(spark, sf_dir, "raw_lines"), labels)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged token records with every reason."""
    return rejected(_sheets(spark, sf_dir))


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good token records as typed rows."""
    return loaded(_sheets(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every ``feats`` or ``misc`` that holds two or more."""
    return explode_items(table(spark, sf_dir, "tokens"), "row_id", ["feats", "misc"], at_least=2)


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every ``feats`` or ``misc``."""
    return explode_items(table(spark, sf_dir, "tokens"), "row_id", ["feats", "misc"])


QUERIES = {f.__name__: f for f in (p4_found, p4_hierarchy, p4_descendants, p5_found, p5_loaded, p6_found, p6_items)}

_NODES = """WITH RECURSIVE n AS (SELECT sent_idx, CAST(id AS BIGINT) AS id, min(CASE WHEN regexp_full_match(head, '[0-9]{1,18}') AND CAST(head AS BIGINT) <> 0 THEN CAST(head AS BIGINT) END) AS head,
       min(deprel) AS deprel, count(*) OVER (PARTITION BY sent_idx) AS size FROM tokens WHERE regexp_full_match(id, '[0-9]{1,18}') AND sent_idx IS NOT NULL GROUP BY 1, 2),
walk AS (SELECT sent_idx, id AS start, id AS pos, 0 AS step FROM n
         UNION ALL SELECT w.sent_idx, w.start, p.id, w.step + 1 FROM walk w JOIN n c ON c.sent_idx = w.sent_idx AND c.id = w.pos JOIN n p ON p.sent_idx = c.sent_idx AND p.id = c.head WHERE w.step < 2 * c.size),
ends AS (SELECT w.sent_idx, w.start AS id, max(step) AS steps, any_value(n.size) AS size FROM walk w JOIN n ON n.sent_idx = w.sent_idx AND n.id = w.start GROUP BY 1, 2),
cyc AS (SELECT w.sent_idx, w.start AS id, min(w.pos) FILTER (w.step >= e.size) AS cycle_id FROM walk w JOIN ends e ON e.sent_idx = w.sent_idx AND e.id = w.start WHERE e.steps >= 2 * e.size GROUP BY 1, 2),
up AS (SELECT w.* FROM walk w ANTI JOIN cyc c ON c.sent_idx = w.sent_idx AND c.id = w.start)
"""
_RECORDS = """WITH l AS (SELECT line_id, raw_text, regexp_full_match(raw_text, '(?s)(?:"(?:[^"]|"")*"|[^"\\t]*)(?:\\t(?:"(?:[^"]|"")*"|[^"\\t]*))*') AS ok FROM raw_lines
  WHERE regexp_matches(raw_text, '[^\\s]') AND NOT starts_with(raw_text, '#')),
f AS (SELECT line_id, ok, CASE WHEN ok THEN list_transform(regexp_extract_all(raw_text || chr(9), '(?s)("(?:[^"]|"")*"|[^"\\t]*)\\t', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS r FROM l),
g AS (SELECT *, len(r) = 10 AS ten, coalesce(TRY_CAST(regexp_extract(r[1], '^([0-9]+)-([0-9]+)$', 1) AS HUGEINT) > 0 AND TRY_CAST(regexp_extract(r[1], '^([0-9]+)-([0-9]+)$', 1) AS HUGEINT) < TRY_CAST(regexp_extract(r[1], '^([0-9]+)-([0-9]+)$', 2) AS HUGEINT), false) AS span FROM f),
w AS (SELECT line_id, 'quoting' AS reason FROM g WHERE NOT ok UNION ALL SELECT line_id, 'columns' FROM g WHERE ok AND NOT ten
  UNION ALL SELECT line_id, 'id' FROM g WHERE ok AND ten AND NOT span AND NOT regexp_full_match(r[1], '0*[1-9][0-9]*')
  UNION ALL SELECT line_id, 'head' FROM g WHERE ok AND ten AND NOT regexp_full_match(r[7], '[0-9]+') AND NOT (span AND r[7] = '_')
  UNION ALL SELECT line_id, 'deprel' FROM g WHERE ok AND ten AND r[8] NOT IN (SELECT label FROM label_set WHERE kind = 'deprel' AND label IS NOT NULL) AND NOT (span AND r[8] = '_'))
"""
# Packed fields without a tokenizer: what stands in quotes is written in private characters, items are marked where a key begins, then all is
# written back. Brackets and backslashes are left aside, which the tables do not have around delimiters.
_ITEMS = r"""WITH long AS (SELECT row_id, 'feats' AS field, feats AS s FROM tokens WHERE contains(feats, '=') UNION ALL SELECT row_id, 'misc', misc FROM tokens WHERE contains(misc, '=')),
d AS (SELECT DISTINCT s FROM long),
parts AS (SELECT s, regexp_extract_all(s, '(?s)"(?:[^"]|"")*"|[^"]+|"') AS p FROM d),
hidden AS (SELECT s, list_aggregate(list_transform(p, lambda x: CASE WHEN starts_with(x, '"') AND length(x) > 1 THEN '"' || translate(substr(x, 2, length(x) - 2), '|;,/¦｜ ="', chr(57345) || chr(57346) || chr(57347) || chr(57348) || chr(57349) || chr(57350) || chr(57351) || chr(57352) || chr(57353)) || '"' ELSE x END), 'string_agg', '') AS h FROM parts),
tight AS (SELECT s, regexp_replace(h, '\s*=\s*', '=', 'g') AS h FROM hidden),
marked AS (SELECT s, regexp_replace(h, '(^|[|;,/¦｜\s"])((?:\p{L}+(?:\[[^\[\]"=]*\])?=)|(?:"\s*\p{L}+(?:\[[^\[\]"=]*\])?' || chr(57351) || '*' || chr(57352) || '))', '\1' || chr(57354) || '\2', 'g') AS h FROM tight),
sp AS (SELECT s, string_split(h, chr(57354)) AS c FROM marked), cut AS (SELECT s, list_slice(c, 2, len(c)) AS c FROM sp),
one AS (SELECT s, unnest(range(1, len(c) + 1)) AS pos, unnest(c) AS piece FROM cut),
bare AS (SELECT s, pos, trim(piece, '|;,/¦｜ ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) AS piece FROM one),
whole AS (SELECT s, pos, CASE WHEN regexp_full_match(piece, '(?s)"[^"]*"') THEN translate(substr(piece, 2, length(piece) - 2), chr(57352), '=') ELSE piece END AS piece FROM bare),
kv AS (SELECT s, pos, trim(split_part(piece, '=', 1)) AS k, trim(substr(piece, instr(piece, '=') + 1)) AS v FROM whole),
val AS (SELECT s, pos, k, CASE WHEN regexp_full_match(v, '(?s)"[^"]*"') THEN replace(substr(v, 2, length(v) - 2), chr(57353) || chr(57353), '"') ELSE v END AS v FROM kv)
, found AS (SELECT row_id, field, CAST(pos AS INT) AS pos, k || '=' || replace(translate(v, chr(57345) || chr(57346) || chr(57347) || chr(57348) || chr(57349) || chr(57350) || chr(57351) || chr(57352), '|;,/¦｜ ='), chr(57353) || chr(57353), '"') AS val
FROM long JOIN val USING (s))
"""
SQL = {
    "p4_found": _NODES + "SELECT sent_idx, CAST(id AS INT) AS id, CAST(cycle_id AS INT) AS cycle_id FROM cyc",
    "p4_hierarchy": _NODES
    + """, d AS (SELECT sent_idx, pos AS anc, count(*) - 1 AS n FROM up GROUP BY 1, 2),
p AS (SELECT u.sent_idx, u.start AS id, max(step) AS depth, arg_max(pos, step) AS root, string_agg(CAST(pos AS VARCHAR), '/' ORDER BY step DESC) AS path, string_agg(coalesce(n.deprel, '_'), '/' ORDER BY step DESC) AS deprel_path
      FROM up u JOIN n ON n.sent_idx = u.sent_idx AND n.id = u.pos GROUP BY 1, 2)
SELECT n.sent_idx, n.id, p.depth, p.root, p.path, p.deprel_path, d.n AS n_descendants, c.id IS NOT NULL AS cyclic, c.cycle_id
FROM n LEFT JOIN p ON p.sent_idx = n.sent_idx AND p.id = n.id LEFT JOIN d ON d.sent_idx = n.sent_idx AND d.anc = n.id LEFT JOIN cyc c ON c.sent_idx = n.sent_idx AND c.id = n.id""",
    "p4_descendants": _NODES + "SELECT sent_idx, pos AS ancestor, start AS descendant, step AS distance FROM up WHERE step > 0",
    "p6_found": _ITEMS + "SELECT row_id, field, pos, val FROM (SELECT *, count(*) OVER (PARTITION BY row_id, field) AS n FROM found) WHERE n > 1",
    "p6_items": _ITEMS + "SELECT * FROM found",
    "p5_found": _RECORDS + "SELECT * FROM w",
    "p5_loaded": _RECORDS
    + """SELECT line_id, CAST(string_split(r[1], '-')[1] AS INT) AS id, CASE WHEN contains(r[1], '-') THEN CAST(string_split(r[1], '-')[2] AS INT) END AS id_end, r[2] AS form, r[3] AS lemma, r[4] AS upos, r[5] AS xpos,
       r[6] AS feats, TRY_CAST(r[7] AS INT) AS head, r[8] AS deprel, r[9] AS deps, r[10] AS misc FROM g WHERE line_id NOT IN (SELECT line_id FROM w)""",
}
