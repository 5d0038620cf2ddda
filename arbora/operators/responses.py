"""Model answers in free text to rows of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats that answers come in, tried in this order.
FORMATS = {
    "basic": r"(\d+)\s+(\S+)\s*->\s*(\d+)\s+(\S+)",
    "detailed": r"(\d+)\s+(\S+)\s*(?:\[.*?\])?\s*(?:\(.*?\))?\s*->\s*(\d+)\s+(\S+)",
    "reasoning": r"(\d+)\s+(\S+).*?->\s*(\d+)\s+(\S+)(?:\s*\((.+?)\))?",
    "tabular": r"(\d+)\s*\|\s*(\S+)\s*\|\s*(\d+)\s*\|\s*(\S+)",
}
CONFIDENCE = r"(\d+).*?confidence[:=]\s*([0-9.]+)"
ARROW = r"^.*?([^\s]+)\s*→\s*([^\s]+)\s*\(([^)]+)\)"
#: Unicode classes, any case, and a dot that stops at line feeds only.
_FLAGS = "(?idU)"


def matches(text: Column, name: str) -> Column:
    """Array of (token_id, form, head, relation, reasoning) of one format; rows whose numbers do not fit are left out."""
    p = F.lit(_FLAGS + FORMATS[name])
    g = [F.regexp_extract_all(text, p, F.lit(i)) for i in range(1, 5)]
    g.append(F.regexp_extract_all(text, p, F.lit(5)) if name == "reasoning" else F.transform(g[0], lambda x: F.lit("")))
    rows = F.transform(
        F.arrays_zip(*(x.alias(f"g{i}") for i, x in enumerate(g))),
        lambda x: F.struct(x["g0"].try_cast("int").alias("token_id"), x["g1"].alias("form"), x["g2"].try_cast("int").alias("head"), F.trim(x["g3"]).alias("relation"), F.coalesce(x["g4"], F.lit("")).alias("reasoning")),
    )
    return F.filter(rows, lambda x: x["token_id"].isNotNull() & x["head"].isNotNull())


def cascade(text: Column) -> Column:
    """The matches of the first format that has any, null if none has.

    The formats are branches of one conditional, so a later one is only tried on texts that the earlier ones do not fit.
    """
    out = F.lit(None)
    for name in reversed(FORMATS):
        out = F.when(text.rlike(_FLAGS + FORMATS[name]) & (F.size(matches(text, name)) > 0), matches(text, name)).otherwise(out)
    return out


def winner(text: Column) -> Column:
    """The name of the format that ``cascade`` takes."""
    out = F.lit(None).cast("string")
    for name in reversed(FORMATS):
        out = F.when(text.rlike(_FLAGS + FORMATS[name]), F.lit(name)).otherwise(out)
    return out


def parse_responses(df: DataFrame, keys: list[str], text: str = "response") -> DataFrame:
    """(keys, pos, token_id, form, head, relation, reasoning): one row per match; texts that no format fits give none."""
    return df.select(*keys, F.posexplode(cascade(F.col(text))).alias("pos", "m")).select(*keys, "pos", "m.*")


def parse_failures(df: DataFrame, keys: list[str], text: str = "response") -> DataFrame:
    """The keys of texts that no format fits, null ones among them."""
    return df.where(F.coalesce(F.size(cascade(F.col(text))), F.lit(0)) <= 0).select(*keys)


def confidences(df: DataFrame, keys: list[str], text: str = "response") -> DataFrame:
    """(keys, token_id, confidence): the last usable value of each token."""
    p = F.lit(_FLAGS + CONFIDENCE)
    z = F.arrays_zip(F.regexp_extract_all(F.col(text), p, F.lit(1)).alias("t"), F.regexp_extract_all(F.col(text), p, F.lit(2)).alias("c"))
    rows = df.select(*keys, F.posexplode(z).alias("pos", "x")).select(*keys, "pos", F.col("x.t").try_cast("int").alias("token_id"), F.col("x.c").try_cast("double").alias("confidence"))
    return rows.where("token_id is not null and confidence is not null").groupBy(*keys, "token_id").agg(F.max_by("confidence", "pos").alias("confidence"))


def parse_arrows(df: DataFrame, gold: DataFrame, keys: list[str], text: str = "response") -> DataFrame:
    """(keys, sent_idx, id, pred_head, pred_deprel): every token of the sentences with the answer of its form.

    ``keys`` must hold ``sent_idx``. A form that stands twice means its last token. The last line about a
    token counts; a token without a line is a root. A root line needs no head.
    """
    lines = df.select(*keys, F.posexplode(F.split(F.trim(text), "\n")).alias("line_no", "line")).where(F.contains("line", F.lit("→")) & F.contains("line", F.lit("(")))
    part = lambda i: F.regexp_extract("line", ARROW, i)
    a = lines.select(*keys, "line_no", part(1).alias("dep"), part(2).alias("to"), part(3).alias("rel")).where("dep <> ''")
    last = gold.groupBy("sent_idx", "form").agg(F.max("id").alias("id"))
    a = a.join(last.select("sent_idx", F.col("form").alias("dep"), F.col("id").alias("dep_id")), ["sent_idx", "dep"])
    a = a.join(last.select("sent_idx", F.col("form").alias("to"), F.col("id").alias("to_id")), ["sent_idx", "to"], "left")
    a = a.where("to_id is not null or rel = 'root'")
    told = a.groupBy(*keys, F.col("dep_id").alias("id")).agg(F.max_by(F.struct(F.coalesce("to_id", F.lit(0)).alias("h"), "rel"), "line_no").alias("b"))
    every = gold.select("sent_idx", "id").join(df.select(*keys).distinct(), "sent_idx")
    return every.join(told, [*keys, "id"], "left").select(*keys, "id", F.coalesce("b.h", F.lit(0)).alias("pred_head"), F.coalesce("b.rel", F.lit("root")).alias("pred_deprel"))
