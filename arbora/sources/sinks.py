"""Where results go: logs, corpora, metric and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The report of the token scores.
REPORT = [
    ("UPOS accuracy:       ", "upos_accuracy"),
    ("Lemma accuracy:      ", "lemma_accuracy"),
    ("UAS:                 ", "uas"),
    ("LAS:                 ", "las"),
    ("FEATS precision:     ", "feats_precision"),
    ("FEATS recall:        ", "feats_recall"),
    ("FEATS F1:            ", "feats_f1"),
]


def append_log(records: DataFrame, path: str) -> None:
    """Appends one JSON object a line; nulls are left out of it."""
    records.write.mode("append").json(path)


def append_blocks(blocks: DataFrame, path: str, block: str = "block") -> None:
    """Appends CoNLL-U blocks, each followed by a blank line."""
    blocks.select(F.concat(F.rtrim(block), F.lit("\n"))).write.mode("append").text(path)


def conllu_blocks(gold: DataFrame, sentences: DataFrame) -> DataFrame:
    """(sent_idx, block): sentences written back as CoNLL-U."""
    line = F.concat_ws("\t", F.col("id").cast("string"), "form", "lemma", "upos", F.lit("_"), "feats", F.col("head").cast("string"), "deprel", F.lit("_"), "misc")
    g = gold.groupBy("sent_idx").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("t"))
    head = F.concat(F.lit("# sent_id = "), F.coalesce("sent_id", F.lit("")), F.lit("\n# text = "), F.coalesce("text", F.lit("")), F.when(F.col("text_en").isNotNull(), F.concat(F.lit("\n# text_en = "), "text_en")).otherwise(""))
    return sentences.join(g, "sent_idx").select("sent_idx", F.concat(head, F.lit("\n"), F.array_join("t.line", "\n")).alias("block"))


def metrics_text(split: Column) -> Column:
    """The report of a row of token scores, four digits a number."""
    lines = [
        F.format_string("=== %s METRICS ===", F.upper(split)),
        F.format_string("Sentences evaluated: %d / %d", "sentences_evaluated", "sentences_total"),
        F.format_string("Tokens considered:   %d", "tokens_considered"),
        F.lit(""),
        *(F.format_string(title + "%.4f", c) for title, c in REPORT),
        F.lit(""),
        F.format_string("Skipped sentences (invalid/mismatch): %d", "sentences_skipped"),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def write_metrics(metrics: DataFrame, path: str, split: str = "split") -> None:
    """A JSON object and a report for each split."""
    metrics.write.mode("overwrite").partitionBy(split).json(f"{path}/json")
    metrics.select(split, metrics_text(F.col(split)).alias("value")).write.mode("overwrite").partitionBy(split).text(f"{path}/text")


def experiment_rows(results: DataFrame, relations: DataFrame, scores: DataFrame, errors: DataFrame, confusion: DataFrame, keys: list[str]) -> DataFrame:
    """One nested row per experiment: means, scores by relation, sentences with their errors, confusion counts.

    The nesting is for files that hold a whole experiment each; for large experiments write the flat tables instead.
    """
    rel = relations.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", F.struct("precision", "recall", "f1", "support").alias("v"))))).alias("per_relation_scores"))
    e = errors.groupBy(*keys, "sent_idx").agg(F.array_sort(F.collect_list(F.struct("id", "form", "error_type", "gold_head", "gold_deprel", "pred_head", "pred_deprel"))).alias("errors"))
    s = scores.join(e, [*keys, "sent_idx"], "left")  # a sentence without errors has null
    cols = ["sent_idx", "uas", "las", "la", "root_correct", "complete_match", "num_tokens", "errors"]
    s = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("per_sentence_results"))
    c = confusion.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("gold", "predicted", "n"))).alias("confusion"))
    return results.join(rel, keys, "left").join(s, keys, "left").join(c, keys, "left")


def write_experiments(rows: DataFrame, path: str, keys: list[str]) -> None:
    """One folder an experiment. Those that ``rows`` holds are replaced and all others kept, so finished ones outlast a later failure."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)


def write_sentence_csv(scores: DataFrame, path: str) -> None:
    scores.select("sent_idx", "uas", "las", "la", "root_correct", "complete_match", "num_tokens", "num_errors").write.mode("overwrite").option("header", True).csv(path)


def comparison(results: DataFrame) -> DataFrame:
    """The columns of the comparison file."""
    names = {"name": "Experiment", "model": "Model", "template": "Template", "strategy": "Selection", "shots": "Examples", "uas": "UAS", "las": "LAS", "la": "LA", "root_accuracy": "Root_Accuracy", "complete_match": "Complete_Match", "processing_time": "Processing_Time"}
    return results.select(*(F.col(k).alias(v) for k, v in names.items()))


def write_comparison(results: DataFrame, path: str) -> None:
    c = comparison(results)
    c.write.mode("overwrite").json(f"{path}/json")
    c.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def prompt_summary(prompts: DataFrame, nested: DataFrame) -> DataFrame:
    """(sent_idx, prompt_length, text, translation, num_tokens) of rendered prompts."""
    return prompts.join(nested, "sent_idx").select("sent_idx", F.length("prompt").cast("bigint").alias("prompt_length"), "text", F.col("text_en").alias("translation"), F.size("tokens").cast("bigint").alias("num_tokens"))
