"""Text reports of experiments, as rows of lines with their place, so that they can be written by any sink."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.plans.experiments import best_experiment, compare, display_name, grouped_means

# Titles and rules of the reports.
TABLE = "Relation        Precision  Recall     F1         Support   "
RULE = "-" * 60
OVERALL = [
    ("Unlabeled Attachment Score (UAS): %.3f", "uas"),
    ("Labeled Attachment Score (LAS):   %.3f", "las"),
    ("Label Accuracy (LA):              %.3f", "la"),
    ("Root Accuracy:                    %.3f", "root_accuracy"),
    ("Complete Match Rate:              %.3f", "complete_match"),
]


def relation_line() -> Column:
    """One row of a relation table.

    Numbers are rounded from their binary value, as Python and C do; the built-in formatter rounds their decimal
    one half up, which differs at ties such as 0.8125. The tables have a row per relation only.
    """

    @F.pandas_udf("string")
    def line(relation: pd.Series, precision: pd.Series, recall: pd.Series, f1: pd.Series, support: pd.Series) -> pd.Series:
        return pd.Series([f"{r:<15} {a:<10.3f} {b:<10.3f} {c:<10.3f} {n:<10d}" for r, a, b, c, n in zip(relation, precision, recall, f1, support)])

    return line("relation", "precision", "recall", "f1", "support")


def relation_lines(relations: DataFrame, keys: list[str], by_name: bool = False) -> DataFrame:
    """(keys, place, line): the relations of each experiment, the best F1 first, or by name; ties by name."""
    order = "relation" if by_name else "f1 desc, relation"
    place = F.expr(f"row_number() over (partition by {', '.join(keys)} order by {order})")
    return relations.select(*keys, place.cast("bigint").alias("place"), relation_line().alias("line"))


def summary(macro: DataFrame, relations: DataFrame, histogram: DataFrame, keys: list[str], language: str = "WOLOF") -> DataFrame:
    """(keys, report): the whole report of each experiment. An experiment has few relations and kinds of errors."""
    title = f"{language} DEPENDENCY PARSING EVALUATION REPORT"
    top = F.concat_ws("\n", F.lit(""), F.lit(title), F.lit("=" * len(title)), F.lit(""), *(F.concat(F.lit(k.replace("_", " ").title() + ": "), F.col(k)) for k in keys), F.lit(""), F.lit("OVERALL PERFORMANCE"), F.lit("-" * 19), *(F.format_string(f, c) for f, c in OVERALL), F.lit(""), F.lit("PER-RELATION PERFORMANCE"), F.lit("-" * 24), F.lit(TABLE), F.lit(RULE))
    rows = relation_lines(relations, keys).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("rows"))
    kinds = histogram.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s: %d", "error_type", "n"))), "\n").alias("kinds"))
    j = macro.select(*keys, top.alias("top")).join(rows, keys, "left").join(kinds, keys, "left")
    errors = F.when(F.col("kinds").isNotNull(), F.concat(F.lit("\nERROR ANALYSIS\n" + "-" * 14 + "\n"), "kinds", F.lit("\n"))).otherwise("")
    return j.select(*keys, F.concat("top", F.lit("\n"), F.coalesce("rows", F.lit("")), F.lit("\n"), errors).alias("report"))


def comparison_report(results: DataFrame) -> DataFrame:
    """(place, line): a line for each experiment, the best LAS first, then the best, the means by template, strategy and model, and over all."""
    flagged = compare(results)
    mark = lambda c: F.when(F.col(c), "*").otherwise(" ")
    line = F.format_string("%-40s %-15s %7.3f%s %7.3f%s %7.3f %7.3f %8.1f", "name", display_name(F.col("model")), "uas", mark("best_uas"), "las", mark("best_las"), "la", "root_accuracy", "processing_time")
    each = flagged.select(F.lit(1).alias("part"), (-F.col("las")).alias("o"), F.col("name").alias("k"), line.alias("line"))
    best = best_experiment(results, ["name"]).select(F.lit(2).alias("part"), F.lit(0.0).alias("o"), F.col("name").alias("k"), F.format_string("Best: %s, LAS %.3f, UAS %.3f", "name", "las", "uas").alias("line"))
    by = ["template", "strategy", "model"]
    what = F.coalesce(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c} "), F.col(c))) for c in by), F.lit("all"))
    means = grouped_means(results, *by).select(F.when(what == "all", 4).otherwise(3).alias("part"), F.lit(0.0).alias("o"), what.alias("k"), F.format_string("Mean of %s: LAS %.3f, UAS %.3f over %d", what, "mean_las", "mean_uas", "n").alias("line"))
    head = results.sparkSession.createDataFrame([(0, 0.0, "", f"{'Experiment':<40} {'Model':<15} {'UAS':>8} {'LAS':>8} {'LA':>7} {'Root':>7} {'Seconds':>8}")], "part int, o double, k string, line string")
    rows = head.unionByName(each).unionByName(best).unionByName(means)
    # as many lines as experiments, which the driver goes through one by one
    return rows.select(F.row_number().over(Window.orderBy("part", "o", "k")).alias("place"), "line")
