"""Experiment grids, costs, comparisons."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dollars for 1000 tokens in and out; the first key that a model's name holds counts.
PRICES = [
    ("gpt-4o-mini", 0.00015, 0.0006),
    ("gpt-4o", 0.005, 0.015),
    ("gpt-4-turbo", 0.01, 0.03),
    ("gpt-3.5-turbo", 0.0005, 0.0015),
    ("claude-3-sonnet", 0.003, 0.015),
    ("claude-3-haiku", 0.00025, 0.00125),
    ("claude-3-opus", 0.015, 0.075),
]
OTHER_PRICE = (0.002, 0.006)
OUT_TOKENS = 500


@dataclass(frozen=True)
class Grid:
    """The lists whose every combination is one experiment, and what all have in common."""

    models: list[str] = field(default_factory=lambda: ["gpt-4o-mini"])
    templates: list[str] = field(default_factory=lambda: ["basic", "gloss_focused"])
    strategies: list[str] = field(default_factory=lambda: ["random", "diversity"])
    shots: list[int] = field(default_factory=lambda: [3, 5])
    test_size: int = 15
    max_tokens: int = 2000
    temperature: float = 0.1
    seed: int = 42
    sleep_time: float = 0.5


QUICK = Grid(templates=["basic"], strategies=["random"], shots=[2], test_size=3)
STANDARD = Grid()
COMPREHENSIVE = Grid(models=["gpt-4o-mini", "gpt-4o"], templates=["basic", "detailed", "gloss_focused"], strategies=["random", "diversity", "coverage"], shots=[2, 3, 5])


def short_name(model: Column) -> Column:
    return F.translate(model, "-.", "__")


def display_name(model: Column) -> Column:
    """What stands behind the last dash, at most 15 characters."""
    return F.substring(F.element_at(F.split(model, "-"), -1), 1, 15)


def grid(spark: SparkSession, g: Grid) -> DataFrame:
    """One row per experiment: each list is exploded in turn over a single row."""
    one = spark.range(1).select(*(F.array(*map(F.lit, getattr(g, k))).alias(k) for k in ("models", "templates", "strategies", "shots")))
    for many, name in (("models", "model"), ("templates", "template"), ("strategies", "strategy"), ("shots", "shots")):
        one = one.select(*(c for c in one.columns if c != many), F.explode(many).alias(name))
    m = F.col("model")
    return one.select(
        F.concat_ws("_", short_name(m), "template", "strategy", F.concat(F.col("shots").cast("string"), F.lit("shot"))).alias("name"),
        F.format_string("%s with %s prompts, %s selection, %d examples", m, "template", "strategy", "shots").alias("description"),
        m,
        "template",
        "strategy",
        "shots",
        provider(m).alias("provider"),
        *(F.lit(getattr(g, k)).alias(k) for k in ("test_size", "max_tokens", "temperature", "seed", "sleep_time")),
    )


def provider(model: Column) -> Column:
    m = F.lower(model)
    return F.when(F.contains(m, F.lit("claude")), "anthropic").otherwise("openai")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def price(model: Column, side: int) -> Column:
    """Dollars for 1000 tokens; a model's name counts in any case."""
    out = F.lit(OTHER_PRICE[side])
    for key, *dollars in reversed(PRICES):
        out = F.when(F.contains(F.lower(model), F.lit(key)), F.lit(dollars[side])).otherwise(out)
    return out


def cost_estimate(model: Column, tokens_in: Column, tokens_out: Column | None = None) -> Column:
    """Dollars; answers are taken as ``OUT_TOKENS`` long where their length is not known."""
    out = F.lit(OUT_TOKENS) if tokens_out is None else tokens_out
    return tokens_in / 1000 * price(model, 0) + out / 1000 * price(model, 1)


def batch_cost(shots: Column, test_size: Column, per_thousand: Column) -> Column:
    """Dollars of a run, from 200 tokens an example and 300 a sentence."""
    return (shots * 200 + 300) * test_size * per_thousand / 1000


def usage(prompts: DataFrame, model: str = "model_name", prompt: str = "prompt", response: str = "response") -> DataFrame:
    """Requests, tokens and dollars of each model; texts that report an error count as requests like all others."""
    n_in, n_out = token_estimate(F.col(prompt)), token_estimate(F.col(response))
    return prompts.groupBy(model).agg(F.count("*").alias("n_requests"), F.sum(n_in + F.coalesce(n_out, F.lit(0))).alias("n_tokens"), F.round(F.sum(cost_estimate(F.col(model), n_in)), 9).alias("cost"))


def compare(results: DataFrame) -> DataFrame:
    """Experiments with flags for the best; the columns of the comparison file."""
    best = results.agg(F.max("las").alias("_las"), F.max("uas").alias("_uas")).first()
    return results.withColumn("best_las", F.col("las") == F.lit(best["_las"])).withColumn("best_uas", F.col("uas") == F.lit(best["_uas"]))


def grouped_means(results: DataFrame, *by: str) -> DataFrame:
    """(by, mean_las, mean_uas, n): means by each of the columns, and over all, in one pass of grouping sets; null stands for all."""
    g = results.groupingSets([*([F.col(c)] for c in by), []], *map(F.col, by))
    return g.agg(F.round(F.avg("las"), 9).alias("mean_las"), F.round(F.avg("uas"), 9).alias("mean_uas"), F.count("*").alias("n"))


def best_experiment(results: DataFrame, keys: list[str]) -> DataFrame:
    """The experiment with the largest LAS, the first by name of equals."""
    return results.orderBy(F.desc("las"), *keys).limit(1).select(*keys, "las", "uas")


def prompt_lengths(prompts: DataFrame, by: list[str]) -> DataFrame:
    return prompts.groupBy(*by).agg(F.round(F.avg(F.length("prompt")), 9).alias("mean_length"), F.count("*").alias("n_prompts"))
