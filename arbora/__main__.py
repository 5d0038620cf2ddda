"""``python -m arbora``: scores, prompts, selections and grids over a folder of tables, or over CoNLL-U files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import frames, scoring, selection
from arbora.plans import experiments, prompts, reports, runner
from arbora.session import local_session, ship, table
from arbora.sources import answers as answers_of
from arbora.sources import conllu, sinks

GRIDS = {"quick": experiments.QUICK, "standard": experiments.STANDARD, "comprehensive": experiments.COMPREHENSIVE}
KEYS = frames.EXPERIMENT


def _score(spark: SparkSession, a: argparse.Namespace) -> None:
    gold = frames.gold_tokens(table(spark, a.tables, "tokens"))
    answers = table(spark, a.tables, "predictions")
    al = frames.aligned(gold, frames.answers(answers))
    if a.ignore_punct:
        al = al.where("upos <> 'PUNCT'")
    s = scoring.sentence_scores(al)
    relations = scoring.per_relation(frames.aligned(gold, frames.answers(answers, "first")))
    macro = scoring.macro_scores(s)
    sinks.write_sentence_csv(s, f"{a.out}/sentences")
    macro.write.mode("overwrite").json(f"{a.out}/experiments")
    reports.summary(macro, relations, scoring.error_histogram(scoring.token_errors(al)), KEYS).select("report").write.mode("overwrite").text(f"{a.out}/reports")


def _split(spark: SparkSession, a: argparse.Namespace, split: str) -> DataFrame:
    s = table(spark, a.tables, "sentences").where(F.col("split") == split)
    g = frames.gold_tokens(table(spark, a.tables, "tokens")).join(s.select("sent_idx"), "sent_idx", "left_semi")
    return prompts.nested(g, s)


def _chosen(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    train = table(spark, a.tables, "sentences").where("split = 'train'").select("sent_idx")
    g = frames.gold_tokens(table(spark, a.tables, "tokens")).join(train, "sent_idx", "left_semi")
    return selection.sentence_strategy(a.strategy)(frames.sentence_features(g), g, a.few_shot_k)


def _prompts(spark: SparkSession, a: argparse.Namespace) -> None:
    examples = _split(spark, a, "train").join(_chosen(spark, a), "sent_idx", "left_semi")
    prompts.Prompts(a.language).render(a.template, _split(spark, a, a.split), examples).write.mode("overwrite").json(a.out)


def _select(spark: SparkSession, a: argparse.Namespace) -> None:
    _chosen(spark, a).write.mode("overwrite").json(a.out)


def _grid(spark: SparkSession, a: argparse.Namespace) -> None:
    experiments.grid(spark, GRIDS[a.preset]).write.mode("overwrite").json(a.out)


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus = runner.Corpus(frames.gold_tokens(table(spark, a.tables, "tokens")), table(spark, a.tables, "sentences"))
    source = {"dry": runner.dry, "provider": runner.asked_of_provider}.get(a.answers) or runner.replayed(spark.read.json(a.answers))
    done = runner.run_grid(corpus, experiments.grid(spark, GRIDS[a.preset]), source, a.out, language=a.language, resume=not a.again)
    reports.comparison_report(done).orderBy("place").select("line").coalesce(1).write.mode("overwrite").text(f"{a.out}/report")


def _tables(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus = runner.Corpus(frames.gold_tokens(table(spark, a.tables, "tokens")), table(spark, a.tables, "sentences"))
    source = {"dry": runner.dry, "provider": runner.asked_of_provider}.get(a.answers) or (lambda p, e: answers_of.replay(p, spark.read.json(a.answers), ["sent_idx"]))
    for split in a.splits:
        runner.run_tables(corpus, split, source, a.out, model=a.model, shots=a.few_shot_k, language=a.language, keep_tokens=a.keep_tokenization, ignore_punct=a.ignore_punct, seed=a.seed, sleep_time=a.sleep, max_tokens=a.max_tokens, temperature=a.temperature)


def _read(spark: SparkSession, a: argparse.Namespace) -> None:
    conllu.tokens(conllu.read_lines(spark, a.files), a.dialect).write.mode("overwrite").parquet(a.out)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="arbora", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *, tables: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--out", required=True)
        if tables:
            c.add_argument("--tables", required=True)
        return c

    c = command("score", _score)
    c.add_argument("--ignore-punct", action="store_true")
    for name, run in (("select", _select), ("prompts", _prompts)):
        c = command(name, run)
        c.add_argument("--strategy", default="diversity")
        c.add_argument("--few-shot-k", type=int, default=3)
    c.add_argument("--template", default="basic")
    c.add_argument("--split", default="test")
    c.add_argument("--language", default="Wolof")
    command("grid", _grid, tables=False).add_argument("--preset", choices=GRIDS, default="standard")
    c = command("run", _run)
    c.add_argument("--preset", choices=GRIDS, default="quick")
    c.add_argument("--answers", default="dry", help="dry, provider, or JSON files of name, sent_idx, response")
    c.add_argument("--language", default="Wolof")
    c.add_argument("--again", action="store_true", help="run experiments that are there already")
    c = command("tables", _tables)
    c.add_argument("--splits", nargs="+", default=["dev", "test"])
    c.add_argument("--answers", default="dry", help="dry, provider, or JSON files of sent_idx, response")
    c.add_argument("--model", default="gpt-4o-mini")
    c.add_argument("--few-shot-k", type=int, default=0)
    c.add_argument("--language", default="")
    c.add_argument("--keep-tokenization", action=argparse.BooleanOptionalAction, default=False)
    c.add_argument("--ignore-punct", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("--seed", type=int, default=7)
    c.add_argument("--sleep", type=float, default=0.0)
    c.add_argument("--max-tokens", type=int, default=1400)
    c.add_argument("--temperature", type=float, default=0.0)
    c = command("read", _read, tables=False)
    c.add_argument("--dialect", choices="ABC", default="A")
    c.add_argument("files", nargs="+")
    a = p.parse_args(args)
    spark = spark or local_session()
    ship(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
