"""Experiments from the grid to scores: choose examples, render prompts, ask, read, score, save; a failed one ends no other."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from arbora.operators import frames, responses, scoring, selection
from arbora.plans import experiments as X
from arbora.plans import prompts as P
from arbora.session import stored
from arbora.sources import answers, conllu, sinks

#: Experiments of one grid, whose rows the driver goes through.
MOST_EXPERIMENTS = 10_000

#: From prompts (sent_idx, prompt) and the experiment's row to the same with ``response``.
Source = Callable[[DataFrame, Row], DataFrame]


@dataclass
class Corpus:
    """Gold tokens and sentences with their split; features of the training part are computed once."""

    gold: DataFrame
    sentences: DataFrame
    _kept: dict[str, DataFrame] = field(default_factory=dict)

    def part(self, split: str) -> DataFrame:
        return self.sentences.where(F.col("split") == split)

    def gold_of(self, sentences: DataFrame) -> DataFrame:
        return self.gold.join(sentences.select("sent_idx"), "sent_idx", "left_semi")

    def train(self) -> tuple[DataFrame, DataFrame]:
        """(gold tokens, features) of the training sentences."""
        if not self._kept:
            gold = stored(self.gold_of(self.part("train")))
            self._kept = {"gold": gold, "features": stored(frames.sentence_features(gold))}
        return self._kept["gold"], self._kept["features"]

    def asked(self, size: int) -> DataFrame:
        """The first sentences with tokens of the test split, or of the development split where there is no test split."""
        for split in ("test", "dev"):
            few = self.part(split).join(self.gold.select("sent_idx").distinct(), "sent_idx", "left_semi").orderBy("sent_idx").limit(size)
            few = stored(few)
            if not few.isEmpty():
                return few
        raise ValueError("no sentences to ask about")


@dataclass(frozen=True)
class Outcome:
    """What an experiment gives; the frames have the columns model_name and prompt_template, the latter with its name."""

    prompts: DataFrame
    responses: DataFrame
    sentences: DataFrame
    macro: DataFrame
    relations: DataFrame
    errors: DataFrame
    confusion: DataFrame
    seconds: float


def prompts_for(corpus: Corpus, e: Row, targets: DataFrame, language: str = "Wolof") -> DataFrame:
    """(sent_idx, prompt) of the target sentences. ``similarity`` chooses examples for each target, all others once."""
    gold, features = corpus.train()
    target_gold = corpus.gold_of(targets)
    if e["strategy"] == "similarity":
        found = selection.similar_sentences_each(features, frames.sentence_features(target_gold), e["shots"])
        place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("similarity"), "sent_idx"))
        chosen = stored(found.withColumn("place", place).select("target", "sent_idx", "place"))
    else:
        chosen = stored(selection.placed_selection(e["strategy"], features, gold, e["shots"], e["seed"]))
    few = chosen.select("sent_idx").distinct()
    nested = P.nested(gold.join(few, "sent_idx", "left_semi"), corpus.sentences.join(few, "sent_idx", "left_semi"))
    return P.Prompts(language).render(e["template"], P.nested(target_gold, targets), nested.join(chosen, "sent_idx"), order="place")


def run_one(corpus: Corpus, e: Row, source: Source, language: str = "Wolof") -> Outcome:
    """One experiment. Sentences whose answer cannot be read count with zero scores and one error."""
    targets = corpus.asked(e["test_size"])
    prompt = stored(prompts_for(corpus, e, targets, language))
    began = time.monotonic()
    answered = stored(source(prompt, e).select("sent_idx", "prompt", "response"))
    seconds = time.monotonic() - began
    named = {"model_name": F.lit(e["model"]), "prompt_template": F.lit(e["name"])}
    gold = stored(corpus.gold_of(targets))
    keyed = answered.withColumns(named)
    read = responses.parse_responses(keyed, scoring.KEYS)
    read = stored(read.select(*scoring.KEYS, F.col("pos").alias("pred_id"), "token_id", F.col("head").alias("predicted_head"), F.col("relation").alias("predicted_relation")))
    unread = stored(responses.parse_failures(keyed, scoring.KEYS))
    asked = keyed.select(*scoring.KEYS).join(unread, scoring.KEYS, "left_anti")
    last = frames.aligned(gold, frames.answers(read), asked)
    first = frames.aligned(gold, frames.answers(read, "first"), asked)
    sentences = stored(scoring.sentence_scores(last).unionByName(scoring.failed_scores(gold, unread)))
    return Outcome(prompt, keyed, sentences, scoring.macro_scores(sentences), scoring.per_relation(first), scoring.token_errors(last), scoring.confusion(first), seconds)


def save(o: Outcome, e: Row, out: str) -> None:
    """Writes an experiment below ``out``, each part in a folder with the experiment's name; other experiments stay."""
    rows = sinks.experiment_rows(o.macro, o.relations, o.sentences, o.errors, o.confusion, frames.EXPERIMENT)
    name = {"experiment": F.lit(e["name"])}
    sinks.write_experiments(rows.withColumns(name), f"{out}/experiments", ["experiment"])
    sinks.write_experiments(o.responses.withColumns(name), f"{out}/responses", ["experiment"])
    used = X.usage(o.responses)
    failed = answers.failed(o.responses).agg(F.count_if("is_error").alias("failed_queries"))
    told = {k: F.lit(e[k]) for k in ("name", "model", "template", "strategy", "shots")} | {"processing_time": F.lit(round(o.seconds, 3))}
    one = o.macro.drop(*frames.EXPERIMENT, "n_sentences").withColumns(told).withColumn("_k", F.lit(1))
    for x in (used.drop("model_name"), failed):
        one = one.join(x.withColumn("_k", F.lit(1)), "_k")
    sinks.write_experiments(one.drop("_k").withColumns(name), f"{out}/results", ["experiment"])


def run_grid(corpus: Corpus, experiments: DataFrame, source: Source, out: str, *, language: str = "Wolof", resume: bool = True) -> DataFrame:
    """The results of all experiments of a grid that have ended well, one row each, also written for comparison.

    An experiment that fails is noted in ``out/failures`` with its error, and the next one begins. With ``resume``
    experiments that ``out`` has are not run again. Only the grid's rows and one sentence limit an experiment reach the driver.
    """
    spark: SparkSession = experiments.sparkSession
    rows = experiments.orderBy("name").limit(MOST_EXPERIMENTS + 1).collect()
    if len(rows) > MOST_EXPERIMENTS:
        raise ValueError(f"more than {MOST_EXPERIMENTS} experiments")
    for e in rows:
        if resume and conllu.path_exists(spark, f"{out}/results/experiment={e['name']}"):
            continue
        try:
            save(run_one(corpus, e, source, language), e, out)
        except Exception as x:  # noqa: BLE001 - whatever went wrong, the next experiment must run
            sinks.append_log(spark.createDataFrame([(e["name"], f"{type(x).__name__}: {x}"[:10_000])], "name string, error string"), f"{out}/failures")
    if not conllu.path_exists(spark, f"{out}/results"):
        return spark.createDataFrame([], RESULT)
    done = spark.read.schema(RESULT).json(f"{out}/results")
    sinks.write_comparison(done, f"{out}/comparison")
    return done


# ------------------------------------------------------------------------------ tables for answers


def exemplars(corpus: Corpus, shots: int, seed: int) -> list[str]:
    """Whole training sentences as CoNLL-U, drawn by seed, in the order drawn."""
    gold, _ = corpus.train()
    drawn = selection.random_selection(gold.select("sent_idx").distinct(), min(shots, P.MOST_EXAMPLES), seed)
    few = stored(drawn.select("sent_idx", "draw"))
    own = few.select("sent_idx")
    blocks = sinks.conllu_blocks(gold.join(own, "sent_idx", "left_semi"), corpus.sentences.join(own, "sent_idx", "left_semi"))
    return [r["block"] for r in blocks.join(few, "sent_idx").orderBy("draw").select("block").collect()]  # as many as shots


def run_tables(corpus: Corpus, split: str, source: Source, out: str, *, model: str = "gpt-4o-mini", shots: int = 0, language: str = "", keep_tokens: bool = True, ignore_punct: bool = True, seed: int = 7, sleep_time: float = 0.0, max_tokens: int = 1400, temperature: float = 0.0) -> DataFrame:
    """Asks for a ten-column table of every sentence of a split: one row of token scores and of what was skipped and why.

    Below ``out``, ``log`` gets every prompt with its answer and the first check that it fails, ``corpus`` the valid tables, and ``metrics``
    the scores. Valid tables with as many rows as gold has are scored row by row, whatever their ids.
    """
    spark = corpus.gold.sparkSession
    targets = corpus.part(split)
    gold = corpus.gold_of(targets)
    shown = exemplars(corpus, shots, seed) if shots else None
    prompt = stored(P.table_prompts(P.nested(gold, targets), language, shown, keep_tokens))
    e = Row(name=f"tables_{split}", model=model, max_tokens=max_tokens, temperature=temperature, sleep_time=sleep_time)
    answered = stored(source(prompt, e).select("sent_idx", "prompt", "response"))
    size = gold.groupBy("sent_idx").agg(F.count("*").cast("int").alias("n"), F.count_if("head_ok").alias("n_gold"), F.array_sort(F.collect_list(F.struct("id", "form"))).alias("t"))
    sized = answered.join(size.select("sent_idx", "n", "n_gold", F.col("t.form").alias("forms")), "sent_idx").withColumn("block", P.extract_block(F.col("response")))
    wanted = (F.col("n"), F.col("forms")) if keep_tokens else (None, None)
    checked = stored(P.check_blocks(sized, F.col("block"), *wanted))
    rows = stored(conllu.model_table(checked.where("message is null"), ["sent_idx"]))
    read = rows.groupBy("sent_idx").agg(F.when(F.bool_and("ok"), F.count("*")).alias("n_rows"))
    whole = stored(checked.select("sent_idx", "message", "n_gold").join(read, "sent_idx", "left"))
    skipped = scoring.skip_reasons(whole.withColumn("split", F.lit(split)), ["split"])
    good = whole.where("message is null and n_rows = n_gold").select("sent_idx")
    place = F.row_number().over(Window.partitionBy("sent_idx").orderBy("id"))
    g = gold.where("head_ok").join(good, "sent_idx", "left_semi").withColumn("row", place - 1)
    p = rows.select("sent_idx", "row", F.col("upos").alias("pred_upos"), F.col("lemma").alias("pred_lemma"), F.col("feats").alias("pred_feats"), F.col("head").alias("pred_head"), F.col("deprel").alias("pred_deprel"))
    pairs = g.join(p, ["sent_idx", "row"]).withColumns({"split": F.lit(split), "answered": F.lit(True)})
    scores = scoring.micro_counts(pairs, ignore_punct=ignore_punct, by=["split"])
    kinds = {f.name: F.lit(0).cast(f.dataType) for f in scores.schema if f.name != "split"}
    m = skipped.join(scores, "split", "left").withColumns({c: F.coalesce(c, z) for c, z in kinds.items()})
    m = stored(m.withColumns({"sentences_skipped": F.col("sentences_total") - F.col("sentences_evaluated"), "ignore_punct": F.lit(ignore_punct)}))
    sinks.append_log(checked.select(F.lit(split).alias("split"), "sent_idx", "prompt", "response", F.col("message").alias("validation_msg")), f"{out}/log")
    sinks.append_blocks(checked.where("message is null"), f"{out}/corpus/{split}")
    if not m.isEmpty():
        sinks.write_metrics(m, f"{out}/metrics/{split}")
    return spark.createDataFrame([], m.schema) if m.isEmpty() else m


RESULT = "name string, model string, template string, strategy string, shots int, uas double, las double, la double, root_accuracy double, complete_match double, processing_time double, n_requests bigint, n_tokens bigint, cost double, failed_queries bigint"


def replayed(recorded: DataFrame) -> Source:
    """Answers from a table of (name, sent_idx, response)."""

    def source(prompts: DataFrame, e: Row) -> DataFrame:
        return answers.replay(prompts, recorded.where(F.col("name") == e["name"]), ["sent_idx"])

    return source


def dry(prompts: DataFrame, e: Row) -> DataFrame:
    return answers.dry_run(prompts)


def asked_of_provider(prompts: DataFrame, e: Row) -> DataFrame:
    """Answers of the model that the experiment names, over the network, with its pause between them."""
    client = answers.provider_client(e["model"], max_tokens=e["max_tokens"], temperature=e["temperature"])
    return answers.ask(prompts, client, pause=e["sleep_time"])
