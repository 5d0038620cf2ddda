"""Whole experiments from the grid to saved results."""

import sys
import types

import pytest
from pyspark.sql import functions as F

from arbora.operators import frames, selection
from arbora.plans import experiments as X
from arbora.plans import reports, runner
from arbora.sources import answers


@pytest.fixture(scope="module")
def corpus(spark):
    rows, sents = [], []
    for s in range(12):
        split = "train" if s < 8 else "test"
        sents.append((s, f"s{s}", f"text {s}", f"english {s}", split))
        for i in range(1, 4 + s % 3):
            rows.append((len(rows), s, str(i), f"w{s}_{i}", "l", "VERB" if i == 1 else "NOUN", "_", "0" if i == 1 else "1", "root" if i == 1 else ("subj" if s % 2 else "mod"), "Gloss=g"))
    tokens = spark.createDataFrame(rows, "row_id bigint, sent_idx bigint, id string, form string, lemma string, upos string, feats string, head string, deprel string, misc string")
    return runner.Corpus(frames.gold_tokens(tokens), spark.createDataFrame(sents, "sent_idx bigint, sent_id string, text string, text_en string, split string"))


def grid(spark, strategies, **more):
    return X.grid(spark, X.Grid(templates=["basic"], strategies=strategies, shots=[2], test_size=3, **more))


@pytest.mark.parametrize("strategy", ["random", "diversity", "coverage", "stratified", "complexity", "similarity"])
def test_prompts_of_every_strategy(spark, corpus, strategy):
    e = grid(spark, [strategy]).first()
    targets = corpus.asked(3)
    got = {r["sent_idx"]: r["prompt"] for r in runner.prompts_for(corpus, e, targets).collect()}
    assert set(got) == {8, 9, 10}
    for i, p in got.items():
        assert f"text {i}" in p and sum(f"Wolof: text {j}\n" in p for j in range(8)) == 2
    if strategy == "similarity":
        _, features = corpus.train()
        near = selection.similar_sentences_each(features, frames.sentence_features(corpus.gold_of(targets)), 2).orderBy(F.desc("similarity"), "sent_idx").collect()
        for i, p in got.items():
            first, second = [r["sent_idx"] for r in near if r["target"] == i]
            assert p.index(f"Wolof: text {first}\n") < p.index(f"Wolof: text {second}\n")


def test_grid_is_scored_saved_and_resumed(spark, corpus, tmp_path):
    g = grid(spark, ["random", "similarity", "nonsense"])
    gold = {}
    for r in corpus.gold.where("sent_idx in (8, 9, 10)").orderBy("sent_idx", "id").collect():
        gold.setdefault(r["sent_idx"], []).append(r)
    right = {i: "\n".join(f"{r['id']} {r['form']} -> {r['head']} {r['deprel']}" for r in t) for i, t in gold.items()}
    names = {r["strategy"]: r["name"] for r in g.collect()}
    said = [(names["random"], i, t) for i, t in right.items()]
    said += [(names["similarity"], 8, right[8]), (names["similarity"], 9, "I do not know"), (names["similarity"], 10, "1 x -> 5 root")]
    source = runner.replayed(spark.createDataFrame(said, "name string, sent_idx bigint, response string"))
    out = str(tmp_path / "out")
    done = {r["strategy"]: r for r in runner.run_grid(corpus, g, source, out).collect()}
    assert set(done) == {"random", "similarity"}
    assert done["random"]["las"] == 1.0 and done["random"]["complete_match"] == 1.0 and done["random"]["n_requests"] == 3
    n = len(gold[10])
    assert done["similarity"]["uas"] == pytest.approx(1 / 3) and done["similarity"]["la"] == pytest.approx((1 + 0 + 1 / n) / 3, abs=1e-8)
    failed = spark.read.json(out + "/failures").collect()
    assert [r["name"] for r in failed] == [names["nonsense"]] and "nonsense" in failed[0]["error"]
    assert spark.read.json(out + "/experiments").count() == 2
    assert spark.read.option("header", True).csv(out + "/comparison/csv").count() == 2
    calls = []
    again = runner.run_grid(corpus, g, lambda p, e: calls.append(e["name"]) or runner.dry(p, e), out)
    assert again.count() == 2 and not calls  # nonsense fails before it asks
    lines = [r["line"] for r in reports.comparison_report(again).orderBy("place").collect()]
    assert lines[1].startswith(names["random"]) and "1.000*" in lines[1]
    assert any(x.startswith(f"Best: {names['random']}") for x in lines) and any("strategy similarity" in x for x in lines) and lines[-1].startswith("Mean of all")


def test_nothing_can_be_read(spark, corpus, tmp_path):
    g = grid(spark, ["random"])
    r = runner.run_grid(corpus, g, lambda p, e: p.withColumn("response", F.lit("no")), str(tmp_path / "o")).first()
    assert r["uas"] == 0.0 and r["failed_queries"] == 0
    none = runner.run_grid(corpus, grid(spark, ["nonsense"]), runner.dry, str(tmp_path / "p"))
    assert none.count() == 0


def test_development_split_where_there_is_no_test(spark, corpus):
    c = runner.Corpus(corpus.gold, corpus.sentences.withColumn("split", F.when(F.col("split") == "test", "dev").otherwise(F.col("split"))))
    assert sorted(r["sent_idx"] for r in c.asked(2).collect()) == [8, 9]


def test_provider_clients(monkeypatch):
    said = {}

    def create(**k):
        said.update(k)
        return types.SimpleNamespace(content=[types.SimpleNamespace(text="a")], choices=[types.SimpleNamespace(message=types.SimpleNamespace(content="b"))])

    monkeypatch.setitem(sys.modules, "anthropic", types.SimpleNamespace(Anthropic=lambda api_key: types.SimpleNamespace(messages=types.SimpleNamespace(create=create))))
    monkeypatch.setitem(sys.modules, "openai", types.SimpleNamespace(OpenAI=lambda api_key: types.SimpleNamespace(chat=types.SimpleNamespace(completions=types.SimpleNamespace(create=create)))))
    assert answers.provider_client("Claude-3-haiku", key="k")()("hello") == "a" and said["model"] == "Claude-3-haiku"
    assert answers.provider_client("gpt-4o", key="k", max_tokens=7)()("hello") == "b" and said["max_tokens"] == 7
    for name in ("ANTHROPIC_API_KEY", "OPENAI_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    for model in ("claude-3", "gpt-4o"):
        with pytest.raises(ValueError):
            answers.provider_client(model)()


def test_pauses_and_empty_answers(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), ("b",)], "prompt string").coalesce(1)
    import time

    began = time.monotonic()
    got = [r["response"] for r in answers.ask(df, lambda: lambda p: p, pause=0.3).collect()]
    assert got == ["a", "ERROR: empty answer", None, "b"] and time.monotonic() - began >= 0.6


def table_of(rows, wrong=None):
    """The answer to a sentence as a ten-column table, spoilt in one of several ways."""
    lines = [f"{r['id']}\t{r['form']}\t{r['lemma']}\t{r['upos']}\t_\t{r['head']}\t{r['deprel']}\t_\t_\tg" for r in rows]
    if wrong == "short":
        lines = lines[:-1]
    if wrong == "label":
        lines[-1] = lines[-1].replace("subj", "obj").replace("mod", "obj")
    if wrong == "columns":
        lines[0] += "\tmore"
    return "Here it is:\n# sent_id = x\n# text = x\n# text_en = x\n" + "\n".join(lines)


@pytest.mark.parametrize("keep_tokens", [True, False])
def test_tables(spark, corpus, tmp_path, keep_tokens):
    gold = {}
    for r in corpus.gold.where("sent_idx >= 8").orderBy("sent_idx", "id").collect():
        gold.setdefault(r["sent_idx"], []).append(r)
    kinds = {8: None, 9: "label", 10: "short", 11: "columns"}
    said = spark.createDataFrame([(i, table_of(gold[i], kinds[i])) for i in gold], "sent_idx bigint, response string")
    seen = []

    def source(prompts, e):
        seen.append(prompts.first()["prompt"])
        return answers.replay(prompts, said, ["sent_idx"])

    out = str(tmp_path / "o")
    m = runner.run_tables(corpus, "test", source, out, shots=2, language="Wolof", keep_tokens=keep_tokens).first()
    n = len(gold[8]) + len(gold[9])
    assert (m["sentences_total"], m["sentences_evaluated"], m["tokens_considered"], m["uas_correct"], m["las_correct"]) == (4, 2, n, n, n - 1)
    assert (m["invalid"], m["mismatch"], m["exception"]) == ((2, 0, 0) if keep_tokens else (1, 1, 0))
    assert seen[0].startswith("### Examples\n# sent_id = s") and seen[0].count("# sent_id = ") == 3
    assert spark.read.json(out + "/log").where("validation_msg is not null").count() == m["invalid"]
    text = "\n".join(r[0] for r in spark.read.text(out + "/metrics/test/text").select("value").collect())
    assert "Sentences evaluated: 2 / 4" in text
    assert sum(r[0].startswith("# sent_id") for r in spark.read.text(out + "/corpus/test").collect()) == 4 - m["invalid"]


def test_tables_that_say_nothing(spark, corpus, tmp_path):
    m = runner.run_tables(corpus, "test", lambda p, e: p.withColumn("response", F.lit(None).cast("string")), str(tmp_path / "o")).first()
    assert (m["sentences_total"], m["sentences_evaluated"], m["invalid"], m["tokens_considered"], m["uas"]) == (4, 0, 4, 0, 0.0)
    assert runner.run_tables(corpus, "nosuch", runner.dry, str(tmp_path / "p")).count() == 0
