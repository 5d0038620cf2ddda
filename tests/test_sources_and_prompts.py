"""Reading conventions, answer formats, prompts, blocks, grids and files on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from arbora.operators import frames, responses
from arbora.operators.ordered import ranked, running_sum
from arbora.plans import experiments as X
from arbora.plans import prompts as P
from arbora.sources import answers, conllu, sinks

TEXT = """# sent_id = a1
# text = One two
# text_en = Un deux
1\tOne\tone\tNUM\t_\tA=b\t2\tmod\t_\tGloss=un|X=y
2-3\ttwo\t_\t_\t_\t_\t_\t_\t_\t_
2\ttwo\ttwo\tNUM\t_\t_\t0\troot\t_\t*Gloss=deux*rest
3.1\tx\tx\tX\t_\t_\t_\t_\t_\t_

 \t
# text = No id here
1\tthree\tthree\tNUM\t_\t_\t_\troot\t_\t_
2\tshort\tline

# sent_id = a3
# text = Only headers
"""


@pytest.fixture(scope="module")
def lines(spark):
    return conllu.string_lines(spark, TEXT, "f").cache()


def test_three_conventions(lines):
    s = {d: {r["sent_id"]: r for r in conllu.sentences(lines, d).collect()} for d in "ABC"}
    assert set(s["A"]) == {"a1"} and set(s["B"]) == {"a1", None, "a3"} and set(s["C"]) == {"a1"}
    assert s["A"]["a1"]["text_en"] == "" and s["B"]["a1"]["text_en"] == "Un deux" == s["C"]["a1"]["text_en"]
    t = {d: [(r["id"], r["form"], r["head"], r["gloss"]) for r in conllu.tokens(lines, d).orderBy("line_no").collect()] for d in "ABC"}
    assert t["A"] == [(1, "One", 2, ""), (0, "two", 0, ""), (2, "two", 0, "deux"), (0, "x", 0, "")]
    assert t["C"] == [(1, "One", 2, "un"), (2, "two", 0, "deux*rest")]
    assert t["B"] == [(1, "One", 2, ""), (2, "two", 0, ""), (1, "three", None, ""), (2, "short", None, "")]
    assert [(r["id"], r["form"]) for r in conllu.gold_rows(lines).orderBy("line_no").collect()] == [(1, "One"), (2, "two")]
    with pytest.raises(ValueError):
        conllu.tokens(lines, "D")


def test_files(spark, tmp_path, lines):
    path = tmp_path / "x.conllu"
    path.write_text(TEXT.replace("\n", "\r\n"))
    read = conllu.read_lines(spark, str(path))
    assert conllu.tokens(read, "A").count() == 4
    both = conllu.load_splits(spark, {"dev": str(path), "train": str(tmp_path / "none")})
    assert {(r["split"], r["n"]) for r in both.groupBy("split").agg(F.count("*").alias("n")).collect()} == {("dev", 4)}
    assert conllu.load_splits(spark, {"train": str(tmp_path / "none")}).count() == 0
    assert conllu.tokens(conllu.sample_lines(spark), "C").count() == 26
    tokens = conllu.tokens(conllu.sample_lines(spark), "C").selectExpr("cast(block as bigint) sent_idx", "id", "line_no row_id", "form", "'_' lemma", "upos", "'_' feats", "head", "deprel", "'_' misc")
    assert frames.arcs(tokens).count() == 23  # of 24 heads one is no token
    pos = conllu.read_pos_list(conllu.string_lines(spark, "a NOUN\nb VERB\n\nc X\n"))
    assert [(r["form"], r["upos"]) for r in pos.orderBy("line_no").collect()] == [("a", "NOUN"), ("b", "VERB"), ("c", "X")]
    assert pos.select("block").distinct().count() == 2


def test_row_pairs(spark):
    rows = [("f", i, x) for i, x in enumerate(["skip", "skip", "a1", " b1 ", "a2", "b2", "odd"], 1)]
    df = spark.createDataFrame(rows, "file_name string, line_no bigint, raw_text string")
    assert [r["joined"] for r in conllu.row_pairs(df).orderBy("pair").collect()] == ["b1\ta1", "b2\ta2"]


def test_ranks_and_sums(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), i, rng.randint(0, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, v int")
    r, n = ranked(df, ["a", "b"])
    assert n == 500 and [(x["a"], x["b"]) for x in r.orderBy("rank").collect()] == sorted((a, b) for a, b, _ in rows)
    assert sorted(x["rank"] for x in r.collect()) == list(range(500))
    so_far, want = 0, {}
    for a, b, v in sorted(rows):
        so_far += v
        want[b] = so_far
    assert {x["b"]: x["s"] for x in running_sum(df, ["a", "b"], F.col("v"), "s").collect()} == want
    assert ranked(df.limit(0), ["a"])[1] == 0


FORMATS = {
    "1 Ndox -> 2 subj\n2 na -> 0 root\n3 . -> 2 punct": ("basic", 3),
    "1 Ndox [NOUN] (gloss: water) -> 2 subj\n2 na [AUX] -> 0 root": ("detailed", 2),
    "1. Ndox -> 2 (subj)\n2. na -> 0": (None, 0),
    "Ndox is the subject of na": (None, 0),
    "1 | Ndox | 2 | subj\n2 | na | 0 | root": ("tabular", 2),
    "": (None, 0),
    "3 x, it hangs on -> 1 mod (since it follows)": ("reasoning", 1),
}


def test_answer_formats(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(FORMATS)] + [(99, None)], "k int, response string")
    w = {r["k"]: r["w"] for r in df.select("k", responses.winner(F.col("response")).alias("w")).collect()}
    n = {r["k"]: r["n"] for r in responses.parse_responses(df, ["k"]).groupBy("k").agg(F.count("*").alias("n")).collect()}
    for i, (name, rows) in enumerate(FORMATS.values()):
        assert w[i] == name and n.get(i, 0) == rows
    last = responses.parse_responses(df.where("k = 6"), ["k"]).first()
    assert (last["token_id"], last["form"], last["head"], last["relation"], last["reasoning"]) == (3, "x,", 1, "mod", "since it follows")
    assert {r["k"] for r in responses.parse_failures(df, ["k"]).collect()} == {2, 3, 5, 99}


def test_confidence(spark):
    df = spark.createDataFrame([(1, "1 a Confidence: 0.5\n1 a confidence=0.7\n2 b confidence: 1.2.3"), (2, None)], "k int, response string")
    assert [tuple(r) for r in responses.confidences(df, ["k"]).collect()] == [(1, 1, 0.7)]


def test_arrows(spark):
    gold = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a")], "sent_idx bigint, id int, form string")
    df = spark.createDataFrame([(1, "x\n- a → b (subj)\n- b → nothing (mod)\n- b → ? (root)\n- zz → a (mod)")], "sent_idx bigint, response string")
    got = {r["id"]: (r["pred_head"], r["pred_deprel"]) for r in responses.parse_arrows(df, gold, ["sent_idx"]).collect()}
    assert got == {1: (0, "root"), 2: (0, "root"), 3: (2, "subj")}


# ------------------------------------------------------------------------------ prompts


@pytest.fixture(scope="module")
def nested(spark):
    rows = [(1, 1, "1", "We", "we", "PRON", "_", "2", "subj", "Gloss=nous"), (2, 1, "2", "read", "read", "VERB", "_", "0", "root", "_"), (3, 1, "3", "it", "it", "PRON", "_", "2", "comp:obj", "_"), (4, 2, "1", "Go", "go", "VERB", "_", "9", "mod", "_")]
    t = spark.createDataFrame(rows, "row_id bigint, sent_idx bigint, id string, form string, lemma string, upos string, feats string, head string, deprel string, misc string")
    s = spark.createDataFrame([(1, "s1", "We read it", "Nous le lisons"), (2, "s2", None, None)], "sent_idx bigint, sent_id string, text string, text_en string")
    return P.nested(frames.gold_tokens(t), s).cache()


def test_formatters(nested):
    r = nested.orderBy("sent_idx").select(
        P.example_basic("Lang").alias("basic"), P.example_detailed("Lang").alias("detailed"), P.example_with_reasoning().alias("reason"), P.target_basic().alias("t"), P.target_detailed().alias("td"), P.alignment().alias("al"), P.gloss_analysis().alias("ga"), P._worked_steps().alias("steps"), P._reasons().alias("why"), P._questions().alias("q"), P._dependencies().alias("deps")
    ).collect()
    a, b = r
    assert a["basic"] == "Lang: We read it\nEnglish: Nous le lisons\n1 We -> 2 subj\n2 read -> 0 root\n3 it -> 2 comp:obj\n\n"
    assert "1 We [PRON] (gloss: nous) -> 2 subj\n2 read [VERB] -> 0 root\n" in a["detailed"]
    assert a["reason"].startswith("Sentence: We read it (Nous le lisons)\nAnalysis:\n- Main verb: 'read' (gloss: )\n- Subject(s): We\n- Object(s): it\nDependencies:\n")
    assert a["t"] == "1 We [PRON]\n2 read [VERB]\n3 it [PRON]\n" and a["td"].startswith("1 We [PRON] (gloss: 'nous')\n2 read [VERB]\n")
    assert a["al"] == "1. We ↔ nous\n2. read ↔ ?\n3. it ↔ ?\n"
    assert a["ga"].startswith("1. We [PRON] → gloss: 'nous'\n2. read [VERB] → gloss: 'no gloss'\n")
    assert a["steps"] == 'Step 1: Main verb (root) = "read" (position 2)\nStep 2: "We" → "read" (subj)\nStep 3: "it" → "read" (comp:obj)\n'
    assert a["why"].splitlines()[0] == "- \"We\" (PRON) (gloss: 'nous') → \"read\" (VERB): pronoun before verb typically indicates subject"
    assert 'Question 2: What are the subjects?\nAnswer: "We"\n\n' in a["q"] and 'Question 3: What are the objects?\nAnswer: "it"\n\n' in a["q"]
    assert b["deps"] == "" and b["steps"] == "" and b["basic"].startswith("Lang: \nEnglish: \n1 Go -> 9 mod\n")


def test_templates(nested):
    p = P.Prompts()
    assert len(p.available()) == 6
    for name in p.available():
        text = p.render(name, nested.where("sent_idx = 1"), nested).first()["prompt"]
        assert "We read it" in text and "{" not in text
    p.add("own", "{extra}: {target_tokens} for {target_text}")
    assert p.render("own", nested.where("sent_idx = 1"), nested, extra="E").first()["prompt"] == "E: 1 We [PRON]\n2 read [VERB]\n3 it [PRON]\n for We read it"
    with pytest.raises(ValueError):
        p.render("none", nested, nested)
    for kind in ("basic", "step_by_step", "context_rich", "interactive"):
        assert 'Sentence: "We read it"' in P.arrow_prompts(kind, nested.where("sent_idx = 1"), nested).first()["prompt"]
    assert P.arrow_prompts("?", nested, nested).exceptAll(P.arrow_prompts("basic", nested, nested)).count() == 0
    table = P.table_prompts(nested.where("sent_idx = 1"), "", ["ex"]).first()["prompt"]
    assert table.startswith("### Examples\nex\n### Target\n# sent_id = s1\n") and "- Language: Unknown\n" in table and "1\tWe\n2\tread\n3\tit" in table


HEAD = "# sent_id = x\n# text = t\n# text_en = e\n"


def row(i, form="a", head=0, rel="root"):
    return f"{i}\t{form}\t_\t_\t_\t{head}\t{rel}\t_\t_\t_"


BLOCKS = [
    (HEAD + row(1) + "\n" + row(2, "b", 1, "mod"), 2, ["a", "b"], None),
    ("Sure! " + HEAD + row(1), 1, None, None),
    ("no header", 1, None, "Missing `# sent_id` header."),
    (None, 1, None, "Missing `# sent_id` header."),
    (HEAD, 1, None, "Too few lines."),
    (HEAD + "1\ta", 1, None, "Row must have 10 columns: `1\ta`"),
    (HEAD + row("x"), 1, None, f"ID/HEAD not int in row: `{row('x')}`"),
    (HEAD + row(2), 1, None, "IDs not contiguous 1..N: [2]"),
    (HEAD + row(1, head=5), 1, None, "HEAD out of range 0..1"),
    (HEAD + row(1), 3, None, "Token count mismatch. Expected 3, got 1"),
    (HEAD + row(1), None, ["z"], "Surface forms mismatch with required tokenization."),
    (HEAD + row(1, rel="mod"), None, None, "Require exactly 1 root, found 0"),
]


def test_blocks(spark):
    df = spark.createDataFrame([(i, b, n, f) for i, (b, n, f, _) in enumerate(BLOCKS)], "k int, b string, n int, forms array<string>")
    got = P.check_blocks(df, P.extract_block(F.col("b")), F.col("n"), F.col("forms"), single_root=True)
    assert [r["message"] for r in got.orderBy("k").collect()] == [m for *_, m in BLOCKS]
    t = conllu.model_table(df.where("k in (0, 5, 6)").select("k", F.col("b").alias("block")), ["k"]).orderBy("k", "row").collect()
    assert [(r["k"], r["id"], r["head"], r["ok"]) for r in t] == [(0, 1, 0, True), (0, 2, 1, True), (5, None, None, False), (6, None, None, False)]


# ------------------------------------------------------------------------------ experiments and files


def test_grids(spark):
    assert X.grid(spark, X.QUICK).count() == 1 and X.grid(spark, X.STANDARD).count() == 8 and X.grid(spark, X.COMPREHENSIVE).count() == 54
    g = X.grid(spark, X.QUICK).first()
    assert g["name"] == "gpt_4o_mini_basic_random_2shot" and g["provider"] == "openai" and g["description"] == "gpt-4o-mini with basic prompts, random selection, 2 examples"
    p = spark.createDataFrame([("gpt-4o-mini-x", "a" * 4000, "b" * 400), ("odd", "a" * 4000, None)], "model_name string, prompt string, response string")
    u = {r["model_name"]: r for r in X.usage(p).collect()}
    assert u["gpt-4o-mini-x"]["cost"] == pytest.approx(1000 / 1000 * 0.00015 + 0.5 * 0.0006) and u["gpt-4o-mini-x"]["n_tokens"] == 1100
    assert u["odd"]["cost"] == pytest.approx(0.002 + 0.5 * 0.006)


def test_answers(spark):
    p = spark.createDataFrame([(1, "hi"), (2, "bad"), (3, None)], "k int, prompt string")

    def client():
        def one(text):
            if text == "bad":
                raise RuntimeError("no")
            return text.upper()

        return one

    got = {r["k"]: (r["response"], r["is_error"]) for r in answers.failed(answers.ask(p, client)).collect()}
    assert got == {1: ("HI", False), 2: ("PROCESSING_ERROR: no", True), 3: (None, True)}
    assert answers.replay(p, spark.createDataFrame([(1, "old")], "k int, response string"), ["k"]).where("response = 'old'").count() == 1
    assert answers.dry_run(p).where("k = 1").first()["response"] == "## DRY-RUN ##\nhi\n## END DRY-RUN ##"


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([("dev", 1, "p", None)], "split string, idx int, prompt string, validation_msg string")
    sinks.append_log(log, str(tmp_path / "log"))
    sinks.append_log(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.append_blocks(spark.createDataFrame([("# sent_id = 1\n1\ta  ",)], "block string"), str(tmp_path / "blocks"))
    text = "".join(f.read_text() for f in (tmp_path / "blocks").glob("*.txt"))
    assert text == "# sent_id = 1\n1\ta\n\n"
    m = spark.createDataFrame([("dev", 5, 6, 100, 1, *[0.5] * 7)], "split string, sentences_evaluated bigint, sentences_total bigint, tokens_considered bigint, sentences_skipped bigint, upos_accuracy double, lemma_accuracy double, uas double, las double, feats_precision double, feats_recall double, feats_f1 double")
    assert m.select(sinks.metrics_text(F.col("split")).alias("t")).first()["t"].splitlines()[:6] == ["=== DEV METRICS ===", "Sentences evaluated: 5 / 6", "Tokens considered:   100", "", "UPOS accuracy:       0.5000", "Lemma accuracy:      0.5000"]
    sinks.write_metrics(m, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics/json")).first()["uas"] == 0.5
    scores = spark.createDataFrame([("m", "t", 1, 0.5, 0.25, 0.75, True, False, 4, 3)], "model_name string, prompt_template string, sent_idx bigint, uas double, las double, la double, root_correct boolean, complete_match boolean, num_tokens bigint, num_errors bigint")
    sinks.write_sentence_csv(scores, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["sent_idx", "uas", "las", "la", "root_correct", "complete_match", "num_tokens", "num_errors"]
    keys = ["model_name", "prompt_template"]
    results = scores.select(*keys, "uas", "las")
    rel = spark.createDataFrame([("m", "t", "subj", 1.0, 0.5, 0.6, 2)], "model_name string, prompt_template string, relation string, precision double, recall double, f1 double, support bigint")
    err = spark.createDataFrame([("m", "t", 1, 2, None, "missing_prediction", 1, "mod", None, None)], "model_name string, prompt_template string, sent_idx bigint, id int, form string, error_type string, gold_head int, gold_deprel string, pred_head int, pred_deprel string")
    conf = spark.createDataFrame([("m", "t", "mod", "MISSING", 1)], "model_name string, prompt_template string, gold string, predicted string, n bigint")
    nested_rows = sinks.experiment_rows(results, rel, scores, err, conf, keys)
    sinks.write_experiments(nested_rows, str(tmp_path / "exp"), keys)
    doc = json.loads(next((tmp_path / "exp").rglob("*.json")).read_text())
    assert doc["per_relation_scores"]["subj"]["support"] == 2 and doc["per_sentence_results"][0]["errors"][0]["error_type"] == "missing_prediction"
    assert conllu.read_results(spark, str(tmp_path / "exp/*/*/*.json")).first()["uas"] == 0.5
    # another experiment beside the first, then the first one again: each is there once, with its last values
    sinks.write_experiments(nested_rows.withColumn("model_name", F.lit("n")), str(tmp_path / "exp"), keys)
    sinks.write_experiments(nested_rows.withColumn("uas", F.lit(0.75)), str(tmp_path / "exp"), keys)
    assert sorted((r["model_name"], r["uas"]) for r in spark.read.json(str(tmp_path / "exp")).collect()) == [("m", 0.75), ("n", 0.5)]
    named = results.withColumns({c: F.lit(c) for c in ("name", "model", "template", "strategy")} | {"shots": F.lit(3)} | {c: F.lit(0.5) for c in ("la", "root_accuracy", "complete_match", "processing_time")})
    sinks.write_comparison(named, str(tmp_path / "cmp"))
    assert spark.read.json(str(tmp_path / "cmp/json")).first()["LAS"] == 0.25
    assert spark.read.option("header", True).csv(str(tmp_path / "cmp/csv")).first()["Selection"] == "strategy"


def test_stream(spark, tmp_path):
    from arbora.streaming import scorer

    rows = [{"pred_id": i, "sent_idx": 1, "token_id": i % 3 + 1, "predicted_head": 0, "predicted_relation": "root", "model_name": "m", "prompt_template": "t", "created_at": f"2024-01-01T0{i % 4}:10:00Z"} for i in range(12)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(map(json.dumps, rows + rows[:2])))
    gold = spark.createDataFrame([(1, 1, 0, "root"), (1, 2, 0, "mod"), (1, 3, 2, "root")], "sent_idx bigint, id int, head int, deprel string")
    out = scorer.windowed_accuracy(scorer.read_answers(spark, str(src)), gold)
    q = out.writeStream.format("memory").queryName("scores").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("scores").agg(F.sum("n").alias("n"), F.sum("heads").alias("h"), F.sum("both").alias("b")).first()
    assert (got["n"], got["h"], got["b"]) == (12, 8, 4)
    seen = []
    q = scorer.each_batch(scorer.read_answers(spark, str(src)), lambda df, n: seen.append(df.count()), str(tmp_path / "chk"))
    q.awaitTermination(120)
    assert sum(seen) == 14


def test_command_line(spark, tmp_path):
    from arbora.__main__ import main

    tok = [(n, s, str(i), f"w{i}", f"w{i}", "NOUN", "_", str(i - 1), "root" if i == 1 else "mod", "_") for n, (s, i) in enumerate((s, i) for s in range(6) for i in range(1, 5))]
    spark.createDataFrame(tok, "row_id bigint, sent_idx bigint, id string, form string, lemma string, upos string, feats string, head string, deprel string, misc string").write.parquet(str(tmp_path / "t/tokens.parquet"))
    spark.createDataFrame([(s, f"s{s}", f"text {s}", None, "train" if s < 4 else "test") for s in range(6)], "sent_idx bigint, sent_id string, text string, text_en string, split string").write.parquet(str(tmp_path / "t/sentences.parquet"))
    spark.createDataFrame([(n, 5, i, f"w{i}", i - 1, "mod", "m", "basic") for n, i in enumerate(range(1, 5))], "pred_id bigint, sent_idx bigint, token_id int, form string, predicted_head int, predicted_relation string, model_name string, prompt_template string").write.parquet(str(tmp_path / "t/predictions.parquet"))
    t, out = str(tmp_path / "t"), str(tmp_path / "out")
    main(["score", "--tables", t, "--out", out + "/s"], spark)
    assert spark.read.json(out + "/s/experiments").first()["uas"] == 1.0
    report = "\n".join(r[0] for r in spark.read.text(out + "/s/reports").collect())
    assert "Labeled Attachment Score (LAS):   0.750" in report and "mod             0.750      1.000      0.857      3" in report and "incorrect_dependency: 1" in report
    main(["select", "--tables", t, "--out", out + "/c", "--few-shot-k", "2", "--strategy", "coverage"], spark)
    assert spark.read.json(out + "/c").count() == 2
    main(["prompts", "--tables", t, "--out", out + "/p", "--template", "detailed"], spark)
    assert spark.read.json(out + "/p").count() == 2
    main(["grid", "--preset", "comprehensive", "--out", out + "/g"], spark)
    assert spark.read.json(out + "/g").count() == 54
    (tmp_path / "x.conllu").write_text(TEXT)
    main(["read", "--dialect", "C", "--out", out + "/r", str(tmp_path / "x.conllu")], spark)
    assert spark.read.parquet(out + "/r").count() == 2
