"""Rows of a model table behind the millionth are read and checked."""

from pyspark.sql import functions as F

from arbora.plans.prompts import check_blocks
from arbora.sources.conllu import model_table

N = 1_000_002


def block(spark):
    head = "# sent_id = a\n# text = a\n# text_en = a\n"
    return spark.range(1).select(F.lit("a").alias("key"), F.concat(F.lit(head), F.repeat(F.lit("x\n"), N)).alias("block"))


def test_model_table(spark):
    r = model_table(block(spark)).agg(F.count("*"), F.max("row")).first()
    assert tuple(r) == (N, N - 1)


def test_check_sees_the_last_row(spark):
    good = "\t".join(["1", "a", "a", "X", "_", "0", "root", "_", "_", "_"])
    head = "# sent_id = a\n# text = a\n# text_en = a\n"
    b = spark.range(1).select(F.concat(F.lit(head), F.repeat(F.lit(good + "\n"), N - 1), F.lit("bad")).alias("block"))
    assert check_blocks(b, F.col("block")).select("message").first()[0] == "Row must have 10 columns: `bad`"


def test_short_blocks(spark):
    b = spark.createDataFrame([("a", "# sent_id = a\nx"), ("b", "")], "key string, block string")
    assert model_table(b).count() == 0
    assert {r["message"] for r in check_blocks(b, F.col("block")).collect()} == {"Too few lines.", "Missing `# sent_id` header."}
