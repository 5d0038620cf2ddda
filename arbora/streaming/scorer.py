"""Scores over answers that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from arbora.operators.frames import EXPERIMENT

ANSWER = T.StructType(
    [
        T.StructField("pred_id", T.LongType()),
        T.StructField("sent_idx", T.LongType()),
        T.StructField("token_id", T.IntegerType()),
        T.StructField("predicted_head", T.IntegerType()),
        T.StructField("predicted_relation", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("prompt_template", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def read_answers(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Answers from the files that a folder gets."""
    return spark.readStream.schema(ANSWER).format(fmt).load(path)


def windowed_accuracy(stream: DataFrame, gold: DataFrame, *, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(window, experiment, n, heads, labels): right answers of each time window, by when they were made.

    Repeated answers with one ``pred_id`` count once; answers later than ``late`` are left out. State ends with the watermark.
    """
    g = gold.select("sent_idx", F.col("id").alias("token_id"), "head", "deprel")
    s = stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["pred_id"])
    j = s.join(g, ["sent_idx", "token_id"])
    return j.groupBy(F.window("created_at", window), *EXPERIMENT).agg(F.count("*").alias("n"), F.count_if(F.col("predicted_head") == F.col("head")).alias("heads"), F.count_if((F.col("predicted_head") == F.col("head")) & (F.col("predicted_relation") == F.col("deprel"))).alias("both"))


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a batch operator on what came since the last run, then stops."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
