"""Stored tables: their place, their rows, and that they go away again."""

from pathlib import Path

from arbora.session import release, stored


def test_stored_and_released(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (None, None, None)], "k bigint, s string, l array<int>")
    t = stored(df)
    assert t.schema == df.schema and sorted(map(tuple, t.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    path = Path(spark.sparkContext._arbora_stored[-1].removeprefix("file:"))
    assert path.is_dir() and str(path.parent) == spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert stored(df.limit(0)).count() == 0
    release(spark)
    assert not path.exists() and spark.sparkContext._arbora_stored == []
    release(spark)


def test_one_of_three_columns_is_read(spark):
    t = stored(spark.range(100).selectExpr("id", "id * 2 a", "cast(id as string) b"))
    assert "ReadSchema: struct<a:bigint>" in t.select("a")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
