"""Sessions, tables and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; on a cluster use the cluster's own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("arbora")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in a directory, which holds one Parquet file or folder for each."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the checkpoint folder that executors share.

    ``spark.checkpoint.dir`` names the folder. Only where neither it nor a folder of the
    context is set, as in tests, a temporary one is made.
    """
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table in that folder: compressed, and read by column. The order of rows is not kept.

    The tables are deleted by ``release``, or when Python ends.
    """
    spark = df.sparkSession
    path = f"{_shared(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    sc = spark.sparkContext
    if not hasattr(sc, "_arbora_stored"):
        sc._arbora_stored = []
        atexit.register(_release_at_exit, spark)
    sc._arbora_stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that ``stored`` has written; frames that read them are of no use any more."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    while getattr(sc, "_arbora_stored", []):
        path = sc._jvm.org.apache.hadoop.fs.Path(sc._arbora_stored.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _release_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone in any way by then
        release(spark)


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder of the context, which is set if it is not."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "arbora-checkpoints"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def ship(spark: SparkSession) -> None:
    """Makes this package known to the executors' Python workers, once for a session.

    Where they can import it already, nothing is sent. Else it goes as an archive by way of the shared folder
    that ``spark.checkpoint.dir`` names; only in local mode without one, by way of a temporary folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_arbora_shipped", False):
        return

    def known(_: int) -> bool:  # a function of its own, as workers may not know this module
        import importlib.util

        return importlib.util.find_spec("arbora") is not None

    if not sc.parallelize([0], 1).map(known).first():
        data = io.BytesIO()
        root = Path(__file__).resolve().parent
        with zipfile.ZipFile(data, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(_stored(sc, data.getvalue()))
    sc._arbora_shipped = True


def _stored(sc: SparkContext, data: bytes) -> str:
    """The place of an archive that all executors can fetch."""
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        to = Path(tempfile.mkdtemp()) / "arbora.zip"
        to.write_bytes(data)
        return str(to)
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{uuid.uuid4().hex}/arbora.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    return path.toString()
