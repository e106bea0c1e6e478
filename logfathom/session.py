"""Session helpers: tables, tables that cut the lineage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a dimension may have to be sent to every executor.
BROADCAST_ROWS = 200_000
#: Most bytes of it.
BROADCAST_BYTES = 64_000_000
_folders: set[str] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application in the one that the cluster names in ``spark.checkpoint.dir``.

    Only a local session may leave that unset; it gets an own folder. On a cluster there is no folder that all
    executors are known to see, so it is an error. What is in the folder is deleted when the driver ends.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "logfathom-checkpoints")
    folder = f"{root.rstrip('/')}/logfathom-{sc.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before
        plain = folder.removeprefix("file://").removeprefix("file:")
        if "://" not in plain:
            shutil.rmtree(plain, ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a compressed table to the shared folder and read it from there afterwards.

    The files outlive executors, so a lost executor costs no more than its running tasks; they are columns, so later
    steps read what they need, and their size is known to the planner.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``rows`` rows of ``size`` bytes in all, else unchanged (shuffled join).

    Bytes are those of the rows written as JSON. No more than ``rows`` + 1 rows are counted.
    """
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    held = df.limit(rows + 1).select(F.octet_length(text).cast("bigint").alias("n")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if held["rows"] <= rows and held["size"] <= size else df


#: Copies of each row of the few where two tables are joined on hot keys.
SALTS = 16


def join_few(many: DataFrame, few: DataFrame, on: list[str], spread: str) -> DataFrame:
    """An inner join of many rows with few of each key, which no hot key gathers in one task.

    The few are sent to all executors if they are proven small; else they are copied for each salt, and the many take
    their salt from the column ``spread``. ``few`` should be cheap to read, such as a table that was cut.
    """
    known = small(few)
    if known is not few:
        return many.join(known, on)
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(copies, [*on, "__salt"]).drop("__salt")
