"""Lines, records and tables in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Files up to this size are read whole; greater ones are read in blocks that many tasks share.
WHOLE_BYTES = 64_000_000


def lines_of(files: DataFrame, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(source_relpath, file_ord, line_number, line): the lines of listed files, numbered from 1.

    ``files`` has path, relpath, size and content, and file_ord if the order matters. A small file is split where it
    is read. The lines of a great file are read in blocks and numbered by the sums over its blocks, so no task and no
    cell ever holds one whole. An empty file has no lines; a line keeps its carriage return.
    """
    if "file_ord" not in files.columns:
        files = files.withColumn("file_ord", F.lit(0))
    body = F.regexp_replace(F.col("content").cast("string"), r"\r?\n$", "")
    small = files.where((F.col("size") > 0) & (F.col("size") <= whole_bytes)).select(F.col("relpath").alias("source_relpath"), F.col("file_ord").cast("int").alias("file_ord"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    small = small.select("source_relpath", "file_ord", (F.col("pos") + 1).cast("bigint").alias("line_number"), "line")
    great = files.where(F.col("size") > whole_bytes).select("path", "relpath", F.col("file_ord").cast("int").alias("file_ord"))
    paths = [r["path"] for r in great.select("path").toLocalIterator()]
    return small.unionByName(_in_blocks(files.sparkSession, paths, great)) if paths else small


def _in_blocks(spark: SparkSession, paths: list[str], great: DataFrame) -> DataFrame:
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    rows = spark.read.option("lineSep", "\n").text(paths).select(plain(F.col("_metadata.file_path")).alias("__path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"), F.col("value").alias("line"))
    sums = rows.groupBy("__path", "__block").agg(F.count("*").alias("n"))
    base = sums.withColumn("__base", F.coalesce(F.sum("n").over(W.partitionBy("__path").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = rows.withColumn("__rn", F.row_number().over(W.partitionBy("__path", "__block").orderBy("__at"))).join(base, ["__path", "__block"])
    named = great.withColumn("__path", F.regexp_replace("path", "^file:/+", "/")).drop("path")
    return numbered.join(named, "__path").select(F.col("relpath").alias("source_relpath"), "file_ord", (F.col("__base") + F.col("__rn")).cast("bigint").alias("line_number"), "line")


def read_lines(spark: SparkSession, paths: list[str] | str, root: str = "") -> DataFrame:
    """The lines of chosen files, as ``lines_of``; ``file_ord`` is the place of a path among those given."""
    paths = [paths] if isinstance(paths, str) else paths
    base = root.rstrip("/") + "/" if root else ""
    files = spark.read.format("binaryFile").load(paths).select("path", F.substring_index("path", base, -1).alias("relpath") if base else F.col("path").alias("relpath"), F.col("length").alias("size"), "content")
    order = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, file_ord int")
    return lines_of(files.join(F.broadcast(order), "path", "left").fillna(0, ["file_ord"]))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; bad and blank lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_semicolon_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with ``;`` between cells; names lose outer blanks and the mark of a byte order."""
    df = spark.read.option("sep", ";").option("header", "true").csv(path)
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, body): whole JSON files by a schema; what doesn't fit is null, never an error."""
    texts = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return texts.select("path", F.from_json("value", schema).alias("body"))
