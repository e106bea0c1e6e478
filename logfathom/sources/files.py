"""Files of a bundle: listing, discovery and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters
from ..rules import packs

#: Ends of names of files that are text.
TEXT_ENDS = ("txt", "log", "json", "yaml", "yml", "conf", "cfg", "csv", "tsv", "cnf", "md", "xml", "html", "ini", "env", "service", "out", "err", "pem", "crt", "cer", "sh", "py", "js", "properties", "toml")


def list_files(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """(path, relpath, size, mtime, content) of all files below a folder, or those of a name; contents are read only where they are used."""
    base = root.rstrip("/") + "/"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name is not None:
        reader = reader.option("pathGlobFilter", name)
    files = reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return files.withColumn("relpath", F.substring_index("path", base, -1))


def is_text(relpath: Column) -> Column:
    return F.lower(F.substring_index(relpath, ".", -1)).isin(*TEXT_ENDS) | ~F.contains(F.substring_index(relpath, "/", -1), F.lit("."))


class ScanError(Exception):
    """Nothing to read."""


def discover(files: DataFrame, include: tuple[str, ...] = packs.INCLUDE, exclude: tuple[str, ...] = packs.EXCLUDE, most_file_bytes: int = packs.MOST_FILE_BYTES, most_bytes: int = packs.MOST_BYTES, most_files: int = packs.MOST_FILES) -> tuple[list[str], dict[str, int]]:
    """The paths to read, in the order (glob, relpath), within the limits, and what became of the others.

    A file that would go over the total is skipped while later smaller ones may still fit, so the choice is sequential. It runs over the
    listing on the driver, row by row, until ``most_files`` are chosen.
    """
    found = filters.discover(files.where(F.col("size") <= most_file_bytes), F.col("relpath"), include, exclude)
    stats = {r["outcome"]: r["n"] for r in filters.discovery_statistics(files, F.col("relpath"), "size", include, exclude, most_file_bytes).collect()}
    chosen, total, over = [], 0, 0
    for row in found.orderBy("glob", "relpath").select("path", "size").toLocalIterator():
        if len(chosen) >= most_files:
            break
        if total + row["size"] > most_bytes:
            over += 1
            continue
        chosen.append(row["path"])
        total += row["size"]
    if not chosen:
        raise ScanError("NO_FILES_MATCHED")
    return chosen, stats | {"scanned": len(chosen), "over_total": over, "bytes": total}


def newest(files: DataFrame, keys: list[str]) -> DataFrame:
    """The newest file of each key; of equal times the last path."""
    return files.groupBy(*keys).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def scan_nodes(files: DataFrame) -> DataFrame:
    """(host, skipped) for each host directory: why it can't be analysed, or null if it can."""
    host = F.substring_index("relpath", "/", 1)
    has = lambda name: F.bool_or(F.substring_index("relpath", "/", -1) == name)
    rows = files.groupBy(host.alias("host")).agg(has("etcd-status.txt").alias("status"), has("ucp-kv.log").alias("log"), F.bool_or(F.contains("relpath", F.lit("journalctl"))).alias("journal"))
    return rows.select("host", F.when(F.col("status") | F.col("log"), F.lit(None).cast("string")).when(F.col("journal"), "journal only").otherwise("no status or log").alias("skipped"))


def bundle_kind(relpaths: DataFrame) -> str:
    """``cluster``, ``node`` or ``unknown``, by marker files."""
    name = F.substring_index("relpath", "/", -1)
    row = relpaths.agg(F.bool_or(name == "ucp-nodes.txt").alias("cluster"), F.bool_or(name == "dsinfo.json").alias("json"), F.bool_or(name == "dsinfo.txt").alias("text"), F.bool_or(F.contains("relpath", F.lit("inspect/"))).alias("inspect")).first()
    return "cluster" if row["cluster"] else "node" if row["json"] and row["text"] and row["inspect"] else "unknown"
