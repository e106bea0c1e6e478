"""Results as files."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Versions that are stamped on what is written.
SCHEMAS = {"events": "events-v1", "clusters": "clusters-v1", "findings": "findings-v1", "meta": "meta-v1", "incidents": "incidents-v1"}


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_jsonl(df: DataFrame, path: str, schema: str | None = None, overwrite: bool = False, one_file: bool = False) -> None:
    """JSON lines, stamped with a schema version."""
    out = df.withColumn("schema_version", F.lit(SCHEMAS[schema])) if schema else df
    (out.coalesce(1) if one_file else out).write.mode(_mode(overwrite)).json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", overwrite: bool = False, by: list[str] | None = None) -> None:
    """CSV with a header; ``by`` names columns that become folders, as the host of an events table."""
    writer = df.write.mode(_mode(overwrite)).option("header", "true").option("sep", sep)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_ledger(path: str, run: dict) -> None:
    """A JSON ledger of a run, replaced as a whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump({"schema_version": SCHEMAS["meta"], **run}, f, ensure_ascii=False, indent=2, default=str)
    os.replace(name, target)


def safe_tag(text: str) -> str:
    """A tag that is good as a part of a folder's name."""
    return re.sub(r"[^A-Za-z0-9._-]+", "-", text).strip("-.")[:64]


def write_tree(lines: DataFrame, target: str, folder: str) -> DataFrame:
    """Texts as files below ``folder``, a path or address of any file system that Arrow knows: (target, n_lines) of what is written.

    ``lines`` has ``target``, line_number and redacted. The lines of a file come to one task in order and are written
    as they come; a file gets its name when it is whole, so a task that is run again does no harm.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        name, out, n, done = None, None, 0, []

        def finish() -> None:
            if out is not None:
                out.close()
                fs.move(*_names(base, name))
                done.append((name, n))

        for batch in batches:
            for at, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if at != name:
                    finish()
                    name, n, out = at, 0, _open(fs, base, at)
                out.write((line or "").encode("utf-8", "surrogatepass") + b"\n")
                n += 1
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["target", "n_lines"])

    placed = lines.where(F.col(target).isNotNull()).select(F.col(target).alias("target"), "line_number", "redacted").repartition("target").sortWithinPartitions("target", "line_number")
    return placed.mapInArrow(write, "target string, n_lines bigint")


def copy_tree(files: DataFrame, target: str, folder: str) -> DataFrame:
    """Files as they are (``target``, content) below ``folder``: (target, error), the error null where all went well."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        for batch in batches:
            names, errors = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist()):
                try:
                    with _open(fs, base, name) as out:
                        out.write(content or b"")
                    fs.move(*_names(base, name))
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e)[:500])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(errors, pa.string())], ["target", "error"])

    return files.select(F.col(target).alias("target"), "content").mapInArrow(write, "target string, error string")


def _file_system(folder: str):
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return fs.LocalFileSystem(), folder


def _names(base: str, target: str) -> tuple[str, str]:
    parts = [p for p in target.split("/") if p not in ("", ".", "..")]
    return "/".join([base.rstrip("/"), *parts[:-1], f".{parts[-1]}.part"]), "/".join([base.rstrip("/"), *parts])


def _open(fs, base: str, target: str):
    part, _ = _names(base, target)
    fs.create_dir(part.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(part)


def manifest(audit: DataFrame, path: str) -> DataFrame:
    """(path, changes): how many replacements of each class a file has, as a map."""
    return audit.groupBy(path).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity", "n")))).alias("changes"))


def export_mapping(mapping: DataFrame, path: str, overwrite: bool = False) -> None:
    mapping.select("entity", "original", "replacement").write.mode(_mode(overwrite)).json(path)


def table_text(rows: Iterable[tuple], header: tuple[str, ...]) -> Iterator[str]:
    """The lines of a padded table of a small result."""
    cells = [tuple("" if c is None else str(c) for c in r) for r in rows]
    widths = [max(len(h), *(len(r[k]) for r in cells)) if cells else len(h) for k, h in enumerate(header)]
    yield "  ".join(h.ljust(w) for h, w in zip(header, widths)).rstrip()
    for r in cells:
        yield "  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip()
