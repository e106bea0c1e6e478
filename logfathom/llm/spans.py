"""Long exact spans that stand in more than one record."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .grams import prefix_hashes, window_hashes, winnow

#: Rows of the sketch, and the bits of its least and greatest width. The greatest bounds what is broadcast (32 MB).
DEPTH, LEAST_BITS, MOST_BITS = 2, 18, 24
#: Cells in one piece of a sketch on its way.
PIECE = 1 << 16
#: Characters that are hashed together; a longer text is a lot of its own.
LOT = 200_000
ANCHORS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("lft", pa.string()), ("rgt", pa.string())])


class Lot(NamedTuple):
    """Texts that are hashed together, which spares most of the cost of short ones."""

    keys: list[int]
    texts: list[str]
    starts: np.ndarray
    symbols: np.ndarray
    hashes: np.ndarray
    chosen: np.ndarray
    owner: np.ndarray


def lots(rows: Iterable[tuple[int, str]], span: int, gram: int) -> Iterator[Lot]:
    """Lots of texts of at least ``span`` characters with their chosen anchors and the text that each belongs to."""

    def lot(keys: list[int], texts: list[str]) -> Lot:
        symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        change = np.zeros(len(symbols) + 2, np.int8)
        change[starts] += 1
        change[starts + lengths - span + 1] -= 1
        inside = np.cumsum(change[: len(symbols) - span + 1], dtype=np.int8) > 0
        hashes = window_hashes(prefix_hashes(symbols), gram)
        chosen = winnow(hashes, span - gram + 1, inside)
        return Lot(keys, texts, starts, symbols, hashes, chosen, np.searchsorted(starts, chosen, "right") - 1)

    keys, texts, size = [], [], 0
    for key, text in rows:
        if text is None or len(text) < span:
            continue
        keys.append(key)
        texts.append(text)
        size += len(text)
        if size >= LOT:
            yield lot(keys, texts)
            keys, texts, size = [], [], 0
    if texts:
        yield lot(keys, texts)


def cells(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The cell of each hash in each row of the sketch, from disjoint bits."""
    for row in range(DEPTH):
        yield ((hashes >> np.uint64(row * 32)) & np.uint64((1 << bits) - 1)).astype(np.int64) + (row << bits)


def sketch(batches: Iterable[pa.RecordBatch], span: int, gram: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The count-min sketch of one partition: in how many texts an anchor occurs, no higher than 2.

    A text counts once in each of its cells.
    """
    total = np.zeros(DEPTH << bits, np.uint8)
    for batch in batches:
        for lot in lots(((0, t) for t in batch.column(0).to_pylist()), span, gram):
            for at in cells(lot.hashes[lot.chosen], bits):
                of_text = np.unique(lot.owner * (DEPTH << bits) + at) % (DEPTH << bits)
                hit, n = np.unique(of_text, return_counts=True)
                total[hit] = np.minimum(total[hit] + n, 2)
    pieces = [k for k in range(0, len(total), PIECE) if total[k : k + PIECE].any()]
    if pieces:
        bodies = [total[k : k + PIECE].tobytes() for k in pieces]
        yield pa.RecordBatch.from_arrays([pa.array([k // PIECE for k in pieces], pa.int32()), pa.array([zlib.crc32(b) % 64 for b in bodies], pa.int32()), pa.array([zlib.compress(b, 1) for b in bodies])], ["piece", "lot", "body"])


def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total: np.ndarray | int = 0
    for body in pdf["body"]:
        total = np.minimum(np.frombuffer(zlib.decompress(body), np.uint8) + total, 2)
    return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "body": [zlib.compress(total.astype(np.uint8).tobytes(), 1)]})


def anchors(batches: Iterable[pa.RecordBatch], span: int, gram: int, bits: int, seen: Broadcast) -> Iterator[pa.RecordBatch]:
    """The anchors that the sketch takes for repeated, with what stands beside them as far as a span may reach."""
    side = span - gram
    total = np.frombuffer(seen.value, np.uint8)
    for batch in batches:
        rows = ((k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if k is not None)
        for lot in lots(rows, span, gram):
            own = lot.hashes[lot.chosen]
            repeated = np.ones(len(own), bool)
            for cell in cells(own, bits):
                repeated &= total[cell] > 1
            if not repeated.any():
                continue
            chosen, owner = lot.chosen[repeated], lot.owner[repeated]
            second = window_hashes(prefix_hashes(lot.symbols, 1), gram, chosen, 1)
            at = chosen - lot.starts[owner]
            places = list(zip(owner.tolist(), at.tolist()))
            arrays = [own[repeated].view(np.int64), second.view(np.int64), np.asarray(lot.keys, np.int64)[owner], at]
            lft = [lot.texts[d][max(0, p - side) : p] for d, p in places]
            rgt = [lot.texts[d][p + gram : p + span] for d, p in places]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(lft, pa.string()), pa.array(rgt, pa.string())], schema=ANCHORS)


def shared_spans(documents: DataFrame, doc_id: Column, text: Column, span: int = 300, gram: int | None = None, bits: int | None = None) -> DataFrame:
    """(doc_id, shared_chars): the characters of each text in spans of at least ``span`` that stand in another text too.

    A character counts if one of the windows of ``span`` characters around it occurs in another record. Winnowing
    picks anchors, windows of ``gram`` characters, so that every window of ``span`` holds one that is chosen wherever
    the window occurs. The first pass counts the anchors of all texts in count-min sketches of fixed size, which are
    merged; a sketch never counts too low, so the second pass may leave out all anchors it has seen once and loses
    nothing. What remains is grouped exactly: equal anchors with equal surroundings first, which settles the inside of
    copied passages however many copies there are, since a group is down to its least and greatest record before it
    is shuffled. Only where the surroundings differ, at the ends of passages, are the windows through an anchor
    compared one by one. No pairs of records are made.

    Records are told apart by id: a span that a record repeats within itself is not shared, nor one in a repeated
    row. Null, empty and short texts and null ids give no rows; long texts are read whole; characters are Unicode code
    points. An empty input gives no rows. Only the two columns are read.
    """
    gram = gram or max(1, span * 4 // 5)
    side = span - gram
    docs = documents.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text")).where("doc_id is not null and text is not null")
    spark = docs.sparkSession
    if bits is None:
        chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
        expected = 2 * chars / (side + 2)
        bits = min(MOST_BITS, max(LEAST_BITS, int(4 * expected).bit_length()))
    parts = docs.select("text").mapInArrow(lambda b: sketch(b, span, gram, bits), "piece int, lot int, body binary")
    merged = parts.groupBy("piece", "lot").applyInPandas(add_up, "piece int, body binary").groupBy("piece").applyInPandas(add_up, "piece int, body binary")
    total = np.zeros(DEPTH << bits, np.uint8)
    for row in merged.toLocalIterator():  # as many rows as a sketch has pieces, 512 at most
        total[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(zlib.decompress(row["body"]), np.uint8)
    seen = spark.sparkContext.broadcast(total.tobytes())

    ddl = "h1 bigint, h2 bigint, doc_id bigint, pos bigint, lft string, rgt string"
    held = cut(docs.mapInArrow(lambda b: anchors(b, span, gram, bits, seen), ddl).withColumn("around", F.xxhash64("lft", "rgt")))
    same = ["h1", "h2", "around"]
    contexts = held.groupBy(*same).agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.first("lft").alias("lft"), F.first("rgt").alias("rgt"))
    alone = F.col("d0") == F.col("d1")
    unsettled = contexts.groupBy("h1", "h2").agg(F.min("d0").alias("a0"), F.max("d1").alias("a1"), F.max(alone).alias("some")).where("a0 <> a1 and some").select("h1", "h2")
    windows = contexts.join(unsettled, ["h1", "h2"]).select(*same, "d0", "d1", "lft", "rgt", F.explode(F.sequence(F.lit(side) - F.length("rgt"), F.length("lft"))).alias("o"))
    windows = windows.select(*same, "d0", "d1", "o", F.xxhash64(F.substring(F.col("lft"), F.length("lft") - F.col("o") + 1, F.col("o")), F.substring(F.col("rgt"), F.lit(1), F.lit(side) - F.col("o"))).alias("w"))
    key = ["h1", "h2", "o", "w"]
    shared = windows.groupBy(*key).agg(F.min("d0").alias("w0"), F.max("d1").alias("w1")).where("w0 <> w1").select(*key)
    partly = windows.where(alone).join(shared, key).groupBy(*same).agg(F.min("o").alias("o0"), F.max("o").alias("o1"))
    wholly = contexts.where(~alone).select(*same, (F.lit(side) - F.length("rgt")).alias("o0"), F.length("lft").alias("o1"))
    covered = held.select(*same, "doc_id", "pos").join(partly.unionByName(wholly), same).select("doc_id", (F.col("pos") - F.col("o1")).alias("a"), (F.col("pos") - F.col("o0") + span).alias("z")).groupBy("doc_id", "a").agg(F.max("z").alias("z"))
    before = F.max("z").over(W.partitionBy("doc_id").orderBy("a").rowsBetween(W.unboundedPreceding, -1))
    fresh = covered.withColumn("new", F.greatest(F.lit(0).cast("bigint"), F.col("z") - F.greatest(F.col("a"), F.coalesce(before, F.col("a")))))
    return fresh.groupBy("doc_id").agg(F.sum("new").alias("shared_chars"))
