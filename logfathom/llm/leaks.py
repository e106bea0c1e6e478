"""Passages of evaluation items inside a corpus, by winnowed word fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, BROADCAST_ROWS
from .grams import prefix_hashes, window_hashes, winnow

WORD = re.compile(r"[^\W_]+")
#: Words in a fingerprint; the winnowing window follows from the guaranteed length.
GRAM = 8
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
#: Copies of each item's fingerprint where they are joined, so that the documents of a hot one spread.
SALTS = 16


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


class Printer:
    """The words of texts, their codes, and the places of their winnowed fingerprints."""

    def __init__(self, span: int, gram: int) -> None:
        self.span, self.gram = span, gram
        self.codes: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None:
        """(words, codes, fingerprints, places); null for a text of fewer words than a span."""
        ws = words(text)
        if len(ws) < self.span:
            return None
        known = self.codes
        if len(known) > 200_000:
            known.clear()
        for w in ws:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        hashes = window_hashes(prefix_hashes(codes), self.gram)
        places = winnow(hashes, self.span - self.gram + 1)
        return ws, codes, hashes[places], places


class Items:
    """Items by fingerprint, to be looked up for each document."""

    def __init__(self, rows: list[tuple[int, str]], span: int, gram: int) -> None:
        printer = Printer(span, gram)
        self.items: list[tuple[int, list[str]]] = []
        at: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in rows:
            got = printer(text)
            if got is not None:
                for h, place in zip(got[2].tolist(), got[3].tolist()):
                    at.setdefault(h, []).append((len(self.items), place))
                self.items.append((item_id, got[0]))
        self.at = at
        self.sorted = np.fromiter(sorted(at), np.uint64, len(at))

    def leaked(self, ws: list[str], prints: np.ndarray, places: np.ndarray, span: int, gram: int) -> set[int]:
        """The items whose hits in the document grow to ``span`` equal words.

        A hit is extended word by word to both sides from its fingerprint. Hits on a stretch that was grown before are
        not grown again.
        """
        if not len(self.sorted):
            return set()
        spot = np.minimum(np.searchsorted(self.sorted, prints), len(self.sorted) - 1)
        out: set[int] = set()
        grown: dict[tuple[int, int], int] = {}
        for k in np.flatnonzero(self.sorted[spot] == prints).tolist():
            p = int(places[k])
            for item, q in self.at[int(prints[k])]:
                item_id, iws = self.items[item]
                if item_id in out or grown.get((item, p - q), -1) >= p + gram:
                    continue
                a = z = 0
                while a < p and a < q and ws[p - a - 1] == iws[q - a - 1]:
                    a += 1
                while p + z < len(ws) and q + z < len(iws) and ws[p + z] == iws[q + z]:
                    z += 1
                grown[item, p - q] = p + z
                if z and a + z >= span:
                    out.add(item_id)
        return out


#: What the worker looked up last, with the rows that it came from.
_held: list = [None, None]


def look_up(batches: Iterable[pa.RecordBatch], items: Broadcast, span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The leaked items of each document, in one pass over the texts."""
    if _held[0] is not items.value:
        _held[:] = items.value, Items(items.value, span, gram)
    known, printer = _held[1], Printer(span, gram)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = printer(text)
            if got is not None:
                rows += [(doc_id, item_id) for item_id in known.leaked(got[0], got[2], got[3], span, gram)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=FOUND)


def sided_prints(batches: Iterable[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The fingerprints of each text with the codes of its words beside them, as far as a span may reach."""
    printer, side = Printer(span, gram), span - gram
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = printer(text)
            if got is not None:
                codes = got[1].view(np.int64)
                rows += [(key, h, codes[max(0, p - side) : p][::-1], codes[p : p + span]) for h, p in zip(got[2].view(np.int64).tolist(), got[3].tolist())]
        if rows:
            ids, hs, left, right = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))], ["id", "print", "lft", "rgt"])


def leaked_items(documents: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, span: int = 12, gram: int = GRAM, most_items: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id): every pair that shares at least ``span`` consecutive words.

    Both sides are fingerprinted by winnowing: of the hashes of ``gram`` words, the least of every window of
    ``span - gram + 1``, so a shared span of ``span`` words always shares a fingerprint. If the items are proven small
    (rows and bytes), they are sent to all workers, and one pass over the documents looks their fingerprints up and
    extends each hit to both sides, word by word; no text is shuffled. Else fingerprints are joined, salted, with the
    codes of the words beside them (64 bits each), and hits are extended over these; again no text is shuffled.

    Null, empty and short texts and null ids give no rows; texts count whole. Repeated rows give a pair once, equal
    items give a pair each. An empty side gives no rows. Only the given columns are read.
    """
    gram = min(gram, span)
    docs = documents.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text")).where("text is not null and doc_id is not null")
    evals = items.select(item_id.cast("bigint").alias("item_id"), item_text.alias("item")).where("item is not null and item_id is not null")
    held = evals.limit(most_items + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("size")).first()
    if held["n"] <= most_items and held["size"] <= BROADCAST_BYTES:
        known = documents.sparkSession.sparkContext.broadcast([(r["item_id"], r["item"]) for r in evals.distinct().collect()])
        return docs.mapInArrow(lambda b: look_up(b, known, span, gram), "doc_id bigint, item_id bigint").distinct()
    schema = "id bigint, print bigint, lft array<bigint>, rgt array<bigint>"
    of_items = evals.mapInArrow(lambda b: sided_prints(b, span, gram), schema).select(F.col("id").alias("item_id"), "print", F.col("lft").alias("il"), F.col("rgt").alias("ir"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of_docs = docs.mapInArrow(lambda b: sided_prints(b, span, gram), schema).withColumn("salt", F.pmod(F.col("id"), F.lit(SALTS)).cast("int"))
    equal = lambda x, y: F.size(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.size(x), F.size(y)), F.lit(1)), lambda k: F.slice(x, F.lit(1), k) == F.slice(y, F.lit(1), k)), lambda same: same))
    grown = F.when(F.least(F.size("lft"), F.size("il")) > 0, equal(F.col("lft"), F.col("il"))).otherwise(0) + equal(F.col("rgt"), F.col("ir"))
    return of_docs.join(of_items, ["print", "salt"]).where(grown >= span).select(F.col("id").alias("doc_id"), "item_id").distinct()
