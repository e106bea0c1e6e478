"""How often every distinct term occurs and in how many records, counted in burst tries."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A container of the trie with more terms than this bursts into one container for each next character.
BURST = 64
#: Subtrees with more terms than this, over all workers, are routed by a longer prefix.
ROUTE_TERMS = 100_000
#: Most prefixes that route, and the longest of them; below the longest, terms are spread by their hash.
ROUTES, DEEPEST, SPREAD = 200_000, 64, 256
LEAF = pa.schema([("field", pa.string()), ("route", pa.string()), ("prefix", pa.string()), ("suffixes", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))])
DDL = "field string, route string, prefix string, suffixes array<string>, totals array<bigint>, records array<bigint>"
OUT = pa.schema([("field", pa.string()), ("term", pa.string()), ("n_total", pa.int64()), ("n_records", pa.int64())])


class Inner(dict):
    """A burst container: children by their next character."""


class BurstTrie:
    """Counts by term. A leaf maps suffixes to slots of two packed arrays of counters; full leaves burst into inner nodes."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.root: dict = {}
        self.totals, self.records = array("q"), array("q")

    def add(self, term: str, total: int, records: int) -> None:
        node, at, above = self.root, 0, None
        while type(node) is Inner:
            above, step = node, term[at : at + 1]
            node = above.get(step)
            if node is None:
                node = above[step] = {}
            at += 1
        suffix = term[at:]
        slot = node.get(suffix)
        if slot is not None:
            self.totals[slot] += total
            self.records[slot] += records
            return
        node[suffix] = len(self.totals)
        self.totals.append(total)
        self.records.append(records)
        if len(node) > self.burst:
            inner = self._burst(node)
            if above is None:
                self.root = inner
            else:
                above[step] = inner

    @staticmethod
    def _burst(leaf: dict) -> Inner:
        """A full leaf as an inner node; a term that ends here goes to the child of the empty step."""
        inner = Inner()
        for suffix, slot in leaf.items():
            inner.setdefault(suffix[:1], {})[suffix[1:]] = slot
        return inner

    def leaves(self) -> Iterator[tuple[str, dict]]:
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if type(node) is Inner:
                todo += [(prefix + step, child) for step, child in node.items()]
            elif node:
                yield prefix, node

    def rows(self, field: str) -> Iterator[tuple]:
        """The leaves as rows (field, route, prefix, suffixes, totals, records), without a route."""
        for prefix, leaf in self.leaves():
            yield field, None, prefix, [*leaf], [self.totals[k] for k in leaf.values()], [self.records[k] for k in leaf.values()]


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def build(batches: Iterable[pa.RecordBatch], burst: int) -> Iterator[pa.RecordBatch]:
    """The leaves of the tries in which a worker counts its rows, one trie for each field."""
    tries: dict[str, BurstTrie] = {}
    for batch in batches:
        for field, term, total, records in zip(*(c.to_pylist() for c in batch.columns)):
            trie = tries.get(field)
            if trie is None:
                trie = tries[field] = BurstTrie(burst)
            trie.add(term, total, records)
    yield from _batches((row for field, trie in tries.items() for row in trie.rows(field)), LEAF, 1000)


def heavy_prefixes(leaves: DataFrame, route_terms: int) -> dict[str, set[str]]:
    """By field, the prefixes under which the leaves of all workers hold more terms than a subtree may have.

    A subtree may have ``route_terms`` terms, or four, sixteen ... times as many if more than ``ROUTES`` prefixes
    would be heavy otherwise; so what is sent to the workers has a bound, however many terms there are.
    """
    steps = leaves.select("field", F.size("suffixes").alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(DEEPEST), F.length("prefix"))), lambda k: F.substring(F.col("prefix"), F.lit(1), k))).alias("route"))
    sums = cut(steps.groupBy("field", "route").agg(F.sum("n").alias("n")).where(F.col("n") > route_terms))
    counts = sums.agg(*[F.count_if(F.col("n") > route_terms * 4**k).alias(str(k)) for k in range(16)]).first()
    most = next((route_terms * 4**k for k in range(16) if counts[k] <= ROUTES), route_terms * 4**16)
    heavy: dict[str, set[str]] = {}
    for row in sums.where(F.col("n") > most).toLocalIterator():
        heavy.setdefault(row["field"], set()).add(row["route"])
    return heavy


def route_of(term: str, heavy: set[str]) -> str:
    """The prefix of a term that is one character longer than its longest heavy prefix; below the longest, a hash."""
    depth = 0
    while depth <= len(term) and term[:depth] in heavy:
        depth += 1
    if depth > DEEPEST:
        return f"{term[:DEEPEST]}\x00{crc32(term.encode('utf-8', 'surrogatepass')) % SPREAD}"
    return term[:depth]


def routed(batches: Iterable[pa.RecordBatch], heavy: Broadcast) -> Iterator[pa.RecordBatch]:
    """The leaves with their routes; a leaf above a route is split among the routes of its terms."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for field, _, prefix, suffixes, totals, records in zip(*(c.to_pylist() for c in batch.columns)):
                own = heavy.value.get(field, set())
                if prefix not in own and len(prefix) <= DEEPEST:
                    yield field, route_of(prefix, own), prefix, suffixes, totals, records
                    continue
                parts: dict[str, list] = {}
                for s, t, r in zip(suffixes, totals, records):
                    parts.setdefault(route_of(prefix + s, own), []).append((s, t, r))
                for route, part in parts.items():
                    yield field, route, prefix, *map(list, zip(*part))

    yield from _batches(rows(), LEAF, 1000)


def merge(batches: Iterable[pa.RecordBatch], burst: int) -> Iterator[pa.RecordBatch]:
    """The counts of all terms from leaves sorted by field and route: matching subtrees of all workers become one trie."""
    key, trie = None, BurstTrie(burst)

    def out() -> Iterator[pa.RecordBatch]:
        if key is not None:
            yield from _batches(((key[0], prefix + s, trie.totals[k], trie.records[k]) for prefix, leaf in trie.leaves() for s, k in leaf.items()), OUT, 10_000)

    for batch in batches:
        for field, route, prefix, suffixes, totals, records in zip(*(c.to_pylist() for c in batch.columns)):
            if (field, route) != key:
                yield from out()
                key, trie = (field, route), BurstTrie(burst)
            for s, t, r in zip(suffixes, totals, records):
                trie.add(prefix + s, t, r)
    yield from out()


def term_frequencies(counts: DataFrame, field: Column, term: Column, record: Column, total: Column, burst: int = BURST, route_terms: int = ROUTE_TERMS) -> DataFrame:
    """(field, term, n_total, n_records): occurrences of every distinct term of a field and the records with it.

    ``counts`` has one row for each mention with its number of occurrences; mentions of a term in one record are
    added up first, with map-side partial aggregation, so a term or record with a third of all rows arrives as a few
    rows. Each worker counts its (term, record) rows in burst tries, whose containers split by the next character when
    they fill up. The leaves of all workers then meet by routing prefix: the prefix of a term is one character longer
    than the longest prefix whose summed subtrees are too large for one reducer, and empty while the whole trie is
    small. There the matching subtrees are merged into one trie, one route after the other.

    Null terms and totals that are null or not above 0 are left out; a null record counts occurrences but no record.
    The caller normalises terms. Very long terms are kept whole. An empty input gives no rows. Repeated mentions add up:
    drop redelivered rows before. Only the given columns are read, so further columns of any name do no harm.
    """
    rows = counts.select(field.alias("field"), term.alias("term"), record.cast("string").alias("record"), total.cast("bigint").alias("total")).where(F.col("term").isNotNull() & (F.col("total") > 0))
    pairs = rows.groupBy("field", "term", "record").agg(F.sum("total").alias("total")).select("field", "term", "total", F.col("record").isNotNull().cast("bigint").alias("records"))
    leaves = cut(pairs.mapInArrow(lambda b: build(b, burst), DDL))
    heavy = counts.sparkSession.sparkContext.broadcast(heavy_prefixes(leaves, route_terms))
    subtrees = leaves.mapInArrow(lambda b: routed(b, heavy), DDL).repartition("field", "route").sortWithinPartitions("field", "route")
    return subtrees.mapInArrow(lambda b: merge(b, burst), "field string, term string, n_total bigint, n_records bigint")
