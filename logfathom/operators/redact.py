"""Consistent pseudonyms for hosts, addresses, ids and mail addresses across a whole bundle."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, BROADCAST_ROWS, small

# Forms of the entities that are replaced wherever they stand.
IPV4 = r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b"
MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b|\b[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}\b"
SHA256 = r"\bsha256:[0-9a-fA-F]{64}\b"
# What stands before the id of a container, in full and in short.
CONTAINER = r'(?:"Id"\s*:\s*"|\bcontainer(?:_id| id)?\b\s*[:=]\s*|\bcontainerd://|\bdocker://|/containers/)([0-9a-fA-F]{64})'
CONTAINER_SHORT = r'(?:"Hostname"\s*:\s*"|"Aliases"\s*:\s*\[\s*"|\bhostname\b\s*[:=]\s*|/containers/)([0-9a-fA-F]{12})\b'
#: A word that may be a host, wherever it stands: in a URL, before a port, in a certificate's names or by itself. Only known hosts are replaced.
HOST = r"\b[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\b"
#: Entity classes in the order in which they take precedence, with the form of each pseudonym.
CLASSES = {"email": EMAIL, "sha256": SHA256, "mac": MAC, "ip": IPV4}
#: A class that is looked up but not discovered: a word is replaced only if an inventory or a context has told what it is.
SEEDED = {"host": HOST}


def pseudonym(entity: Column, n: Column) -> Column:
    """The pseudonym of the n-th entity of a class; addresses count through a private range."""
    three = F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), "0")
    ip = F.concat(F.lit("10."), F.floor((n - 1) / (254 * 254)).cast("string"), F.lit("."), (F.pmod(F.floor((n - 1) / 254), F.lit(254)) + 1).cast("string"), F.lit("."), (F.pmod(n - 1, F.lit(254)) + 1).cast("string"))
    return (
        F.when(entity == "host", F.concat(F.lit("host-"), three, F.lit(".example.invalid")))
        .when(entity == "email", F.concat(F.lit("user"), three, F.lit("@example.invalid")))
        .when(entity == "sha256", F.concat(F.lit("sha256:digest-"), three))
        .when(entity == "ip", ip)
        .when(entity == "container_short", F.concat(F.lit("ctr-"), three))
        .otherwise(F.concat(entity, F.lit("-"), three))
    )


def tokens(texts: DataFrame, text: str, classes: tuple[str, ...] = tuple(CLASSES)) -> DataFrame:
    """(entity, original): the distinct entities of each class in all texts, in lower case."""

    def of_class(c: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(CLASSES[c]), 0)), lambda t: F.struct(F.lit(c).alias("entity"), F.lower(t).alias("original")))

    found = F.concat(*map(of_class, classes))
    return texts.where(F.col(text).isNotNull()).select(F.explode(found).alias("t")).select("t.entity", "t.original").distinct()


def containers(texts: DataFrame, text: str) -> DataFrame:
    """(entity, original): ids of containers that stand in a context which says so, in lower case."""

    def of_class(c: str, p: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(p), 1), lambda t: F.struct(F.lit(c).alias("entity"), F.lower(t).alias("original")))

    found = F.concat(of_class("container", CONTAINER), of_class("container_short", CONTAINER_SHORT))
    return texts.where(F.col(text).isNotNull()).select(F.explode(found).alias("t")).select("t.entity", "t.original").distinct()


def seeds(nodes: DataFrame, hostname: str, address: str, cluster: str, node_id: str) -> DataFrame:
    """(entity, original) of the hosts, addresses, clusters and node ids of an inventory, in lower case; blanks are left out."""
    columns = (("host", hostname), ("ip", address), ("cluster", cluster), ("node", node_id))
    named = F.array(*[F.struct(F.lit(e).alias("entity"), F.lower(F.trim(F.col(c))).alias("original")) for e, c in columns])
    return nodes.select(F.inline(named)).where("original <> ''").distinct()


def with_short_hosts(mapped: DataFrame) -> DataFrame:
    """The mapping with the first label of each dotted host as well, as the first label of its pseudonym.

    A label that several hosts share goes to the first of them; a host that is known by the label alone keeps its own.
    """
    dotted = mapped.where((F.col("entity") == "host") & F.contains("original", F.lit(".")))
    label = F.substring_index("original", ".", 1)
    short = dotted.groupBy(label.alias("original")).agg(F.min(F.substring_index("replacement", ".", 1)).alias("replacement")).withColumn("entity", F.lit("host"))
    fresh = short.join(mapped.where("entity = 'host'").select("original"), "original", "left_anti")
    return mapped.unionByName(fresh.select("entity", "original", "replacement"))


def rewrite_columns(rows: DataFrame, columns: dict[str, str], mapped: DataFrame) -> DataFrame:
    """Whole cells replaced: ``columns`` names the entity class of each column; unknown cells stay."""
    out = rows
    for c, entity in columns.items():
        known = small(mapped.where(F.col("entity") == entity).select(F.col("original").alias("__original"), F.col("replacement").alias("__replacement")))
        out = out.join(known, F.lower(F.trim(F.col(c))) == F.col("__original"), "left").withColumn(c, F.coalesce("__replacement", c)).drop("__original", "__replacement")
    return out


def mapping(entities: DataFrame) -> DataFrame:
    """(entity, original, replacement): dense pseudonyms in the order of the originals, the same in every run.

    Originals are put in buckets by their first characters, as many as tell members of the class apart, and numbered
    inside from the bucket's base, so no task orders a whole class.
    """
    heads = F.when(F.col("entity") == "sha256", 11).when(F.col("entity").isin("ip", "mac"), 7).otherwise(4)
    bucketed = entities.withColumn("bucket", F.substring(F.col("original"), F.lit(1), heads))
    sums = bucketed.groupBy("entity", "bucket").agg(F.count("*").alias("n"))
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("entity").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(W.partitionBy("entity", "bucket").orderBy("original"))
    numbered = bucketed.withColumn("inside", inside).join(base, ["entity", "bucket"]).withColumn("n", F.col("base") + F.col("inside"))
    return numbered.select("entity", "original", pseudonym(F.col("entity"), F.col("n")).alias("replacement"))


def rewrite(texts: DataFrame, keys: list[str], text: str, mapped: DataFrame, classes: tuple[str, ...] = tuple(CLASSES), most: int = BROADCAST_ROWS, by_class: bool = False, labels: bool = False) -> DataFrame:
    """(keys, redacted, n_replaced): every entity of the classes replaced by its pseudonym, in one pass over each text.

    If the mapping is proven small (rows and bytes) it is sent to all workers, and each text is rewritten where it is,
    without a shuffle. Else the distinct tokens of each text are looked up by a shuffled join, without the texts, and
    come back as one small table for each text that has any. Either way a pseudonym is never rewritten. Tokens without
    a mapping stay; with ``labels`` a dotted word that is not known is looked up by its longest known runs of labels,
    so a host is found in ``host.log``. Null texts stay null. ``by_class`` adds ``replaced``, a map of the
    replacements of each class.
    """
    forms = CLASSES | SEEDED
    pattern = "|".join(f"(?:{forms[c]})" for c in classes)
    wanted = mapped.select("entity", "original", "replacement")
    held = wanted.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("original") + F.length("replacement")), F.lit(0)).alias("size")).first()
    picked = texts.select(*keys, F.col(text).alias("__text"))
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keys)])
    ddl = f"{key_ddl}, redacted string, n_replaced bigint, replaced map<string,bigint>"
    runs = (wanted.agg(F.max(F.size(F.split("original", r"\."))).alias("n")).first()["n"] or 1) if labels else 0
    if held["n"] <= most and held["size"] <= BROADCAST_BYTES:
        known = texts.sparkSession.sparkContext.broadcast({r["original"]: (r["replacement"], r["entity"]) for r in wanted.collect()})
        out = picked.mapInArrow(lambda b: _rewritten(b, pattern, runs, known), ddl)
    else:
        asked = picked.mapInArrow(lambda b: _asked(b, pattern, runs), f"{key_ddl}, __original string")
        known = wanted.groupBy(F.col("original").alias("__original")).agg(F.min(F.struct("replacement", "entity")).alias("__as"))
        told = asked.join(known, "__original").groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.collect_list(F.struct("__original", "__as.replacement", "__as.entity")).alias("__known"))
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        out = picked.join(told, same, "left").select(*keys, "__known", "__text").mapInArrow(lambda b: _rewritten(b, pattern, runs), ddl)
    return out if by_class else out.drop("replaced")


def _parts(word: str, runs: int) -> Iterator[tuple[int, str]]:
    """Runs of labels of a dotted word, from each label the longest first, with the number of labels."""
    labels = word.split(".")
    for i in range(len(labels)):
        for n in range(min(runs, len(labels) - i), 0, -1):
            yield i, ".".join(labels[i : i + n])


def _asked(batches: Iterable[pa.RecordBatch], pattern: str, runs: int) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text that may be known."""
    find = re.compile(pattern, re.A)
    for batch in batches:
        at, words = [], []
        for k, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            own = {m[0].lower() for m in find.finditer(t or "")}
            if runs:
                own |= {part for w in own if "." in w for _, part in _parts(w, runs)}
            at += [k] * len(own)
            words += own
        rows = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(words, pa.string())], [*batch.schema.names[:-1], "__original"])


def _rewritten(batches: Iterable[pa.RecordBatch], pattern: str, runs: int, known: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    find, names = re.compile(pattern, re.A), known.value if known is not None else {}
    counts: Counter = Counter()

    def put(m: re.Match) -> str:
        word = m[0]
        got = names.get(word.lower())
        if got is not None:
            counts[got[1]] += 1
            return got[0]
        if not runs or "." not in word:
            return word
        out, after = [], 0
        for i, part in _parts(word, runs):
            if i < after:
                continue
            got = names.get(part.lower())
            if got is not None:
                counts[got[1]] += 1
                out.append(got[0])
                after = i + part.count(".") + 1
            elif "." not in part:
                out.append(part)
        return ".".join(out)

    for batch in batches:
        texts, ns, maps = [], [], []
        tables = batch.column(batch.num_columns - 2).to_pylist() if known is None else ()
        for k, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            counts.clear()
            if known is None:
                names = {e["__original"]: (e["replacement"], e["entity"]) for e in tables[k] or ()}
            texts.append(None if t is None else find.sub(put, t))
            ns.append(sum(counts.values()))
            maps.append(list(counts.items()))
        n = batch.num_columns - (2 if known is None else 1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array(ns, pa.int64()), pa.array(maps, pa.map_(pa.string(), pa.int64()))], [*batch.schema.names[:n], "redacted", "n_replaced", "replaced"])


def replace_literals(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Known literals replaced, the longest first."""
    for old, new in sorted(pairs, key=lambda p: (-len(p[0]), p[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def count_literal(text: Column, literal: str) -> Column:
    """How often a literal stands in a text, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("bigint")


def rewrite_path(path: Column, hosts: dict[str, str]) -> Column:
    """Each component of a path that is a known host, in any case, replaced."""
    table = F.create_map(*[F.lit(x) for kv in hosts.items() for x in kv]) if hosts else F.lit(None).cast("map<string,string>")
    return F.array_join(F.transform(F.split(path, "/"), lambda c: F.coalesce(F.try_element_at(table, F.lower(c)), c)), "/")


def path_collisions(paths: DataFrame, target: str) -> DataFrame:
    """Targets that more than one path would be written to, whatever their case."""
    return paths.groupBy(F.lower(target).alias("target")).agg(F.count("*").alias("n")).where("n > 1")


def audit(texts: DataFrame, key: str, text: str, classes: tuple[str, ...] = tuple(CLASSES)) -> DataFrame:
    """(key, entity, n): how many tokens of each class each file has."""
    per = [F.struct(F.lit(c).alias("entity"), F.size(F.regexp_extract_all(F.col(text), F.lit(CLASSES[c]), 0)).alias("n")) for c in classes]
    return texts.where(F.col(text).isNotNull()).select(key, F.inline(F.array(*per))).groupBy(key, "entity").agg(F.sum("n").alias("n")).where("n > 0")
