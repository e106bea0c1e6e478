"""Canonical forms of ids, event types and machine addresses that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outer white space of ids: blank, tab and line ends.
OUTER_SPACE = " \t\r\n"
IPV4 = r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?![\d.])"


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def canonical_id(text: Column) -> Column:
    """Lower case without outer white space; an empty id is null."""
    return blank_to_null(F.lower(F.trim(text, F.lit(OUTER_SPACE))))


def canonical_type(text: Column) -> Column:
    """One form for ``memberlist_timeout``, ``MEMBERLIST-TIMEOUT``, ``Memberlist Timeout`` and ``MemberlistTimeout``."""
    return blank_to_null(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")))


def peer_ipv4(text: Column) -> Column:
    """The dotted IPv4 address in ``10.0.0.1``, ``tcp://10.0.0.1:2377`` or ``[::ffff:10.0.0.1]:7946``, else null."""
    return blank_to_null(F.regexp_extract(text, IPV4, 1))


def peer_name(text: Column) -> Column:
    """The IPv4 address if there is one, else the trimmed text in lower case; blanks and dashes mean missing."""
    plain = F.lower(F.trim(text, F.lit(OUTER_SPACE)))
    return F.coalesce(peer_ipv4(text), F.when(~plain.isin("", "-"), plain))


def peer_port(text: Column) -> Column:
    """The port written behind an IPv4 address, else null."""
    return F.regexp_extract(text, IPV4 + r"\]?:(\d{1,9})", 2).try_cast("int")


def snake_type(text: Column) -> Column:
    """An event type as ``words_with_underscores``, however it is written."""
    split = F.regexp_replace(F.trim(text, F.lit(OUTER_SPACE)), r"([a-z0-9])([A-Z])", "$1_$2")
    return blank_to_null(F.lower(F.regexp_replace(split, r"[ -]+", "_")))


def safe_file_name(host: Column) -> Column:
    """A host name that is good as a part of a file name."""
    return F.regexp_replace(host, r"[^A-Za-z0-9._-]+", "_")


def host_key(text: Column) -> Column:
    """A host name without any blanks, in lower case."""
    return blank_to_null(F.lower(F.regexp_replace(text, r"\s+", "")))
