"""Escapes, safe names and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_field(c: Column) -> Column:
    """Quoted where the field holds a quote, comma or line break; quotes doubled."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def xml_text(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def json_string(c: Column) -> Column:
    """A JSON string literal."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), s, F.lit('"'))


def file_name(c: Column, most: int = 48) -> Column:
    """A name safe in every file system: other characters become _, at most `most` characters, and eight digits of a digest tell equal ones apart."""
    safe = F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")
    return F.concat(F.substring(safe, 1, most), F.lit("_"), F.substring(F.sha2(c, 256), 1, 8))


def class_key(c: Column) -> Column:
    """A compound class with its facets in order: b+a and a+b are one."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(c, r"\+"))), "+")


def range_key(source, track, scene, static, start, end) -> Column:
    """Key of a window: its place with times in whole microseconds."""
    us = lambda t: F.round(t * 1e6).cast("long")
    return F.concat_ws("|", *[x.cast("string") for x in (source, track, scene, static, us(start), us(end))])


def fingerprint(*columns: Column) -> Column:
    """SHA-256 over columns as text, nulls apart from empty strings."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]), 256)
