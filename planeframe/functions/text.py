"""Escaping, numbers and times as text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER = re.compile(r"[+-]?[0-9]+")


def number(value: float) -> str:
    """A double in 17 significant digits, without trailing zeros."""
    return "%.17g" % value


def number_text(values: Column) -> Column:
    """``number`` of a column; Spark's own casts print the shortest form instead."""

    @F.pandas_udf("string")
    def texts(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or x != x else number(x))

    return texts(values)


def escape_xml(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = text.replace(a, b)
    return text


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def json_escaped(text: Column) -> Column:
    """A quoted JSON string; control characters are escaped, all else stays as it is."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def csv_field(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if re.search(r'[,"\n\r]', text) else text


def csv_escaped(text: Column) -> Column:
    """Quoted only where it holds a comma, a quote or a line end; quotes are doubled."""
    return F.when(text.rlike(r'[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_fields(line: str) -> list[str] | None:
    """Fields of one CSV record; a quote opens only an empty field; None if a quoted field does not end."""
    out, field, quoted, k = [], "", False, 0
    while k < len(line):
        ch = line[k]
        if quoted:
            if ch == '"' and line[k + 1 : k + 2] == '"':
                field += '"'
                k += 1
            elif ch == '"':
                quoted = False
            else:
                field += ch
        elif ch == '"' and not field:
            quoted = True
        elif ch == ",":
            out.append(field)
            field = ""
        else:
            field += ch
        k += 1
    return None if quoted else [*out, field]


def parse_integer(text: str) -> int | None:
    """The integer that the whole text is, or None."""
    return int(text) if _INTEGER.fullmatch(text) else None


def iso_timestamp(ns: Column) -> Column:
    """Nanoseconds since the epoch -> UTC text in milliseconds, cut off; empty for 0. The session's time zone does not matter."""
    ms = F.call_function("div", ns.cast("decimal(20,0)"), F.lit(1000000).cast("decimal(20,0)")).cast("long")
    day, second = F.call_function("div", ms, F.lit(86_400_000)).cast("int"), F.call_function("div", ms % 86_400_000, F.lit(1000))
    whole = (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(day, F.lit(0), F.lit(0), second.cast("decimal(18,6)"))).cast("string")
    return F.when(ns == 0, "").otherwise(F.concat(F.replace(F.substring(whole, 1, 19), F.lit(" "), F.lit("T")), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("Z")))


def iso_text(ns: int) -> str:
    """The same on the driver."""
    from datetime import datetime, timedelta

    if not ns:
        return ""
    return (datetime(1970, 1, 1) + timedelta(milliseconds=ns // 1_000_000)).isoformat(timespec="milliseconds") + "Z"


def urn_uuid(text: Column) -> Column:
    """Whether a text is urn:uuid: and a UUID, nothing else."""
    return text.rlike(r"\Aurn:uuid:[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z")


def csv_split(line: Column) -> Column:
    """``csv_fields`` of a column: null where a quoted field does not end."""

    @F.pandas_udf("array<string>")
    def fields(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else csv_fields(x))

    return fields(line)


def integer(text: Column) -> Column:
    """The long that the whole text is, or null: no blanks, no point, no exponent."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))


def xml_integer(text: Column, name: str) -> Column:
    """The first Name="integer" in a text."""
    return F.nullif(F.regexp_extract(text, name + '="(-?[0-9]+)"', 1), F.lit("")).try_cast("long")


def effective_exposure(exposure: Column, default: float) -> Column:
    """The frame's exposure if positive, else the dataset's; null if neither is."""
    used = F.when(exposure > 0, exposure).otherwise(F.lit(float(default)))
    return F.when(used > 0, used)


def delta_ms(timestamp_ns: Column, start_ns: int) -> Column:
    """Milliseconds since the start; null without a start and for earlier frames. Subtracted as integers."""
    since = timestamp_ns.cast("decimal(20,0)") - F.lit(start_ns).cast("decimal(20,0)")
    return F.when((F.lit(start_ns) != 0) & (since >= 0), since.cast("double") / 1e6)


def sorted_map(m: Column) -> Column:
    """The entries of a map in key order: Spark's maps have none."""
    return F.array_sort(F.map_entries(m))
