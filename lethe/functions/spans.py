"""All matches of a regular expression with their places, as native columns.

Offsets count code points from 0.  A pattern is prefix + value + suffix; the span is that of the value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string,lead:string>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def find_spans(text: Column, value: str | Column, prefix: str = "", suffix: str = "", flags: str = "U") -> Column:
    """array<struct<start, end, text, lead>> of the non-empty values that match, in order; lead is what the prefix matched.

    value may be a column that holds a pattern.  Python's ends of lines are meant, so only a line feed is one.
    """
    if isinstance(value, str):
        pattern = F.lit(f"(?{flags}d)({prefix})({value}){suffix}")
    else:
        pattern = F.concat(F.lit(f"(?{flags}d)({prefix})("), value, F.lit(f"){suffix}"))
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    parts = [F.slice(gaps, F.lit(1), F.size(whole)).alias("g"), whole.alias("w")]
    if prefix:
        parts.append(F.regexp_extract_all(text, pattern, F.lit(1)).alias("p"))
    if prefix or suffix:
        parts.append(F.regexp_extract_all(text, pattern, F.lit(2)).alias("v"))

    def add(acc: Column, x: Column) -> Column:
        lead, found = x["p"] if prefix else F.lit(""), x["v"] if prefix or suffix else x["w"]
        start = acc["at"] + F.length(x["g"]) + F.length(lead)
        span = F.struct(start.alias("start"), (start + F.length(found)).alias("end"), found.alias("text"), lead.alias("lead"))
        return F.struct((acc["at"] + F.length(x["g"]) + F.length(x["w"])).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), none().alias("out"))
    found = F.aggregate(F.arrays_zip(*parts), zero, add, lambda a: F.filter(a["out"], lambda s: s["end"] > s["start"]))
    return F.when(F.rlike(text, pattern), found).otherwise(none())


def cut(span: Column, text: Column) -> Column:
    """span shortened to the leading text given."""
    return F.struct(span["start"], (span["start"] + F.length(text)).alias("end"), text.alias("text"), span["lead"])


def behind(span: Column, n: Column) -> Column:
    """span without its first n characters."""
    return F.struct((span["start"] + n).alias("start"), span["end"], F.substring(span["text"], n + 1, F.length(span["text"])).alias("text"), span["lead"])


def before(text: Column, at: Column, n: int) -> Column:
    """The n characters in front of a place."""
    return F.substring(text, F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n)))


def after(text: Column, at: Column, n: int) -> Column:
    return F.substring(text, at + 1, F.lit(n))
