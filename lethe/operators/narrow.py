"""Narrowing of redactions that reach too far: edges, prepositions and labels in front, a date or year and a region behind.

A narrowed span lies inside the one given, or is null where nothing is left of it; nothing is ever widened.

Defined cases: a null text or place gives null; places beyond the text are brought to its ends; a span that is nothing but a label or edge
characters is null; one that is nothing but a region stays.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from lethe.operators import gazetteers
from lethe.operators import patterns as P

_EDGE = "[" + "".join("\\" + c if not c.isalnum() and c.isascii() and not c.isspace() else c for c in P.EDGE_CHARS) + "]+"
_REGIONS = "|".join(rf"\Q{x}\E" for x in sorted(gazetteers.REGIONS, key=len, reverse=True))
_REGION_HEAD = rf"(?iUds)^(.*?[^ \t,])[ \t,]*(?:{_REGIONS})[ \t,]*$"


def _head(value: Column, tail: str) -> Column:
    """value before a tail that it ends in; value itself if it has none or is nothing else."""
    pattern = rf"(?Ud)^((?s:.*?)){tail}"
    found = F.regexp_extract(value, pattern, 1)
    return F.when(found != "", found).otherwise(value)


def narrow(text: Column, start: Column, end: Column, category: Column) -> Column:
    """struct<start, end> of what is left of a redaction of text, or null."""
    lo = F.least(F.greatest(start, F.lit(0)), F.length(text))
    hi = F.least(F.greatest(end, F.lit(0)), F.length(text))
    raw = F.substring(text, lo + 1, F.greatest(hi - lo, F.lit(0)))
    left = F.regexp_replace(raw, f"^{_EDGE}", "")
    first = F.struct((lo + F.length(raw) - F.length(left)).cast("int").alias("at"), F.regexp_replace(left, f"{_EDGE}$", "").alias("v"), F.lit(False).alias("done"))
    name = category.isin(*P.NAME_CATEGORIES)

    def step(s: Column, _: Column) -> Column:
        word = F.regexp_extract(s["v"], f"(?iUd){P.LEADING_PREPOSITION}", 0)
        # In a name a word in capitals belongs to it.
        word = F.when(name & (F.trim(word) != F.lower(F.trim(word))), "").otherwise(word)
        cue = F.when(name, "").otherwise(F.regexp_extract(s["v"], f"(?iUd){P.TRIM_CUE}", 0))
        lead = F.when(s["done"], "").when(word != "", word).otherwise(cue)
        rest = F.substring(s["v"], F.length(lead) + 1, F.length(s["v"]))
        kept = F.when(lead == "", s["v"]).otherwise(F.regexp_replace(rest, f"^{_EDGE}", ""))
        return F.struct((s["at"] + F.length(s["v"]) - F.length(kept)).cast("int").alias("at"), kept.alias("v"), (lead == "").alias("done"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(4)), first, step)

    def tails(s: Column) -> Column:
        dated = category.isin(*P.YEAR_SUFFIX) | ((category == "PROPERTY_ID") & F.substring(text, F.lit(1), s["at"]).rlike(P.NOTICE_CUE_BEFORE))
        v = F.when(dated, _head(_head(s["v"], P.TRAILING_DATE), P.TRAILING_YEAR)).otherwise(s["v"])
        head = F.regexp_extract(v, _REGION_HEAD, 1)
        v = F.when(head != "", head).otherwise(v)
        return F.when(F.length(v) > 0, F.struct(s["at"].alias("start"), (s["at"] + F.length(v)).alias("end")))

    return F.transform(F.array(found), tails)[0]


def narrowed(spans, text: str = "text_of_unit"):
    """Spans with their redactions narrowed; those of which nothing is left go.  text is the column of the unit's text."""
    new = F.when(F.col("action") == "REDACT", narrow(F.col(text), F.col("start"), F.col("end"), F.col("category"))).otherwise(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))
    rows = spans.withColumn("__n", new).filter("__n IS NOT NULL")
    kept = F.substring(F.col(text), F.col("__n.start") + 1, F.col("__n.end") - F.col("__n.start"))
    more = {"start": F.col("__n.start"), "end": F.col("__n.end")} | ({"text": kept} if "text" in spans.columns else {})
    return rows.withColumns(more).drop("__n")


