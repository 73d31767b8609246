"""Conflict resolution: one owner for each character, as an interval sweep over window functions.

A span's tier and a total order over a unit's spans decide; the owner of a character is the span of the
highest tier, of equal ones the first in order.  Only the ends of spans are ever compared, so
the cost follows the number of spans, not of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The policy.
PRESERVE_HIGH, REDACT_HIGH, REDACT = 0.8, 0.9, 0.7
HARD_PRESERVE = ("DOU", "PUBLIC_SERVICE", "LEGAL_REF", "MONEY", "TAX_YEAR", "ARTICLE_REF", "COURT_DECISION", "DECISION_METADATA", "PERCENTAGE", "FISCAL_PERIOD", "FIELD_LABEL", "PROCEDURAL_DATE")
HARD_REDACT = ("AFM", "AMKA", "IBAN", "EMAIL", "PROPERTY_ID", "LOCALITY")
STRUCTURED = ("AFM", "AMKA", "IBAN", "EMAIL")
GLYPH = "."


def tier(policy=None) -> Column:
    """Rank of a span from 8 down to 0; 0 never owns a character.  policy: another one than the built-in, with the same names in lower case."""
    preserve_high, redact_high, redact = (policy.preserve_high, policy.redact_high, policy.redact) if policy else (PRESERVE_HIGH, REDACT_HIGH, REDACT)
    hard_redact, hard_preserve = (policy.hard_redact, policy.hard_preserve) if policy else (HARD_REDACT, HARD_PRESERVE)
    action, category, confidence, rule = F.col("action"), F.col("category"), F.coalesce("confidence", F.lit(0.0)), F.col("origin") == "deterministic"
    second = F.col("origin") == "llm_pass2"
    return (
        F.when(rule & (action == "REDACT") & category.isin(*hard_redact) & (confidence >= redact_high), 8)
        .when(rule & (action == "PRESERVE") & category.isin(*hard_preserve), 7)
        .when(second & (action == "PRESERVE"), 6)
        .when(second & (action == "REDACT"), 5)
        .when(second, 0)
        .when((action == "REDACT") & category.isin(*STRUCTURED) & (confidence >= redact_high), 4)
        .when((action == "PRESERVE") & (confidence >= preserve_high), 3)
        .when((action == "REDACT") & (confidence >= redact), 2)
        .when(action == "PRESERVE", 1)
        .otherwise(0)
    )


def resolve(spans: DataFrame, keys: list[str], length: str | None = None, policy=None) -> DataFrame:
    """Disjoint runs (keys, start, end, action, category, detector, tier) of the spans of each unit.

    Equal neighbours of different spans stay apart.  REVIEW spans are refused by the job.
    """
    ok = F.assert_true(F.col("action") != "REVIEW", F.lit("REVIEW spans cannot be resolved"))
    end = F.least("end", F.col(length)) if length else F.col("end")
    # The assertion is null when it holds.
    s = spans.withColumns({"start": F.greatest("start", F.lit(0)), "end": end, "tier": tier(policy) + F.coalesce(ok.cast("int"), F.lit(0))}).filter("tier > 0 AND end > start")
    order = Window.partitionBy(*keys).orderBy("start", (F.col("start") - F.col("end")), F.col("confidence").desc(), "action", "origin", "category", "detector", "reason")
    s = s.withColumn("rank", F.row_number().over(order))
    # The ends of a unit's spans are numbered; a span meets the pieces between its own two, so only pieces that it covers are made.
    ends = s.select(*keys, F.struct("rank", "action", "category", "detector", "tier").alias("s"), F.explode(F.array("start", "end")).alias("a"))
    ends = ends.withColumn("n", F.dense_rank().over(Window.partitionBy(*keys).orderBy("a")))
    covers = ends.groupBy(*keys, "s").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    covers = covers.select(*keys, "s.*", F.explode(F.expr("sequence(first, last - 1)")).alias("n"))
    pieces = ends.groupBy(*keys, "n").agg(F.min("a").alias("a"))
    pieces = pieces.withColumn("b", F.lead("a").over(Window.partitionBy(*keys).orderBy("n"))).filter("b IS NOT NULL")
    inside = pieces.join(covers, [*keys, "n"])
    best = F.max_by(F.struct("rank", "action", "category", "detector", "tier"), F.struct("tier", -F.col("rank")))
    owned = inside.groupBy(*keys, "a", "b").agg(best.alias("o")).select(*keys, "a", "b", "o.*")
    line = Window.partitionBy(*keys).orderBy("a")
    new = (F.lag("rank").over(line) != F.col("rank")) | (F.lag("b").over(line) != F.col("a"))
    runs = owned.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(line))
    return runs.groupBy(*keys, "run").agg(F.min("a").alias("start"), F.max("b").alias("end"), *[F.first(c).alias(c) for c in ("action", "category", "detector", "tier")]).drop("run")


def mask(units: DataFrame, plan: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """units with the characters of REDACT runs replaced one for one."""
    cuts = plan.filter(F.col("action") == "REDACT").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    kept = f"transform(cuts, (c, i) -> concat(substring({text}, if(i = 0, 0, cuts[i - 1].end) + 1, c.start - if(i = 0, 0, cuts[i - 1].end)), repeat('{GLYPH}', c.end - c.start)))"
    body = F.expr(f"array_join(concat({kept}, array(substring({text}, element_at(cuts, -1).end + 1, length({text})))), '')")
    return units.join(cuts, keys, "left").withColumn(text, F.when(F.col("cuts").isNull(), F.col(text)).otherwise(body)).drop("cuts")


def summary(plan: DataFrame) -> DataFrame:
    """Counts by action, category and detector, and of all."""
    sets = plan.groupingSets([[F.col("action")], [F.col("category")], [F.col("detector")], []], "action", "category", "detector")
    return sets.agg(F.count("*").alias("n"))


def inconsistent(spans: DataFrame, document: str) -> DataFrame:
    """Strings that a document both redacts and preserves: a digest and the length, never the text."""
    low = F.replace(F.lower("text"), F.lit("ς"), F.lit("σ"))
    both = spans.filter(F.col("action").isin("REDACT", "PRESERVE")).groupBy(document, low.alias("low")).agg(F.count_distinct("action").alias("c")).filter("c = 2")
    return both.select(document, F.substring(F.sha2("low", 256), 1, 12).alias("digest"), F.length("low").cast("long").alias("length"))
