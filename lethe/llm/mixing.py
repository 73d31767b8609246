"""Mixing sources to target weights by Pareto order sampling.

Sources share ``share`` times all words by weight; a target stops at ``most`` times its source's
words and what is over is shared again.  A target of r times a source's words gives every
document floor(r) whole copies; the rest is a fixed-size sample of unequal inclusion
probabilities p, in proportion to the square root of a document's length (documents for which that
reaches 1 are certain).  Documents are ranked by (u / (1 - u)) / (p / (1 - p)), u being uniform
by hash, and taken from the lowest rank until the words that are left of the target are
reached as nearly as whole documents allow.

A source is never ranked in one task: ranks are cut into buckets whose sizes are summed,
and only the bucket in which the target is reached is sorted, so a source that holds
a third of all rows costs no more than its share.

Defined cases: a null or empty text has size 0 and takes no words; null is a source of its own and
sorts last; repeated rows and ids are separate documents (u comes from id, length and text, so equal rows
tie and any of them may be the last one taken); an empty table gives no rows; a
source without words has target 0; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm import _store

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BUCKETS = 4096
SEED = 17
MADE = ("size", "source_size", "target", "copies", "taken")
WORD = r"[^\x20\x09-\x0D]+"
_P = _store.OWN


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    t = t.withColumns(
        {
            "below": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
            "total": share * F.sum("source_size").over(Window.partitionBy()),
        }
    ).withColumn("level", (F.col("total") - F.col("below")) / F.col("rest"))
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(Window.partitionBy())
    return t.withColumn("level", level).select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, buckets: int = BUCKETS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with size, source_size, target, copies and taken = copies * size."""
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in MADE and not c.startswith(_P)]
    body, names = _store.column(docs, text, "string"), {c: f"{_P}c{i}" for i, c in enumerate(carried)}
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        _store.column(docs, source, "string").alias("source"),
        _store.column(docs, doc_id, "string").alias("id"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(body, F.lit("")).cast("binary")).alias("text_md5"),
    )
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("id", F.lit("")), F.col("size").cast("string"), "text_md5"))
    u = (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = _store.stored(rows.withColumn("u", u), "mix")

    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = goal.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = _store.cut(goal.withColumn("left", F.col("target") - F.col("base") * F.col("source_size")))

    # p = least(1, c * g): the c with which the expected words are those that are left.
    g = F.ceil(F.sqrt("size")).cast("long")
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    hist = rows.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).join(_same(goal), F.col("source").eqNullSafe(F.col("s_")))
    above = F.coalesce(F.sum(F.col("size") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.sum(g * F.col("size") * F.col("n")).over(down.rowsBetween(0, Window.unboundedFollowing))
    c = (F.col("left") - above) / here
    fits = hist.select("source", "size", c.alias("c"), (c * g <= 1.0).alias("ok"))
    scale = fits.filter("ok").groupBy("source").agg(F.max_by("c", "size").alias("c"))

    with_goal = _same(goal).join(scale.select(F.col("source").alias("t_"), "c"), F.col("s_").eqNullSafe(F.col("t_")), "left").drop("t_")
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("c", F.lit(1.0)) * g))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    # The rank as a number from 0 to 1; certain documents come first, impossible ones last.
    rank = F.when(F.col("p") >= 1.0, F.lit(0.0)).when(F.col("p") <= 0.0, F.lit(1.0)).otherwise(odds / (1 + odds))
    ranked = rows.join(with_goal, F.col("source").eqNullSafe(F.col("s_"))).drop("s_").withColumn("p", p).withColumn("v", rank)
    ranked = ranked.withColumn("b", F.least(F.floor(F.col("v") * buckets), F.lit(buckets)).cast("int"))

    up = Window.partitionBy("source").orderBy("b")
    sums = ranked.groupBy("source", "b").agg(F.sum("size").alias("s"), F.max("left").alias("left"))
    sums = sums.withColumn("before", F.sum("s").over(up) - F.col("s")).filter("left > 0 AND before < left AND before + s >= left")
    edge = sums.groupBy("source").agg(F.min("b").alias("eb"), F.min_by("before", "b").alias("before"))
    ranked = ranked.join(edge.select(F.col("source").alias("s_"), "eb", "before"), F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
    order = Window.partitionBy("source").orderBy("v", "id", "text_md5")
    at_edge = F.coalesce(F.col("b") == F.col("eb"), F.lit(False))
    inside = ranked.filter(at_edge).withColumn("to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("extra", (F.col("before") + F.col("to") - F.col("size") / 2.0 <= F.col("left")).cast("long")).drop("to")
    clear = ranked.filter(~at_edge).withColumn("extra", F.when(F.col("left") <= 0, F.lit(False)).otherwise(F.col("eb").isNull() | (F.col("b") < F.col("eb"))).cast("long"))
    out = clear.unionByName(inside).withColumn("copies", F.col("base") + F.col("extra"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _same(goal: DataFrame) -> DataFrame:
    return goal.withColumnRenamed("source", "s_")


def take(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, each once, with docs' columns and copies and taken."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}_" for i in range(len(names))])
    at = {k: f"c{names.index(options.pop(k, k))}_" for k in ("text", "source", "doc_id")}
    own = [F.col(f"c{i}_").alias(n) for i, n in enumerate(names) if n.lower() not in MADE]
    return mix(plain, **at, **options).filter("copies > 0").select(*own, "copies", "taken")
