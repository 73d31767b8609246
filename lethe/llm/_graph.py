"""Connected components of a link table, and links of bucket members, without collecting either."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm._store import cut, discard, scope


#: Links that one task can join as fast as many.
FEW = 100_000


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # The least neighbour of u hangs u, and its other neighbours.
    found = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
    return found.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b")).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether each node hangs below one other and none hangs below a node that hangs itself."""
    many = e.groupBy("a").agg(F.count("*").alias("c")).filter("c > 1")
    return many.isEmpty() and e.join(e.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node of its component.

    Alternating large and small stars: each round hangs the neighbours of a node below
    the smallest of them, until every component is one star.  The reads of a node's
    neighbours are joins that adaptive execution may split, so a node with very many
    links needs no single task; up to FEW links are joined in one task, without shuffles.  The table of a round is deleted when the next one is written.
    Null ends are dropped; no links give no rows.
    """
    e = cut(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    dealt = (lambda df: df.coalesce(1)) if e.count() <= FEW else (lambda df: df)
    while not _stars(dealt(e)):
        before, e = e, cut(_small_star(_large_star(dealt(e))))
        discard(before)
    both = F.explode(F.array_distinct(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))))
    out = cut(dealt(e).select(both.alias("x")).select("x.*").distinct())
    discard(e)
    return out


#: Buckets of at most this many members are compared pairwise at once.
SMALL = 8


def connect_members(members: DataFrame, attrs: list[str], may: str, verify: Callable[[DataFrame], DataFrame], *, rounds: int = 3, small: int = SMALL, central: str = "0", near: str = "0", last: tuple[DataFrame, str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(node, root) of the members that some verified pair of a bucket connects with others.

    members: (sig, cls, *attrs), a row for each bucket sig that holds the member cls.  may: SQL over
    x_<attr> and y_<attr> that is true of every pair that can link.  verify: of pairs (a, b), those that link.

    Buckets of up to ``small`` members are compared pairwise; near: SQL over x_<attr> and y_<attr> that is the less, the likelier a pair links, summed over the buckets that a pair shares;
    pairs: more such pairs (a, b, d), with their sums d.  Of larger ones no pairs are formed at first: in each round one
    member of a bucket that is connected with none of its earlier centres is made a centre, that with the least ``central`` (SQL
    over attrs), and all that are apart from it are verified against it.  What is still apart after the rounds is
    compared pairwise.  last: more attributes by cls, and SQL over all of them that is true
    of every pair that can link, for that comparison; a sharper bound there keeps a group of members
    that cannot link from being written out as pairs.  Tables made on the way are deleted.
    """
    spark = members.sparkSession

    def side(df: DataFrame, key: str, mark: str) -> DataFrame:
        return df.select("sig", F.col("cls").alias(key), *[F.col(c).alias(f"{mark}_{c}") for c in ("root", *attrs) if c in df.columns])

    def pairwise(df: DataFrame) -> DataFrame:
        return side(df, "a", "x").join(side(df, "b", "y"), "sig").filter(f"a < b AND ({may})").select("a", "b", F.expr(near).alias("d"))

    with scope(spark) as keep:
        many = cut(members.groupBy("sig").agg(F.count("*").alias("c")).filter(F.col("c") > small).select("sig"))
        rest = pairwise(members.join(many, "sig", "left_anti"))
        rest = cut((rest if pairs is None else rest.union(pairs)).groupBy("a", "b").agg(F.sum("d").alias("d")))
        large = cut(members.join(many, "sig"))
        roots = None
        # What is connected is handed on as stars, so that links do not pile up.
        also = lambda good: cut(good if roots is None else roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(good))
        # Each member is verified against the nearest of its partners that are apart from it, twice, and then against all that are left.
        for k in range(3):
            pick = rest.select("a", "b") if k == 2 else cut(rest.groupBy("b").agg(F.min(F.struct("d", "a")).alias("x")).select(F.col("x.a").alias("a"), "b"))
            links, before = also(verify(pick)), roots
            roots = components(links)
            discard(before, links)
            if k == 2:
                break
            root = lambda key: roots.select(F.col("node").alias(key), F.col("root").alias(f"{key}_root"))  # noqa: E731, B023
            apart = rest.join(pick, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left").filter("coalesce(a_root, a) != coalesce(b_root, b)")
            old, rest = rest, cut(apart.select("a", "b", "d"))
            discard(old, pick)
            if rest.isEmpty():
                break
        if large.isEmpty():
            return keep(roots)
        centres = None
        for k in range(rounds):
            todo = cut(large.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
            lone = todo.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("sig")
            free = todo.join(lone, "sig", "left_semi")
            if centres is not None:
                held = todo.join(centres.withColumnRenamed("b", "cls"), ["sig", "cls"]).select("sig", "root").distinct()
                free = free.join(held, ["sig", "root"], "left_anti")
            best = F.min(F.struct(F.expr(central).alias("p"), F.xxhash64("cls", F.lit(k)).alias("q"), F.col("cls").alias("b"), F.col("root").alias("y_root"), *[F.col(c).alias(f"y_{c}") for c in attrs]))
            centre = cut(free.groupBy("sig").agg(best.alias("x")).select("sig", "x.*").drop("p", "q"))
            centres = centre.select("sig", "b") if centres is None else centres.union(centre.select("sig", "b"))
            spokes = side(todo, "a", "x").join(centre, "sig").filter(f"x_root != y_root AND ({may})").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            good = cut(verify(spokes.distinct()))
            discard(todo)
            if k and good.isEmpty():
                break
            links, before = also(good), roots
            roots = components(links)
            discard(before, links, good)
        todo = large.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        # Members of a bucket's largest component are not compared with each other.
        count = todo.groupBy("sig", "root").agg(F.count("*").alias("c"))
        most = count.groupBy("sig").agg(F.max(F.struct("c", "root")).alias("x"), F.count("*").alias("n")).filter("n > 1").select("sig", F.col("x.root").alias("most"))
        todo = cut(todo.join(most, "sig"))
        if todo.isEmpty():
            return keep(roots)
        more = "true"
        if last:
            held, more = last
            attrs = [*attrs, *(c for c in held.columns if c != "cls")]
            todo = todo.join(held, "cls")
        rest = side(todo.filter("root != most"), "a", "x").join(side(todo, "b", "y"), "sig").filter(f"x_root != y_root AND ({may}) AND ({more})")
        good = cut(verify(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        return keep(roots if good.isEmpty() else components(also(good)))
