"""Text units of documents, their places in the joined text, limits, chunks and rendered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.operators.patterns import DECISION_TITLE, HEADER_CUES

# Limits on documents and chunks.
MAX_TEXT_CHARS, MAX_CHUNKS, CHUNK_CHARS = 400_000, 150, 3_000


def text_units(docs: DataFrame, document: str = "doc_id", text: str = "text") -> DataFrame:
    """(document, unit_ord, text): the lines of each text that are not empty, numbered from 0."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return docs.select(document, F.posexplode(lines).alias("unit_ord", "text"))


def offsets(units: DataFrame, document: str = "doc_id") -> DataFrame:
    """units with the place of each in the document's units joined by line breaks."""
    before = Window.partitionBy(document).orderBy("unit_ord").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))


def limits(units: DataFrame, document: str = "doc_id", most: int = MAX_TEXT_CHARS) -> DataFrame:
    """Characters of each document and the code of the limit that it breaks, if any."""
    return units.groupBy(document).agg(F.sum(F.length("text")).cast("long").alias("chars"), F.count("*").alias("units")).withColumn("code", F.when(F.col("chars") > most, F.lit("text_too_long")))


def pack(units: DataFrame, document: str = "doc_id", size: int = CHUNK_CHARS, table: str = "table_index", part: str = "part_name") -> DataFrame:
    """(document, unit_ord, chunk): each table is a chunk, tables first; other units are packed in order, joined by line breaks, and never split.

    Only the first units of chunks are gathered on the way through a document.
    """
    tabled = table in units.columns
    where = F.struct(F.col(part) if part in units.columns else F.lit(""), F.col(table)) if tabled else F.lit(None)
    own = units.select(document, "unit_ord", F.length("text").alias("n"), F.when(F.col(table).isNotNull() if tabled else F.lit(False), where.cast("string")).alias("t"))
    cells, plain = own.filter("t IS NOT NULL"), own.filter("t IS NULL")
    tables = cells.groupBy(document, "t").agg(F.min("unit_ord").alias("o"))
    tables = tables.withColumn("chunk", F.row_number().over(Window.partitionBy(document).orderBy("o")) - 1)
    per = plain.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("unit_ord", "n"))).alias("us"))
    new = f"size(s.firsts) = 0 OR s.used + 1 + u.n > {size}"
    step = f"aggregate(us, struct(CAST(array() AS array<int>) AS firsts, 0 AS used), (s, u) -> struct(if({new}, concat(s.firsts, array(u.unit_ord)), s.firsts) AS firsts, if({new}, u.n, s.used + 1 + u.n) AS used), s -> s.firsts)"
    starts = per.select(document, F.posexplode(F.expr(step)).alias("k", "first"))
    before = tables.groupBy(document).agg(F.count("*").cast("int").alias("before"))
    both = plain.select(document, "unit_ord", F.lit(None).cast("int").alias("k")).unionByName(starts.select(document, F.col("first").alias("unit_ord"), "k"))
    up = Window.partitionBy(document).orderBy("unit_ord", F.col("k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("at", F.last("k", ignorenulls=True).over(up)).filter("k IS NULL").join(before, document, "left")
    out = placed.select(document, "unit_ord", (F.col("at") + F.coalesce("before", F.lit(0))).alias("chunk"))
    return out.unionByName(cells.join(tables.select(document, "t", "chunk"), [document, "t"]).select(document, "unit_ord", "chunk")) if tabled else out


def render(units: DataFrame, document: str = "doc_id", table: str = "table_index") -> tuple[DataFrame, DataFrame]:
    """(document, chunk, text) as a reader sees each chunk, and units with at, the place of their text in it.

    units: with chunk, and of cells row_index and col_index.  Lines of text are joined by line breaks; a table begins with TABLE: and has a line for each row, cells joined by bars.
    """
    tabled = F.col(table).isNotNull() if table in units.columns else F.lit(False)
    order = ["row_index", "col_index", "unit_ord"] if table in units.columns else ["unit_ord"]
    line = Window.partitionBy(document, "chunk").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    first = F.row_number().over(line) == 1
    same = F.coalesce(F.lag("row_index").over(line) == F.col("row_index"), F.lit(False)) if table in units.columns else F.lit(False)
    lead = F.when(tabled & first, "TABLE:\n").when(tabled & same, " | ").when(first, "").otherwise("\n")
    rows = units.withColumn("lead", lead)
    ahead = F.sum(F.length("lead") + F.length("text")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("at", (ahead - F.length("text")).cast("int")).withColumn("k", F.row_number().over(line))
    texts = rows.groupBy(document, "chunk").agg(F.array_sort(F.collect_list(F.struct("k", F.concat("lead", "text").alias("x")))).alias("xs"))
    return texts.select(document, "chunk", F.array_join(F.transform("xs", lambda x: x["x"]), "").alias("text")), rows.drop("lead", "k")


def render_tables(cells: DataFrame, table: str, row: str, col: str, text: str) -> DataFrame:
    """Each table as TABLE:, then its rows, cells joined by bars."""
    rows = cells.groupBy(table, row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(col).alias("c"), F.col(text).alias("t")))), lambda x: x["t"]), " | ").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col("line")))), lambda x: x["line"])
    return rows.groupBy(table).agg(F.concat(F.lit("TABLE:\n"), F.array_join(lines, "\n")).alias("rendered"))


def locate(positions: DataFrame, units: DataFrame, document: str = "doc_id", position: str = "position") -> DataFrame:
    """The last unit that begins at or before each position of its document (as-of join).

    One sorted pass: units and positions are merged and the last unit is carried forward.
    """
    both = units.select(document, F.col("offset").alias("at"), F.lit(0).alias("kind"), F.col("unit_ord").alias("u"), F.lit(None).cast("long").alias("p")).unionByName(
        positions.select(document, F.col(position).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("u"), F.col(position).cast("long").alias("p"))
    )
    up = Window.partitionBy(document).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("unit_ord", F.last("u", ignorenulls=True).over(up)).filter("kind = 1").select(document, F.col("p").alias(position), "unit_ord")


def header_units(units: DataFrame, document: str, cues: str = HEADER_CUES, title: str = DECISION_TITLE, first: int = 30) -> DataFrame:
    """Units among a document's first ones, before its title, that hold cues: the authority's header."""
    up = Window.partitionBy(document).orderBy("unit_ord").rowsBetween(Window.unboundedPreceding, 0)
    seen = units.filter(F.col("unit_ord") < first).withColumn("titled", F.max(F.col("text").rlike(title)).over(up))
    n: Column = F.regexp_count("text", F.lit(cues))
    return seen.filter(~F.col("titled")).withColumn("cues", n).filter("cues > 0").withColumn("confidence", F.when(F.col("cues") >= 2, 1.0).otherwise(0.7)).drop("titled")
