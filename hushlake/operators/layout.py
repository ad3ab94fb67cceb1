"""Positioned words to lines and text, and detections to regions of the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fill colours by name.
COLOURS = {"black": "000000", "white": "ffffff", "red": "ff0000", "green": "00ff00", "blue": "0000ff", "yellow": "ffff00", "gray": "808080", "grey": "808080", "orange": "ffa500"}


def lines(words: DataFrame, top_down: bool = False) -> DataFrame:
    """Words (doc_id, page, word_idx, text, x, y, width, height) with ``line`` and their byte range ``start``, ``end`` in the page's text.

    A word whose baseline is off the last one's by more than half the lesser
    height (1 at least) opens a line. Everything is by page, so a page is what a
    task holds.
    """
    page = Window.partitionBy("doc_id", "page")
    reading = page.orderBy(F.col("y") if top_down else F.desc("y"), "x", "word_idx")
    gap = F.abs(F.col("y") - F.lag("y").over(reading)) > F.greatest(F.least("height", F.lag("height").over(reading)) / 2, F.lit(1.0))
    w = words.withColumn("opens", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("line", F.sum("opens").over(reading.rowsBetween(Window.unboundedPreceding, 0)))
    in_line = page.orderBy("line", "x", "word_idx")
    size = F.octet_length("text") + 1
    return w.withColumn("start", F.coalesce(F.sum(size).over(in_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("end", F.col("start") + F.octet_length("text")).drop("opens")


def page_text(lined: DataFrame) -> DataFrame:
    """``(doc_id, page, text)``: words by a space, lines by a newline."""
    by_line = lined.groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_idx", "text"))), lambda x: x["text"]), " ").alias("t"))
    return by_line.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"))


def regions(lined: DataFrame, detected: DataFrame, padding: float = 0.0) -> DataFrame:
    """The padded union box of the words that each detection (doc_id, page, start, end, entity_type) overlaps; never below zero.

    Page is the equi-key, the overlap a residual condition: no nested loops over
    the table.
    """
    w, d = lined.alias("w"), detected.alias("d")
    met = w.join(d, (F.col("w.doc_id") == F.col("d.doc_id")) & (F.col("w.page") == F.col("d.page")) & (F.col("w.start") < F.col("d.end")) & (F.col("w.end") > F.col("d.start")))
    low = lambda c: F.greatest(F.min(c) - padding, F.lit(0.0))
    return met.groupBy("d.doc_id", "d.page", "d.start", "d.end", "d.entity_type").agg(low("w.x").alias("x0"), low("w.y").alias("y0"), (F.max(F.col("w.x") + F.col("w.width")) + padding).alias("x1"), (F.max(F.col("w.y") + F.col("w.height")) + padding).alias("y1"))


def colour(name: Column) -> Column:
    """Six hex digits of a colour name, #RGB or #RRGGBB; null for anything else."""
    low = F.lower(F.trim(name))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), low)
    return F.when(low.rlike("^#[0-9a-f]{6}$"), F.substr(low, F.lit(2))).when(low.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(F.substr(low, F.lit(2)), "(.)", "$1$1")).otherwise(named)
