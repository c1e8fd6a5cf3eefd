"""Text lines from positioned text items of document pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.html_text import tidy


def page_texts(items: DataFrame) -> DataFrame:
    """(doc_id, page, text) of items(doc_id, page, item_idx, str, x, y, width, has_eol).

    Items without a string are skipped. A vertical step of more than one unit begins a line; a horizontal gap of more than one unit
    gets a space unless one is there; an end-of-line mark ends the line and forgets the position.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("item_idx")
    items = items.where(F.col("str").isNotNull())
    eol = F.coalesce(F.lag("has_eol").over(w), F.lit(True))
    seen = items.withColumns({"_eol": eol, "_y": F.lag("y").over(w), "_end": F.lag(F.col("x") + F.coalesce("width", F.lit(0.0))).over(w)})
    breaks = ~F.col("_eol") & (F.abs(F.col("_y") - F.col("y")) > 1)
    gap = ~F.col("_eol") & ~breaks & (F.col("x") - F.col("_end") > 1) & (F.col("str") != "") & ~F.startswith("str", F.lit(" "))
    # What the text so far ends with: the last of a line end, a break or a non-empty string before this item.
    tail = F.when(F.coalesce("has_eol", F.lit(False)), F.lit("\n")).when(F.col("str") != "", F.substring("str", -1, 1)).when(breaks, F.lit("\n"))
    seen = seen.withColumns({"_break": breaks, "_gap": gap, "_tail": tail})
    ends = F.last("_tail", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # An inserted space before an empty string cannot happen: a gap needs a non-empty string.
    lead = F.when(F.col("_break"), "\n").when(F.col("_gap") & (F.coalesce(ends, F.lit("")) != " "), " ").otherwise("")
    piece = F.concat(lead, "str", F.when(F.coalesce("has_eol", F.lit(False)), "\n").otherwise(""))
    pieces = seen.select("doc_id", "page", "item_idx", piece.alias("piece"))
    joined = pieces.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("item_idx", "piece"))).alias("p"))
    return joined.select("doc_id", "page", tidy(F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias("text"))
