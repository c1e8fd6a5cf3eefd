"""Line structure of converted texts: line types, runs of empty lines, titles and layout styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T

#: The markers of line types.
BULLETS = "\u2022\u00b7\u25aa\u25b8\u25ba-"
EMPTY_RUN = 2

#: Fixed values: (type, font, size in points, lines before, lines after, points needed on the page, alignment) of rendered lines.
STYLES = [
    ("h1", "Helvetica-Bold", 20, 0.8, 0.5, 80, "center"),
    ("h2", "Helvetica-Bold", 16, 0.6, 0.3, 60, "left"),
    ("h3", "Helvetica-Bold", 13, 0.4, 0.2, 50, "left"),
    ("bullet", "Helvetica", 11, 0.0, 0.0, 0, "left"),
    ("image-placeholder", "Helvetica-Oblique", 10, 0.0, 0.0, 0, "center"),
    ("empty", "Helvetica", 11, 0.4, 0.0, 0, "left"),
    ("body", "Helvetica", 11, 0.0, 0.0, 0, "left"),
]


def classified(line: Column, before: Column, after: Column) -> Column:
    """struct(type, text) of a line with its neighbours."""
    w = T.WHITE
    both = lambda mark: F.rlike(before, F.lit(f"^{mark}{{10,}}\\z")) & F.rlike(after, F.lit(f"^{mark}{{10,}}\\z"))
    typed = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    trimmed, bullet = T.trim_white(line), rf"^[{w}]*[{BULLETS}][{w}]+"
    return (
        F.when(both("="), typed("h1", trimmed))
        .when(both("-"), typed("h2", trimmed))
        .when(F.rlike(line, F.lit(rf"^###[{w}]+")), typed("h3", T.trim_white(F.regexp_replace(line, rf"^###[{w}]+", ""))))
        .when(F.rlike(line, F.lit("^[=\u2500\\-]{10,}\\z")), typed("separator", F.lit("")))
        .when(F.rlike(line, F.lit(bullet)), typed("bullet", T.trim_white(F.regexp_replace(line, bullet, ""))))
        .when(F.rlike(trimmed, F.lit(rf"^\[Image{T.DOT}*\]\z")), typed("image-placeholder", trimmed))
        .when(trimmed == "", typed("empty", F.lit("")))
        .otherwise(typed("body", line))
    )


def classify_lines(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(keep..., line_no, type, text) of every line.

    Neighbours are read from the array of lines, so no window and no shuffle is needed.
    """
    df = T.once(df.select(*keep, F.col(text).alias("_text")), _lines=T.lines_of(F.col("_text")))
    near = lambda i: F.coalesce(F.when(i >= 0, F.get("_lines", i)), F.lit(""))
    typed = F.transform("_lines", lambda line, i: classified(line, near(i - 1), near(i + 1)))
    return df.select(*keep, F.posexplode(typed).alias("line_no", "_l")).select(*keep, "line_no", "_l.type", "_l.text")


def rendered(lines: DataFrame, *key: str) -> DataFrame:
    """lines with ``rendered``: false for separators, which neither count nor end a run, and for the empty lines past the second of a run."""
    order = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ended = lines.withColumn("_run", F.sum(F.when(F.col("type").isin("empty", "separator"), 0).otherwise(1)).over(order))
    within = Window.partitionBy(*key, "_run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.sum(F.when(F.col("type") == "empty", 1).otherwise(0)).over(within)
    return ended.withColumn("rendered", (F.col("type") != "separator") & ((F.col("type") != "empty") | (nth <= EMPTY_RUN))).drop("_run")


def styled(lines: DataFrame) -> DataFrame:
    """lines with the layout style of their type, a constant lookup; a separator has none."""
    pick = lambda i: F.element_at(F.create_map(*[x for s in STYLES for x in (F.lit(s[0]), F.lit(s[i]))]), F.col("type"))
    return lines.withColumns({"font": pick(1), "size": pick(2), "lines_before": pick(3), "lines_after": pick(4), "needed": pick(5), "align": pick(6)})


def doc_title(text: Column, fallback: Column) -> Column:
    """The first of ten lines that is neither blank nor a separator, up to 100 characters, or else the fallback."""
    first = F.transform(F.slice(T.lines_of(text), 1, 10), T.trim_white)
    good = F.filter(first, lambda x: (x != "") & ~F.rlike(x, F.lit(rf"^[=\-\u2500#{T.WHITE}]*\z")))
    return F.coalesce(F.substring(F.get(good, F.lit(0)), 1, 100), fallback)
