"""HTML to readable text, chapter titles and the plainer cleaning of scraped chapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as T

#: What marks headings, rules, list items and table cells in the text.
H1_RULE, H2_RULE, HR_RULE, BULLET, CELLS = "=" * 60, "-" * 40, "\u2500" * 40, "  \u2022 ", " | "
BLOCKS = "p|div|blockquote|section|article|aside|figure|figcaption"
TAG = r"<[^>]*>"


def _inner(c: Column) -> Column:
    return T.trim_white(F.regexp_replace(c, TAG, ""))


def _between(open_tag: str, close_tag: str) -> str:
    return rf"(?is){open_tag}[^>]*>(.*?){close_tag}"


def _row_text(row: Column) -> Column:
    cells = F.regexp_extract_all(row, F.lit(_between("<t[dh]", "</t[dh]>")), 1)
    return F.concat(F.array_join(F.transform(cells, _inner), CELLS), F.lit("\n"))


def _boxed(rule: str, upper: bool = False):
    def make(c: Column) -> Column:
        inner = F.upper(_inner(c)) if upper else _inner(c)
        return F.concat(F.lit(f"\n{rule}\n"), inner, F.lit(f"\n{rule}\n\n"))

    return make


def tidy(c: Column) -> Column:
    """Single spaces, no spaces around line ends, at most three line ends in a row, trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), " *\n *", "\n")
    return T.trim_white(F.regexp_replace(c, "\n{4,}", "\n\n\n"))


#: The steps in order: each takes the text so far.
STEPS = [
    lambda c: F.regexp_replace(c, r"(?is)<head[\s>].*?</head>", ""),
    lambda c: F.regexp_replace(c, r"(?is)<script[\s>].*?</script>", ""),
    lambda c: F.regexp_replace(c, r"(?is)<style[\s>].*?</style>", ""),
    lambda c: T.map_matches(c, _between("<h1", "</h1>"), _boxed(H1_RULE, upper=True)),
    lambda c: T.map_matches(c, _between("<h2", "</h2>"), _boxed(H2_RULE)),
    lambda c: T.map_matches(c, _between("<h3", "</h3>"), lambda x: F.concat(F.lit("\n### "), _inner(x), F.lit("\n\n"))),
    lambda c: T.map_matches(c, _between("<h[4-6]", "</h[4-6]>"), lambda x: F.concat(F.lit("\n"), _inner(x), F.lit("\n\n"))),
    lambda c: F.regexp_replace(F.regexp_replace(c, r"(?i)<hr[^>]*/?>", f"\n{HR_RULE}\n"), r"(?i)<br\s*/?>", "\n"),
    lambda c: F.regexp_replace(F.regexp_replace(c, f"(?i)</({BLOCKS})>", "\n\n"), f"(?i)<({BLOCKS})[^>]*>", ""),
    lambda c: T.map_matches(c, _between("<li", "</li>"), lambda x: F.concat(F.lit(BULLET), _inner(x), F.lit("\n"))),
    lambda c: F.regexp_replace(F.regexp_replace(c, "(?i)</(ul|ol)>", "\n"), "(?i)<(ul|ol)[^>]*>", "\n"),
    lambda c: T.map_matches(c, _between("<tr", "</tr>"), _row_text),
    lambda c: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(c, r"""(?i)<img[^>]*alt=["']["'][^>]*/?>""", "[Image]"), r"""(?i)<img[^>]*alt=["']([^"']*)["'][^>]*/?>""", "[Image: $1]"), r"(?i)<img[^>]*/?>", "[Image]"
    ),
    lambda c: F.regexp_replace(c, TAG, ""),
]


def html_to_text(df: DataFrame, html: str = "html", out: str = "text", entities: Callable[[Column], Column] = T.decode_entities) -> DataFrame:
    """df with the readable text of an HTML column; a null stays null.

    Headings are marked (the first level in capitals), list items bulleted, table rows joined, images named by their alternative
    text; entities are decoded last, by ``entities``. All steps are narrow; each is its own projection to keep generated methods small.
    """
    df = df.withColumn(out, F.col(html))
    for step in STEPS:
        df = df.withColumn(out, step(F.col(out)))
    return df.withColumn(out, entities(F.col(out))).withColumn(out, tidy(F.col(out)))


def chapter_title(df: DataFrame, html: str = "html", out: str = "title", entities: Callable[[Column], Column] = T.decode_entities) -> DataFrame:
    """df with the title element's text, or else the first heading's up to level three, or else null."""
    first = lambda p: F.regexp_replace(F.regexp_extract(F.col(html), p, 1), TAG, "")
    df = df.withColumn("_t", T.trim_white(entities(first(_between("<title", "</title>"))))).withColumn(
        "_h", T.trim_white(entities(first(_between("<h[1-3]", "</h[1-3]>"))))
    )
    return df.withColumn(out, F.coalesce(F.nullif("_t", F.lit("")), F.nullif("_h", F.lit("")))).drop("_t", "_h")


#: Fixed value: where scraped pages keep the chapter.
CHAPTER_BLOCK = r"""(?is)<div[^>]*id=["'](?:showReading|chaptercontent)["'][^>]*>(.*?)</div>"""


def scrape_clean(c: Column) -> Column:
    """Plainer cleaning of a scraped chapter: named entities one after the other, decimal ones by 16-bit code."""
    for pattern, text in [(r"(?i)<br\s*/?>", "\n"), ("(?i)</p>", "\n"), ("(?i)<sent[^>]*>", ""), ("(?i)</sent>", ""), ("<[^>]+>", ""), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"')]:
        c = F.regexp_replace(c, pattern, text)
    unit = lambda n: F.decode(F.unhex(F.lpad(F.hex(F.pmod(n.cast("decimal(38,0)"), F.lit(65536)).cast("long")), 4, "0")), "UTF-16BE")
    c = T.map_matches(c, r"&#(\d+);", unit)
    c = F.regexp_replace(c, r"(?s)\(adsbygoogle.*?\);", "")
    return T.trim_white(F.regexp_replace(c, "\n{3,}", "\n\n"))


def scraped_chapters(df: DataFrame, html: str = "html", block: str = CHAPTER_BLOCK, out: str = "text") -> DataFrame:
    """df with the cleaned chapter of each page; null where the block is missing or empty, which counts as a failure."""
    found = T.once(df, _block=F.regexp_extract_all(F.col(html), F.lit(block), 1))
    cleaned = T.once(found, _clean=scrape_clean(F.get("_block", F.lit(0))))
    return cleaned.withColumn(out, F.nullif("_clean", F.lit(""))).drop("_block", "_clean")
