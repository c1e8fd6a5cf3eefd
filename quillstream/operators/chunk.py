"""Splitting texts into size-bounded chunks on paragraph and sentence borders, in two variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as T

WEB_LIMIT, LLM_LIMIT = 4500, 4000
#: A sentence with its terminators and the white space after them; or an unterminated rest, so that no text is scanned twice.
SENTENCE = rf"[^.!?]++(?:[.!?]++[{T.WHITE}]*+|\z)"
STRUCTURAL_WEB, STRUCTURAL_LLM = "=\\-\u2500#", "=\\-\u2500#\u2550"
_STATE = "struct<done:array<string>,cur:string,n:int>"


def sentences(paragraph: Column, lossless: bool = False) -> Column:
    """The terminated sentences of a paragraph, or the paragraph if it has none.

    What precedes or follows all terminated sentences is lost unless ``lossless``, which keeps it as parts of its own.
    """
    if lossless:
        found = F.regexp_extract_all(paragraph, F.lit(rf"[.!?]*+{SENTENCE}|[.!?]++[{T.WHITE}]*+"), 0)
    else:
        found = F.filter(F.regexp_extract_all(paragraph, F.lit(SENTENCE), 0), lambda s: F.rlike(s, F.lit("[.!?]")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(paragraph))


def _tokens(text: Column, limit: int, trimmed: bool, lossless: bool) -> Column:
    """Paragraphs (kind p), and for longer ones a flush (f) and their sentences (s), each with its measured and kept length."""

    def token(kind: str, s: Column, kept: Column | None = None) -> Column:
        kept = s if kept is None else kept
        return F.struct(F.lit(kind).alias("kind"), kept.alias("s"), T.utf16_length(s).alias("n"), T.utf16_length(kept).alias("m"))

    def of(para: Column) -> Column:
        parts = sentences(para, lossless)
        if trimmed:
            parts = F.filter(F.transform(parts, T.trim_white), lambda s: s != "")
            tokens = F.transform(parts, lambda s: token("s", s))
        else:
            tokens = F.transform(parts, lambda s: token("s", s, T.trim_white(s)))
        return F.when(T.utf16_length(para) > limit, F.concat(F.array(token("f", F.lit(""))), tokens)).otherwise(F.array(token("p", para)))

    return F.flatten(F.transform(F.split(text, "\n\n+", -1), of))


def _packed(tokens: Column, limit: int, sentence_slack: int) -> Column:
    """Greedy ordered packing of tokens as a fold over (done, cur, n): lengths are carried, not measured again."""
    state = lambda done, cur, n: F.struct(done.alias("done"), cur.alias("cur"), n.alias("n")).cast(_STATE)

    def pushed(a: Column) -> Column:
        return F.when(T.trim_white(a["cur"]) != "", F.concat(a["done"], F.array(T.trim_white(a["cur"])))).otherwise(a["done"])

    def step(a: Column, t: Column) -> Column:
        is_s = t["kind"] == "s"
        over = a["n"] + t["n"] + F.when(is_s, sentence_slack).otherwise(2) > limit
        glue = F.when(a["n"] == 0, "").when(is_s, " ").otherwise("\n\n")
        blank = T.trim_white(a["cur"]) == ""
        flush = F.when(blank, a).otherwise(state(pushed(a), F.lit(""), F.lit(0)))
        joined = state(a["done"], F.concat(a["cur"], glue, t["s"]), a["n"] + t["m"] + F.length(glue))
        return F.when(t["kind"] == "f", flush).when(over, state(pushed(a), t["s"], t["m"])).otherwise(joined)

    return F.aggregate(tokens, state(F.array().cast("array<string>"), F.lit(""), F.lit(0)), step, pushed)


def web_chunks(text: Column, limit: int = WEB_LIMIT, lossless: bool = False) -> Column:
    """Chunks for the web translator: sentences are trimmed, empty ones dropped, and two characters are reserved per joint."""
    return _packed(_tokens(text, limit, True, lossless), limit, 2)


def llm_chunks(text: Column, limit: int = LLM_LIMIT, lossless: bool = False) -> Column:
    """Chunks for the language-model translator: untrimmed sentences are measured, so a joined chunk may exceed the limit by its spaces."""
    return _packed(_tokens(text, limit, False, lossless), limit, 0)


def exploded(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """(keep..., chunk_idx, chunk), one row a chunk, in order of chunk_idx within a document. No shuffle."""
    return df.select(*keep, F.posexplode(chunks).alias("chunk_idx", "chunk"))


def is_structural(chunk: Column, marks: str = STRUCTURAL_WEB) -> Column:
    """Whether a chunk holds separator characters and white space only."""
    return F.rlike(chunk, F.lit(rf"^[{marks}{T.WHITE}]+\z"))


def is_blank(chunk: Column) -> Column:
    return T.trim_white(chunk) == ""
