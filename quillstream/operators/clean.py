"""Unicode sanitizing and user-configurable cleaning rules, with statistics per rule."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstream.functions import text as T

#: The sanitizer's passes (label, character class, replacement), in order.
SANITIZE_PASSES = [
    ("Weird whitespace -> space", r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", " "),
    ("Zero-width / formatting chars", r"[\x{200B}-\x{200F}\x{2028}\x{2029}\x{2060}-\x{206F}\x{FEFF}]", ""),
    ("Control chars", r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]", ""),
    ("Combining marks (zalgo)", r"[\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}]", ""),
    ("Box drawing / blocks / geometric", r"[\x{2500}-\x{25FF}]", ""),
    ("Misc symbols / dingbats", r"[\x{2600}-\x{27BF}]", ""),
]

#: The default rules.
DEFAULT_RULES = {
    "blocks": [
        {
            "label": "Novelupdate rating request",
            "text": "Your invaluable feedback and ratings mean the world to me. Please\ntake a moment to rate this novel at Novelupdate.\nIf you come across any mistakes within this chapter, kindly notify me\nin the comments below, so that I can make the necessary corrections.",
        }
    ],
    "linePatterns": [
        {"label": "Rate/review on Novelupdate", "pattern": "rate this novel at Novelupdate", "flags": "i"},
        {"label": "Rate/review", "pattern": "Please report us if you find any errors so we can fix it asap!", "flags": "i"},
        {"label": "Rate/review es", "pattern": "¡Infórmenos si encuentra algún error para que podamos solucionarlo lo antes posible!", "flags": "i"},
        {"label": "Patreon promotions", "pattern": "patreon\\.com", "flags": "i"},
        {"label": "Ko-fi promotions", "pattern": "ko-fi\\.com", "flags": "i"},
        {"label": "Support me on lines", "pattern": "support me (on|at|by)", "flags": "i"},
        {"label": "Join Discord server", "pattern": "join (my|our|the) discord", "flags": "i"},
        {"label": "Translator notes begging", "pattern": "please (leave|give|write).*review", "flags": "i"},
        {"label": "Bullet point lines (•)", "pattern": "^\\s*•", "flags": ""},
        {"label": "Thank you ~ lines", "pattern": "^\\s*Thank you\\s*~", "flags": "i"},
        {"label": "PS: lines", "pattern": "^\\s*PS:", "flags": ""},
        {"label": "¡Gracias ~", "pattern": "^\\s*¡Gracias\\s*~", "flags": "i"},
        {"label": "PD: lines", "pattern": "^\\s*PD:", "flags": ""},
    ],
    "replacements": [
        {"label": "Astronomía flotante", "find": "Astronomía flotante", "replaceWith": "", "regex": False},
        {"label": "Double spaces", "find": "  +", "replaceWith": " ", "regex": True, "flags": "g"},
    ],
}
#: Passes of array functions over a text; what is nested deeper goes through Arrow.
PASSES = 16
#: Texts that are Python objects at once in an Arrow function.
PIECE = 256


@dataclass(frozen=True)
class Rule:
    """One compiled rule: a block, a line pattern, a literal or a regular-expression replacement."""

    kind: str
    label: str
    find: str
    into: str = ""
    everywhere: bool = True
    groups: int = 0


def compile_rules(rules: dict | str) -> list[Rule]:
    """Rules of a JSON object (or its text), in the order blocks, line patterns, replacements.

    Missing labels and flags get their defaults (empty flags mean case-insensitive); unknown keys are ignored. A literal that is
    empty, or comes back in its own replacement, would never finish and is rejected.
    """
    rules = json.loads(rules) if isinstance(rules, str) else rules
    out = [Rule("block", b.get("label") or b["text"][:40] + "...", b["text"]) for b in rules.get("blocks") or []]
    for p in rules.get("linePatterns") or []:
        out.append(Rule("line", p.get("label") or p["pattern"], T.java_pattern(p["pattern"], p.get("flags") or "i")))
    for r in rules.get("replacements") or []:
        label, into = r.get("label") or r["find"], r.get("replaceWith")
        into = "" if into is None else into
        if r.get("regex"):
            flags = r.get("flags") or "gi"
            out.append(Rule("regex", label, T.java_pattern(r["find"], flags), T.java_template(into), "g" in flags, _groups(r["find"])))
        else:
            out.append(Rule("literal", label, r["find"], into))
    for r in out:
        if r.kind in ("block", "literal") and (not r.find or r.find in r.into):
            raise ValueError(f"rule {r.label!r} would never finish")
    return out


def _groups(pattern: str) -> int:
    """Capturing groups of a regular expression."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def _borders(find: str) -> bool:
    return any(find.startswith(find[k:]) for k in range(1, len(find)))


def _by_place(text: str, find: str, into: str) -> tuple[str, int]:
    """(text with ``find`` replaced, first place first, until it is gone; how often).

    What stands before a place holds no ``find``, so the next one begins at most its length before the replacement's end.
    """
    n, at = 0, text.find(find)
    while at >= 0:
        text = text[:at] + into + text[at + len(find) :]
        n, at = n + 1, text.find(find, max(0, at - len(find) + 1))
    return text, n


def _settle(texts: pa.Array, find: str, into: str) -> tuple[pa.Array, np.ndarray]:
    """(texts after _by_place, how often in each). Those that hold ``find`` become Python objects, PIECE at a time; the others stay in Arrow."""
    done, counts = [texts.slice(0, 0)], [np.zeros(0, np.int64)]
    for k in range(0, len(texts), PIECE):
        part = texts.slice(k, PIECE)
        hit, n = pc.fill_null(pc.match_substring(part, find), False), np.zeros(len(part), np.int64)
        found = [_by_place(t, find, into) for t in part.filter(hit).to_pylist()]
        if found:
            part = pc.replace_with_mask(part, hit, pa.array([t for t, _ in found], part.type))
            n[hit.to_numpy(zero_copy_only=False)] = [m for _, m in found]
        done.append(part)
        counts.append(n)
    return pa.concat_arrays(done), np.concatenate(counts)


def _settled(find: str, into: str):
    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return _settle(texts, find, into)[0]

    return run


PLACED = "lines array<string>, n long"


def _settled_lines(find: str, into: str):
    @F.arrow_udf(PLACED)
    def run(lines: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False))])
        texts, n = _settle(lines.flatten(), find, into)
        so_far = np.concatenate([[0], np.cumsum(n)])
        after = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts, mask=lines.is_null())
        return pa.StructArray.from_arrays([after, pa.array(so_far[ends[1:]] - so_far[ends[:-1]], pa.int64())], names=["lines", "n"])

    return run


def _passes(c: Column, find: str, into: str) -> Column:
    """c after at most PASSES passes over all places of ``find``."""
    f = F.lit(find)
    again = F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), c, lambda t, _: F.when(F.contains(t, f), F.replace(t, f, F.lit(into))).otherwise(t))
    return F.when(F.contains(c, f), again).otherwise(c)


def fixpoint(df: DataFrame, name: str, find: str, into: str = "") -> DataFrame:
    """df with ``find`` replaced in the text column ``name``, first place first, until it is gone.

    Where ``find`` cannot overlap itself, passes over all its places come to the same, and only texts nested deeper than PASSES
    cross to an Arrow function that goes place by place. A literal that overlaps itself always does.
    """
    run = _settled(find, into)
    if _borders(find):
        return df.withColumn(name, run(F.col(name)))
    df = T.once(df, _t=_passes(F.col(name), find, into))
    return df.withColumn(name, F.coalesce(run(F.when(F.contains("_t", F.lit(find)), F.col("_t"))), F.col("_t"))).drop("_t")


def replace_lines(df: DataFrame, name: str, r: Rule, count: str | None = None) -> DataFrame:
    """df with a literal rule applied to the array of lines ``name``; ``count`` names a column for the number of places."""
    run, f = _settled_lines(r.find, r.into), F.lit(r.find)
    if _borders(r.find) or (count is not None and len(r.find) == len(r.into)):
        df = df.withColumn("_p", run(F.col(name)))
        counted = {} if count is None else {count: F.coalesce("_p.n", F.lit(0))}
        return df.withColumns({name: F.col("_p.lines"), **counted}).drop("_p")
    df = T.once(df, _t=F.transform(name, lambda line: _passes(line, r.find, r.into)))
    deep = run(F.when(F.exists("_t", lambda line: F.contains(line, f)), F.col("_t")))
    df = T.once(df.withColumn("_d", deep), _after=F.coalesce("_d.lines", "_t"))
    if count is not None:  # each place changes the length by as much
        gone = F.aggregate(F.zip_with(name, "_after", lambda a, b: F.length(a) - F.length(b)), F.lit(0), lambda a, x: a + x)
        df = df.withColumn(count, F.coalesce((gone / (len(r.find) - len(r.into))).cast("long"), F.lit(0)))
    return df.withColumn(name, F.col("_after")).drop("_t", "_d", "_after")


def sanitize(df: DataFrame, text: str = "text", out: str = "text") -> DataFrame:
    """df with NFC text and the sanitizer's passes applied."""
    df = df.withColumn(out, T.nfc(F.col(text)))
    return df.withColumn(out, reduce(lambda c, p: F.regexp_replace(c, p[1], p[2]), SANITIZE_PASSES, F.col(out)))


def sanitize_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(label, ord, count) of each pass over the whole table; a pass counts on the text that the one before it left."""
    df = df.select(T.nfc(F.col(text)).alias("t"))
    counts = []
    for k, (_, pattern, into) in enumerate(SANITIZE_PASSES):
        df = T.once(df.withColumn(f"n{k}", F.regexp_count("t", F.lit(pattern))), u=F.regexp_replace("t", pattern, into)).drop("t").withColumnRenamed("u", "t")
        counts.append(F.sum(f"n{k}").alias(f"n{k}"))
    total = df.agg(*counts)
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(k).alias("ord"), F.coalesce(F.col(f"n{k}"), F.lit(0)).cast("long").alias("count")) for k, (label, *_) in enumerate(SANITIZE_PASSES)])
    return total.select(F.inline(rows))


def remove_blocks(df: DataFrame, rules: list[Rule], text: str = "text", out: str = "text") -> DataFrame:
    """df without the rules' blocks, wherever they stand, until none is left."""
    return reduce(lambda d, r: fixpoint(d, out, r.find), [r for r in rules if r.kind == "block"], df.withColumn(out, F.col(text)))


def _first_match(line: Column, patterns: list[Rule]) -> Column:
    """Number of the first line pattern that matches, null if none does."""
    if not patterns:
        return F.lit(None).cast("int")
    chain = F.when(F.rlike(line, F.lit(patterns[0].find)), F.lit(0))
    for k, r in enumerate(patterns[1:], 1):
        chain = chain.when(F.rlike(line, F.lit(r.find)), F.lit(k))
    return chain


def drop_lines(lines: Column, rules: list[Rule]) -> Column:
    """The lines that no line pattern matches."""
    patterns = [r for r in rules if r.kind == "line"]
    if not patterns:
        return lines
    return F.filter(lines, lambda line: ~reduce(lambda a, b: a | b, [F.rlike(line, F.lit(r.find)) for r in patterns]))


def _replaced(line: Column, r: Rule) -> Column:
    """line with a regular-expression rule applied."""
    if r.everywhere:
        return F.regexp_replace(line, r.find, r.into)
    # Only the first match: the line up to its end is one match, and what follows is kept as it is.
    head = F.regexp_extract(line, f"(?s)\\A(.*?(?:{r.find}))", 1)
    return F.when(F.rlike(line, F.lit(r.find)), F.concat(F.regexp_replace(head, r.find, r.into), F.substring(line, F.length(head) + 1, F.length(line)))).otherwise(line)


def apply_replacements(df: DataFrame, name: str, rules: list[Rule]) -> DataFrame:
    """df with the replacements applied, in order, to the array of lines ``name``."""
    for r in rules:
        if r.kind == "literal":
            df = replace_lines(df, name, r)
        elif r.kind == "regex":
            df = df.withColumn(name, F.transform(name, _on(_replaced, r)))
    return df


def _matches(line: Column, r: Rule) -> Column:
    return F.rlike(line, F.lit(r.find))


def _count(line: Column, r: Rule) -> Column:
    return F.regexp_count(line, F.lit(r.find))


def _on(f, value):
    """f with its second argument set, as the one-argument function that array functions want."""
    return lambda x: f(x, value)


def clean_text(df: DataFrame, rules: list[Rule], text: str = "text", out: str = "text") -> DataFrame:
    """df with its text cleaned: sanitizing, blocks, line patterns, replacements on kept lines, at most three line ends in a row.

    One narrow projection after the other: no shuffle, and a text that loses all its lines stays as an empty text. A null stays null.
    """
    df = remove_blocks(sanitize(df, text, out), rules, out, out)
    df = T.once(df, _lines=drop_lines(T.lines_of(F.col(out)), rules))
    df = apply_replacements(df, "_lines", rules)
    return df.withColumn(out, F.regexp_replace(F.array_join("_lines", "\n"), "\n{4,}", "\n\n\n")).drop("_lines")


def rule_counts(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """(label, ord, count) of each rule over the whole table, in rule order; rules that share a label share a count."""
    df = sanitize(df.select(F.col(text).alias("t")), "t", "t")
    n, names = [], []
    for r in rules:
        if r.kind == "block":
            df = fixpoint(df.withColumn("u", F.col("t")), "u", r.find)
            name = f"n{len(names)}"
            df = df.withColumn(name, F.expr(f"(length(t) - length(u)) div {len(r.find)}")).drop("t").withColumnRenamed("u", "t")
            names.append((r.label, name))
    patterns = [r for r in rules if r.kind == "line"]
    df = T.once(df, lines=T.lines_of(F.col("t"))).drop("t")
    df = T.once(df, hits=F.transform("lines", lambda line: F.coalesce(_first_match(line, patterns), F.lit(-1))))
    for k, r in enumerate(patterns):
        names.append((r.label, f"n{len(names)}"))
        df = df.withColumn(names[-1][1], F.size(F.filter("hits", _on(lambda h, k: h == k, k))))
    df = T.once(df, kept=F.transform(F.filter(F.arrays_zip("lines", "hits"), lambda x: x["hits"] == -1), lambda x: x["lines"])).drop("lines", "hits")
    for r in (r for r in rules if r.kind in ("literal", "regex")):
        names.append((r.label, f"n{len(names)}"))
        if r.kind == "literal":
            df = replace_lines(df, "kept", r, names[-1][1])
            continue
        if r.everywhere:
            count = F.aggregate(F.transform("kept", _on(_count, r)), F.lit(0), lambda a, x: a + x)
        else:
            count = F.size(F.filter("kept", _on(_matches, r))) * (1 + r.groups)
        # Both come out of one generator, so the lines are gone through once a rule.
        df = T.once(df, after=F.transform("kept", _on(_replaced, r)), **{names[-1][1]: count}).drop("kept").withColumnRenamed("after", "kept")
    if not names:
        return df.select(F.lit("").alias("label"), F.lit(0).alias("ord"), F.lit(0).cast("long").alias("count")).where(F.lit(False))
    n = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for _, c in names]
    total = df.agg(*n)
    labels = list(dict.fromkeys(label for label, _ in names))
    rows = [F.struct(F.lit(label).alias("label"), F.lit(k).alias("ord"), sum((F.col(c) for x, c in names if x == label), F.lit(0)).cast("long").alias("count")) for k, label in enumerate(labels)]
    return total.select(F.inline(F.array(*rows)))


def size_report(before: DataFrame, after: DataFrame, text: str = "text") -> DataFrame:
    """(bytes_before, bytes_after, bytes_removed, removed_pct) of two versions of a table."""
    size = lambda df, sign: df.select(F.octet_length(text).cast("long").alias("n"), F.lit(sign).alias("side"))
    of = lambda sign: F.coalesce(F.sum(F.when(F.col("side") == sign, F.col("n"))), F.lit(0)).cast("long")
    both = size(before, 0).unionAll(size(after, 1)).agg(of(0).alias("bytes_before"), of(1).alias("bytes_after"))
    removed = F.col("bytes_before") - F.col("bytes_after")
    return both.select("bytes_before", "bytes_after", removed.alias("bytes_removed"), F.round(F.try_divide(removed * 100.0, F.col("bytes_before")), 2).alias("removed_pct"))
