"""Column functions with the string semantics that the text operators need.

Lengths count UTF-16 code units, white space is the Unicode set that ``trim`` of the source format uses (with NBSP and the byte
order mark, without U+0085), ``$`` means the very end, and replacing by a callback is done with arrays.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The white-space characters of trimming and of ``\s``.
WHITE_CHARS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same as the inside of a character class, for Java and RE2 alike.
WHITE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Any character that ``.`` matches.
DOT = r"[^\n\r\x{2028}\x{2029}]"


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def trim_white(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_CHARS))


def decoded(content: Column) -> Column:
    """Text of UTF-8 bytes; malformed ones become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def map_matches(c: Column, pattern: str, make: Callable[[Column], Column]) -> Column:
    """c with every match of pattern replaced by make(its first group)."""
    made = F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), make)
    return F.array_join(F.zip_with(F.split(c, pattern, -1), made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row.

    They come out of a generator, so that no later projection or lambda repeats them inside itself.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def nfc(c: Column) -> Column:
    """Unicode NFC; Spark has no such function, but brings the ICU library along."""
    return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False)))


@F.pandas_udf(StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """HTML entities decoded in one pass; Spark has no such function."""
    return texts.map(html.unescape, na_action="ignore")


_CLOSED = re.compile("&(#[0-9]+|#[xX][0-9A-Fa-f]+|[0-9A-Za-z]+);")


def _closed(m: re.Match) -> str:
    return html.unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html.entities.html5 else m[0]


@F.pandas_udf(StringType())
def decode_closed_entities(texts: pd.Series) -> pd.Series:
    """The same, but what no semicolon ends stays as it is, also where HTML knows the name without one (``&amp``)."""
    return texts.map(lambda t: _CLOSED.sub(_closed, t), na_action="ignore")


_ESCAPES = {"s": f"[{WHITE}]", "S": f"[^{WHITE}]"}


def java_pattern(pattern: str, flags: str = "") -> str:
    """A user's JavaScript regular expression as a Java one of the same meaning.

    ``$`` becomes the very end unless flag m is set, ``.`` and white-space classes are spelled out, and characters that only
    Java treats as special inside a class are escaped. Flags other than g, i, m, s, u raise ValueError, as do
    named groups' back references and class set notation, rather than differing silently.
    """
    odd = set(flags) - set("gimsu")
    if odd:
        raise ValueError(f"unsupported flags {sorted(odd)} of {pattern!r}")
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise ValueError(f"{pattern!r} ends in a backslash")
            e = pattern[i + 1]
            if e == "k":
                raise ValueError(f"named back reference in {pattern!r}")
            brace = re.match(r"\\u\{([0-9A-Fa-f]+)\}", pattern[i:])
            if brace and "u" in flags:
                out.append(f"\\x{{{brace[1]}}}")
                i += len(brace[0])
                continue
            if e == "s" and inside:
                out.append(WHITE)
            elif e == "S" and inside:
                raise ValueError(f"\\S inside a class of {pattern!r}")
            else:
                out.append(_ESCAPES.get(e, c + e))
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            elif c in "[&" or c == "~":
                c = "\\" + c
        elif c == "[":
            inside = True
            if pattern.startswith("[]", i) or pattern.startswith("[^]", i):
                raise ValueError(f"empty class in {pattern!r}")
        elif c == "$" and "m" not in flags:
            c = "\\z"
        elif c == "." and "s" not in flags:
            c = DOT
        out.append(c)
        i += 1
    prefix = ("iu" if "i" in flags else "") + ("m" if "m" in flags else "") + ("s" if "s" in flags else "")
    found = (f"(?{prefix})" if prefix else "") + "".join(out)
    return found


def java_template(text: str) -> str:
    """A JavaScript replacement template ($1, $&, $$) as a Java one."""

    def one(m: re.Match) -> str:
        t = m[0]
        if t == "\\":
            return "\\\\"
        if t == "$$":
            return "\\$"
        if t == "$&":
            return "$0"
        return t if t[1:].isdigit() else "\\$"

    return re.sub(r"\\|\$\$|\$&|\$\d{1,2}|\$", one, text)
