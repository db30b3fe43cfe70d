"""Text functions as Column expressions; none needs Python on executors."""

from __future__ import annotations

import importlib.util
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() has it.
WHITE = r"[\s\p{Z}\x1c-\x1f\x85]"
NOT_BLANK = r"[^\s\p{Z}\x1c-\x1f\x85]"
TRANSLATE_CHARS = 4500
#: The decimal digits of all scripts, and the ASCII digit for each.
DIGITS = [chr(c) for c in range(0x110000) if unicodedata.decimal(chr(c), None) is not None]
VALUES = [str(unicodedata.decimal(c)) for c in DIGITS]
#: Stands for numbers above it.
MOST = 2**63 - 1


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def normal_email(email: Column) -> Column:
    return F.lower(strip(email))


def lines(text: Column) -> Column:
    """Lines at any line end, without an empty one after the last; an empty text has none."""
    parts = F.split(text, r"\R")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def reverse_words(text: Column) -> Column:
    """Each line's words in reverse order, for right-to-left text without a shaping library; blank lines stay."""
    words = lambda line: F.filter(F.split(line, r"\s+"), lambda w: w != "")
    turn = lambda line: F.when(strip(line) == "", line).otherwise(F.array_join(F.reverse(words(line)), " "))
    return F.array_join(F.transform(lines(text), turn), "\n")


def _displayed(lines: pd.Series, reshape: bool) -> pd.Series:
    from bidi.algorithm import get_display

    if reshape:
        import arabic_reshaper

        lines = lines.map(lambda x: x and arabic_reshaper.reshape(x))
    return lines.map(lambda x: x and get_display(x))


def display(text: Column, language: str) -> Column:
    """Right-to-left text in the order of display: by the bidirectional algorithm where its library is installed, with
    Arabic letters joined where that one's is; else each line's words in reverse order."""
    found = lambda name: importlib.util.find_spec(name) is not None
    if not found("bidi") or language == "ar" and not found("arabic_reshaper"):
        return reverse_words(text)
    return F.pandas_udf(lambda s: _displayed(s, language == "ar"), "string")(text)


def chunks(text: Column, size: int = TRANSLATE_CHARS) -> Column:
    """A text in slices of `size` code points, one at least."""
    at = F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int"))
    return F.transform(at, lambda i: F.substring(text, i * size + 1, F.lit(size)))


def number_list(text: Column) -> Column:
    """"1, 3,x,-2" as [1, 3]: what isn't digits, of any script, is dropped; null and empty give no number. A number of any
    length stays one: those beyond a long become MOST, which no page has."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda p: p.rlike(r"^\p{Nd}+$"))
    plain = lambda p: F.when(p.rlike("^[0-9]+$"), p).otherwise(F.translate(p, "".join(DIGITS), "".join(VALUES)))
    return F.transform(parts, lambda p: F.coalesce(plain(p).try_cast("bigint"), F.lit(MOST)))


def term_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda t: t != "")


def page_range(text: Column, total: Column) -> Column:
    """struct(first, last, error) of "3", "3-7": a pair is clamped to 1..total, a single page outside gives an empty
    range (first > last), anything else is an error."""
    r = strip(text)
    whole = lambda x: F.when(strip(x).rlike("^[+-]?[0-9]+$"), F.expr("0") + strip(x).try_cast("bigint"))
    a, b = whole(F.substring_index(r, "-", 1)), whole(F.substr(r, F.instr(r, "-") + 1))
    one = whole(r)
    dash = F.contains(r, F.lit("-"))
    first = F.when(dash, F.greatest(F.lit(1), a)).otherwise(one)
    last = F.when(dash, F.least(total, b)).otherwise(F.when(one.between(1, total), one).otherwise(one - 1))
    bad = F.when(dash, a.isNull() | b.isNull()).otherwise(one.isNull())
    return F.struct(F.when(~bad, first).alias("first"), F.when(~bad, last).alias("last"), bad.alias("error"))


def stem(name: Column) -> Column:
    base = F.regexp_extract(name, "[^/]*$", 0)
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")


def suffix(name: Column) -> Column:
    """The last suffix in lower case with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(F.regexp_extract(name, "[^/]*$", 0), r"[^.](\.[^.]+)$", 1))


def safe_filename(name: Column, most: int = 200) -> Column:
    return F.substring(F.regexp_replace(F.regexp_extract(name, "[^/]*$", 0), r"[^\p{L}\p{N}_\-. ]", "_"), 1, most)


def gateway_reply(body: Column) -> Column:
    """"a=1&b=2=3&c" as entries (k, v): pairs without = are dropped, the first = parts, the last value of a key wins.
    Entries come by key."""
    pairs = F.transform(F.filter(F.split(body, "&"), lambda p: F.contains(p, F.lit("="))), lambda p: F.split(p, "=", 2))
    keyed = lambda wins: F.array_sort(F.array_distinct(F.transform(pairs, lambda p: wins(p))))
    return keyed(lambda p: F.struct(p[0].alias("k"), F.element_at(F.filter(pairs, lambda q: q[0] == p[0]), -1)[1].alias("v")))


def _decoded(part: Column) -> Column:
    """URL-decoded, or as it is where it has a broken escape."""
    return F.coalesce(F.try_url_decode(part), part)


def query_fields(query: Column) -> Column:
    """A query string as a map: URL-decoded, the last value of a key wins, a key without = has the empty value."""
    parts = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.split(p, "=", 2))
    plain = F.transform(parts, lambda p: F.struct(_decoded(p[0]).alias("k"), F.coalesce(_decoded(F.get(p, F.lit(1))), F.lit("")).alias("v")))
    last = F.array_distinct(F.transform(plain, lambda p: F.struct(p["k"].alias("k"), F.element_at(F.filter(plain, lambda q: q["k"] == p["k"]), -1)["v"].alias("v"))))
    return F.map_from_entries(last)


def form_fields(body: Column) -> Column:
    """A form body as a map: values URL-decoded, the first value of a key wins, pairs without a value are dropped."""
    parts = F.filter(F.transform(F.split(body, "&"), lambda p: F.split(p, "=", 2)), lambda p: (F.size(p) == 2) & (p[1] != ""))
    plain = F.transform(parts, lambda p: F.struct(_decoded(p[0]).alias("k"), _decoded(p[1]).alias("v")))
    first = F.array_distinct(F.transform(plain, lambda p: F.struct(p["k"].alias("k"), F.filter(plain, lambda q: q["k"] == p["k"])[0]["v"].alias("v"))))
    return F.map_from_entries(first)


def query_string(fields: list[tuple[str, Column]]) -> Column:
    """key=value pairs in the given order, values URL-encoded."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in fields])


def redact(text: Column, terms: list[str], case_sensitive: bool = False, mask: str = "█") -> tuple[Column, Column]:
    """The text with every term masked, and how many places were. Terms are literal and taken in turn."""
    flags, count = "" if case_sensitive else "(?iu)", F.lit(0)
    for term in terms:
        quoted = flags + "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        count = count + F.regexp_count(text, F.lit(quoted))
        text = F.regexp_replace(text, F.lit(quoted), F.lit(mask * len(term)))
    return text, count.cast("long")
