"""Analysis as column expressions: character filters, tokenizers that the JVM can express, token filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS_DIGITS = r"[\p{L}\p{N}]+"


def html_strip(text: Column) -> Column:
    """Tags go, each bracket leaves a blank; an unclosed tag takes the rest."""
    return F.regexp_replace(F.regexp_replace(text, "<[^>]*>", "  "), "(?s)<[^>]*$", " ")


def markdown_strip(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), "[#*_`~>]", ""))


def standard(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS_DIGITS), F.lit(0))


def whitespace(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def keyword(text: Column) -> Column:
    return F.array(F.lower(text))


TOKENIZERS = {"standard": standard, "whitespace": whitespace, "keyword": keyword}


def length_filter(tokens: Column, low: int, high: int) -> Column:
    """Tokens of low to high characters; digits alone may be shorter."""
    return F.filter(tokens, lambda x: (F.length(x) <= high) & ((F.length(x) >= low) | x.rlike("^[0-9]+$")))


def stop_filter(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(*words))


def wildcard_regex(pattern: str) -> str:
    """An anchored expression for *, ? and [abc]; anything else stands for itself."""
    out, i = "^", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i)) > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\").replace("^", "\\^") + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() else "\\" + c)
        i += 1
    return out + "$"
