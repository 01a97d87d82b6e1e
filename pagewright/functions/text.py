"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, no-break spaces included.
SPACE = r"(?U)\s+"


def words(text: Column) -> Column:
    """The words of a text, separated by Unicode white space; an empty array for a blank text, null for null."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words; 0 for a blank text and for null."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and leading "www."; null where there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def compared_form(line: Column) -> Column:
    """A line for comparison: trimmed, lower case, white space runs as one blank, digit runs as one 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]+", "0"))


def tokens(text: Column) -> Column:
    """Terms: lower case, maximal runs of a-z and 0-9, single characters left out; an empty array for null."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.coalesce(F.filter(found, lambda t: F.length(t) > 1), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Split after . ! or ? before white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def sentence_score(sentence: Column) -> Column:
    """3 for a digit, 2 for a capitalised word of three letters or more, and a point for each 25 words, 2 at most."""
    score = F.when(sentence.rlike("[0-9]"), 3).otherwise(0) + F.when(sentence.rlike("[A-Z][a-z]{2,}"), 2).otherwise(0)
    return score + F.least(F.floor(F.size(F.filter(F.split(sentence, r"\s+"), lambda w: w != "")) / 25), F.lit(2)).cast("int")


def embedding_text(title: Column, heading_path: Column, text: Column) -> Column:
    """What is embedded for a chunk: "title — heading path", a line end, the text; blank parts are left out."""
    given = lambda c: F.when(F.trim(c) != "", c)
    head = F.concat_ws(" — ", given(title), given(heading_path))
    return F.concat_ws("\n", F.when(head != "", head), given(text))


def last_segment(url: Column) -> Column:
    """What follows the last slash of a URL."""
    return F.element_at(F.split(url, "/"), -1)


def snippet(text: Column, chars: int = 140) -> Column:
    """The first characters cut at the last space, with an ellipsis; a text that fits stays whole."""
    cut = F.regexp_replace(F.substring(text, 1, chars), r"\s+\S*$", "")
    return F.when(F.length(text) > chars, F.concat(cut, F.lit("…"))).otherwise(text)


def slug(text: Column, chars: int = 40) -> Column:
    """Lower case with a dash for each run of other signs than letters and digits; "section" if nothing is left."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, chars)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("section")).otherwise(s)
