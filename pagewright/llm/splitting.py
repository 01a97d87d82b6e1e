"""Cutting oversized items into pieces at natural boundaries, neighbours overlapping by whole words."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 325
MAX_CHARS = 4000
OVERLAP_WORDS = 30
PIECES = "item string, item_id long, piece_no int, start_pos int, end_pos int, words int, text string"

#: Where a level ends a part: before a heading, after a line that is no heading, after a sentence, after a word.
_LEVELS = [re.compile(r"\n(?=#{1,6}\s)"), re.compile(r"^(?!#{1,6}\s).*\n+", re.M), re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+"), re.compile(r"\s+")]


class _Text:
    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = [], []
        for m in re.finditer(r"\S+", text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def words(self, start: int, end: int) -> int:
        """Words that lie at least partly in text[start:end]."""
        return bisect_left(self.starts, end) - bisect_left(self.ends, start + 1)

    def fits(self, start: int, end: int, words: int, chars: int) -> bool:
        return end - start <= chars and self.words(start, end) <= words

    def parts(self, start: int, end: int, level: int, words: int, chars: int):
        """Spans that cover text[start:end], each within the limits, cut at the first level that is fine enough."""
        if self.fits(start, end, words, chars):
            yield start, end
        elif level == len(_LEVELS):
            for at in range(start, end, chars):
                yield at, min(at + chars, end)
        else:
            at = start
            for m in _LEVELS[level].finditer(self.text, start, end):
                if m.end() > at:
                    yield from self.parts(at, m.end(), level + 1, words, chars)
                    at = m.end()
            if at < end:
                yield from self.parts(at, end, level + 1, words, chars)

    def tail(self, start: int, end: int, overlap: int, chars: int) -> int:
        """Where the last `overlap` words of text[start:end] begin; fewer words where these are longer than chars."""
        last = bisect_left(self.starts, end)
        first = max(bisect_left(self.starts, start), last - overlap)
        while first < last and end - self.starts[first] > chars:
            first += 1
        return self.starts[first] if first < last else end


def piece_spans(text: str, max_words: int, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces of one text: every piece is within both limits, each starts `overlap` words before the end
    of the one before it, and without the overlaps they are the text."""
    t = _Text(text)
    tail_chars = max_chars // 4 if overlap else 0
    pieces, start, end = [], 0, 0
    for _, to in t.parts(0, len(text), 0, max_words - overlap, max_chars - tail_chars):
        if end > start and not t.fits(start, to, max_words, max_chars):
            pieces.append((start, end))
            start = t.tail(start, end, overlap, tail_chars) if overlap else end
        end = to
    return [*pieces, (start, end)]


def oversized(text, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS):
    """Whether a text column is over a limit. A text of max_words words and one more has over 2 x max_words characters, so
    shorter ones are not searched for words."""
    return (F.length(text) > max_chars) | ((F.length(text) > 2 * max_words) & (F.regexp_count(text, F.lit(r"(?U)\S+")) > max_words))


def split_oversized(items: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """The pieces of every item over a limit, as PIECES; items within the limits don't come out.

    items: item, item_id, text. text is text[start_pos:end_pos] of the item, unchanged. A null or blank text isn't over
    a limit unless it has more than max_chars white characters. An overlap is shorter where its words take more than a
    quarter of max_chars. Repeated items are cut each on its own."""
    if not 0 <= overlap < max_words or max_chars < 4:
        raise ValueError("the overlap must be less than the limit")
    own = items.select(F.col("item").cast("string"), F.col("item_id").cast("long"), F.col("text").cast("string")).where(oversized(F.col("text"), max_words, max_chars))

    def cut(batches):
        for batch in batches:
            rows = []
            for item, item_id, text in zip(batch["item"], batch["item_id"], batch["text"]):
                t = _Text(text)
                for n, (a, b) in enumerate(piece_spans(text, max_words, max_chars, overlap)):
                    rows.append((item, item_id, n, a, b, t.words(a, b), text[a:b]))
            yield pd.DataFrame(rows, columns=["item", "item_id", "piece_no", "start_pos", "end_pos", "words", "text"])

    return own.mapInPandas(cut, PIECES)


def pieces(items: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Every item as pieces under the limits: small ones whole, as piece 0, without leaving the JVM. Null texts don't come out."""
    small = items.where(F.col("text").isNotNull() & ~oversized(F.col("text"), max_words, max_chars)).select(
        F.col("item").cast("string").alias("item"), F.col("item_id").cast("long").alias("item_id"), F.lit(0).alias("piece_no"), F.lit(0).alias("start_pos"),
        F.length("text").alias("end_pos"), F.regexp_count("text", F.lit(r"(?U)\S+")).alias("words"), "text",
    )
    return small.unionByName(split_oversized(items, max_words, max_chars, overlap))
