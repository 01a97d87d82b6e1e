"""Text quality statistics per document, and outlier scores from exact ranks within each language."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.site_lines import repeated_lines
from pagewright.sources.tables import cut, sized

MIN_WORDS = 25
#: The list of common words is read by the driver and sent to the tasks.
MAX_COMMON_WORDS = 1_000_000
#: Statistics, and the side on which a value is unlike prose: 1 high, -1 low, 0 either.
STATISTICS = {"mean_word_length": 0, "symbol_share": 1, "ended_share": -1, "ended_words": -1, "common_share": -1, "digit_share": 1, "listed_share": 1}
#: Parts of the range-partitioned sort of each statistic's values.
RANGE_PARTS = 24
#: Width of the cells of the histogram of scores.
SCORE_CELL = 0.1

_SENTENCE_END = re.compile(r"[.!?…][\"'”’)\]]*(?=\s|$)")
_LINE_END = re.compile(r"[.!?…:;][\"'”’)\]]*$")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_VOWEL = re.compile(r"[aeiouyáàâäãåæéèêëíìîïóòôöõøúùûüœ]", re.I)
_CODE_LINE = re.compile(r"[{};=<>|\\]|\w\(|\w\.\w+\(|^\s*(?:at |def |for \w+ in |if \(|var |return |import |#include)|\d{4}-\d\d-\d\dT?\s?\d\d:\d\d|\b(?:DEBUG|INFO|WARN|ERROR|TRACE|FATAL)\b")
_LOOP = re.compile(r"\s*(?:for|while|if|def|class) .*[:{]\s*\S+\(|\s*for \w+ in \w+:|\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_CELL = re.compile(r"\t| \| | – |;;?(?=\S)| » ")
_CELL_SIGNS = ("\t", " | ", " – ", ";", " » ")
_SPACE, _LETTER, _DIGIT, _SYMBOL = range(4)
#: Kind of each character of the basic plane; what lies beyond counts as a symbol.
_KINDS = np.array([_SPACE if chr(i).isspace() else _DIGIT if chr(i).isdigit() else _LETTER if chr(i).isalnum() else _SYMBOL for i in range(0x10000)] + [_SYMBOL], dtype=np.uint8)


def in_sentences(line: str, tokens: list[str], joins: int) -> bool:
    """Whether the words of a line stand in sentences: joined by common words, or filler with the shape of sentences.

    tokens: the words of letters of the line; joins: how many of them are common words of any language."""
    words = line.split()
    if not tokens or len(words) < 3:
        return False
    if _LOOP.match(line) or any(s in line for s in _CELL_SIGNS) and len(_CELL.findall(line)) > 1:
        return False
    joined = joins / len(words)
    if joined < 0.3 and _CODE_LINE.search(line):
        return False
    symbols = sum(not (c.isalnum() or c.isspace()) for c in line) / len(line)
    if joined >= 0.14 and symbols < 0.12 and (joins > 1 or len(words) < 6 and _SENTENCE_END.search(line)):
        return True
    ends = len(_SENTENCE_END.findall(line))
    if not ends or sum(map(len, tokens)) < 0.7 * len(line.replace(" ", "")):
        return False
    # Without common words: sentences of an invented language begin with a capital, end with a stop and can be spoken.
    spoken = sum(bool(_VOWEL.search(t)) for t in tokens) / len(tokens)
    return line[:1].isupper() and spoken > 0.9 and 3 <= len(words) / ends <= 40 and symbols < 0.1 and line.count(",") < 0.25 * len(words)


class Measure:
    """The statistics of texts for lists of common words by language."""

    def __init__(self, common: dict[str, frozenset[str]]):
        self.langs = sorted(common)
        self.bits: dict[str, int] = {}
        for i, lang in enumerate(self.langs):
            for word in common[lang]:
                self.bits[word] = self.bits.get(word, 0) | 1 << i

    def page(self, text: str) -> tuple:
        """(lang, words, letters a token, common words a word, lines): lang is the language whose common words occur most
        often, "" where none does, the first by name of equals. lines has a number for each line of the text: 0 for a
        blank line or a heading, else 4 x words, 2 for a line of sentences, 1 for one that ends in punctuation."""
        look = self.bits.get
        masks: Counter = Counter()
        letters = count = 0
        lines = []
        for raw in text.split("\n"):
            tokens = _TOKEN.findall(raw.lower())
            hits = [m for t in tokens if (m := look(t))]
            masks.update(hits)
            letters += sum(map(len, tokens))
            count += len(tokens)
            line = raw.strip()
            if not line or line[0] == "#":
                lines.append(0)
            else:
                lines.append(4 * len(line.split()) + 2 * in_sentences(line, tokens, len(hits)) + (_LINE_END.search(line) is not None))
        per = [sum(n for m, n in masks.items() if m >> i & 1) for i in range(len(self.langs))]
        most = max(per, default=0)
        words = len(text.split())
        return self.langs[per.index(most)] if most else "", words, round(letters / count, 6) if count else 0.0, round(most / words, 6) if words else 0.0, lines


def character_shares(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, digits) of each text, as shares of its characters that are no white space; 0 for a blank text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = _KINDS[np.minimum(codes, 0x10000)]
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    counts = np.bincount(of * 4 + kinds, minlength=4 * len(texts)).reshape(-1, 4)
    dense = np.maximum(counts[:, _LETTER] + counts[:, _DIGIT] + counts[:, _SYMBOL], 1)
    return np.round(counts[:, _SYMBOL] / dense, 6), np.round(counts[:, _DIGIT] / dense, 6)


_MEASURED = "page_id long, lang string, words int, mean_word_length double, common_share double, lines array<int>, symbol_share double, digit_share double"


def text_statistics(pages: DataFrame, common_words: DataFrame) -> DataFrame:
    """(page_id, lang, words, STATISTICS) for every page with a text, computed from the text alone.

    pages: page_id, url, text; common_words: lang, word. lang is the language whose common words are most frequent, "" if
    none occurs. A null text has no row, a blank one zeros; ids may repeat or be null. The shares of lines (ended_share)
    and of words in lines (ended_words, listed_share) leave out headings and the lines that the site repeats, which
    repeated_lines finds over all pages. Texts are read once here and not moved: of each line only a number is."""
    rows = common_words.select(F.lower(F.trim("lang")).alias("lang"), F.lower(F.trim("word")).alias("word")).where("lang <> '' AND word <> ''").distinct().limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    common: dict = {}
    for r in rows:
        common.setdefault(r["lang"], set()).add(r["word"])
    common = {k: frozenset(v) for k, v in common.items()}

    def measure(batches):
        one = Measure(common)
        kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                texts = b.column("text").to_pylist()
                columns = zip(*map(one.page, texts))
                yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, k) for c, k in zip(columns, kinds)), *map(pa.array, character_shares(texts))], [c.split()[0] for c in _MEASURED.split(", ")])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    gone = repeated_lines(pages).groupBy("page_id").agg(F.collect_list("line_no").alias("gone"))
    joined = own.mapInArrow(measure, _MEASURED).join(gone, "page_id", "left")
    none = F.array().cast("array<int>")
    kept = F.filter(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", none)), lambda i: F.get("lines", i) > 0)
    lines = joined.withColumn("own", F.transform(kept, lambda i: F.get("lines", i)))
    total = lambda value: F.aggregate("own", F.lit(0), lambda s, x: s + value(x))
    words, ended = (lambda x: F.shiftright(x, 2)), (lambda x: x.bitwiseAND(1))
    sums = lines.withColumns({"w": total(words), "e": total(ended), "ew": total(lambda x: words(x) * ended(x)), "out": total(lambda x: words(x) * (1 - F.shiftright(x.bitwiseAND(2), 1))), "n": F.size("own")})
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6).alias
    return sums.select("page_id", "lang", "words", "mean_word_length", "symbol_share", share("e", "n")("ended_share"), share("ew", "w")("ended_words"), "common_share", "digit_share", share("out", "w")("listed_share"))


def exact_ranks(values: DataFrame) -> DataFrame:
    """(stat, lang, value, below, upto, n): how many values of the language are smaller, how many are at most as large,
    and how many there are.

    values: stat, lang, value, copies. Equal values are counted together first. The counted values are range-partitioned
    and sorted, each partition adds up its own counts, and gets the sum of the partitions before it as offset; no
    partition holds a whole language, and only sums of partitions are moved again."""
    counted = values.groupBy("stat", "lang", "value").agg(F.sum("copies").alias("copies"))
    parted = cut(counted.repartitionByRange(RANGE_PARTS, "stat", "lang", "value").withColumn("part", F.spark_partition_id()))
    sums = parted.groupBy("stat", "lang", "part").agg(F.sum("copies").alias("own"))
    order = Window.partitionBy("stat", "lang").orderBy("part")
    offsets = sums.select("stat", "lang", "part", (F.sum("own").over(order) - F.col("own")).alias("offset"), F.sum("own").over(Window.partitionBy("stat", "lang")).alias("n"))
    inside = Window.partitionBy("part", "stat", "lang").orderBy("value")
    local = parted.withColumn("inside", F.sum("copies").over(inside))
    joined = local.join(offsets, ["stat", "lang", "part"])
    return joined.select("stat", "lang", "value", (F.col("offset") + F.col("inside") - F.col("copies")).alias("below"), (F.col("offset") + F.col("inside")).alias("upto"), "n")


def outlier_scores(stats: DataFrame) -> DataFrame:
    """stats with `score`: the sum over STATISTICS of -ln of the empirical probability of a value at least as far on the
    side that is unlike prose (of both sides, the larger). The probabilities are those within the page's language or,
    where that gives the larger sum, among all pages: a page in no known or a rare language has too few peers."""
    own = cut(stats.withColumn("row", F.monotonically_increasing_id()))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in STATISTICS])).alias("s")
    long = own.select("row", "lang", each).select("row", "lang", "s.stat", "s.value")
    counts = long.where("lang <> ''").groupBy("stat", "lang", "value").agg(F.count(F.lit(1)).alias("copies"))
    counts = counts.unionByName(long.groupBy("stat", F.lit("").alias("lang"), "value").agg(F.count(F.lit(1)).alias("copies")))
    ranks = exact_ranks(counts)
    low, high = -F.log(F.col("upto") / F.col("n")), -F.log((F.col("n") - F.col("below")) / F.col("n"))
    side = F.create_map(*[x for name, s in STATISTICS.items() for x in (F.lit(name), F.lit(s))])[F.col("stat")]
    tails = sized(ranks.select("stat", "lang", "value", F.when(side > 0, high).when(side < 0, low).otherwise(F.greatest(low, high)).alias("tail")))
    twice = long.where("lang <> ''").unionByName(long.withColumn("lang", F.lit("")))
    sums = twice.join(tails, ["stat", "lang", "value"]).groupBy("row", "lang").agg(F.sum("tail").alias("score")).groupBy("row").agg(F.max("score").alias("score"))
    return own.join(sums, "row").select("page_id", "lang", "words", *STATISTICS, "score")


def score_threshold(scores: DataFrame) -> float:
    """The score that parts the pages in two groups best (the largest variance between the groups), from a histogram of
    cells of SCORE_CELL, whose number doesn't grow with the table; infinite for an empty table."""
    cells = sorted((r["cell"], r["n"]) for r in scores.groupBy(F.floor(F.col("score") / SCORE_CELL).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not cells:
        return float("inf")
    value, n = (np.array(x, dtype=float) for x in zip(*cells))
    below, mass = np.cumsum(n)[:-1], np.cumsum(n * value)[:-1]
    if not len(below):
        return float(value[0] * SCORE_CELL)
    between = (mass / below - (mass[-1] + n[-1] * value[-1] - mass) / (n.sum() - below)) ** 2 * below * (n.sum() - below)
    return float(value[1:][between.argmax()] * SCORE_CELL)


def outlying(pages: DataFrame, common_words: DataFrame, min_score: float | None = None) -> DataFrame:
    """The scored pages of at least MIN_WORDS words whose score is min_score or more; without it, score_threshold of them."""
    scored = cut(outlier_scores(text_statistics(pages, common_words)).where(F.col("words") >= MIN_WORDS))
    return scored.where(F.col("score") >= (score_threshold(scored) if min_score is None else min_score))


def unlike_prose(pages: DataFrame, common_words: DataFrame, min_score: float | None = None) -> DataFrame:
    """(page_id, score, listed_share) of the outlying pages of whose words, after an exact count, more than half stand
    outside sentences: the score finds the pages, the count only drops some of them."""
    return outlying(pages, common_words, min_score).where(F.col("listed_share") > 0.5).select("page_id", "score", "listed_share")
