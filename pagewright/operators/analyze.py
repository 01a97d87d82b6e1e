"""Extractive points with citations, the guard on citations, and replies of a language model as reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import sentence_score, sentences, tokens

MIN_SENTENCE_CHARS = 30
REPLY = "struct<executive_summary: string, sections: array<struct<id: string, points: array<struct<text: string, citations: array<string>>>>>>"


def scored_sentences(chunks: DataFrame, key: str) -> DataFrame:
    """(key, pos, sentence, score) of the sentences of more than MIN_SENTENCE_CHARS characters."""
    split = chunks.select(key, F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence"))
    return split.where(F.length("sentence") > MIN_SENTENCE_CHARS).select(key, "pos", "sentence", sentence_score(F.col("sentence")).alias("score"))


def best_sentences(chunks: DataFrame, key: str) -> DataFrame:
    """(key, sentence, score): the highest score of each chunk, the first of equals; no row for a chunk without one.

    Expressions over the array of a chunk's sentences; rows stay where they are."""
    pos = F.transform(sentences(F.col("text")), lambda x, i: F.struct(F.trim(x).alias("s"), i.alias("i")))
    able = F.filter(pos, lambda x: F.length(x["s"]) > MIN_SENTENCE_CHARS)
    best = F.array_max(F.transform(able, lambda x: F.struct(sentence_score(x["s"]).alias("score"), (-x["i"]).alias("at"), x["s"].alias("sentence"))))
    return chunks.select(key, best.alias("b")).where("b IS NOT NULL").select(key, "b.sentence", "b.score")


def cited_points(ranked: DataFrame, chunks: DataFrame, section: str, key: str) -> DataFrame:
    """(section, rank, key, sentence): the best sentence of each of a section's first 6 chunks; a chunk is cited by the
    first section only.

    ranked: section (an ordinal), key, rank. Whether a chunk has a sentence depends on the chunk alone, so the first
    section that ranks it is the one that uses it."""
    able = ranked.where("rank <= 6").join(best_sentences(chunks.join(ranked.select(key).distinct(), key, "left_semi"), key), key)
    first = Window.partitionBy(key).orderBy(section)
    return able.withColumn("n", F.row_number().over(first)).where("n = 1").select(section, "rank", key, "sentence")


def report_terms(pages: DataFrame, stop_words: DataFrame, n: int = 6) -> DataFrame:
    """(term, n): the most frequent terms over title, description and the first 800 characters of all pages; ties by term."""
    text = F.concat_ws(" ", "title", "meta_description", F.substring("text", 1, 800))
    found = pages.select(F.explode(tokens(text)).alias("term")).join(stop_words.select(F.lower("word").alias("term")).distinct(), "term", "left_anti")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(n)


def context_lines(ranked: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, line): one line a distinct retrieved chunk, at its best score: id, heading (or title, or URL), score, text."""
    best = ranked.groupBy(key).agg(F.max("score").alias("score"))
    given = lambda c: F.when(F.trim(c) != "", F.col(c))
    label = F.coalesce(given("heading_path"), given("page_title"), F.col("page_url"), F.lit(""))
    own = best.join(chunks.select(key, "heading_path", "page_title", "page_url", "text"), key)
    return own.select(key, F.concat(F.lit("["), F.col(key).cast("string"), F.lit("] "), label, F.lit(" ("), F.format_string("%.2f", F.col("score")), F.lit(") "), F.coalesce("text", F.lit(""))).alias("line"))


def parsed_reply(reply: Column) -> Column:
    """The report object of a reply: bare, inside a code fence or between other words; null where there is none. Values of
    another kind than an object are not taken."""
    inner = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(inner != "", inner).otherwise(reply))
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(F.when(body.startswith("{"), body), REPLY), F.from_json(F.when(braces != "", braces), REPLY))


def _valid(replies: DataFrame) -> DataFrame:
    """replies with r, their report object, those only that have a summary."""
    return replies.withColumn("r", parsed_reply(F.col("reply"))).where("r IS NOT NULL AND trim(r.executive_summary) <> ''")


def guarded_points(replies: DataFrame, retrieved: DataFrame, sections: DataFrame) -> DataFrame:
    """(reply_id, section_id, point_no, text, citations): the points of each reply that cite at least one retrieved chunk,
    with those citations only, in order; sections that are not asked for and points without text are dropped.

    replies: reply_id, reply; retrieved: reply_id, cited; sections: section_id. A reply that can't be read or has no
    summary gives nothing."""
    each = _valid(replies).select("reply_id", F.explode("r.sections").alias("s")).select("reply_id", F.col("s.id").alias("section_id"), F.posexplode("s.points").alias("point_no", "p"))
    known = each.join(sections.select("section_id"), "section_id", "left_semi").where("trim(p.text) <> ''")
    cites = known.select("reply_id", "section_id", "point_no", F.col("p.text").alias("text"), F.posexplode("p.citations").alias("at", "cited"))
    good = cites.join(retrieved.select("reply_id", "cited").distinct(), ["reply_id", "cited"], "left_semi")
    return good.groupBy("reply_id", "section_id", "point_no", "text").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cited"))), lambda x: x["cited"]).alias("citations"))


REPAIR = "The reply before this was no JSON object of the form asked for. Answer with that object and nothing else.\n\n"


def repair_prompts(prompts_: DataFrame, replies: DataFrame) -> DataFrame:
    """(reply_id, prompt): the prompt (reply_id, prompt) again, after a note, for each id none of whose replies is valid."""
    return prompts_.join(_valid(replies).select("reply_id").distinct(), "reply_id", "left_anti").select("reply_id", F.concat(F.lit(REPAIR), "prompt").alias("prompt"))


def answered_sections(replies: DataFrame, retrieved: DataFrame, sections: DataFrame, extractive: DataFrame) -> DataFrame:
    """(reply_id, attempt, section, section_id, points): every asked section of every id, with its points (text, citations)
    in order, an empty array where there are none.

    replies: reply_id, attempt, reply. The first attempt with a valid report counts; an id without one, and one for which
    nothing was retrieved, gets the extractive points (reply_id, section_id, point_no, text, citations) and attempt 0."""
    ids = replies.select("reply_id").unionByName(extractive.select("reply_id")).distinct()
    first = _valid(replies.join(retrieved.select("reply_id").distinct(), "reply_id", "left_semi")).groupBy("reply_id").agg(F.min("attempt").alias("attempt"))
    chosen = guarded_points(replies.join(first, ["reply_id", "attempt"], "left_semi"), retrieved, sections)
    spare = extractive.join(first, "reply_id", "left_anti").select("reply_id", "section_id", "point_no", "text", "citations")
    points = chosen.unionByName(spare).groupBy("reply_id", "section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("point_no", "text", "citations"))), lambda p: F.struct(p["text"].alias("text"), p["citations"].alias("citations"))).alias("points"))
    wanted = [F.struct(F.lit(n).alias("section"), F.lit(i).alias("section_id")) for n, i in sections.select(F.col("section").cast("int"), "section_id").orderBy("section").collect()]  # the few sections of a report
    asked = ids.join(first, "reply_id", "left").withColumn("s", F.explode(F.array(*wanted) if wanted else F.array().cast("array<struct<section:int,section_id:string>>")))
    rows = asked.select("reply_id", F.coalesce("attempt", F.lit(0)).alias("attempt"), "s.section", "s.section_id")
    none = F.array().cast("array<struct<text:string,citations:array<string>>>")
    return rows.join(points, ["reply_id", "section_id"], "left").select("reply_id", "attempt", "section", "section_id", F.coalesce("points", none).alias("points"))


def executive_summary(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """(summary), one row: how many pages and words there are, the most frequent terms, and the first titles by page_id."""
    size = pages.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "term")))  # a handful of terms
    named = terms.agg(F.array_join(F.transform(order, lambda x: x["term"]), ", ").alias("terms"))
    first = pages.where("trim(title) <> ''").select("page_id", "title").orderBy("page_id").limit(5)
    titles = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "title"))), lambda x: x["title"]), "; ").alias("titles"))
    one = lambda df: df.withColumn("one", F.lit(1))
    joined = one(size).join(one(named), "one").join(one(titles), "one")
    return joined.select(F.concat(F.lit("The site has "), F.col("pages"), F.lit(" pages with "), F.col("words"), F.lit(" words. It often speaks of "), F.col("terms"), F.lit(". First pages: "), F.col("titles"), F.lit(".")).alias("summary"))


def prompts(context: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """(prompt), one row for a language model: the sections asked for, the answer's form, and the retrieved chunks by id."""
    lines = context.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "line"))), lambda x: x["line"]), "\n").alias("context"))  # what was retrieved: sections x k lines
    asked = sections.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "section_id", "title"))), lambda x: F.concat(x["section_id"], F.lit(": "), x["title"])), "\n").alias("asked"))
    joined = lines.withColumn("one", F.lit(1)).join(asked.withColumn("one", F.lit(1)), "one")
    form = '{"executive_summary": "...", "sections": [{"id": "...", "points": [{"text": "...", "citations": ["..."]}]}]}'
    return joined.select(F.concat(F.lit("Write a report with these sections:\n"), F.col("asked"), F.lit(f"\n\nAnswer with one JSON object: {form}\nCite chunks by their ids in brackets, and nothing else.\n\n"), F.col("context")).alias("prompt"))
