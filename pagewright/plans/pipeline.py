"""The chain from fetched pages to a cited report, as DataFrames that are computed when they are used."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import embedding_text
from pagewright.operators import analyze, chunk, extract, report, retrieve, tfidf
from pagewright.sources.tables import cut

#: Sections of a report: ordinal, id, title and the question that retrieves for it.
SECTIONS = [
    (0, "overview", "Overview", "what the company does and how its workshop team helps customers"),
    (1, "products", "Products and services", "product range delivery repair support service features"),
    (2, "pricing", "Prices and plans", "price cost percent offer euros discount order"),
    (3, "audience", "Customers", "who uses it: customers buyers teams crews and kitchens"),
    (4, "company", "Company", "founded registered name address opening hours contact people"),
]


@dataclass(frozen=True)
class Settings:
    target_words: int = 280
    overlap_words: int = 45
    top_k: int = 6
    max_per_page: int | None = 3
    min_page_words: int = 25

    def __post_init__(self):
        if not 80 <= self.target_words <= 1200 or not 0 <= self.overlap_words <= 400 or not 1 <= self.top_k <= 50:
            raise ValueError("a setting is out of its range")
        if self.overlap_words >= self.target_words:
            raise ValueError("the overlap must be less than the target")


@dataclass(frozen=True)
class Stages:
    extracted: DataFrame
    chunks: DataFrame
    ranked: DataFrame
    points: DataFrame
    pages: DataFrame
    report: DataFrame
    counts: DataFrame
    document: DataFrame
    seconds: dict[str, float]


def sections_table(spark) -> DataFrame:
    return spark.createDataFrame(SECTIONS, "section int, section_id string, title string, query string")


#: Parts in which the askers of one question get its answers.
ASKER_PARTS = 16


def rank(chunks: DataFrame, queries: DataFrame, stop_words: DataFrame, settings: Settings = Settings(), query: str = "section", key: str = "chunk_ord", page: str = "page_url", index: str | None = None, many: bool = False) -> DataFrame:
    """(query, key, page, score, rank): chunks (key, page, page_title, heading_path, text) for queries (query, text) by
    TF-IDF cosine, with the cap on a page. index: the folder of an index stored from these chunks by index_chunks; without
    it the chunks are split into terms and weighted here. many: for query sets that grow with the chunks; each different
    text is asked once, and frequent terms are joined only where they can decide. The rows are the same."""
    wide = settings.top_k * (2 if settings.max_per_page else 1) if many else None
    askers = None
    if many:
        askers = queries.select(query, F.sha2(F.coalesce("text", F.lit("")), 256).alias("asked"), "text")
        queries, asker, query = askers.groupBy("asked").agg(F.first("text").alias("text")), query, "asked"
    if index:
        scores = tfidf.search_index(chunks.sparkSession, index, queries, query, key, stop_words, wide)
    else:
        texts = chunks.select(key, embedding_text(F.col("page_title"), F.col("heading_path"), F.col("text")).alias("text"))
        counts = cut(tfidf.term_counts(texts, key, stop_words))  # texts are split into terms once
        weights = cut(tfidf.idf(counts, texts.count())) if many else tfidf.idf(counts, texts.count())
        asked = tfidf.postings(tfidf.term_counts(queries.select(query, "text"), query, stop_words), weights, query)
        corpus = tfidf.postings(counts, weights, key)
        scores = tfidf.best_cosine(cut(asked), corpus, query, key, wide) if many else tfidf.cosine(asked, corpus, query, key)
    ranked = retrieve.page_capped(scores.join(chunks.select(key, page), key), query, key, page, settings.top_k, settings.max_per_page)
    if not many:
        return ranked
    part = F.pmod(F.xxhash64(asker), F.lit(ASKER_PARTS)).cast("int")
    answers = ranked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ASKER_PARTS - 1))))
    return askers.select(asker, "asked", part.alias("part")).join(answers, ["asked", "part"]).select(asker, key, page, "score", "rank")


def index_chunks(chunks: DataFrame, stop_words: DataFrame, folder: str, key: str = "chunk_ord") -> None:
    """Fit the terms of chunks once, for any number of rank calls."""
    tfidf.store_index(chunks.select(key, embedding_text(F.col("page_title"), F.col("heading_path"), F.col("text")).alias("text")), key, stop_words, folder)


def stage_counts(fetched: DataFrame, extracted: DataFrame, kept: DataFrame, chunks: DataFrame, ranked: DataFrame, points: DataFrame) -> DataFrame:
    """(ord, stage, items): what each stage gave; pages that could be read count beside those that were fetched."""
    parts = [("fetched", fetched), ("read", fetched.where(extract.ok())), ("extracted", extracted), ("kept", kept), ("chunks", chunks), ("retrieved", ranked), ("points", points)]
    out = None
    for i, (name, df) in enumerate(parts):
        row = df.agg(F.count(F.lit(1)).alias("items")).select(F.lit(i).alias("ord"), F.lit(name).alias("stage"), "items")
        out = row if out is None else out.unionByName(row)
    return out


def run(pages: DataFrame, stop_words: DataFrame, settings: Settings = Settings(), title: str = "Site report") -> Stages:
    """Fetched pages (page_id, run_id, url, status, error, html) to a report. seconds has the time of each stage that is
    computed here; the others are computed when they are used."""
    spark, seconds, began = pages.sparkSession, {}, time.time()

    def done(name: str, df: DataFrame) -> DataFrame:
        nonlocal began
        df = cut(df)
        seconds[name], began = round(time.time() - began, 3), time.time()
        return df

    extracted = done("extracted", extract.extract(pages))  # pages are parsed once
    kept = extract.kept_pages(extracted, settings.min_page_words)
    # Runs and ids are numbered; texts are moved once, by page.
    numbers = chunk.numbered_pages(kept.select("page_id").join(pages.select("page_id", "run_id"), "page_id"), "run_id", "page_id")
    chunks = chunk.chunk_pages(kept.join(numbers, "page_id"), settings.target_words, settings.overlap_words).withColumn("chunk_ord", F.xxhash64("page_id", "id"))
    chunks = done("chunks", chunks)
    sections = sections_table(spark)
    ranked = done("retrieved", rank(chunks, sections.select("section", F.col("query").alias("text")), stop_words, settings))
    points = done("points", analyze.cited_points(ranked, chunks, "section", "chunk_ord"))
    summaries = report.page_summaries(kept, chunks)
    marked = report.markdown(points, chunks, sections, "chunk_ord")
    counts = stage_counts(pages, extracted, kept, chunks, ranked, points)
    summary = analyze.executive_summary(kept, analyze.report_terms(kept, stop_words))
    document = report.document(title, summary, marked.join(sections.select("section", "section_id"), "section_id"), summaries, counts, chunks, "chunk_ord")
    return Stages(kept, chunks, ranked, points, summaries, marked, counts, document, seconds)
