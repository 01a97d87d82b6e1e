"""Queries over the stored tables for every operator, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import embedding_text, host_of, slug, word_count
from pagewright.operators import analyze, chunk, crawl, evaluate, extract, report, retrieve, robots, tfidf, vectors
from pagewright.plans import pipeline
from pagewright.sources.tables import cut, ensure_checkpoint_dir, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- TF-IDF ---------------------------------------------------------------------------------------------------------
_TOKENS = """
WITH stop AS (SELECT DISTINCT lower(word) AS term FROM common_words WHERE lang = 'en'),
texts AS (SELECT chunk_ord, concat_ws(chr(10), nullif(concat_ws(' — ', CASE WHEN trim(page_title) <> '' THEN page_title END, CASE WHEN trim(heading_path) <> '' THEN heading_path END), ''), CASE WHEN trim(text) <> '' THEN text END) AS text FROM chunks),
counts AS (SELECT chunk_ord, term, count(*) AS tf FROM (SELECT chunk_ord, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM texts) WHERE length(term) > 1 AND term NOT IN (SELECT term FROM stop) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM texts) + 1) / (count(*) + 1)) + 1 AS idf FROM counts GROUP BY term),
corpus AS (SELECT chunk_ord, term, (1 + ln(tf)) * idf AS weight, sqrt(sum(power((1 + ln(tf)) * idf, 2)) OVER (PARTITION BY chunk_ord)) AS norm FROM counts JOIN idf USING (term))
"""


def _stop(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "common_words").where("lang = 'en'")


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").select("chunk_ord", embedding_text(F.col("page_title"), F.col("heading_path"), F.col("text")).alias("text"))


def _corpus(spark: SparkSession, root: str):
    texts = _texts(spark, root)
    counts = tfidf.term_counts(texts, "chunk_ord", _stop(spark, root))
    weights = tfidf.idf(counts, texts.count())
    return counts, weights, tfidf.postings(counts, weights, "chunk_ord")


@query(_TOKENS + "SELECT chunk_ord, term, tf FROM counts")
def term_counts(spark, root):
    return tfidf.term_counts(_texts(spark, root), "chunk_ord", _stop(spark, root))


@query(_TOKENS + "SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark, root):
    return _corpus(spark, root)[1].select("term", "df", F.round("idf", 6).alias("idf"))


@query(_TOKENS + "SELECT chunk_ord, round(min(norm), 6) AS norm, count(*) AS terms FROM corpus GROUP BY chunk_ord")
def tfidf_norms(spark, root):
    return _corpus(spark, root)[2].groupBy("chunk_ord").agg(F.round(F.min("norm"), 6).alias("norm"), F.count(F.lit(1)).alias("terms"))


@query(_TOKENS + "SELECT chunk_ord, rank, term, weight FROM (SELECT chunk_ord, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY chunk_ord ORDER BY round(weight, 6) DESC, term) AS rank FROM corpus) WHERE rank <= 5")
def top_terms(spark, root):
    scores = _corpus(spark, root)[2].select("chunk_ord", "term", F.round("weight", 6).alias("score"))
    return retrieve.top_k(scores, "chunk_ord", "term", 5).select("chunk_ord", F.col("rank").cast("long").alias("rank"), "term", F.col("score").alias("weight"))


@query(_TOKENS.split(",\ncounts")[0] + "SELECT chunk_ord, text FROM texts")
def embedding_texts(spark, root):
    return _texts(spark, root)


_SECTIONS = "(VALUES " + ", ".join(f"({n}, '{i}', '{t}', '{q}')" for n, i, t, q in pipeline.SECTIONS) + ") AS s(section, section_id, title, query)"
_SCORES = _TOKENS + f""",
qcounts AS (SELECT section, term, count(*) AS tf FROM (SELECT section, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM {_SECTIONS}) WHERE length(term) > 1 AND term NOT IN (SELECT term FROM stop) GROUP BY ALL),
q AS (SELECT section, term, (1 + ln(tf)) * idf AS weight, sqrt(sum(power((1 + ln(tf)) * idf, 2)) OVER (PARTITION BY section)) AS norm FROM qcounts JOIN idf USING (term)),
scores AS (SELECT section, chunk_ord, round(sum(q.weight * c.weight) / (min(q.norm) * min(c.norm)), 6) AS score FROM q JOIN corpus c USING (term) GROUP BY section, chunk_ord),
best AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, chunk_ord) AS rank FROM scores WHERE score > 0),
capped AS (SELECT section, chunk_ord, score, row_number() OVER (PARTITION BY section ORDER BY rank) AS rank FROM (
  SELECT b.*, row_number() OVER (PARTITION BY section, page_url ORDER BY rank) AS n FROM best b JOIN chunks USING (chunk_ord) WHERE rank <= 12) WHERE n <= 3),
ranked AS (SELECT * FROM capped WHERE rank <= 6)
"""


def _ranked(spark, root) -> DataFrame:
    sections = pipeline.sections_table(spark).select("section", F.col("query").alias("text"))
    return pipeline.rank(table(spark, root, "chunks"), sections, _stop(spark, root))


@query(_SCORES + "SELECT section, chunk_ord, score, rank FROM best WHERE rank <= 5")
def retrieve_topk(spark, root):
    sections = pipeline.sections_table(spark).select("section", F.col("query").alias("text"))
    got = pipeline.rank(table(spark, root, "chunks"), sections, _stop(spark, root), pipeline.Settings(top_k=5, max_per_page=None))
    return got.select("section", "chunk_ord", "score", F.col("rank").cast("long").alias("rank"))


@query(_SCORES + "SELECT section, chunk_ord, score, rank FROM ranked")
def retrieve_page_capped(spark, root):
    return _ranked(spark, root).select("section", "chunk_ord", "score", F.col("rank").cast("long").alias("rank"))


@query(_SCORES + "SELECT section, chunk_ord, score, rank FROM ranked")
def retrieve_indexed(spark, root):
    """As retrieve_page_capped, from an index that is stored first, in the shared folder."""
    chunks, folder = table(spark, root, "chunks"), f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    pipeline.index_chunks(chunks, _stop(spark, root), folder)
    sections = pipeline.sections_table(spark).select("section", F.col("query").alias("text"))
    return pipeline.rank(chunks, sections, _stop(spark, root), index=folder).select("section", "chunk_ord", "score", F.col("rank").cast("long").alias("rank"))


# ---- evaluation: titles of every 50th page as questions, the page as the truth ----------------------------------------
_CASES = _TOKENS + """,
cases AS (SELECT page_id AS case_id, title AS query, url AS expected_url, substr(split_part(text, chr(10), 1), 4, 40) AS expected_snippet FROM extracted_pages WHERE page_id % 50 = 0 AND title IS NOT NULL),
qcounts AS (SELECT case_id, term, count(*) AS tf FROM (SELECT case_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM cases) WHERE length(term) > 1 AND term NOT IN (SELECT term FROM stop) GROUP BY ALL),
q AS (SELECT case_id, term, (1 + ln(tf)) * idf AS weight, sqrt(sum(power((1 + ln(tf)) * idf, 2)) OVER (PARTITION BY case_id)) AS norm FROM qcounts JOIN idf USING (term)),
scores AS (SELECT case_id, chunk_ord, round(sum(q.weight * c.weight) / (min(q.norm) * min(c.norm)), 6) AS score FROM q JOIN corpus c USING (term) GROUP BY case_id, chunk_ord),
best AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, chunk_ord) AS rank FROM scores WHERE score > 0),
results AS (SELECT c.case_id, min(CASE WHEN contains(k.page_url, c.expected_url) THEN rank END) AS first_rank,
  coalesce(bool_or(c.expected_snippet <> '' AND contains(lower(k.text), lower(c.expected_snippet))), false) AS snippet_at_5
  FROM cases c LEFT JOIN (SELECT * FROM best WHERE rank <= 5) b USING (case_id) LEFT JOIN chunks k USING (chunk_ord) GROUP BY c.case_id),
graded AS (SELECT case_id, first_rank, coalesce(first_rank <= 3, false) AS hit_at_3, coalesce(first_rank <= 5, false) AS hit_at_5, snippet_at_5 FROM results)
"""


def _case_results(spark, root) -> DataFrame:
    pages = table(spark, root, "extracted_pages").where("page_id % 50 = 0 AND title IS NOT NULL")
    cases = pages.select(F.col("page_id").alias("case_id"), F.col("title").alias("text"), F.col("url").alias("expected_url"), F.expr("substring(split_part(text, '\n', 1), 4, 40)").alias("expected_snippet"))
    chunks = table(spark, root, "chunks")
    got = pipeline.rank(chunks, cases, _stop(spark, root), pipeline.Settings(top_k=5, max_per_page=None), query="case_id", many=True)
    ranked = got.select("case_id", "chunk_ord", F.col("rank").cast("long").alias("rank")).join(chunks.select("chunk_ord", "page_url", "text"), "chunk_ord")
    return evaluate.case_results(cases.drop("text"), ranked)


@query(_CASES + "SELECT * REPLACE (coalesce(first_rank, 0) AS first_rank) FROM graded")
def eval_cases(spark, root):
    """first_rank is 0 for a case without a hit."""
    return _case_results(spark, root).na.fill(0, ["first_rank"])


@query(_CASES + """SELECT count(*) AS cases, round(avg(hit_at_3::DOUBLE), 6) AS hit_at_3, round(avg(hit_at_5::DOUBLE), 6) AS hit_at_5, round(avg(snippet_at_5::DOUBLE), 6) AS snippet_at_5,
round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr FROM graded""")
def eval_summary(spark, root):
    return evaluate.summary(_case_results(spark, root))


# ---- dense vectors ----------------------------------------------------------------------------------------------------
_KNN = """
WITH n AS (SELECT q.vec_id AS query_id, v.vec_id, q.label AS label, v.label AS other, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM n WHERE score > 0)
"""


def _knn(spark, root) -> DataFrame:
    found = table(spark, root, "embeddings")
    return vectors.knn(found, found.where("vec_id % 50 = 0"), 5)


@query(_KNN + "SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5")
def knn_exact(spark, root):
    return _knn(spark, root).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query(_KNN + "SELECT label, count(*) AS neighbours, round(avg((label = other)::INT), 6) AS agreement FROM r WHERE rank <= 5 GROUP BY label")
def knn_label_agreement(spark, root):
    return vectors.label_agreement(_knn(spark, root), table(spark, root, "embeddings"))


@query(_KNN + "SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5")
def knn_hashed(spark, root):
    """Queries that their buckets don't settle, here nearly all, get the exact answer; the SQL gives the exact one for all."""
    found = table(spark, root, "embeddings")
    return vectors.knn_hashed(found, found.where("vec_id % 50 = 0"), 5).select("query_id", "vec_id", "score", "rank")


# ---- sentences, points, citations ---------------------------------------------------------------------------------------
_SENTENCES = r"""
parts AS (SELECT chunk_ord, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM chunks WHERE text IS NOT NULL),
sentences AS (SELECT chunk_ord, i - 1 AS pos, trim(s[i]) AS sentence FROM parts, unnest(generate_series(1, len(s))) AS t(i)),
scored AS (SELECT *, CAST(CASE WHEN regexp_matches(sentence, '[0-9]') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(sentence, '[A-Z][a-z]{2,}') THEN 2 ELSE 0 END
  + least(len(regexp_extract_all(sentence, '\S+')) // 25, 2) AS INTEGER) AS score FROM sentences WHERE length(sentence) > 30),
best_s AS (SELECT chunk_ord, sentence, score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_ord ORDER BY score DESC, pos) AS n FROM scored) WHERE n = 1)
"""


@query("WITH " + _SENTENCES.strip() + " SELECT chunk_ord, CAST(pos AS INTEGER) AS pos, sentence, score FROM scored")
def sentence_scores(spark, root):
    return analyze.scored_sentences(table(spark, root, "chunks"), "chunk_ord")


@query("WITH " + _SENTENCES.strip() + " SELECT * FROM best_s")
def best_sentence(spark, root):
    return analyze.best_sentences(table(spark, root, "chunks"), "chunk_ord")


_POINTS = _SCORES + "," + _SENTENCES + """, points AS (SELECT section, rank, chunk_ord, sentence FROM (
  SELECT r.section, r.rank, chunk_ord, sentence, row_number() OVER (PARTITION BY chunk_ord ORDER BY section) AS n FROM ranked r JOIN best_s USING (chunk_ord)) WHERE n = 1)
"""


def _points(spark, root) -> DataFrame:
    return analyze.cited_points(_ranked(spark, root), table(spark, root, "chunks"), "section", "chunk_ord")


@query(_POINTS + "SELECT section, rank, chunk_ord, sentence FROM points")
def cited_points(spark, root):
    return _points(spark, root).select("section", F.col("rank").cast("long").alias("rank"), "chunk_ord", "sentence")


@query(_POINTS + f"""SELECT section_id, '## ' || title || chr(10) || chr(10) || coalesce(body, 'No findings.') AS markdown FROM {_SECTIONS} LEFT JOIN (
  SELECT section, string_agg('- ' || sentence || ' [' || chunk_ord || '](' || coalesce(page_url, '') || ')', chr(10) ORDER BY rank) AS body FROM points JOIN chunks USING (chunk_ord) GROUP BY section) USING (section)""")
def report_markdown(spark, root):
    return report.markdown(_points(spark, root), table(spark, root, "chunks"), pipeline.sections_table(spark), "chunk_ord")


@query(_SCORES + """SELECT chunk_ord, '[' || chunk_ord || '] ' || coalesce(CASE WHEN trim(heading_path) <> '' THEN heading_path END, CASE WHEN trim(page_title) <> '' THEN page_title END, page_url, '') || ' (' || printf('%.2f', score) || ') ' || coalesce(text, '') AS line
FROM (SELECT chunk_ord, max(score) AS score FROM ranked GROUP BY chunk_ord) JOIN chunks USING (chunk_ord)""")
def context_lines(spark, root):
    return analyze.context_lines(_ranked(spark, root), table(spark, root, "chunks"), "chunk_ord")


@query("""WITH stop AS (SELECT DISTINCT lower(word) AS term FROM common_words WHERE lang = 'en'),
t AS (SELECT unnest(regexp_extract_all(lower(concat_ws(' ', title, meta_description, substr(text, 1, 800))), '[a-z0-9]+')) AS term FROM extracted_pages)
SELECT term, count(*) AS n FROM t WHERE length(term) > 1 AND term NOT IN (SELECT term FROM stop) GROUP BY term ORDER BY n DESC, term LIMIT 6""")
def report_terms(spark, root):
    return analyze.report_terms(table(spark, root, "extracted_pages"), _stop(spark, root))


@query("""WITH stop AS (SELECT DISTINCT lower(word) AS term FROM common_words WHERE lang = 'en'),
t AS (SELECT unnest(regexp_extract_all(lower(concat_ws(' ', title, meta_description, substr(text, 1, 800))), '[a-z0-9]+')) AS term FROM extracted_pages),
c AS (SELECT term, count(*) AS n FROM t WHERE length(term) > 1 AND term NOT IN (SELECT term FROM stop) GROUP BY term ORDER BY n DESC, term LIMIT 6)
SELECT 'The site has ' || (SELECT count(*) FROM extracted_pages) || ' pages with ' || (SELECT coalesce(sum(word_count), 0) FROM extracted_pages) || ' words. It often speaks of ' || (SELECT string_agg(term, ', ' ORDER BY n DESC, term) FROM c)
 || '. First pages: ' || (SELECT string_agg(title, '; ' ORDER BY page_id) FROM (SELECT page_id, title FROM extracted_pages WHERE trim(title) <> '' ORDER BY page_id LIMIT 5)) || '.' AS summary""")
def executive_summary(spark, root):
    pages = table(spark, root, "extracted_pages")
    return analyze.executive_summary(pages, analyze.report_terms(pages, _stop(spark, root)))


@query(f"""SELECT 'Write a report with these sections:' || chr(10) || (SELECT string_agg(section_id || ': ' || title, chr(10) ORDER BY section) FROM {_SECTIONS}) || chr(10) || chr(10)
|| 'Answer with one JSON object: {{"executive_summary": "...", "sections": [{{"id": "...", "points": [{{"text": "...", "citations": ["..."]}}]}}]}}' || chr(10) || 'Cite chunks by their ids in brackets, and nothing else.' || chr(10) || chr(10)
|| (SELECT string_agg(line, chr(10) ORDER BY chunk_ord) FROM ({ORACLE["context_lines"]})) AS prompt""")
def prompt(spark, root):
    context = analyze.context_lines(_ranked(spark, root), table(spark, root, "chunks"), "chunk_ord")
    return analyze.prompts(context, pipeline.sections_table(spark), "chunk_ord")


def _replies(spark, root) -> DataFrame:
    """Two replies for each page with chunks: the second one good, fenced for even ids and between words for odd ones; the
    first one no JSON (page_id % 4 = 0), without a summary (1), good (2) or a list (3). A good one cites the page's chunks from the
    last to the first, the text of a point being the title and its number, and one that doesn't exist; it has a point that cites
    nothing known and a section that nobody asked for. A page without a title has no summary."""
    chunks = table(spark, root, "chunks").where("text IS NOT NULL").groupBy("page_id").agg(F.sort_array(F.collect_list("chunk_ord"), False).alias("c"), F.min_by("page_title", "chunk_ord").alias("t"))
    point = lambda text, cites: F.struct(text.alias("text"), cites.alias("citations"))
    title = F.coalesce("t", F.lit(""))
    points = F.transform(F.col("c"), lambda c, i: point(F.concat(title, F.lit(" "), i.cast("string")), F.concat(F.array(F.lit("none")), F.transform(F.slice(F.col("c"), i + 1, F.lit(3)), lambda x: x.cast("string")))))
    unknown = F.array(point(F.lit("second"), F.array(F.lit("none"))))
    sections = F.array(F.struct(F.lit("overview").alias("id"), F.concat(unknown, points).alias("points")), F.struct(F.lit("gossip").alias("id"), unknown.alias("points")))
    body = lambda summary: F.to_json(F.struct(summary.alias("executive_summary"), sections.alias("sections")))
    id_ = F.col("page_id")
    good = F.when(id_ % 2 == 0, F.concat(F.lit("```json\n"), body(title), F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), body(title), F.lit(" - done.")))
    first = F.when(id_ % 4 == 0, F.lit('{"executive_summary": "cut off')).when(id_ % 4 == 1, body(F.lit(" "))).when(id_ % 4 == 2, good).otherwise(F.lit("[1, 2]"))
    each = chunks.select("page_id", F.explode(F.array(F.struct(F.lit(1).alias("attempt"), first.alias("reply")), F.struct(F.lit(2).alias("attempt"), good.alias("reply")))).alias("a"))
    return each.select(id_.alias("reply_id"), "a.attempt", "a.reply")


def _retrieved(spark, root) -> DataFrame:
    return table(spark, root, "chunks").select(F.col("page_id").alias("reply_id"), F.col("chunk_ord").cast("string").alias("cited"))


_GUARDED = """
WITH c AS (SELECT page_id, list(chunk_ord ORDER BY chunk_ord DESC) AS c, arg_min(coalesce(page_title, ''), chunk_ord) AS t FROM chunks WHERE text IS NOT NULL GROUP BY page_id),
g AS (SELECT page_id, CAST(i AS INTEGER) AS point_no, t || ' ' || (i - 1) AS text, list_transform(c[i:i + 2], lambda x: CAST(x AS VARCHAR)) AS citations FROM c, unnest(generate_series(1, len(c))) AS s(i) WHERE trim(t) <> '')
"""


@query(_GUARDED + "SELECT page_id AS reply_id, 'overview' AS section_id, point_no, text, citations FROM g")
def citation_guard(spark, root):
    return analyze.guarded_points(_replies(spark, root).where("attempt = 2"), _retrieved(spark, root), pipeline.sections_table(spark))


def _extractive(spark, root) -> DataFrame:
    """The best sentence of the first chunk of each page that has one, as a point of the first section."""
    best = analyze.best_sentences(table(spark, root, "chunks"), "chunk_ord").join(table(spark, root, "chunks").select("chunk_ord", "page_id"), "chunk_ord")
    one = best.groupBy(F.col("page_id").alias("reply_id")).agg(F.min_by(F.struct("sentence", "chunk_ord"), "chunk_ord").alias("b"))
    return one.select("reply_id", F.lit("overview").alias("section_id"), F.lit(0).alias("point_no"), F.col("b.sentence").alias("text"), F.array(F.col("b.chunk_ord").cast("string")).alias("citations"))


@query(_GUARDED + "," + _SENTENCES + f""",
e AS (SELECT page_id, arg_min(sentence, chunk_ord) AS text, min(chunk_ord) AS c FROM best_s JOIN chunks USING (chunk_ord) GROUP BY page_id),
ids AS (SELECT page_id FROM c UNION SELECT page_id FROM e),
a AS (SELECT page_id, CASE WHEN trim(coalesce(t, '')) = '' THEN 0 WHEN page_id % 4 = 2 THEN 1 ELSE 2 END AS attempt FROM ids LEFT JOIN c USING (page_id)),
p AS (SELECT page_id, string_agg(text || '=' || array_to_string(citations, ','), '; ' ORDER BY point_no) AS points FROM g GROUP BY page_id
  UNION ALL SELECT page_id, text || '=' || c FROM e JOIN a USING (page_id) WHERE attempt = 0)
SELECT a.page_id AS reply_id, CAST(attempt AS INTEGER) AS attempt, section_id, coalesce(CASE WHEN section = 0 THEN points END, '') AS points FROM a CROSS JOIN {_SECTIONS} LEFT JOIN p USING (page_id)""")
def reply_sections(spark, root):
    """Replies by attempt, the first valid one of each id, else extractive points; the points of a section as one text."""
    got = analyze.answered_sections(_replies(spark, root), _retrieved(spark, root), pipeline.sections_table(spark), _extractive(spark, root))
    text = F.array_join(F.transform("points", lambda p: F.concat(p["text"], F.lit("="), F.array_join(p["citations"], ","))), "; ")
    return got.select("reply_id", "attempt", "section_id", text.alias("points"))


@query(_GUARDED + "SELECT page_id AS reply_id, 'The reply before this was no JSON object of the form asked for. Answer with that object and nothing else.' || chr(10) || chr(10) || t AS prompt FROM c WHERE page_id % 4 <> 2 OR trim(t) = ''")
def repair_prompts(spark, root):
    """Which pages' first reply needs another attempt; the title stands for the prompt."""
    prompts = table(spark, root, "chunks").where("text IS NOT NULL").groupBy(F.col("page_id").alias("reply_id")).agg(F.min_by(F.coalesce("page_title", F.lit("")), "chunk_ord").alias("prompt"))
    return analyze.repair_prompts(prompts, _replies(spark, root).where("attempt = 1"))


# ---- pages, sections, chunks ---------------------------------------------------------------------------------------------
@query("SELECT page_id, url, status FROM fetched_pages WHERE error IS NULL AND status BETWEEN 200 AND 299 AND length(html) > 0")
def ok_pages(spark, root):
    return table(spark, root, "fetched_pages").where(extract.ok()).select("page_id", "url", "status")


_WS = r"[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"


@query(f"SELECT * FROM (SELECT page_id, CAST(coalesce(len(regexp_extract_all(text, '{_WS}')), 0) AS INTEGER) AS words FROM extracted_pages) WHERE words < 25")
def thin_pages(spark, root):
    pages = table(spark, root, "extracted_pages")
    return pages.select("page_id", word_count(F.col("text")).alias("words")).where(F.col("words") < extract.MIN_PAGE_WORDS)


@query(r"""WITH l AS (SELECT page_id, i - 1 AS line_no, trim(x[i]) AS line FROM (SELECT page_id, string_split(text, chr(10)) AS x FROM extracted_pages), unnest(generate_series(1, len(x))) AS t(i)),
m AS (SELECT *, length(regexp_extract(line, '^(#{2,5})\s+\S', 1)) AS level, trim(regexp_replace(line, '^#{2,5}\s+', '')) AS title FROM l WHERE line <> ''),
s AS (SELECT *, CAST(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS INTEGER) AS section_no,
  last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS h2,
  last_value(CASE WHEN level = 3 THEN title WHEN level = 2 THEN '' END IGNORE NULLS) OVER w AS h3,
  last_value(CASE WHEN level = 4 THEN title WHEN level IN (2, 3) THEN '' END IGNORE NULLS) OVER w AS h4,
  last_value(CASE WHEN level = 5 THEN title WHEN level IN (2, 3, 4) THEN '' END IGNORE NULLS) OVER w AS h5
  FROM m WINDOW w AS (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT page_id, CAST(line_no AS INTEGER) AS line_no, section_no, concat_ws(' > ', nullif(h2, ''), nullif(h3, ''), nullif(h4, ''), nullif(h5, '')) AS heading_path, line FROM s WHERE level = 0""")
def section_lines(spark, root):
    return chunk.section_lines(table(spark, root, "extracted_pages"))


def _chunked(spark, root) -> DataFrame:
    pages = extract.kept_pages(table(spark, root, "extracted_pages").withColumn("word_count", word_count(F.col("text"))))
    runs = table(spark, root, "fetched_pages").select("page_id", "run_id")
    return chunk.chunk_pages(pages.join(chunk.numbered_pages(pages.select("page_id").join(runs, "page_id"), "run_id", "page_id"), "page_id"))


@query(f"""SELECT run_id, page_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY page_id) - 1 AS INTEGER) AS page_no FROM extracted_pages JOIN fetched_pages USING (page_id)
WHERE coalesce(len(regexp_extract_all(text, '{_WS}')), 0) >= 25""")
def page_numbers(spark, root):
    pages = extract.kept_pages(table(spark, root, "extracted_pages").withColumn("word_count", word_count(F.col("text"))))
    return chunk.numbered_pages(pages.select("page_id").join(table(spark, root, "fetched_pages").select("page_id", "run_id"), "page_id"), "run_id", "page_id")


@query()
def chunked_pages(spark, root):
    return _chunked(spark, root)


@query()
def chunk_stats(spark, root):
    """Chunks and mean words of a chunk of each run's pages, as made here."""
    made = _chunked(spark, root).join(table(spark, root, "fetched_pages").select("page_id", "run_id"), "page_id")
    return made.groupBy("run_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.sum("word_count") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("mean_words"))


@query("""SELECT p.page_id, url, coalesce(CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(string_split(url, '/')[-1]) <> '' THEN string_split(url, '/')[-1] END, url) AS title, coalesce(word_count, 0) AS word_count, coalesce(n, 0) AS chunk_count,
coalesce(CASE WHEN trim(meta_description) <> '' THEN meta_description END, CASE WHEN length(text) > 140 THEN regexp_replace(substr(replace(text, chr(10), ' '), 1, 140), '\\s+\\S*$', '') || '…' ELSE replace(text, chr(10), ' ') END) AS summary_line
FROM extracted_pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM chunks GROUP BY page_id) c ON p.page_id = c.page_id""".replace("\\\\", "\\"))
def page_summaries(spark, root):
    return report.page_summaries(table(spark, root, "extracted_pages"), table(spark, root, "chunks")).na.fill(0, ["word_count"])


@query(r"""WITH h AS (SELECT page_id, status, regexp_replace(html, '(?is)<body.*$', '') AS head FROM fetched_pages WHERE error IS NULL AND status BETWEEN 200 AND 299 AND length(html) > 0),
t AS (SELECT page_id, status, regexp_extract(head, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(head, '(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1) AS meta FROM h)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(title, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '\s+', ' ', 'g')) AS title,
trim(replace(replace(replace(replace(meta, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"')) AS meta_description, status AS fetch_status FROM t""")
def extracted_heads(spark, root):
    """Title and description as extraction gives them."""
    return extract.extract(table(spark, root, "fetched_pages")).select("page_id", "title", "meta_description", "fetch_status")


@query()
def extracted(spark, root):
    return extract.extract(table(spark, root, "fetched_pages"))


@query("""SELECT run_id, round(avg(kept_ratio), 6) AS mean_kept_ratio, sum(word_count) AS words FROM extracted_pages JOIN fetched_pages USING (page_id) GROUP BY run_id""")
def run_ratios(spark, root):
    pages = table(spark, root, "extracted_pages").join(table(spark, root, "fetched_pages").select("page_id", "run_id"), "page_id")
    return pages.groupBy("run_id").agg(F.round(F.avg("kept_ratio"), 6).alias("mean_kept_ratio"), F.sum("word_count").alias("words"))


# ---- URLs, links, crawls ----------------------------------------------------------------------------------------------------
@query(r"""SELECT page_id, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS authority,
coalesce(nullif(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path,
nullif(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', ''), '') AS host,
lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) || '://' || lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))
 || coalesce(nullif(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(trim(url), '^[^?#]*(\?[^#]*)?', 1) AS normalized FROM fetched_pages""")
def url_parts(spark, root):
    u = F.col("url")
    return table(spark, root, "fetched_pages").select("page_id", urls.scheme_of(u).alias("scheme"), urls.authority_of(u).alias("authority"), urls.path_of(u).alias("path"), host_of(u).alias("host"), urls.normalized(u).alias("normalized"))


@query(r"""SELECT page_id, left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug FROM extracted_pages WHERE regexp_matches(title, '[A-Za-z0-9]')""")
def title_slugs(spark, root):
    return table(spark, root, "extracted_pages").where(F.col("title").rlike("[A-Za-z0-9]")).select("page_id", slug(F.col("title")).alias("slug"))


_LINKS = r"""
WITH r AS (SELECT page_id, url, i - 1 AS position, refs[i] AS ref, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS site
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS refs FROM fetched_pages WHERE error IS NULL AND status BETWEEN 200 AND 299 AND length(html) > 0), unnest(generate_series(1, len(refs))) AS t(i)),
f AS (SELECT page_id, min(position) AS position, site || ref AS link FROM r WHERE starts_with(ref, '/') AND NOT regexp_matches(lower(ref), '\.(css|gif|gz|ico|jpeg|jpg|js|json|mp3|mp4|pdf|png|rss|svg|tar|webp|xml|zip)$') GROUP BY page_id, site || ref)
"""


@query(_LINKS + "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY position) - 1 AS INTEGER) AS position, link FROM f")
def page_links(spark, root):
    return extract.same_site(extract.links(table(spark, root, "fetched_pages"))).select("page_id", "position", "link")


@query("SELECT run_id, sum((error IS NULL AND status BETWEEN 200 AND 299)::INT) AS pages_fetched, sum((NOT (error IS NULL AND status BETWEEN 200 AND 299))::INT) AS pages_failed, max(depth) AS deepest FROM fetched_pages GROUP BY run_id")
def run_counters(spark, root):
    return crawl.run_counters(table(spark, root, "fetched_pages"))


def _graph(spark, root):
    pages = table(spark, root, "fetched_pages")
    return crawl.stored_graph(pages, table(spark, root, "crawl_stats").select("run_id", F.col("start_url").alias("url")))


_WALK = """
WITH RECURSIVE p AS (SELECT run_id, page_id, url, depth FROM fetched_pages WHERE depth IS NOT NULL AND page_id IS NOT NULL AND url IS NOT NULL),
s AS (SELECT DISTINCT run_id, start_url AS url FROM crawl_stats),
b AS (SELECT run_id, page_id, url, (SELECT max(q.page_id) FROM p q WHERE q.run_id = c.run_id AND q.depth = c.depth AND q.page_id < c.page_id) AS same,
  coalesce((SELECT max(q.page_id) FROM p q WHERE q.run_id = c.run_id AND q.depth = c.depth - 1 AND q.page_id < c.page_id), (SELECT min(q.page_id) FROM p q WHERE q.run_id = c.run_id AND q.depth = c.depth - 1)) AS parent FROM p c),
e AS (SELECT coalesce(q.url, s.url) AS url, b.page_id AS position, b.url AS link FROM b JOIN s USING (run_id) LEFT JOIN p q ON q.page_id = b.parent
  UNION ALL SELECT z.url, b.page_id, b.url FROM b JOIN s USING (run_id) JOIN b a ON a.page_id = b.parent JOIN p z ON z.page_id = a.same
  UNION ALL SELECT b.url, coalesce(b.parent, -1), coalesce(q.url, s.url) FROM b JOIN s USING (run_id) LEFT JOIN p q ON q.page_id = b.parent),
w AS (SELECT run_id, url, 0 AS depth, CAST([] AS BIGINT[]) AS path, [url] AS way FROM s
  UNION ALL SELECT w.run_id, e.link, w.depth + 1, list_append(w.path, e.position), list_append(w.way, e.link) FROM w JOIN e ON e.url = w.url WHERE w.depth < (SELECT max(depth) FROM p) AND NOT list_contains(w.way, e.link)),
f AS (SELECT run_id, url, depth, path FROM w QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY depth, path) = 1),
o AS (SELECT run_id, url, depth, row_number() OVER (PARTITION BY run_id, depth ORDER BY path) - 1 AS ord FROM f)
"""


@query(_WALK + "SELECT run_id, url, depth, ord FROM o QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY depth, ord) <= 25")
def crawl_bfs(spark, root):
    starts, edges, deepest = _graph(spark, root)
    return crawl.crawl(starts, edges, max_pages=25, max_depth=deepest)[0]


_POLITE = _WALK.replace("AND NOT list_contains(w.way, e.link)", "AND NOT list_contains(w.way, e.link) AND NOT contains(w.url, '/support/')") + """,
x AS (SELECT *, contains(url, '/support/') AS no, coalesce(sum((NOT contains(url, '/support/'))::INT) OVER (PARTITION BY run_id ORDER BY depth, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 15 AS popped FROM f),
late AS (SELECT DISTINCT x.run_id, x.url FROM x JOIN e ON e.link = x.url JOIN x y ON y.run_id = x.run_id AND y.url = e.url AND y.popped AND NOT y.no AND y.depth < (SELECT max(depth) FROM p) WHERE NOT x.popped)
"""


@query(_POLITE + """SELECT run_id, count(*) FILTER (popped AND NOT no) AS pages_fetched, count(*) FILTER (popped AND no) AS skipped_robots, coalesce(any_value(n), 0) AS skipped_budget
FROM x LEFT JOIN (SELECT run_id, count(*) AS n FROM late GROUP BY run_id) USING (run_id) GROUP BY run_id""")
def crawl_counts(spark, root):
    starts, edges, deepest = _graph(spark, root)
    blocked = table(spark, root, "fetched_pages").select("url").where(F.contains("url", F.lit("/support/")))
    return crawl.crawl(starts, edges, blocked, max_pages=15, max_depth=deepest)[1]


@query("""SELECT DISTINCT url, NOT (starts_with(p, '/support/') OR (starts_with(p, '/pricing/') AND NOT starts_with(p, '/pricing/a'))) AS allowed FROM (
SELECT url, coalesce(nullif(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS p FROM fetched_pages WHERE url IS NOT NULL)""")
def robots_allowed(spark, root):
    pages = table(spark, root, "fetched_pages").where("url IS NOT NULL")
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /support/ # help\nAllow: /pricing/a\nDisallow: /pricing/\nDisallow:"
    files = pages.select(urls.authority_of(F.col("url")).alias("host")).distinct().withColumn("robots", F.lit(text))
    return robots.allowed(pages.select("url"), robots.rules(files, "pagewright/1.0"))


@query()
def pipeline_report(spark, root):
    """Fetched pages to the report's sections."""
    return pipeline.run(table(spark, root, "fetched_pages"), _stop(spark, root)).report


# ---- the whole report -------------------------------------------------------------------------------------------------------
_STAGES = _POINTS + f""", n(ord, stage, items) AS (
SELECT 0, 'fetched', (SELECT count(*) FROM fetched_pages) UNION ALL SELECT 1, 'read', (SELECT count(*) FROM fetched_pages WHERE error IS NULL AND status BETWEEN 200 AND 299 AND length(html) > 0)
UNION ALL SELECT 2, 'extracted', (SELECT count(*) FROM extracted_pages) UNION ALL SELECT 3, 'kept', (SELECT count(*) FROM extracted_pages WHERE coalesce(len(regexp_extract_all(text, '{_WS}')), 0) >= 25)
UNION ALL SELECT 4, 'chunks', (SELECT count(*) FROM chunks) UNION ALL SELECT 5, 'retrieved', (SELECT count(*) FROM ranked) UNION ALL SELECT 6, 'points', (SELECT count(*) FROM points))
"""


def _stages(spark, root, ranked: DataFrame, points: DataFrame) -> DataFrame:
    pages = table(spark, root, "extracted_pages")
    kept = extract.kept_pages(pages.select("page_id", word_count(F.col("text")).alias("word_count")))
    return pipeline.stage_counts(table(spark, root, "fetched_pages"), pages, kept, table(spark, root, "chunks"), ranked, points)


@query(_STAGES + "SELECT stage, items FROM n")
def stage_counts(spark, root):
    ranked = cut(_ranked(spark, root))
    return _stages(spark, root, ranked, analyze.cited_points(ranked, table(spark, root, "chunks"), "section", "chunk_ord")).select("stage", "items")


_CELL = lambda c: f"replace(coalesce(CAST({c} AS VARCHAR), ''), '|', '/')"


@query(f"""SELECT * FROM (VALUES (0, 0, '# Site report' || chr(10)), (1, 0, '## Executive summary' || chr(10)), (3, -2, '## Pages' || chr(10)), (3, -1, '| Page | Title | Words | Chunks |' || chr(10) || '|-|-|-|-|'),
  (4, -2, chr(10) || '## Stages' || chr(10)), (4, -1, '| Stage | Items |' || chr(10) || '|-|-|'), (5, -1, chr(10) || '## Citations' || chr(10))) AS v(part, ord, line)
UNION ALL SELECT 1, 1, summary || chr(10) FROM ({ORACLE["executive_summary"]})
UNION ALL SELECT 2, section, markdown || chr(10) FROM ({ORACLE["report_markdown"]}) JOIN {_SECTIONS} USING (section_id)
UNION ALL SELECT 3, page_id, '| ' || {_CELL('url')} || ' | ' || {_CELL('title')} || ' | ' || {_CELL('word_count')} || ' | ' || {_CELL('chunk_count')} || ' |' FROM ({ORACLE["page_summaries"]})
UNION ALL SELECT 4, ord, '| ' || stage || ' | ' || items || ' |' FROM ({_STAGES} SELECT * FROM n)
UNION ALL SELECT 5, chunk_ord, '- ' || chunk_ord || ': ' || concat_ws(' > ', CASE WHEN trim(page_title) <> '' THEN page_title END, CASE WHEN trim(heading_path) <> '' THEN heading_path END) || ' (' || coalesce(page_url, '') || ')' FROM chunks""")
def report_document(spark, root):
    """The whole report over the stored tables, as lines with their place."""
    pages, chunks, sections = table(spark, root, "extracted_pages"), table(spark, root, "chunks"), pipeline.sections_table(spark)
    ranked = cut(_ranked(spark, root))
    points = cut(analyze.cited_points(ranked, chunks, "section", "chunk_ord"))
    marked = report.markdown(points, chunks, sections, "chunk_ord").join(sections.select("section", "section_id"), "section_id")
    return report.document("Site report", executive_summary(spark, root), marked, page_summaries(spark, root), _stages(spark, root, ranked, points), chunks, "chunk_ord")
