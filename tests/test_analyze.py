import json

from pagewright.operators import analyze, report


def test_points_cite_a_chunk_once(spark):
    chunks = spark.createDataFrame([(1, "Short. This sentence has 5 words and more of them."), (2, "tiny"), (3, "Another sentence that is long enough to be taken.")], "k long, text string")
    ranked = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 1), (1, 2, 3), (1, 7, 3)], "section int, rank int, k long")
    got = sorted((r["section"], r["k"]) for r in analyze.cited_points(ranked, chunks, "section", "k").collect())
    assert got == [(0, 1), (1, 3)]


def test_replies(spark):
    good = json.dumps({"executive_summary": "s", "sections": [{"id": "overview", "points": [{"text": "t", "citations": ["2", "9", "1"]}, {"text": "", "citations": ["1"]}, {"text": "u", "citations": ["9"]}]}, {"id": "other", "points": [{"text": "v", "citations": ["1"]}]}]})
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, f"Sure: {good} bye"), (4, "no json"), (5, "[1]"), (6, None), (7, good.replace('"s"', '" "')), (8, '{"executive_summary": "s", "sections": [5]}')]
    replies = spark.createDataFrame(rows, "reply_id long, reply string")
    retrieved = spark.createDataFrame([(i, c) for i in range(9) for c in ("1", "2")], "reply_id long, cited string")
    sections = spark.createDataFrame([("overview",)], "section_id string")
    got = {r["reply_id"]: (r["text"], r["citations"]) for r in analyze.guarded_points(replies, retrieved, sections).collect()}
    assert got == {i: ("t", ["2", "1"]) for i in (1, 2, 3)}


def test_terms_and_summaries(spark):
    pages = spark.createDataFrame([(1, "https://a.example/x/last", None, "", "pump pump valve", 3), (2, "https://a.example/", "Title", "About", None, None)], "page_id long, url string, title string, meta_description string, text string, word_count int")
    assert [(r["term"], r["n"]) for r in analyze.report_terms(pages, spark.createDataFrame([("about",)], "word string"), 2).collect()] == [("pump", 2), ("title", 1)]
    got = {r["page_id"]: r for r in report.page_summaries(pages, spark.createDataFrame([(1,), (1,)], "page_id long")).collect()}
    assert (got[1]["title"], got[1]["chunk_count"], got[1]["summary_line"]) == ("last", 2, "pump pump valve")
    assert (got[2]["title"], got[2]["chunk_count"], got[2]["summary_line"]) == ("Title", 0, "About")
