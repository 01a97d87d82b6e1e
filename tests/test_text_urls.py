from pyspark.sql import functions as F

from pagewright.functions import text, urls


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("o")).first()["o"]


def test_words_are_separated_by_unicode_space(spark):
    assert one(spark, "a b  c\n d", text.word_count) == 4
    assert one(spark, "", text.word_count) == 0
    assert one(spark, None, text.word_count) == 0


def test_tokens(spark):
    assert one(spark, "The API-v2 costs 5 EUR, naïve", text.tokens) == ["the", "api", "v2", "costs", "eur", "na", "ve"]
    assert one(spark, None, text.tokens) == []


def test_compared_form(spark):
    assert one(spark, "  Page  12 of 345 ", text.compared_form) == "page 0 of 0"


def test_host(spark):
    assert one(spark, "HTTPS://me@WWW.Shop.example:8080/a?b", text.host_of) == "shop.example"
    assert one(spark, "/relative", text.host_of) is None
    assert one(spark, None, text.host_of) is None


def test_sentence_score(spark):
    assert one(spark, "it cost 5 euros", text.sentence_score) == 3
    assert one(spark, "Nothing here", text.sentence_score) == 2
    assert one(spark, "word " * 60, text.sentence_score) == 2


def test_snippet_and_slug(spark):
    assert one(spark, "short", text.snippet) == "short"
    assert one(spark, "word " * 50, text.snippet).endswith("word…")
    assert one(spark, "  What?! Prices & Plans ", text.slug) == "what-prices-plans"
    assert one(spark, "!!", text.slug) == "section"


def test_normalized(spark):
    assert one(spark, " HTTP://Shop.Example ", urls.normalized) == "http://shop.example/"
    assert one(spark, "https://a.example/x?q=1#frag", urls.normalized) == "https://a.example/x?q=1"
    assert one(spark, "/just/path", urls.normalized) == "/just/path"
    again = one(spark, one(spark, "https://A.example:80/b/", urls.normalized), urls.normalized)
    assert again == "https://a.example:80/b/"


def test_page_urls(spark):
    rows = [("https://a.example/x.PDF",), ("https://a.example/x",), ("mailto:a@b.example",), ("https://a.example/v1.2/doc",)]
    got = [r["p"] for r in spark.createDataFrame(rows, "u string").select(urls.is_page_url(F.col("u")).alias("p")).collect()]
    assert got == [False, True, False, True]


def test_join(spark):
    rows = [("https://a.example/x/y", "../z"), ("https://a.example/x", "//b.example/q"), ("https://a.example/x", None), ("https://a.example", "http://[bad")]
    got = [r["j"] for r in spark.createDataFrame(rows, "b string, r string").select(urls.join("b", "r").alias("j")).collect()]
    assert got == ["https://a.example/z", "https://b.example/q", None, None]
