from pagewright.operators import extract

PAGE = """<!doctype html><html><head><title> Pumps </title><meta name="description" content="About pumps"></head><body>
<nav><a href="/home">Home</a></nav><div id="cookie"><p>We use cookies</p></div>
<main><h1>Pumps</h1><p>{}</p><ul><li>one<li>two</ul><h3>Care</h3><p>Clean it<p>Dry it</main><footer><p>Imprint</p></footer><script>var a = "<p>no</p>"</script></body></html>"""


def test_main_region_headings_and_unclosed_tags():
    title, meta, headings, text, words, ratio = extract.extract_page(PAGE.format("word " * 60))
    assert (title, meta, headings) == ("Pumps", "About pumps", ["Pumps", "Care"])
    assert text.split("\n") == ["## Pumps", "word " * 59 + "word", "one", "two", "#### Care", "Clean it", "Dry it"]
    assert "cookies" not in text and "Imprint" not in text and "no" not in text.split()
    assert words == sum(len(line.split()) for line in text.split("\n")) and 0 < ratio


def test_short_main_falls_back_to_the_densest_child():
    html = "<body><main><p>few words</p></main><div>{}</div><div><a>{}</a></div></body>".format("<p>" + "text " * 50 + "</p>", "link " * 80)
    assert extract.extract_page(html)[3].strip() == ("text " * 50).strip()


def test_no_body_and_empty():
    assert extract.extract_page("<html><title>x</title></html>")[3:] == ("", 0, 0.0)
    assert extract.extract_page("")[3:] == ("", 0, 0.0)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, status int, error string, html string, extra string")


def test_only_ok_pages(spark):
    got = extract.extract(pages(spark, [(1, "u", 200, None, "<body><p>x</p>", "e"), (2, "u", 404, None, "<p>", "e"), (3, "u", 200, "timeout", "<p>", "e"), (4, "u", 200, None, None, "e"), (5, "u", 200, None, "", "e")]))
    assert [r["page_id"] for r in got.collect()] == [1]


def test_links(spark):
    html = '<a href="/a#x">1</a><a class=z href="#top">2</a><a href="b.pdf">3</a><A HREF="/a">4</A><a href="https://other.example/q">5</a><a href="mailto:x@y.example">6</a>'
    found = extract.links(pages(spark, [(1, "https://s.example/dir/", 200, None, html, "")]))
    assert [(r["position"], r["link"]) for r in found.orderBy("position").collect()] == [(0, "https://s.example/a"), (1, "https://other.example/q")]
    assert [r["link"] for r in extract.same_site(found).collect()] == ["https://s.example/a"]


def test_empty_table(spark):
    assert extract.extract(pages(spark, [])).count() == 0 and extract.links(pages(spark, [])).count() == 0


def test_unclosed_tags_by_the_thousand():
    html = "<html><body>" + "<span>" * 100_000 + "<p>" + "deep words " * 30
    assert extract.extract_page(html)[4] == 60


def test_a_short_main_does_not_hide_a_long_one():
    long = "<p>" + "text " * 60 + "</p>"
    assert extract.extract_page(f"<body><main><p>few</p></main><main>{long}</main><div>{long * 3}</div></body>")[4] == 60
    assert extract.extract_page(f"<body><article><p>few</p></article><article>{long}</article><div>{long * 3}</div></body>")[4] == 180


def test_title_of_a_picture_is_no_title():
    assert extract.extract_page("<body><svg><title>icon</title></svg><p>x</p></body>")[0] == ""
    assert extract.extract_page("<head><title>Page</title></head><body><svg><title>icon</title></svg></body>")[0] == "Page"
