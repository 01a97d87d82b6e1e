import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import bitmaps, site_lines

low = st.lists(st.integers(0, 65535), min_size=1, max_size=60)


@settings(max_examples=80, deadline=None)
@given(low, low, st.booleans())
def test_bitmaps_are_sets(a, b, dense):
    if dense:
        a = a + list(range(0, 65536, 3))
    x, y = bitmaps.pack(np.array(a)), bitmaps.pack(np.array(b))
    both = bitmaps.union([x, y])
    assert set(bitmaps.unpack(both).tolist()) == set(a) | set(b)
    assert bitmaps.cardinality(both) == len(set(a) | set(b))
    assert all(bitmaps.contains(both, n) == (n in set(a) | set(b)) for n in [*a[:20], *b, 1, 40000])


def brute(rows, least):
    pages, places = defaultdict(set), []
    for page, url, text in rows:
        if page is None or url is None or text is None or "://" not in url:
            continue
        host = re.sub(r"^www\.", "", url.split("://")[1].split("/")[0].split(":")[0].lower())
        for no, line in enumerate(text.split("\n")):
            if line.startswith("#") or not any(c.isalpha() for c in line):
                continue
            form = re.sub("[0-9]+", "0", " ".join(line.lower().split()))
            pages[host, form].add(page)
            places.append((page, no, host, form))
    return {(p, n) for p, n, h, f in places if len(pages[h, f]) >= least}


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(4)
    lines = ["Share this page", "SHARE  this page ", "Page 12 of 9", "page 3 of 77", "# heading", "12 34", "", "   ", *[f"own line {c}" for c in "abcdefghij"]]
    rows = [(i if i % 17 else i * 70_000, rng.choice(["https://www.A.example/x", "http://a.example:80/y", "https://b.example/", "no url"]), "\n".join(rng.choices(lines, k=8))) for i in range(1, 80)]
    rows += [(None, "https://a.example", "Share this page"), (900, None, "Share this page"), (901, "https://a.example", None), (902, "https://a.example", ""), rows[0], (903, "https://a.example", "long " * 20000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, text string, host string, low int")
    got = {(r["page_id"], r["line_no"]) for r in site_lines.repeated_lines(df, 4).collect()}
    assert got == brute(rows, 4) and got
    texts = {r["page_id"]: r["text"] for r in site_lines.without_repeated_lines(df, 4).collect()}
    page = next(p for p, _ in got)
    text = next(t for p, _, t in rows if p == page)
    assert texts[page] == "\n".join(x for n, x in enumerate(text.split("\n")) if (page, n) not in got)
    assert texts[901] is None and texts[902] == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, text string")
    assert site_lines.repeated_lines(df).count() == 0 and site_lines.without_repeated_lines(df).count() == 0
