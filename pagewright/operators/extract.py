"""Extraction: title, description, headings and text of the main region of each fetched page, and its links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.html import Node, parse
from pagewright.functions.urls import authority_of, is_page_url, join_one, normalized

#: Elements that hold no content, elements whose text is rendered, and marks of headings.
DROPPED = frozenset("script style noscript nav header footer aside form iframe svg button select template".split())
RENDERED = frozenset("h1 h2 h3 h4 p li td pre blockquote figcaption".split())
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4}
REGION_WORDS, CHILD_WORDS, MIN_PAGE_WORDS = 50, 40, 25
EXTRACTED = "page_id long, url string, title string, meta_description string, headings array<string>, text string, word_count int, kept_ratio double, fetch_status int"


def ok() -> Column:
    """Fetched without error, status 200 to 299, with html."""
    return F.col("error").isNull() & F.col("status").between(200, 299) & (F.length("html") > 0)


def _prune(root: Node) -> None:
    """Take the DROPPED elements out of a tree of any depth."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.content = [x for x in node.content if isinstance(x, str) or x.tag not in DROPPED]
        stack += [x for x in node.content if isinstance(x, Node)]


def _region(body: Node) -> Node:
    """The first main of more than REGION_WORDS words; else the first article, else the first role=main, if it has so
    many; else the child of the body with the best ratio of squared words to link words, the first of equals, among those
    of CHILD_WORDS words; else the body."""
    below = list(body.walk())
    mains = (n for n in below if n.tag == "main")
    firsts = (next((n for n in below if n.tag == "article"), None), next((n for n in below if n.attrs.get("role") == "main"), None))
    for n in (*mains, *firsts):
        if n is not None and n.word_count() > REGION_WORDS:
            return n
    best, most = body, -1.0
    for child in body.content:
        if isinstance(child, Node) and (n := child.word_count()) >= CHILD_WORDS:
            links = child.word_count() if child.tag == "a" else sum(a.word_count() for a in child.walk() if a.tag == "a")
            if n * n / (1 + links) > most:
                best, most = child, n * n / (1 + links)
    return best


def extract_page(html: str) -> tuple:
    """(title, meta description, headings, text, words, kept ratio) of one page. Nested rendered elements come out in the
    text of each, so the ratio can be over 1."""
    root = parse(html)
    whole = root.word_count()
    _prune(root)
    title = next((n.text() for n in root.walk() if n.tag == "title"), "")
    meta = next((n.attrs.get("content", "").strip() for n in root.walk() if n.tag == "meta" and n.attrs.get("name") == "description"), "")
    body = next((n for n in root.walk() if n.tag == "body"), None)
    if body is None:
        return title, meta, [], "", 0, 0.0
    lines, headings = [], []
    for n in _region(body).walk():
        if n.tag in RENDERED and (text := n.text()):
            level = HEADINGS.get(n.tag, 0)
            lines.append("#" * (level + 1) + " " + text if level else text)
            if 0 < level < 4:
                headings.append(text)
    words = sum(len(x.split()) for x in lines)
    return title, meta, headings, "\n".join(lines), words, round(words / whole, 3) if whole else 0.0


def extract(pages: DataFrame) -> DataFrame:
    """One row of EXTRACTED a fetched page that is ok. Pages with null html are not; broken markup gives what can be read."""

    def run(batches):
        for b in batches:
            rows = [extract_page(h) for h in b["html"]]
            made = pd.DataFrame(rows, columns=["title", "meta_description", "headings", "text", "word_count", "kept_ratio"], index=b.index)
            yield pd.concat([b[["page_id", "url"]], made, b[["status"]].rename(columns={"status": "fetch_status"})], axis=1)

    return pages.where(ok()).select("page_id", "url", "status", "html").mapInPandas(run, EXTRACTED)


def kept_pages(extracted: DataFrame, min_words: int = MIN_PAGE_WORDS) -> DataFrame:
    """Pages of min_words words or more."""
    return extracted.where(F.col("word_count") >= min_words)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _joined(base: pd.Series, references: pd.Series) -> pd.Series:
    return pd.Series([[join_one(b, r) for r in refs] for b, refs in zip(base, references)], dtype=object)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, position, link): the different links of a page in order, resolved and normalised, http(s) pages only.

    References to a place in the same page and files that hold no page are left out. Expressions over the page's array of
    references do it all but for joining them with the URL of the page; nothing is shuffled."""
    refs = F.regexp_extract_all("html", F.lit("""(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["']([^"']*)["']"""), F.lit(1))
    own = pages.where(ok()).select("page_id", "url", F.transform(F.filter(refs, lambda r: ~r.startswith("#")), lambda r: F.replace(r, F.lit("&amp;"), F.lit("&"))).alias("refs"))
    full = own.where(F.size("refs") > 0).select("page_id", "url", F.transform(_joined("url", "refs"), normalized).alias("links"))
    return full.select("page_id", "url", F.posexplode(F.array_distinct(F.filter("links", lambda x: F.coalesce(is_page_url(x), F.lit(False))))).alias("position", "link"))


def same_site(found: DataFrame) -> DataFrame:
    """Links to the host, port included, of their own page."""
    return found.where(authority_of(F.col("link")) == authority_of(F.col("url")))
