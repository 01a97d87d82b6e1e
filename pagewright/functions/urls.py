"""URL parts, normal form and filters as expressions; joining relative references in Arrow batches."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions of files that hold no page.
SKIPPED_EXTENSIONS = (".css", ".gif", ".gz", ".ico", ".jpeg", ".jpg", ".js", ".json", ".mp3", ".mp4", ".pdf", ".png", ".rss", ".svg", ".tar", ".webp", ".xml", ".zip")


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority_of(url: Column) -> Column:
    """Host and port in lower case; "" for a URL without a host."""
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """The path, "/" where there is none."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def query_of(url: Column) -> Column:
    """The query with its question mark; "" for none."""
    return F.regexp_extract(F.trim(url), r"^[^?#]*(\?[^#]*)?", 1)


def normalized(url: Column) -> Column:
    """Trimmed, scheme and host in lower case, an empty path as "/", the query kept, the fragment dropped. A reference
    without scheme and host stays as it is. Dot segments are resolved by `join`, which links come through."""
    made = F.concat(scheme_of(url), F.lit("://"), authority_of(url), path_of(url), query_of(url))
    return F.when(authority_of(url) != "", made).otherwise(F.trim(url))


def is_page_url(url: Column) -> Column:
    """http or https, and no extension of a file that holds no page."""
    extension = F.lower(F.regexp_extract(path_of(url), r"(\.[^./]*)$", 1))
    return scheme_of(url).isin("http", "https") & ~extension.isin(*SKIPPED_EXTENSIONS)


def join_one(base: str | None, reference: str | None) -> str | None:
    """A reference resolved against the URL of its page; None where either can't be read."""
    try:
        joined = urljoin(base, reference.strip())
        urlsplit(joined)
        return joined
    except (AttributeError, TypeError, ValueError):
        return None


@F.pandas_udf(T.StringType())
def join(base: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([join_one(b, r) for b, r in zip(base, reference)], dtype=object)
