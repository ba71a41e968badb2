"""Line deduplication by site-relative frequency, in DataFrame functions only.

A line that stands on a large share of a host's pages is boilerplate of that site. Pages are grouped by host; the pages
that contain a line, divided by all pages of the host, give its ratio, and lines above ``RATIO`` are dropped.

Counting combines map-side, so neither a large host nor a line on every page meets in one task. What a host's pages must
know is its list of boilerplate lines: every page contributes its own lines, so at most (mean lines per page) / ratio
lines of a host can exceed the ratio. The list is joined to the pages by host, where a large host's pages are split by
Spark's skew handling, and lines are filtered in place; no line is shuffled back to its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.session import stored

#: A line on more than this share of a host's pages, and on at least so many of them, is boilerplate.
RATIO, MIN_PAGES = 0.2, 3

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
#: Markup to text, in order: (pattern, replacement). Both Java and RE2 read these alike.
_MARKUP = (
    (r"(?is)<(script|style|template|noscript)\b[^>]*>.*?</(script|style|template|noscript)\s*>", " "),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)</?(p|div|br|hr|li|ul|ol|dl|dt|dd|tr|td|th|table|section|article|header|footer|nav|aside|main|form|pre|blockquote|h[1-6]|title|head|body|html)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r"[ \t\x0B\f\r]+", " "),
)
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(host != "", host)


def lines_of(html: Column) -> Column:
    """Visible lines of a page, trimmed, without empty ones: block elements and newlines end a line."""
    text = F.coalesce(html, F.lit(""))
    for pattern, by in _MARKUP:
        text = F.regexp_replace(text, pattern, by)
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _key(line: Column) -> Column:
    """128 bits that stand for a line while counting."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def drop_site_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url",
                    html_col: str = "html") -> DataFrame:
    """page_id, host, n_lines, n_kept, text (kept lines, one newline between) for every row of ``pages``.

    A page counts once for a line however often it repeats it; rows that repeat a page count as pages of their own. A
    null or empty page has no lines and an empty text. Without a host in the URL there is no site to compare with, so
    all lines stay and host is null. Other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines"))
    rows = stored(rows, "lines")
    sited = rows.filter("host is not null")
    totals = sited.groupBy("host").agg(F.count("*").alias("pages"))
    keys = sited.select("host", F.explode(F.array_distinct(F.transform("lines", _key))).alias("key"))
    counts = keys.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    common = stored(counts, "line-counts").join(stored(totals, "host-pages"), "host").filter(F.col("n") / F.col("pages") > ratio)
    per_host = stored(common.groupBy("host").agg(F.collect_list("key").alias("bad")), "boilerplate")
    marked = rows.join(per_host, "host", "left")
    kept = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("bad"), _key(x))))
    return marked.select("page_id", "host", F.size("lines").alias("n_lines"), kept.alias("_kept")).select(
        "page_id", "host", "n_lines", F.size("_kept").alias("n_kept"), F.array_join("_kept", "\n").alias("text"))


def _sql() -> str:
    text = "coalesce(html, '')"
    for pattern, by in _MARKUP:
        to = "chr(10)" if by == "\n" else f"'{by}'"
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    for name, char in _ENTITIES:
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"""
WITH p AS (SELECT row_number() OVER () AS row_no, page_id, nullif(lower(regexp_extract(url, '{_HOST}', 1)), '') AS host,
  list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
l AS (SELECT row_no, page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM p),
t AS (SELECT host, count(*) AS pages FROM p WHERE host IS NOT NULL GROUP BY 1),
c AS (SELECT host, line, count(DISTINCT row_no) AS n FROM l WHERE host IS NOT NULL GROUP BY 1, 2),
b AS (SELECT c.host, c.line FROM c JOIN t USING (host) WHERE n >= {MIN_PAGES} AND n / pages > {RATIO}),
k AS (SELECT l.row_no, count(*) AS n_kept, string_agg(l.line, chr(10) ORDER BY pos) AS text
  FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line WHERE b.line IS NULL GROUP BY 1)
SELECT page_id, host, len(lines)::INT AS n_lines, coalesce(n_kept, 0)::INT AS n_kept, coalesce(text, '') AS text FROM p LEFT JOIN k USING (row_no)
"""


ORACLE = _sql()
