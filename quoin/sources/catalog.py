"""Document catalogues in HTML: groups, rows and paging, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.text import strip, strip_html, unescape

# The markup of the catalogue.
GROUP = r"href='/list2/([0-9]+)-0\.htm'[^>]*>([^<]+)</a>"
ROW = r"(?s)<tr class='m3'>(.*?)</tr>"
CELL = r"(?s)<td[^>]*>(.*?)</td>"
LINK = r"href='(https?://[^']+/Data2?/[^']+\.pdf)'[^>]*title='([^']*)'"


def _all(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(k))


def parse_groups(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' other columns with name and gid of each group that is linked."""
    found = F.arrays_zip(_all(F.col(html), GROUP, 2).alias("name"), _all(F.col(html), GROUP, 1).alias("gid"))
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.explode(found).alias("g")).select(*rest, strip(unescape(F.col("g.name"))).alias("name"), "g.gid")


def parse_catalog(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' other columns with row (place on the page), id, designation, title, date, status and pdf_url of each row
    that links a PDF and has four cells."""
    rest = [c for c in pages.columns if c != html]
    rows = pages.select(*rest, F.posexplode(_all(F.col(html), ROW, 1)).alias("row", "_html"))
    rows = rows.withColumn("_cells", _all(F.col("_html"), CELL, 1)).filter(F.col("_html").rlike(LINK) & (F.size("_cells") >= 4))
    url = F.regexp_extract("_html", LINK, 1)
    return rows.select(
        *rest, "row", F.regexp_extract(url, r"([^/]*)\.[^./]*$", 1).alias("id"), strip(unescape(F.regexp_extract("_html", LINK, 2))).alias("designation"),
        *[strip_html(F.col("_cells")[k]).alias(n) for k, n in ((1, "title"), (2, "date"), (3, "status"))], url.alias("pdf_url"),
    )
