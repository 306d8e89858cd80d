"""Links and texts from web pages and public books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links_first_seen(pages: DataFrame, page: str, html: str) -> DataFrame:
    """Each page's links once, with the place where they first occur."""
    found = pages.select(page, F.posexplode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)).alias("pos", "link"))
    return found.groupBy(page, "link").agg(F.min("pos").alias("first"))


def book_body(text: Column) -> Column:
    """A public book's text between its start and end marks, lines of a paragraph joined."""
    body = F.regexp_replace(text, r"(?s)^.*?\*\*\* ?START OF[^\n]*\n", "")
    body = F.regexp_replace(body, r"(?s)\*\*\* ?END OF.*$", "")
    return F.regexp_replace(F.regexp_replace(body, "\r\n?", "\n"), r"(?<!\n)\n(?!\n)", " ")
