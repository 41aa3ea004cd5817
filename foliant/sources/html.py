"""HTML to Markdown over a column of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..kernels.html import html_to_md
from ..operators.rowwise import each


def import_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, md, error) of every page; a page that cannot be read has an error and a null text, and stops nothing. A null page stays null."""
    return each(pages, key, {"html": html}, "md string", lambda html: (None if html is None else html_to_md(html),))
