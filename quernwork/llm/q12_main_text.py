"""The query that extracts the main text of all ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quernwork.llm.main_text import learned, main_text
from quernwork.sources import Tables


def run(tables: Tables) -> DataFrame:
    """The main text of every page, by a model learned from a sample of them."""
    pages = tables.read("pages", "page_id", "url", "html")
    return main_text(pages, "html", learned(pages, "html"))
