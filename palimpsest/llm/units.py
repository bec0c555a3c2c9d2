"""Texts of imported documents as units: raw_text is page 0, the pages of a pdf are numbered from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def units(docs: DataFrame) -> DataFrame:
    """(document_id, page_no, text) of every non-null id and non-null text; redelivered rows come again."""
    page = "struct(cast({0} as int) as page_no, {1} as text)"
    pages = F.expr(f"transform(coalesce(pdf_pages, array()), (p, i) -> {page.format('i + 1', 'p.text')})")
    own = F.expr(f"array({page.format(0, 'raw_text')})")
    out = docs.filter("id is not null").select(F.col("id").alias("document_id"), F.explode(F.concat(own, pages)).alias("u"))
    return out.select("document_id", "u.page_no", "u.text").filter("text is not null")


def pages(docs: DataFrame) -> DataFrame:
    """(document_id, pages array<string>) of every distinct id with pages; of a redelivered id one row stays.

    A redelivered row has the same content, so which one stays makes no difference.
    """
    has = docs.filter("id is not null and size(pdf_pages) > 0").select(F.col("id").alias("document_id"), F.col("pdf_pages.text").alias("pages"))
    return has.dropDuplicates(["document_id"])
