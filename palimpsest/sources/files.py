"""Sources: files by kind, pasted texts, settings and word lists."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions.dates import parse_birthdate, safe_shift
from palimpsest.sources.pdf import extract_pages
from palimpsest.functions.text import best_candidate, list_lines, normalize_page_text, strip

IMPORTED = "id string, source_kind string, display_name string, path string, raw_text string, pdf_pages array<struct<text:string,width:double,height:double>>, status string, error_message string"
WIDTH, HEIGHT = 612.0, 792.0
NO_TEXT = "The PDF does not contain readable text."
BAD_KIND = "The file type is not supported."


def file_kind(path: Column) -> Column:
    """text_file, html or pdf by the suffix, ignoring case; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix == ".txt", "text_file").when(suffix.isin(".html", ".htm"), "html").when(suffix == ".pdf", "pdf")


@F.pandas_udf(StringType())
def decode(content: pd.Series) -> pd.Series:
    """Text of bytes by the first encoding that fits: UTF-8 with or without mark, Windows-1252, Latin-1."""

    def one(b):
        for encoding in ("utf-8-sig", "cp1252", "latin-1"):
            try:
                return b.decode(encoding)
            except UnicodeDecodeError:
                continue

    return content.map(lambda b: one(bytes(b)), na_action="ignore")


def page_size(width: Column, height: Column) -> tuple[Column, Column]:
    ok = (width > 0) & (height > 0)
    return F.when(ok, width).otherwise(WIDTH), F.when(ok, height).otherwise(HEIGHT)


def join_pages(pages: Column) -> Column:
    """Pages that aren't blank, trimmed, with a blank line between."""
    return F.array_join(F.filter(F.transform(pages, lambda p: strip(F.coalesce(p, F.lit("")))), lambda p: p != ""), "\n\n")


def pages_from_candidates(candidates: DataFrame) -> DataFrame:
    """(id, pdf_pages, raw_text) from (id, page_no, texts array, width, height): the best text of each page, pages in order.

    This is what an extractor's output goes through; each page's candidates are in the order of the engines.
    """
    w, h = page_size(F.col("width"), F.col("height"))
    one = candidates.select("id", F.struct("page_no", best_candidate(F.transform("texts", lambda t: normalize_page_text(t))).alias("text"), w.alias("width"), h.alias("height")).alias("p"))
    out = one.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return out.select("id", F.transform("ps", lambda p: F.struct(p.text.alias("text"), p.width.alias("width"), p.height.alias("height"))).alias("pdf_pages"), join_pages(F.transform("ps", lambda p: p.text)).alias("raw_text"))


def read_documents(spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Imported documents of all files under a path; the id is a hash of the file's path.

    extract turns (id, content) of PDF files into pages_from_candidates' input; palimpsest.sources.pdf reads text PDFs unless
    another one is given. Files without readable text and files of other kinds are rows with status "error": one file never
    fails the job.
    """
    extract = extract or extract_pages
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = files.select(F.sha2("path", 256).alias("id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("display_name"), "path", "content", file_kind(F.col("path")).alias("source_kind"))
    no_pages = F.lit(None).cast("array<struct<text:string,width:double,height:double>>")
    row = ["id", "source_kind", "display_name", "path", "raw_text", "pdf_pages", "status", "error_message"]
    texts = base.filter(F.col("source_kind").isin("text_file", "html")).withColumn("raw_text", decode("content")).withColumn("pdf_pages", no_pages)
    texts = texts.withColumn("status", F.lit("pending")).withColumn("error_message", F.lit(None).cast("string")).select(row)
    failed = lambda df, message: df.withColumn("raw_text", F.lit(None).cast("string")).withColumn("pdf_pages", no_pages).withColumn("status", F.lit("error")).withColumn("error_message", F.lit(message)).select(row)
    others = failed(base.filter(F.col("source_kind").isNull()), BAD_KIND)
    pdf = base.filter(F.col("source_kind") == "pdf")
    pages = pdf.select("id", "source_kind", "display_name", "path").join(pages_from_candidates(extract(pdf.select("id", "content"))), "id", "left")
    blank = F.coalesce(F.col("raw_text") == "", F.lit(True))
    pages = pages.withColumn("status", F.when(blank, "error").otherwise("pending")).withColumn("error_message", F.when(blank, NO_TEXT)).withColumn("raw_text", F.when(~blank, F.col("raw_text")))
    return texts.unionByName(others).unionByName(pages.select(row))


def stream_files(spark: SparkSession, path: str, at_once: int = 1) -> DataFrame:
    """(path, modificationTime, length, content) of the files that come to a folder, at_once of them in a micro-batch at most."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", at_once).load(path)


def pasted(texts: DataFrame, text: str = "text") -> DataFrame:
    """Pasted texts as documents; the id is a hash of the trimmed text. Blank ones are left out."""
    t = texts.select(strip(F.col(text)).alias("raw_text")).filter("raw_text != ''")
    no_pages = F.lit(None).cast("array<struct<text:string,width:double,height:double>>")
    return t.select(F.sha2("raw_text", 256).alias("id"), F.lit("paste").alias("source_kind"), F.lit("Pasted text").alias("display_name"), F.lit(None).cast("string").alias("path"), "raw_text", no_pages.alias("pdf_pages"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_message"))


def load_settings(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Settings as saved (all strings) with their types: dates, shifts in range, lists by line, unknown modes as placeholders; keep: columns passed on."""
    return raw.select(
        *keep, strip(F.col("first_name")).alias("first_name"), strip(F.col("last_name")).alias("last_name"), parse_birthdate(F.col("birthdate")).alias("birthdate"), safe_shift(F.expr("try_cast(date_shift_days as int)")).alias("date_shift_days"),
        list_lines(F.col("other_names")).alias("other_names"), list_lines(F.col("custom_addresses")).alias("custom_addresses"), F.coalesce(F.expr("try_cast(deidentify_filenames as boolean)"), F.lit(True)).alias("deidentify_filenames"),
        F.when(F.col("mode").isin("placeholders", "smart_pseudonyms"), F.col("mode")).otherwise("placeholders").alias("mode"),
    )


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(term, term_norm) of a file with one term per line; blank lines are dropped."""
    t = spark.read.text(path).select(strip(F.col("value")).alias("term")).filter("term != ''")
    return t.select("term", F.lower(F.regexp_replace("term", r"(?U)\s+", " ")).alias("term_norm")).distinct()
