"""The operators in SQL: views of a table's spans and of its rewritten texts, and functions to be called in spark.sql."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.cleanup import Settings
from palimpsest.operators.documents import deidentify
from palimpsest.operators.html import _text_of
from palimpsest.operators.recognise import RECOGNISERS, recognise
from palimpsest.plans.session import spread

#: Recognisers whose patterns both regular-expression engines read alike, for the functions that run in Python.
SIMPLE = {r.tag: re.sub(r"^\(\?(i?)U\)", lambda m: f"(?{m[1]})" if m[1] else "", r.pattern) for r in RECOGNISERS if r.name in ("email", "url", "date_numbers")}


def register_views(spark: SparkSession, source: str, key: str, text: str, settings: Settings = Settings(), given: list[str] = ()) -> None:
    """Temporary views over a table or view: <source>_spans (key, tag, text, start, end), a row for each span, and
    <source>_deidentified (key, output_text, placeholder_references, warnings), a row for each row. They are planned like any other
    query, so filters on the key reach the source.
    """
    rows = spark.table(source).select(F.col(key), F.col(text).alias("_text"))
    found = spread(rows.filter("_text is not null")).select(key, F.explode(recognise(F.col("_text"), settings.flags or None, settings.literals(), given=given)).alias("s"))
    found.select(key, "s.tag", "s.text", "s.start", "s.end").createOrReplaceTempView(f"{source}_spans")
    done = deidentify(rows, "_text", "_done", settings, given=given)
    done.select(key, F.col("_done.text").alias("output_text"), F.col("_done.references").alias("placeholder_references"), F.col("_done.warnings").alias("warnings")).createOrReplaceTempView(f"{source}_deidentified")


def register(spark: SparkSession) -> None:
    """Registers html_text(page), decode_text(bytes), mask_simple(text) and the table function simple_spans(text)."""
    from palimpsest.sources.files import decode

    @F.pandas_udf("string")
    def mask_simple(texts: pd.Series) -> pd.Series:
        for tag, rx in SIMPLE.items():
            texts = texts.str.replace(re.compile(rx), f"[{tag.upper()}]", regex=True)
        return texts

    @F.udtf(returnType="tag string, text string, start int, stop int")
    class SimpleSpans:
        def eval(self, text: str) -> Iterator[tuple]:
            for tag, rx in SIMPLE.items():
                for m in re.finditer(rx, text or ""):
                    yield tag, m[0], m.start(), m.end()

    spark.udf.register("page_text", _text_of)
    # the white space of html_to_text, in SQL
    white = r"\\t\\x0b\\x0c\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
    lines = r"regexp_replace(regexp_replace(replace(regexp_replace(page_text(page), '\\r\\n?', '\n'), '\u00a0', ' '), '[ \\t]+', ' '), '[%s]*\\n[%s]*', '\n')" % (white, white)
    spark.sql(rf"create or replace temporary function html_text(page string) returns string return regexp_replace(regexp_replace({lines}, '\\n{{3,}}', '\n\n'), '^[\\n{white}]+|[\\n{white}]+\\z', '')")
    spark.udf.register("decode_text", decode)
    spark.udf.register("mask_simple", mask_simple)
    spark.udtf.register("simple_spans", SimpleSpans)
