"""A corpus of PDF cases: files made from descriptions, read again and compared with what is expected."""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from palimpsest.operators.export import corpus_case
from palimpsest.sources.files import NO_TEXT, pages_from_candidates
from palimpsest.sources.pdf import extract_pages

#: The manifest's schema; a word of positioned_words is a text and two numbers, all as strings.
MANIFEST = "struct<name:string,cases:array<struct<id:string,category:string,description:string,fixture:struct<kind:string,text:string,words:array<array<string>>,pages:array<string>,stream:string,streams:array<string>>,expected_text:string,expected_error_contains:string>>>"


def _stream(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    return f"BT\n/F1 18 Tf\n72 720 Td\n({escaped}) Tj\nET\n"


#: The cases that every reader of PDF files must pass.
STARTER = json.dumps({
    "name": "starter",
    "cases": [
        {"id": "native-simple", "category": "native_text", "fixture": {"kind": "text", "text": "Bonjour clinique"}, "expected_text": "Bonjour clinique"},
        {"id": "positioned-words-spacing", "category": "spacing", "fixture": {"kind": "positioned_words", "words": [["Bonjour", "72", "720"], ["clinique", "140", "720"]]}, "expected_text": "Bonjour clinique"},
        {"id": "tj-array-spacing", "category": "spacing", "fixture": {"kind": "raw_stream", "stream": "BT\n/F1 18 Tf\n72 720 Td\n[(Bonjour) 1200 (clinique)] TJ\nET\n"}, "expected_text": "Bonjour clinique"},
        {"id": "multi-page-native", "category": "multipage", "fixture": {"kind": "text_pages", "pages": ["Bonjour clinique", "Deuxieme page"]}, "expected_text": "Bonjour clinique\n\nDeuxieme page"},
        {"id": "text-plus-blank-page", "category": "blank_pages", "fixture": {"kind": "raw_pages", "streams": [_stream("Bonjour clinique"), ""]}, "expected_text": "Bonjour clinique"},
        {"id": "blank-document", "category": "blank_pages", "fixture": {"kind": "blank"}, "expected_error_contains": "does not contain readable text"},
    ],
})


def cases(spark: SparkSession, manifest: str) -> DataFrame:
    """(id, category, fixture, expected_text, expected_error_contains) of a manifest in JSON."""
    one = spark.createDataFrame([(manifest,)], "j string").select(F.from_json("j", MANIFEST).alias("m"))
    return one.select(F.explode("m.cases").alias("c")).select("c.id", "c.category", "c.fixture", "c.expected_text", "c.expected_error_contains")


def _pages_of(fixture) -> list[str]:
    kind = fixture["kind"]
    if kind == "text":
        return [_stream(fixture["text"] or "")]
    if kind == "text_pages":
        return [_stream(t) for t in fixture["pages"]]
    if kind == "positioned_words":
        return ["BT\n/F1 18 Tf\n" + "".join(f"1 0 0 1 {x} {y} Tm\n" + _stream(t).split("Td\n")[1].replace("ET\n", "") for t, x, y in fixture["words"]) + "ET\n"]
    if kind == "raw_stream":
        return [fixture["stream"]]
    return [*fixture["streams"]] if kind == "raw_pages" else [""]


def build(streams: list[str]) -> bytes:
    """A file of one page for each content stream."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(streams))), len(streams)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for k, s in enumerate(streams):
        raw = zlib.compress(s.encode("latin-1"))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * k))
        objects.append(b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(raw), raw))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer\n<< /Root 1 0 R >>\n%%EOF\n"


@F.pandas_udf(BinaryType())
def _built(fixtures: pd.DataFrame) -> pd.Series:
    return pd.Series([build(_pages_of(f)) for f in fixtures.to_dict("records")], dtype=object)


def run_cases(found: DataFrame) -> DataFrame:
    """Cases with the error, if any, and result, struct<status, exact, skeleton, similarity>."""
    made = found.withColumn("content", _built("fixture"))
    read = pages_from_candidates(extract_pages(made.select("id", "content"))).select("id", "raw_text")
    both = made.join(read, "id", "left")
    both = both.withColumn("error", F.when(F.coalesce(F.col("raw_text"), F.lit("")) == "", NO_TEXT))
    return both.withColumn("result", corpus_case(F.coalesce("raw_text", F.lit("")), F.col("expected_text"), F.col("error"), F.col("expected_error_contains"))).drop("content")


def counts(results: DataFrame) -> DataFrame:
    """(status, n) of the results."""
    return results.groupBy(F.col("result.status").alias("status")).agg(F.count("*").alias("n"))
