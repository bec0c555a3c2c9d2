"""Export of processed documents: names, what is exported and skipped, files and report."""

from __future__ import annotations

import zipfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.dates import format_shift
from palimpsest.functions.keyed import hashed_stem
from palimpsest.functions.text import is_placeholder, normalize_page_text, similarity, skeleton
from palimpsest.operators.html import html_to_text
from palimpsest.plans.session import materialize
from palimpsest.sources.pdf import pdf_file

#: Accents that sanitising removes, and names that Windows reserves.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
REPORT = "export-report.txt"


def sanitize_stem(c: Column) -> Column:
    """A stem of ASCII letters, digits, dots, underscores and hyphens; "document" if nothing is left; reserved names get "-file".

    Accented Latin letters lose their accents, other characters outside ASCII are dropped.
    """
    ascii_only = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[^\x00-\x7f]", "")
    clean = F.regexp_replace(F.regexp_replace(ascii_only, r"[^A-Za-z0-9._-]+", "-"), r"^[._-]+|[._-]+$", "")
    named = F.when(clean == "", "document").otherwise(clean)
    return F.when(F.upper(named).isin(RESERVED), F.concat(named, F.lit("-file"))).otherwise(named)


def source_stem(display_name: Column) -> Column:
    return F.regexp_replace(display_name, r"(?<=.)\.[^.]*$", "")


def export_suffix(source_kind: Column, path: Column, text_mode: Column) -> Column:
    own = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(text_mode, ".txt").when((source_kind == "html") & (own != ""), own).when(source_kind == "pdf", ".pdf").otherwise(".txt")


def export_name(docs: DataFrame, recognised: Column, hash_names: Column, text_mode: Column) -> DataFrame:
    """Adds export_name: pasted texts keep their name; others get the sanitised stem, or the hashed one when hash_names is on and
    something in the name was recognised, and the suffix of their kind."""
    stem = source_stem(F.col("display_name"))
    chosen = F.when(hash_names & recognised, hashed_stem(F.col("raw_text"), F.col("display_name"), stem)).otherwise(stem)
    name = F.concat(sanitize_stem(chosen), export_suffix(F.col("source_kind"), F.col("path"), text_mode))
    return docs.withColumn("export_name", F.when(F.col("source_kind") == "paste", F.col("display_name")).otherwise(name))


def unique_names(docs: DataFrame, name: str, order: list[str], out: str = "unique_name", reserved: list[str] = (REPORT,)) -> DataFrame:
    """Adds out: names in order, the first use as it is, later ones with "-2", "-3" and so on before the suffix.

    Numbers that a name which is typed so holds itself are passed over: a repeat takes the first numbers that no name of the
    input has. The report's name counts as used. A name's rows are counted by ranges of the order first, so that
    a name which very many rows share isn't sorted in one task.
    """
    # rows of a repeated name are ranked inside slices of the order, which are cut evenly over all rows
    counts = docs.groupBy(name).agg(F.count("*").alias("_n"))
    single = docs.join(counts.filter("_n = 1").select(name), name)
    many = docs.join(counts.filter("_n > 1").select(name), name).repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    many = materialize(many)
    sizes = many.groupBy(name, "_slice").agg(F.count("*").alias("_m"))
    before = sizes.withColumn("_before", F.sum("_m").over(Window.partitionBy(name).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).select(name, "_slice", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(name, "_slice").orderBy(*order))
    ranked = many.withColumn("_i", inside).join(before, [name, "_slice"]).withColumn("_k", (F.col("_i") + F.col("_before")).cast("int")).drop("_slice", "_i", "_before")
    both = single.withColumn("_k", F.lit(1)).unionByName(ranked)
    both = both.withColumn("_k", F.col("_k") + F.col(name).isin(list(reserved)).cast("int"))
    # numbered names that the input itself holds
    parts = F.regexp_extract(name, r"(?s)^(.+)-(\d{1,6})(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.+)-(\d{1,6})(\.[^.]*)?$", 2), F.regexp_extract(name, r"(?s)^(.+)-(\d{1,6})(\.[^.]*)?$", 3)
    taken = counts.select(F.concat(parts[0], parts[2]).alias(name), F.when(parts[1] != "", parts[1]).cast("int").alias("_t")).filter("_t > 1").groupBy(name).agg(F.array_sort(F.collect_set("_t")).alias("_taken"))
    both = both.join(taken, name, "left")
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_k"), lambda k, t: F.when(t <= k, k + 1).otherwise(k))
    stem, suffix = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)
    return both.withColumn(out, F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), free.cast("string"), suffix))).drop("_k", "_taken")


def render_output(source_kind: Column, output_text: Column, text_mode: Column) -> Column:
    """What is written: in text mode HTML as readable text, else the output as it is."""
    return F.when(text_mode & (source_kind == "html"), html_to_text(output_text)).otherwise(output_text)


def render_content(source_kind: Column, output_text: Column, page_texts: Column, sizes: Column, text_mode: Column) -> Column:
    """The bytes that are written: a PDF of the pages (or of the whole text) at their sizes for paged documents unless in text mode, else the
    rendered text in UTF-8. sizes: array of structs with width and height."""
    pages = F.when(F.size(page_texts) > 0, page_texts).otherwise(F.array(output_text))
    paged = (source_kind == "pdf") & ~text_mode
    made = pdf_file(F.when(paged, pages), F.transform(sizes, lambda p: p.width), F.transform(sizes, lambda p: p.height))
    return F.when(paged, made).otherwise(F.encode(render_output(source_kind, output_text, text_mode), "utf-8"))


def exported(docs: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents with their latest processed generation."""
    latest = processed.groupBy(F.col("document_id").alias("id")).agg(F.max_by(F.struct("output_text", "pdf_page_texts", "placeholder_references", "warnings", "generation"), "generation").alias("p"))
    return docs.join(latest.select("id", "p.*"), "id")


def skipped(docs: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents that were never processed, with the reason."""
    none = docs.join(processed.select(F.col("document_id").alias("id")), "id", "left_anti")
    return none.withColumn("reason", F.when(F.col("status") == "error", F.coalesce("error_message", F.lit("The import failed."))).otherwise("Not processed."))


def export_summary(docs: DataFrame, processed: DataFrame) -> DataFrame:
    done = processed.select(F.col("document_id").alias("id")).distinct().withColumn("done", F.lit(True))
    return docs.select("id").distinct().join(done, "id", "left").agg(F.count_if("done").alias("exported_count"), F.count_if(F.col("done").isNull()).alias("skipped_count"))


def report_name(export: Column, display: Column, source_kind: Column, hash_names: Column) -> Column:
    """The name in the report: the new one, with the old one behind it when file names are de-identified and it differs."""
    same = ~hash_names | (source_kind == "paste") | (export == display)
    return F.when(same, export).otherwise(F.concat(export, F.lit(" ("), display, F.lit(")")))


def mapping_lines(references: Column) -> Column:
    """ "- original => replacement" for every original of a replacement that is no placeholder."""
    shown = F.filter(references, lambda r: ~is_placeholder(r.replacement))
    return F.flatten(F.transform(shown, lambda r: F.transform(r.originals, lambda o: F.concat(F.lit("- "), o, F.lit(" => "), r.replacement))))


def tooltip(replacement: Column, originals: Column) -> Column:
    kind = F.when(is_placeholder(replacement), "Placeholder for: ").otherwise("Pseudonym for: ")
    return F.concat(kind, F.array_join(originals, "; "))


def warnings_text(warnings: Column) -> Column:
    return F.when(F.coalesce(F.size(warnings), F.lit(0)) == 0, "").otherwise(F.concat(F.lit("Warning(s): "), F.array_join(warnings, "; ")))


def shown_text(output_text: Column, raw_text: Column, error_message: Column) -> Column:
    """What is shown of a document: its output, else the text with the error's message, else the text."""
    return F.coalesce(output_text, F.when(error_message.isNotNull(), F.concat_ws("\n\n", error_message, raw_text)), raw_text, F.lit(""))


def corpus_case(extracted: Column, expected: Column, error: Column, expected_error: Column) -> Column:
    """struct<status, exact, skeleton, similarity> of a test case: pass when the text is the expected one, or the error holds the expected words."""
    a, b = normalize_page_text(extracted), normalize_page_text(expected)
    exact = F.coalesce(a == b, F.lit(False))
    fails_well = F.coalesce(F.contains(error, expected_error), F.lit(False))
    ok = F.when(expected_error.isNotNull(), fails_well).otherwise(exact)
    return F.struct(F.when(ok, "pass").otherwise("fail").alias("status"), exact.alias("exact"), F.coalesce(skeleton(a) == skeleton(b), F.lit(False)).alias("skeleton"), F.round(similarity(a, b), 4).alias("similarity"))


def write_export(rows: DataFrame, folder: str) -> None:
    """Files of an export as a table of (name, content), one part for each task; an archive may be made of it afterwards."""
    rows.select(F.col("export_name").alias("name"), F.col("content")).write.mode("overwrite").parquet(folder)


def pasted_names(docs: DataFrame, order: list[str]) -> DataFrame:
    """Adds export_name "pasted-001.txt" and so on to pasted texts, in order of the input.

    Rows are numbered inside ranges of the order and ranges by their counts, so no task sorts all of them.
    """
    cut = materialize(docs.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    # one row per range: as many as there are partitions
    sizes = cut.groupBy("_slice").agg(F.count("*").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    n = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) + F.col("_before")
    numbered = cut.join(F.broadcast(sizes), "_slice").withColumn("_n", n.cast("string"))
    return numbered.withColumn("export_name", F.concat(F.lit("pasted-"), F.lpad("_n", F.greatest(F.length("_n"), F.lit(3)), F.lit("0")), F.lit(".txt"))).drop("_slice", "_before", "_n")


def covering(places: Column, position: Column) -> Column:
    """The longest highlighted range that holds a position, null if none does."""
    inside = F.filter(places, lambda p: (p.start <= position) & (position < p.start - p.minus_length))
    return F.get(F.array_sort(F.transform(inside, lambda p: F.struct(p.minus_length, p.start, p.text))), F.lit(0))


def date_shift_line(mode: Column, manual: Column, automatic: Column) -> Column:
    shown = F.when(manual.isNotNull(), F.concat(F.lit("Date shift: "), format_shift(manual), F.lit(" (manual)"))).when(automatic.isNotNull(), F.concat(F.lit("Date shift: "), format_shift(automatic), F.lit(" (auto)")))
    return F.when(mode == "smart_pseudonyms", F.coalesce(shown, F.lit("Date shift: Auto"))).otherwise("Date shift: Not used")


def report_table(done: DataFrame, missed: DataFrame) -> DataFrame:
    """(section, line) of the report: a line per exported and skipped document, "- None" for an empty section.

    done: (shown, references); missed: (shown, reason). Mappings follow as a section of their own. It stays a table; write_zip
    puts it in order.
    """
    parts = [
        done.select(F.lit("Exported").alias("section"), F.concat(F.lit("- "), F.col("shown")).alias("line")),
        missed.select(F.lit("Skipped").alias("section"), F.concat(F.lit("- "), F.col("shown"), F.lit(": "), F.col("reason")).alias("line")),
        done.select(F.lit("Mappings").alias("section"), F.explode(mapping_lines(F.col("references"))).alias("line")),
    ]
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2])
    every = done.sparkSession.createDataFrame([("Exported",), ("Skipped",), ("Mappings",)], "section string")
    return every.join(lines, "section", "left").select("section", F.coalesce("line", F.lit("- None")).alias("line"))


def write_zip(rows: DataFrame, report: DataFrame, path: str) -> tuple[int, int]:
    """An archive on the driver of (name, content) rows and the report; numbers of files and of report lines.

    One file needs one writer: rows come one partition at a time, never all at once. For large exports use write_export.
    """
    files, lines = 0, 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in rows.select("name", "content").toLocalIterator():
            z.writestr(r["name"], bytes(r["content"]) if isinstance(r["content"], (bytes, bytearray)) else r["content"] or "")
            files += 1
        with z.open(REPORT, "w") as f:
            section = None
            for r in report.orderBy(F.array_position(F.array(*map(F.lit, ("Exported", "Skipped", "Mappings"))), F.col("section")), "line").toLocalIterator():
                if r["section"] != section:
                    section = r["section"]
                    f.write(f"{section}\n".encode())
                f.write(f"{r['line']}\n".encode())
                lines += 1
    return files, lines
