"""De-identification of whole documents: text, pages, HTML and file names, with references, warnings and errors.

Everything is one projection over a document's row: no shuffle, whatever the number of documents. Only a table of given
names is joined, by the words of each document. Only the HTML branch goes through Python, and only rows of that kind are sent there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dates import date_pieces, parsed_pieces, render_like
from palimpsest.functions.keyed import automatic_shift, institution_of, key_pads, person_of
from palimpsest.functions.names import split_title
from palimpsest.functions.text import affixes, html_escape, is_placeholder, normalize_key, normalize_whitespace, strip, styled
from palimpsest.operators.cleanup import Settings, cleanup, prepared
from palimpsest.operators.html import html_pieces
from palimpsest.operators.recognise import recognise, run_words
from palimpsest.operators.spans import REFERENCES, canonical_tag, merge_references, numbered, references_of, render
from palimpsest.plans.session import by_key, spread

#: Tags by the treatment they get with pseudonyms.
PERSON_TAGS = ["patient", "person", "persoon"]
INSTITUTION_TAGS = ["hospital", "institution", "healthcare_institution", "ziekenhuis", "zorginstelling"]
DATE_TAGS = ["date", "datum"]
#: Stands between the pages of a document while it is processed as one text.
PAGE_BREAK = ""
BLANK = r"(?U)\A\s*\z"


def with_pseudonyms(df: DataFrame, column: str, secret_hex: Column, shift: Column) -> DataFrame:
    """Numbered spans whose persons and institutions get keyed pseudonyms and whose dates are shifted by days.

    A date literal that can't be read keeps its placeholder. Each step is a projection of its own: what a step needs is a field of the
    spans by then, so no lambda is nested in another one.
    """
    c = F.col(column)
    df = df.withColumn("_pads", key_pads(secret_hex)).withColumn("_shift", shift)
    pads = F.col("_pads")
    df = df.withColumn(column, F.transform(c, lambda s: F.struct(s.text, s.tag, s.start, s.end, s.replacement, canonical_tag(s.tag).alias("kind"), split_title(s.text).alias("title"), date_pieces(s.text).alias("pieces"))))
    of = lambda s, tags: s.kind.isin(tags)
    fields = ["text", "tag", "start", "end", "replacement", "kind"]
    keep = lambda s: [s[f].alias(f) for f in fields]
    df = df.withColumn(column, F.transform(c, lambda s: F.struct(*keep(s), s.title.title.alias("title"), F.when(of(s, PERSON_TAGS), strip(s.title.body)).otherwise(strip(s.text)).alias("body"), F.when(of(s, DATE_TAGS), parsed_pieces(s.pieces)).alias("style"))))
    df = df.withColumn(column, F.transform(c, lambda s: F.struct(*keep(s), s.title.alias("title"), s.body.alias("body"), normalize_key(s.body).alias("key"), s.style.alias("style"), F.date_add(s.style.date, F.col("_shift")).alias("day"))))
    df = df.withColumn(column, F.transform(c, lambda s: F.struct(*keep(s), s.title.alias("title"), s.body.alias("body"), F.when(of(s, PERSON_TAGS), person_of(pads, s.key)).when(of(s, INSTITUTION_TAGS), institution_of(pads, s.key, s.body)).alias("name"), F.when(s.style.isNotNull(), render_like(s.day, s.style)).alias("date"))))
    new = lambda s: F.when(of(s, PERSON_TAGS), F.concat(s.title, styled(s["name"], s.body))).when(of(s, INSTITUTION_TAGS), styled(s["name"], s.body)).when(of(s, DATE_TAGS), s.date)
    df = df.withColumn(column, F.transform(c, lambda s: F.struct(s.text, s.tag, s.start, s.end, F.coalesce(new(s), s.replacement).alias("replacement"))))
    return df.drop("_pads", "_shift")


def own_shift(settings: dict[str, Column], secret_hex: Column) -> Column:
    """Days by which a patient's dates are moved: configured, or the keyed ones of the name."""
    subject = F.lower(F.concat_ws(" ", settings.get("first_name", F.lit("")), settings.get("last_name", F.lit(""))))
    return F.coalesce(settings.get("date_shift_days", F.lit(None).cast("int")), automatic_shift(secret_hex, subject))


def deidentify(df: DataFrame, source: str, out: str, settings: Settings | dict[str, Column] | list[str] = Settings(), flags: dict | None = None, normalize: bool = True, secret_hex: Column | None = None, name_like: bool = False, given: list[str] | Column = (), shift: Column | None = None) -> DataFrame:
    """Adds out, struct<text, references, warnings> of the text column source; null for null, and blank text as it is.

    With secret_hex, persons, institutions and dates get pseudonyms; the shift is the settings' own or the keyed automatic one of
    the patient's name, unless shift is given. settings may be the columns of prepared patterns (cleanup.prepared), which then need a
    shift beside a secret. Then the guaranteed cleanup of the settings runs over the result. White space around the text stays as it is
    where it isn't normalised. Columns whose names begin with an
    underscore are used in between.
    """
    extra: list[tuple[str, str]] = []
    if isinstance(settings, Settings):
        flags = settings.flags if flags is None else flags
        extra = [] if name_like else settings.literals()
        settings = settings.columns()
    src = F.col(source)
    full = ~src.rlike(BLANK)
    df = df.withColumn("_a", affixes(src)).withColumn("_t", F.when(full, normalize_whitespace(src) if normalize else F.col("_a.core")))
    df = df.withColumn("_s", recognise(F.col("_t"), flags, extra, given=given)).withColumn("_s", numbered(F.col("_s")))
    if secret_hex is not None:
        df = df.withColumn("_d", own_shift(settings, secret_hex) if shift is None else shift)
        df = with_pseudonyms(df, "_s", secret_hex, F.col("_d"))
    df = df.withColumn("_r", F.struct(render(F.col("_t"), F.col("_s")).alias("text"), references_of(F.col("_s")).alias("references")))
    df = cleanup(df, "_r", "_o", settings, name_like, secret_hex, None if secret_hex is None else F.col("_d")).drop("_d")
    blank = F.struct(src.alias("text"), F.array().cast(REFERENCES).alias("references"), F.array().cast("array<string>").alias("warnings"))
    if not normalize:
        df = df.withColumn("_o", F.struct(F.concat(F.col("_a.lead"), F.col("_o.text"), F.col("_a.tail")).alias("text"), F.col("_o.references").alias("references"), F.col("_o.warnings").alias("warnings")))
    return df.withColumn(out, F.when(full, F.col("_o")).when(src.isNotNull(), blank)).drop("_a", "_t", "_s", "_r", "_o")


def deidentify_pages(df: DataFrame, pages: str, out: str, settings: Settings | dict[str, Column] = Settings(), flags: dict | None = None, secret_hex: Column | None = None, given: list[str] = ()) -> DataFrame:
    """Adds out, struct<text, pages, references, warnings>: pages processed as one document, so numbers run through it.

    If the number of pages differs afterwards, pages are dropped and the text keeps the whole.
    """
    df = deidentify(df.withColumn("_joined", F.when(F.size(pages) > 0, joined_pages(F.col(pages)))), "_joined", "_j", settings, flags, normalize=False, secret_hex=secret_hex, given=given)
    return cut_pages(df, "_j", F.size(pages), out).drop("_joined", "_j")


def joined_pages(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: normalize_whitespace(F.coalesce(p, F.lit("")))), f"\n\n{PAGE_BREAK}\n\n")


def cut_pages(df: DataFrame, done: str, n: Column, out: str) -> DataFrame:
    """Adds out, struct<text, pages, references, warnings>, from the result of joined pages; n: their number."""
    r = F.col(done)
    df = df.withColumn("_parts", F.transform(F.split(r.text, rf"\s*{PAGE_BREAK}\s*", -1), lambda p: F.trim(p)))
    full = F.array_join(F.filter(F.col("_parts"), lambda p: p != ""), "\n\n")
    kept = F.when(F.size("_parts") == n, F.col("_parts")).otherwise(F.array().cast("array<string>"))
    whole = F.struct(full.alias("text"), kept.alias("pages"), r.references.alias("references"), r.warnings.alias("warnings"))
    return df.withColumn(out, F.when(r.isNotNull(), whole)).drop("_parts")


def deidentify_html(df: DataFrame, page: str, out: str, key: list[str], settings: Settings | dict[str, Column] = Settings(), flags: dict | None = None, secret_hex: Column | None = None, given: list[str] = (), carried: list[str] = ()) -> DataFrame:
    """(*key, out) with out a struct<text, references, warnings, error> of each page: text runs and text attributes are rewritten,
    markup, scripts and comments stay.

    Numbers restart with every fragment; references of one placeholder are merged over the page. key must be
    distinct; carried are the columns that per-row settings use. error is null unless the page can't be parsed. Fragments are rows of their own, gathered by key again: one shuffle of the pages' pieces.
    """
    cut = df.select(*key, *carried, F.posexplode(html_pieces(F.col(page))).alias("_pos", "_piece")).select(*key, *carried, "_pos", F.col("_piece.kind").alias("_kind"), F.col("_piece.text").alias("_text"))
    cut = deidentify(cut.withColumn("_own", F.when(F.col("_kind").isin("text", "attribute"), F.col("_text"))), "_own", "_x", settings, flags, normalize=False, secret_hex=secret_hex, given=given)
    return gathered(cut, key, out)


def gathered(cut: DataFrame, key: list[str], out: str, *more: Column) -> DataFrame:
    """(*key, out, *more) of the pieces of documents (_pos, _kind, _text and the result _x); more are aggregates."""
    shown = F.when(F.col("_kind") == "markup", F.col("_text")).when(F.col("_kind") == "text", html_escape(F.col("_x.text"))).when(F.col("_kind") == "attribute", html_escape(F.col("_x.text"), True)).otherwise(F.col("_x.text"))
    failed = F.when(F.col("_kind") == "error", F.col("_text"))
    piece = F.struct("_pos", shown.alias("text"), F.coalesce(F.col("_x.references"), F.array().cast(REFERENCES)).alias("references"), F.coalesce(F.col("_x.warnings"), F.array().cast("array<string>")).alias("warnings"))
    parts = cut.groupBy(*key).agg(F.array_sort(F.collect_list(piece)).alias("_all"), F.max(failed).alias("_error"), *more)
    rest = [c for c in parts.columns if c not in (*key, "_all", "_error")]
    joined = F.struct(
        F.array_join(F.transform("_all", lambda r: r.text), "").alias("text"),
        merge_references(F.flatten(F.transform("_all", lambda r: r.references))).alias("references"),
        F.array_distinct(F.flatten(F.transform("_all", lambda r: r.warnings))).alias("warnings"),
        F.col("_error").alias("error"),
    )
    return parts.select(*key, joined.alias(out), *rest)


#: What may be configured per dossier, as columns.
PER_DOSSIER = ["first_name", "last_name", "birthdate", "other_names", "custom_addresses", "date_shift_days"]


def in_pieces(rows: DataFrame) -> DataFrame:
    """Adds _of, the kind of a document (source_kind, raw_text, pages), and _pieces, array<struct<kind, text>>: what its texts are cut to.

    There is always a piece. Explode them as outer ones all the same: else empty arrays are looked for first, by cutting every text once more.
    """
    blank = F.coalesce(F.col("raw_text").rlike(BLANK), F.lit(True))
    paged = F.coalesce((F.col("source_kind") == "pdf") & (F.size("pages") > 0), F.lit(False))
    is_html = F.coalesce(F.col("source_kind") == "html", F.lit(False))
    rows = rows.withColumn("_of", F.when(blank, "blank").when(paged, "pages").when(is_html, "html").otherwise("whole"))
    kind = F.col("_of")
    rows = rows.withColumn("_html", html_pieces(F.when(kind == "html", F.col("raw_text"))))
    one = lambda k, text: F.array(F.struct(k.alias("kind"), text.alias("text")))
    text = F.when(kind == "pages", joined_pages(F.col("pages"))).when(kind == "whole", normalize_whitespace(F.col("raw_text")))
    pieces = F.when(F.size("_html") > 0, F.col("_html")).when(kind == "html", one(F.lit("markup"), F.lit(""))).otherwise(one(kind, text))
    return rows.withColumn("_pieces", pieces).drop("_html")


def own_text(kind: Column, text: Column) -> Column:
    """The text of a piece if it is the document's own, else null."""
    return F.when(~kind.isin("markup", "error", "blank"), text)


def known_names(texts: DataFrame, given: DataFrame) -> DataFrame:
    """(document_id, _known): which words of each document are given names, for general_names. Documents without one are left out.

    A join, so the table of names may have any size; where it is small enough to be broadcast, only the words that are names are
    shuffled. Names of all rows of an id are taken together: those that the newest text hasn't are never looked up.
    """
    cut = in_pieces(spread(texts.select("document_id", "source_kind", "raw_text", "pages"))).select("document_id", F.explode_outer("_pieces").alias("_p"))
    words = cut.select("document_id", F.explode_outer(run_words(own_text(F.col("_p.kind"), F.col("_p.text")))).alias("_word"))
    names = given.select(F.lower("given_name").alias("_word"))
    return words.join(names, "_word", "left_semi").groupBy("document_id").agg(F.collect_set("_word").alias("_known"))


def process_documents(docs: DataFrame, settings: Settings = Settings(), secret_hex: Column | None = None, given: list[str] | DataFrame = (), dossiers: DataFrame | None = None) -> DataFrame:
    """(document_id, output_text, pdf_page_texts, placeholder_references, warnings, status, error_message) of each distinct imported id.

    Of a redelivered id the row that arrived last counts. A document without text, or that can't be parsed, is a row with status
    "error" and a message; others are "ready", and none stops another. All kinds are pieces of one frame without a branch, so the rules are
    planned once; only HTML reaches the parser. With dossiers (settings_id and PER_DOSSIER, one row each) a document is processed with the
    settings of its own dossier, or with none: patterns and pseudonyms are made once for a dossier, and documents are spread by their
    own ids behind the join, so a dossier with many is no task of its own. given names are a list, or a table (given_name) of any size.
    """
    dated = ["arrived_at"] if "arrived_at" in docs.columns else []
    own = ["settings_id"] if dossiers is not None else []
    rows = docs.filter("id is not null").select(F.col("id").alias("document_id"), "source_kind", "raw_text", F.col("pdf_pages.text").alias("pages"), *own, *dated)
    texts, shift, carried = rows, None, []
    if dossiers is not None:
        configured = {c: F.col(c) for c in PER_DOSSIER}
        patterns, settings = prepared(by_key(dossiers.select("settings_id", *PER_DOSSIER), "settings_id"), configured, secret_hex=secret_hex)
        carried = settings
        if secret_hex is not None:
            patterns = patterns.withColumn("_own_shift", own_shift(configured, secret_hex))
            carried, shift = [*settings, "_own_shift"], F.coalesce("_own_shift", own_shift({c: F.lit(None).cast("string") for c in ("first_name", "last_name")}, secret_hex))
        rows = rows.join(patterns.select("settings_id", *carried), "settings_id", "left").drop("settings_id")
    each = F.struct("source_kind", "raw_text", "pages", *carried)
    newest = by_key(rows, "document_id").groupBy("document_id").agg((F.max_by(each, "arrived_at") if dated else F.max(each)).alias("d")).select("document_id", "d.*")
    if isinstance(given, DataFrame):
        newest = newest.join(known_names(texts, given), "document_id", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>")))
        carried, given = [*carried, "_known"], F.col("_known")
    cut = in_pieces(newest).select("document_id", *carried, F.size("pages").alias("_n"), "_of", F.posexplode_outer("_pieces").alias("_pos", "_p"))
    cut = cut.select("document_id", *carried, "_n", "_of", "_pos", F.col("_p.kind").alias("_kind"), F.col("_p.text").alias("_text")).withColumn("_own", own_text(F.col("_kind"), F.col("_text")))
    cut = deidentify(cut, "_own", "_x", settings, normalize=False, secret_hex=secret_hex, given=given, shift=shift)
    done = gathered(cut, ["document_id"], "g", F.max("_n").alias("_n"), F.max("_of").alias("_of"))
    done = cut_pages(done.withColumn("_gp", F.when(F.col("_of") == "pages", F.col("g"))), "_gp", F.col("_n"), "_paged")
    none = F.array().cast("array<string>")
    whole = F.struct(F.col("g.text"), none.alias("pages"), F.col("g.references"), F.col("g.warnings"))
    r = F.when(F.col("_of") == "pages", F.col("_paged")).when((F.col("_of") != "blank") & F.col("g.error").isNull(), whole)
    return done.withColumn("r", r).select(
        "document_id", F.col("r.text").alias("output_text"), F.col("r.pages").alias("pdf_page_texts"), F.col("r.references").alias("placeholder_references"), F.coalesce("r.warnings", none).alias("warnings"),
        F.when(F.col("r").isNull(), "error").otherwise("ready").alias("status"), F.when(F.col("_of") == "blank", "The document has no text.").otherwise(F.col("g.error")).alias("error_message"),
    )


def filename_words(stem: Column) -> Column:
    """Separators of a file stem that aren't next to digits as blanks."""
    return F.regexp_replace(stem, r"(?<!\d)[._-]+|[._-]+(?!\d)", " ")


def deidentify_filename(df: DataFrame, stem: str, out: str, settings: Settings | dict[str, Column] = Settings(), flags: dict | None = None) -> DataFrame:
    """Adds out, struct<stem, recognised>: the rewritten stem and whether anything in it was recognised."""
    df = deidentify(df.withColumn("_words", filename_words(F.col(stem))), "_words", "_f", settings, flags, normalize=False, name_like=True)
    done = F.struct(normalize_whitespace(F.col("_f.text")).alias("stem"), (F.size("_f.references") > 0).alias("recognised"))
    return df.withColumn(out, F.when(F.col(stem).isNotNull(), done)).drop("_words", "_f")


def pseudonym_mappings(references: Column) -> Column:
    """References whose replacement isn't a placeholder."""
    return F.filter(references, lambda r: ~is_placeholder(r.replacement))
