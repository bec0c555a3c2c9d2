import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dates, keyed, names, text
from palimpsest.operators import cleanup, documents, export, html, recognise, spans
from palimpsest.operators.cleanup import Settings
from palimpsest.sources import files
from palimpsest.streaming import flow

SECRET = "00ff" * 16


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_white_space(spark):
    t = F.lit("  a\t b\r\n\r\n\n\r c d \n")
    assert one(spark, text.normalize_whitespace(t)) == "a b\n\nc d"
    assert one(spark, text.normalize_page_text(F.lit("a\fb  \n\n\n\n c"))) == "a\nb\n\nc"
    assert one(spark, text.skeleton(t)) == "abcd"
    assert one(spark, text.whitespace_quality(F.lit("ab cd\nef g"))) == 5 * 2 - 4 - 1
    assert one(spark, text.normalize_whitespace(F.lit(None).cast("string")), text.normalize_whitespace(F.lit(""))) == (None, "")
    assert len(one(spark, text.normalize_whitespace(F.lit("x " * 200_000)))) == 399_999


@pytest.mark.parametrize("values,best", [(["a b", "a\nb"], "a b"), (["a\nb", "a b"], "a b"), (["ab", "abc d"], "abc d"), (["", None, "x"], "x"), ([], ""), (["a b", "a b"], "a b"), (["  ", "x"], "x")])
def test_best_candidate(spark, values, best):
    assert one(spark, text.best_candidate(F.array(*map(F.lit, values)).cast("array<string>"))) == best


@pytest.mark.parametrize("a,b,near", [("abc", "abc", True), ("abc", "acb", True), ("abc", "abcd", True), ("abc", "bca", False), ("é1", "e1", True), ("", "", True), ("ab", "ba", True), ("abcd", "badc", False)])
def test_one_edit(spark, a, b, near):
    assert one(spark, text.within_one_edit(F.lit(a), F.lit(b))) is near


def test_lists_and_cases(spark):
    assert one(spark, text.list_lines(F.lit("- Jan\r\n* JAN\n\n• Piet"))) == ["Jan", "Piet"]
    assert one(spark, *[text.match_case(F.lit("Anna Maes"), F.lit(x)) for x in ("JAN", "jan", "Jan De Wit", "jAN", "12")]) == ("ANNA MAES", "anna maes", "Anna Maes", "Anna Maes", "Anna Maes")
    assert one(spark, text.title_case(F.lit("d'heygere o-b"))) == "D'Heygere O-B"
    assert one(spark, text.next_index(F.lit("[DATE-2] [DATE-10] [PERSON-3]"), "DATE"), text.next_index(F.lit(""), "DATE")) == (11, 1)


@pytest.mark.parametrize(
    "name,given,family",
    [("Stig Hellemans", "Stig", "Hellemans"), ("Hellemans, Stig", "Stig", "Hellemans"), ("Veerle D'heygere", "Veerle", "D'heygere"), ("Jean Van den Berg", "Jean", "Van den Berg"), ("Cher", "Cher", ""), ("", "", ""), ("de Wit", "de", "Wit")],
)
def test_person_parts(spark, name, given, family):
    assert tuple(one(spark, names.person_parts(F.lit(name)))) == (given, family)


def test_variants(spark):
    assert one(spark, names.person_variants(F.lit("Veerle D'heygere"))) == ["Veerle D'heygere", "Veerle D heygere", "D heygere Veerle", "D heygere, Veerle"]
    assert tuple(one(spark, names.address_parts(F.lit("12 Rue de la Loi 1000 Bruxelles")))) == ("Rue de la Loi", "12", "1000", "Bruxelles")
    assert "12 Rue de la Loi" in one(spark, names.address_variants(F.lit("Rue de la Loi 12, 1000 Bruxelles")))
    assert one(spark, names.person_variants(F.lit(" ")), names.address_variants(F.lit(""))) == ([], [])


@pytest.mark.parametrize(
    "literal,days,want",
    [
        ("1 février 1990", 10, "11 fevrier 1990"), ("8 février 1990", 10, "18 fevrier 1990"), ("10 oktober 2018", 30, "09 november 2018"), ("01/02/1990", 1, "02/02/1990"), ("1-2-90", 1, "2-2-90"), ("31/12/'98", 1, "01/01/'99"),
        ("1990-02-01", 7, "1990-02-08"), (" 12 MARS 1980 ", 1, " 13 MARS 1980 "), ("1 sept. 2001", 30, "1 oct. 2001"), ("30/02/1990", 1, None), ("geen datum", 1, None), ("", 1, None),
    ],
)
def test_shifted_literals(spark, literal, days, want):
    assert one(spark, dates.shift_literal(F.lit(literal), F.lit(days))) == want


def test_birthdates_and_shifts(spark):
    assert [str(x) for x in one(spark, *[dates.parse_birthdate(F.lit(x)) for x in ("1/2/1990", "01-02-1990", "1990.2.1", "31/02/1990", " ", "x")])] == ["1990-02-01"] * 3 + ["None"] * 3
    v = one(spark, dates.birthdate_variants(F.lit("1990-02-01").cast("date")))
    assert {"01/02/1990", "1-2-90", "1 februari 1990", "1 février 1990", "01 feb. 90"} <= set(v) and len(v) == len(set(v))
    assert one(spark, *[dates.safe_shift(F.lit(x).cast("int")) for x in (None, 0, 5, -5, 900, -900, 50)]) == (None, None, 10, -10, 728, -728, 50)
    assert one(spark, dates.days_to_slider(dates.slider_to_days(F.lit(0))), dates.days_to_slider(dates.slider_to_days(F.lit(719))), dates.slider_to_days(F.lit(719))) == (0, 719, 10)


def test_keyed(spark):
    for m in ("", "é test", "x" * 500):
        assert one(spark, keyed.hmac_sha256(F.lit(SECRET), F.lit(m))) == hmac.new(bytes.fromhex(SECRET), m.encode(), hashlib.sha256).hexdigest()
    a, b, c = one(spark, *[keyed.person_pseudonym(F.lit(SECRET), F.lit(x)) for x in ("Dr. Sophie Martin", "SOPHIE MARTIN", "Sophie")])
    assert a.startswith("Dr. ") and a[4:].upper() == b and len(c.split()) == 1
    shift = one(spark, keyed.automatic_shift(F.lit(SECRET), F.lit("jan")))
    assert shift % 7 == 0 and 42 <= abs(shift) <= 728
    assert one(spark, keyed.institution_pseudonym(F.lit(SECRET), F.lit("UZ LEUVEN"))).isupper()


def test_numbering_takes_the_first_near_span(spark):
    t = "abc xyz abcd abcde"
    s = F.array(*[F.struct(F.lit(w).alias("text"), F.lit("persoon").alias("tag"), F.lit(t.index(f"{w} ") if w != "abcde" else 13).alias("start"), F.lit(t.index(f"{w} ") + len(w) if w != "abcde" else 18).alias("end")) for w in t.split()])
    done = one(spark, spans.numbered(s))
    assert [x.replacement for x in done] == ["[PERSON-1]", "[PERSON-2]", "[PERSON-1]", "[PERSON-1]"]
    assert one(spark, spans.render(F.lit(t), spans.numbered(s))) == "[PERSON-1] [PERSON-2] [PERSON-1] [PERSON-1]"
    refs = one(spark, spans.references_of(spans.numbered(s)))
    assert [(r.replacement, r.originals) for r in refs] == [("[PERSON-1]", ["abc", "abcd", "abcde"]), ("[PERSON-2]", ["xyz"])]


@pytest.mark.parametrize(
    "t,tag,found",
    [
        ("Dr. Vanassche B. komt", "persoon", "Vanassche B."), ("Consultation au CHU UCL Namur - Site GODINNE.", "hospital", "CHU UCL Namur - Site GODINNE"), ("Adresse: 1000 Bruxelles.", "location", "1000 Bruxelles"), ("64 jaar oud", "leeftijd", "64 jaar oud"),
        ("bel 0405/38.49.90", "phone_number", "0405/38.49.90"), ("zie https://x.be/a.", "url", "https://x.be/a"), ("né le 12 mars 1980.", "datum", "12 mars 1980"), ("a.b@c.be", "email", "a.b@c.be"),
    ],
)
def test_recognisers(spark, t, tag, found):
    assert (tag, found, t.index(found)) in [(s.tag, s.text, s.start) for s in one(spark, recognise.recognise(F.lit(t)))]


def test_flags(spark):
    t = "Mail jan.10@x.be op 3/4/2011, 64 jaar oud"
    tags = lambda flags: {s.tag for s in one(spark, recognise.recognise(F.lit(t), flags))}
    assert tags(None) == {"email", "datum", "leeftijd"} and tags({"dates": False}) == {"email", "leeftijd"} and tags({"email_addresses": False}) == {"datum", "leeftijd"}
    assert tags({g: False for g in recognise.GROUPS}) == set()


ST = Settings("Jean", "Dubois", "1990-02-01", ("Sophie Martin",), ("Rue de la Loi 12, 1000 Bruxelles",), flags={g: False for g in recognise.GROUPS})
DOCS = [
    ("t", "text_file", "Jean Dubois est vu le 1 février 1990. Martin, Sophie habite 12 Rue de la Loi 1000 Bruxelles.", None, "x"), ("h", "html", '<p title="Jean Dubois">Bonjour <strong>Jean</strong> &amp; Dubois</p><script>var Jean=1;</script>', None, "x"),
    ("p", "pdf", "x", [("Jean p1", 1.0, 1.0), ("", 1.0, 1.0), ("le 01/02/1990", 1.0, 1.0)], "x"), ("b", "paste", "  ", None, "x"), ("n", "pdf", None, None, "x"), (None, "paste", "Jean", None, "x"),
]
SCHEMA = "id string, source_kind string, raw_text string, pdf_pages array<struct<text:string,width:double,height:double>>, output_text string"


def test_documents(spark):
    got = {r.document_id: r for r in documents.process_documents(spark.createDataFrame(DOCS, SCHEMA), ST).collect()}
    assert set(got) == {"t", "h", "p", "b", "n"}
    assert got["t"].output_text == "[PATIENT] est vu le [DATE-1]. [PERSON-1] habite [LOCATION-1]."
    assert got["h"].output_text == '<p title="[PATIENT]">Bonjour <strong>[PATIENT]</strong> &amp; [PATIENT]</p><script>var Jean=1;</script>'
    assert got["p"].pdf_page_texts == ["[PATIENT] p1", "", "le [DATE-1]"] and got["p"].output_text == "[PATIENT] p1\n\nle [DATE-1]"
    assert {k: v.status for k, v in got.items()} == {"t": "ready", "h": "ready", "p": "ready", "b": "error", "n": "error"}
    assert {r.replacement: r.originals for r in got["t"].placeholder_references} == {"[PATIENT]": ["Jean Dubois"], "[PERSON-1]": ["Martin, Sophie"], "[LOCATION-1]": ["12 Rue de la Loi 1000 Bruxelles"], "[DATE-1]": ["1 février 1990"]}


def test_cleanup_leaves_placeholders(spark):
    df = spark.createDataFrame([("[PATIENT] Patient ziet [DATE-3] Patientje", [], "Patient"), (None, None, None)], "text string, references array<struct<replacement:string,originals:array<string>>>, last_name string")
    df = df.withColumn("src", F.struct("text", "references"))
    got = cleanup.cleanup(df, "src", "r", {"first_name": F.lit(None).cast("string"), "last_name": F.col("last_name")}).select("r.*").collect()
    assert got[0].text == "[PATIENT] [PATIENT] ziet [DATE-3] Patientje" and got[0].warnings == [cleanup.WARNING]
    assert got[1].text is None


def test_pseudonyms_keep_gaps(spark):
    df = spark.createDataFrame([("Dr. Sophie Martin, 1 février 1990 en 8 février 1990.",)], "t string")
    out = documents.deidentify(df, "t", "r", Settings(date_shift_days=10), secret_hex=F.lit(SECRET)).first().r.text
    assert out.startswith("Dr. ") and "11 fevrier 1990 en 18 fevrier 1990" in out and "Martin" not in out


def test_html_text(spark):
    assert one(spark, html.html_to_text(F.lit("<p>[PATIENT]</p><p>Line&nbsp;two</p><style>p{}</style>"))) == "[PATIENT]\n\nLine two"


def test_export(spark):
    assert one(spark, *[export.sanitize_stem(F.lit(x)) for x in ('Patient: "John"/Report?', "é", "..", "con", "日本")]) == ("Patient-John-Report", "e", "document", "con-file", "document")
    names_in = ["a.txt", "a.txt", "a-2.txt", "a.txt", "b", "b", export.REPORT]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names_in)], "i int, name string")
    got = {r.i: r.unique_name for r in export.unique_names(df, "name", ["i"]).collect()}
    assert len(set(got.values())) == len(got) and got[0] == "a.txt" and got[2] == "a-2.txt" and got[1] == "a-3.txt" and got[4] == "b" and got[5] == "b-2" and got[6] != export.REPORT
    docs = spark.createDataFrame([("f", "text_file", "/x/Jean_Dubois.txt", "Jean_Dubois.txt", "input")], "id string, source_kind string, path string, display_name string, raw_text string")
    row = export.export_name(docs, F.lit(True), F.lit(True), F.lit(False)).first()
    assert row.export_name == hashlib.sha256(b"input").hexdigest()[:10] + "_deid.txt"
    found = documents.deidentify_filename(docs.select(export.source_stem(F.col("display_name")).alias("stem")), "stem", "f", ST).first().f
    assert found.recognised and "Dubois" not in found.stem
    assert one(spark, export.tooltip(F.lit("[X-1]"), F.array(F.lit("a"), F.lit("b"))), export.warnings_text(F.lit(None).cast("array<string>"))) == ("Placeholder for: a; b", "")
    case = one(spark, export.corpus_case(F.lit("a  b"), F.lit("a b"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    assert case.status == "pass" and case.similarity == 1.0


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Résumé clinique".encode("cp1252"))
    (tmp_path / "b.HTML").write_bytes("﻿<p>é</p>".encode())
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.bin").write_bytes(b"\x00")
    rows = {r.display_name: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].raw_text == "Résumé clinique" and rows["b.HTML"].raw_text == "<p>é</p>" and rows["b.HTML"].source_kind == "html"
    assert rows["c.pdf"].status == "error" and rows["d.bin"].error_message == files.BAD_KIND

    def extract(pdf):
        return pdf.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_no"), F.array(F.lit("a b"), F.lit("a b c")).alias("texts"), F.lit(0.0).alias("width"), F.lit(5.0).alias("height"))

    page = {r.display_name: r for r in files.read_documents(spark, str(tmp_path), extract).collect()}["c.pdf"]
    assert page.raw_text == "a b c\n\na b c" and page.pdf_pages[0].width == 612.0 and page.status == "pending"
    assert files.pasted(spark.createDataFrame([(" x ",), (" ",), (None,)], "text string")).count() == 1
    (tmp_path / "w.lst").write_text("Anna\n\n Bo \n")
    assert {r.term for r in files.word_list(spark, str(tmp_path / "w.lst")).collect()} == {"Anna", "Bo"}
    s = files.load_settings(spark.createDataFrame([("A", None, "1/2/1990", "5", "- x\nX", None, "nee?", "odd")], "first_name string, last_name string, birthdate string, date_shift_days string, other_names string, custom_addresses string, deidentify_filenames string, mode string")).first()
    assert (str(s.birthdate), s.date_shift_days, s.other_names, s.deidentify_filenames, s.mode) == ("1990-02-01", 10, ["x"], True, "placeholders")


def test_stream(spark, tmp_path):
    rows = [("a", 1, "oud"), ("a", 2, "nieuw"), ("b", 1, "x")]
    spark.createDataFrame(rows, "id string, generation int, raw_text string").write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("id string, generation int, raw_text string").parquet(str(tmp_path / "in"))
    flow.run(stream, lambda b: b.withColumn("output_text", F.upper("raw_text")), lambda b, n: got.extend(b.collect()), str(tmp_path / "c1")).awaitTermination()
    assert sorted((r.id, r.output_text) for r in got) == [("a", "NIEUW"), ("b", "X")]
    failed = []

    def broken(batch):
        raise ValueError("kapot")

    flow.run(stream, broken, lambda b, n: failed.extend(b.collect()), str(tmp_path / "c2")).awaitTermination()
    assert {(r.document_id, r.status, r.error_message) for r in failed} == {("a", "error", "kapot"), ("b", "error", "kapot")}


def test_streamed_tables_are_files_or_folders(spark, tmp_path):
    from palimpsest import catalogue, catalogue_operators  # noqa: F401  (registers its queries)

    rows = [("a", 1, "oud"), ("a", 3, "nieuwst"), ("a", 2, "nieuw"), ("b", 1, "x"), ("c", 5, None), (None, 1, "los")]
    df = spark.createDataFrame(rows, "document_id string, generation int, output_text string")
    want = {("a", 3, 7), ("b", 1, 1), ("c", 5, None), (None, 1, 3)}
    df.repartition(3).write.parquet(str(tmp_path / "folder" / "processed_documents.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "file" / "processed_documents.parquet")
    df.limit(0).write.parquet(str(tmp_path / "empty" / "processed_documents.parquet"))
    for at, rows in (("folder", want), ("file", want), ("empty", set())):
        got = catalogue.QUERIES["streamed_latest"](spark, str(tmp_path / at)).collect()
        assert len(got) == len(rows) and {tuple(r) for r in got} == rows


def test_versions(spark):
    docs = spark.createDataFrame([("a", 2, "pending", None, "x"), ("b", 1, "pending", None, None)], "id string, generation int, status string, error_message string, raw_text string")
    res = spark.createDataFrame([("a", 1, "oud", None), ("a", 2, "nieuw", None), ("weg", 1, "x", None)], "document_id string, generation int, output_text string, error_message string")
    current = flow.current_results(res, docs)
    assert [r.output_text for r in current.collect()] == ["nieuw"]
    merged = {r.id: (r.status, r.output_text) for r in flow.merge_results(docs, current).collect()}
    assert merged == {"a": ("ready", "nieuw"), "b": ("pending", None)}
    assert {(r.id, r.generation) for r in flow.reset(docs, F.lit(True)).collect()} == {("a", 3), ("b", 1)}
    assert [r.id for r in flow.processable(docs).collect()] == ["a"]


def test_zip_and_report(spark, tmp_path):
    import zipfile

    rows = spark.createDataFrame([("a.txt", "één"), ("b.txt", None)], "name string, content string")
    done = spark.createDataFrame([("a.txt", [("Anna Maes", ["Jan"]), ("[DATE-1]", ["1 mei"])])], "shown string, references array<struct<replacement:string,originals:array<string>>>")
    missed = spark.createDataFrame([], "shown string, reason string")
    assert export.write_zip(rows, export.report_table(done, missed), str(tmp_path / "x.zip")) == (2, 3)
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.read("a.txt").decode() == "één"
        assert z.read(export.REPORT).decode().splitlines() == ["Exported", "- a.txt", "Skipped", "- None", "Mappings", "- Jan => Anna Maes"]
    pasted = spark.createDataFrame([(i,) for i in range(1200)], "i int")
    got = {r.i: r.export_name for r in export.pasted_names(pasted, ["i"]).collect()}
    assert got[0] == "pasted-001.txt" and got[1199] == "pasted-1200.txt" and len(set(got.values())) == 1200
    places = spans.highlights(F.lit("[A-1] x [A-1]"), F.array(F.struct(F.lit("[A-1]").alias("replacement"), F.array(F.lit("q")).alias("originals"))))
    assert [p.start for p in one(spark, places)] == [0, 8] and one(spark, export.covering(places, F.lit(9))).text == "[A-1]" and one(spark, export.covering(places, F.lit(6))) is None
    assert one(spark, export.date_shift_line(F.lit("smart_pseudonyms"), F.lit(12), F.lit(7))) == "Date shift: +12 days (manual)"


def test_sql_names(spark):
    from palimpsest.plans.sql import register

    register(spark)
    assert spark.sql("select mask_simple('mail a@b.be op 1/2/2003')").first()[0] == "mail [EMAIL] op [DATUM]"
    assert [tuple(r) for r in spark.sql("select * from simple_spans('x a@b.be')").collect()] == [("email", "a@b.be", 2, 8)]
    assert spark.sql("select html_text('<p>a</p>')").first()[0] == "a"


def test_near_duplicate_names_with_accents(spark, tmp_path):
    from palimpsest import catalogue

    def near(a, b):
        if a == b or len(a) == len(b) and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1)):
            return True
        cut = lambda x: {x[:i] + x[i + 1 :] for i in range(len(x))}
        return a in cut(b) or b in cut(a) or len(a) == len(b) and sum(p != q for p, q in zip(a, b)) == 1

    words = ["Léon", "Leon", "Lèon", "Loén", "Lén", "Müller", "Muller", "Mülelr", "Møllér", "Łeon", "Léonn", "Zoë", "Zëo", "Bos", "Bas"]
    rows = [(1, "last_name", w) for w in words] + [(1, "other_names", w) for w in words] + [(1, "annotation", None), (2, "annotation", "Léon")]
    spark.createDataFrame(rows, "settings_id long, field string, name string").write.parquet(f"{tmp_path}/name_records.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["near_duplicate_names_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, a, b) for a in words for b in words if near(a, b)}


def test_dates_are_no_phones(spark):
    for t in ("01/02/1990", "le 01-02-1990 a", "op 1.2.1990,"):
        assert [s.tag for s in one(spark, recognise.recognise(F.lit(t)))] == ["datum"]


def test_names_without_a_title(spark):
    found = one(spark, recognise.recognise(F.lit("Gezien met Tavowen van den Bosch en Quordinckx Zelien. CHU Namur"), given=["Tavowen", "Zelien"]))
    assert [s.text for s in found if s.tag == "persoon"] == ["Tavowen van den Bosch", "Quordinckx Zelien"]
    both = one(spark, recognise.recognise(F.lit("Rue Haute 12, 1000 Bruxelles")))
    assert [s.text for s in both] == ["Rue Haute 12, 1000 Bruxelles"]


def test_given_names_of_a_table_of_any_size(spark, tmp_path, monkeypatch):
    from palimpsest import catalogue, catalogue_operators  # noqa: F401

    letters = "abcdefghij"
    names = ["Qu" + "".join(letters[int(c)] for c in f"{i:05d}") for i in range(20000)]
    spark.createDataFrame([(n, None) for n in [*names, None]], "given_name string, nickname string").write.parquet(f"{tmp_path}/given_nicknames.parquet")
    hidden = names[::400]
    text = [f"Gezien met {a} van den Bosch en Zorro {b}, d'{c}." for a, b, c in zip(hidden[::3], hidden[1::3], hidden[2::3])]
    rows = [(f"t{i}", "text_file", t, None, 1, 1) for i, t in enumerate(text[:5])]
    rows += [(f"h{i}", "html", f'<p title="{t}">{t}</p>', None, 1, 1) for i, t in enumerate(text[5:10])]
    rows += [(f"p{i}", "pdf", t, [("Blad een",), (t,)], 1, 1) for i, t in enumerate(text[10:])]
    rows += [("t0", "text_file", "Niets.", None, 1, 0), ("none", "text_file", "Gezien met Quzz Janssens.", None, 1, 1), ("blank", "text_file", " ", None, 1, 1)]
    docs = spark.createDataFrame(rows, "id string, source_kind string, raw_text string, pdf_pages array<struct<text string>>, settings_id bigint, arrived_at int")
    docs.write.parquet(f"{tmp_path}/imported_documents.parquet")
    own = spark.createDataFrame([], "settings_id bigint, first_name string, last_name string, birthdate date, other_names array<string>, custom_addresses array<string>, date_shift_days int, saved_at timestamp")
    own.write.parquet(f"{tmp_path}/patient_settings.parquet")
    made, process = [], documents.process_documents
    monkeypatch.setattr(documents, "process_documents", lambda *a, **k: made.append(process(*a, **k)) or made[-1])
    catalogue.QUERIES["smart_documents"](spark, str(tmp_path))
    got = {r.document_id: r.output_text for r in made[0].collect()}
    left = [n for n in hidden for t in got.values() if t and n.lower() in t.lower()]
    assert left == [] and not any("Bosch" in (t or "") or "Zorro" in (t or "") for t in got.values())
    assert len(got) == len(rows) - 1 and got["none"] == "Gezien met Quzz Janssens." and got["blank"] is None
    # a list gives the same
    listed = process(docs, given=hidden).select("document_id", "output_text", "placeholder_references")
    joined = process(docs, given=spark.read.parquet(f"{tmp_path}/given_nicknames.parquet")).select("document_id", "output_text", "placeholder_references")
    assert sorted(listed.collect()) == sorted(joined.collect())


def test_pseudonyms_in_the_cleanup(spark):
    rows = [("a", "Jean Dubois zag Sophie Martin op 01/02/1990 in Kerkstraat 5.", "Jean", "Dubois", "1990-02-01", ["Sophie Martin", None], ["Kerkstraat 5"], 10), ("b", "JEAN", "Jean", None, None, None, None, None), ("c", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, t string, first_name string, last_name string, birthdate string, other_names array<string>, custom_addresses array<string>, date_shift_days int")
    own = {c: F.col(c) for c in documents.PER_DOSSIER} | {"birthdate": F.col("birthdate").cast("date")}
    got = {r.id: r.r for r in documents.deidentify(df, "t", "r", own, {g: False for g in recognise.GROUPS}, secret_hex=F.lit(SECRET)).collect()}
    text_a = got["a"].text
    assert "[PATIENT]" not in text_a and "Dubois" not in text_a and "Martin" not in text_a and "op 11/02/1990 in [LOCATION-1]." in text_a
    assert got["b"].text.isupper() and got["b"].text != "JEAN" and got["c"] is None
    assert {o for x in got["a"].references for o in x.originals} == {"Jean Dubois", "Sophie Martin", "01/02/1990", "Kerkstraat 5"}


def test_placeholders_keep_their_case(spark):
    df = spark.createDataFrame([("mail jan[at]post [PATIENT]", [], "post")], "text string, references array<struct<replacement:string,originals:array<string>>>, last_name string").withColumn("src", F.struct("text", "references"))
    assert cleanup.cleanup(df, "src", "r", {"first_name": F.lit(None).cast("string"), "last_name": F.col("last_name")}).first().r.text == "mail jan[at][PATIENT] [PATIENT]"


def test_dossiers(spark):
    docs = spark.createDataFrame([("t", "paste", "Jean komt.", None, 1), ("h", "html", "<P Title='Jean'>Jean</P>", None, 1), ("o", "paste", "Jean komt.", None, 2), ("n", "paste", "Jean", None, None)], "id string, source_kind string, raw_text string, pdf_pages array<struct<text:string,width:double,height:double>>, settings_id long")
    own = spark.createDataFrame([(1, "Jean", None, None, None, None, None)], "settings_id long, first_name string, last_name string, birthdate date, other_names array<string>, custom_addresses array<string>, date_shift_days int")
    got = {r.document_id: r.output_text for r in documents.process_documents(docs, dossiers=own).collect()}
    assert got == {"t": "[PATIENT] komt.", "h": '<P Title="[PATIENT]">[PATIENT]</p>', "o": "Jean komt.", "n": "Jean"}


def test_settings_are_prepared_once_for_a_dossier(spark):
    page = [("Jean Peeters", 1.0, 1.0), ("", 1.0, 1.0), ("geboren 01/02/1990", 1.0, 1.0)]
    kinds = [("t", "paste", "Jean Peeters, 01/02/1990.", None), ("h", "html", "<p title='Jean Peeters'>01/02/1990</p>", None), ("p", "pdf", "x", page), ("b", "text_file", " ", None), ("e", "html", "<a", None)]
    rows = [(f"{k}{s or ''}", kind, t, p, s) for s in (1, 2, None) for k, kind, t, p in kinds]
    docs = spark.createDataFrame(rows, "id string, source_kind string, raw_text string, pdf_pages array<struct<text:string,width:double,height:double>>, settings_id long")
    own = spark.createDataFrame([(1, "Jean", "Peeters", "1990-02-01", None, None, 10), (2, None, None, None, ["Peeters"], None, None)], "settings_id long, first_name string, last_name string, birthdate string, other_names array<string>, custom_addresses array<string>, date_shift_days int")
    done = documents.process_documents(docs, secret_hex=F.lit(SECRET), dossiers=own.withColumn("birthdate", F.col("birthdate").cast("date")))
    got = {r.document_id: r for r in done.collect()}
    assert len(got) == 15 and {i for i, r in got.items() if r.status == "error"} == {"b1", "b2", "b"}
    assert "11/02/1990" in got["t1"].output_text and "11/02/1990" in got["h1"].output_text and "11/02/1990" in got["p1"].pdf_page_texts[2]
    assert not any("Jean" in got[i].output_text for i in ("t1", "h1", "p1")) and not any("Peeters" in got[i].output_text for i in ("t2", "h2", "p2"))
    assert "Jean Peeters" in got["t"].output_text and len(got["p"].pdf_page_texts) == 3 and "01/02/1990" not in got["t"].output_text
    # one branch: the rules are planned once, and patterns are on the dossiers' side of the join
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("ArrowEvalPython") == 1


def test_pdf_round_trip():
    from palimpsest.sources import pdf

    pages = ["Eén regel\n(met haakjes) \\ en tab", "日本語 naast Latijn", "", "woord " * 900]
    read = pdf.page_candidates(pdf.write_pdf(pages, [(300.0, 400.0), (320.0, 420.0)]))
    assert [(w, h) for _, w, h in read][:2] == [(300.0, 400.0), (320.0, 420.0)] and len(read) > 4
    squeeze = lambda t: "".join(t.split())
    assert squeeze(read[0][0][1]) == squeeze(pages[0]) and squeeze(read[1][0][1]) == squeeze(pages[1]) and read[2][0] == ["", ""]
    assert squeeze("".join(t[1] for t, *_ in read[3:])) == squeeze(pages[3])
    assert pdf.page_candidates(pdf.write_pdf([])) == [(["", ""], 612.0, 792.0)]
    with pytest.raises(ValueError):
        pdf.page_candidates(b"no pdf")


def test_secret(spark, tmp_path):
    from palimpsest.sources import secret

    a = secret.load_secret(tmp_path / "x" / "s")
    assert len(a) == 64 and secret.load_secret(tmp_path / "x" / "s") == a and (tmp_path / "x" / "s").stat().st_mode & 0o777 == 0o600
    assert secret.secret_table(spark, tmp_path / "x" / "s").first().secret_hex == a
    (tmp_path / "bad").write_bytes(b"x")
    with pytest.raises(ValueError):
        secret.load_secret(tmp_path / "bad")


def test_views_in_sql(spark):
    from palimpsest.plans.sql import register, register_views

    spark.createDataFrame([(1, "mail a@b.be op 1/2/2003"), (2, None)], "k int, t string").createOrReplaceTempView("letters")
    register_views(spark, "letters", "k", "t")
    assert [tuple(r) for r in spark.sql("select tag, text from letters_spans order by start").collect()] == [("email", "a@b.be"), ("datum", "1/2/2003")]
    assert [r.output_text for r in spark.sql("select output_text from letters_deidentified order by k").collect()] == ["mail [EMAIL-1] op [DATE-1]", None]
    register(spark)
    assert spark.sql("select html_text('<p>a</p>\n\n<p>b</p> c')").first()[0] == one(spark, html.html_to_text(F.lit("<p>a</p>\n\n<p>b</p> c")))


def test_cluster_failures_end_the_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x")], "id string, generation int, raw_text string").write.parquet(str(tmp_path / "in"))

    def lost(batch):
        raise OSError("No space left on device")

    stream = spark.readStream.schema("id string, generation int, raw_text string").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="No space left"):
        flow.run(stream, lost, lambda b, n: None, str(tmp_path / "c")).awaitTermination()
    left = flow.without_removed(spark.createDataFrame([("a",), ("b",), (None,)], "id string"), spark.createDataFrame([("a",), (None,)], "id string"))
    assert {r.id for r in left.collect()} == {"b", None}


def test_linked_values(spark):
    assert one(spark, names.person_value(F.lit(" A "), F.lit(None).cast("string")), names.address_value(F.lit("Kerkstraat"), F.lit("5"), F.lit(""), F.lit("Gent")), names.address_value(*[F.lit(" ")] * 4)) == ("A", "Kerkstraat 5, Gent", "")
