import pytest

from palimpsest.llm import p2_personal as p2

PLACES = p2.Places([("7687", "Sint-Stopvoorde", "Saint-Stoperaux"), ("5114", "Sackkerke", "Sackcourt-le-Bas")])
KNOWN = p2.Known({"tavowen", "quordinckx", "van", "den", "bas"}, {"volgens", "contactpersoon", "gezien", "toestel", "post"}, {"volgens", "contactpersoon:", "met"}, {"id_number:insz": 0.9, "id_number:staalnummer": 0.0, "id_number:niss": 0.9}, bytes(p2.MARKS // 8))


@pytest.mark.parametrize(
    "text,kind,item",
    [
        ("Mail: jan.peeters+zorg@mail.x.test sturen", "email", "jan.peeters+zorg@mail.x.test"), ("naar jan (at) mail-x.invalid.", "email", "jan (at) mail-x.invalid"), ("via jan87[at]mail[dot]x[dot]org", "email", "jan87[at]mail[dot]x[dot]org"),
        ("Tel. 0032 408 652868 (thuis)", "phone", "0032 408 652868"), ("au (02) 0931 30 98 a", "phone", "(02) 0931 30 98"), ("op 03/0088.30.19.", "phone", "03/0088.30.19"), ("+32 (0)406 65 62 12", "phone", "+32 (0)406 65 62 12"),
        ("INSZ 63.03.04 214-53", "id_number", "63.03.04 214-53"), ("NISS 594-4371033-37", "id_number", "594-4371033-37"), ("Rijksregisternr. 598 6182794 49", "id_number", "598 6182794 49"), ("nr B80424512408", "id_number", "B80424512408"),
        ("naar Noeckulaikaai 64 bus 3, 7687 Sint-Stopvoorde worden", "address", "Noeckulaikaai 64 bus 3, 7687 Sint-Stopvoorde"), ("op 5114 Sackkerke - Glaemumellaan 43.", "address", "5114 Sackkerke - Glaemumellaan 43"),
        ("réside 91, Allée de la Wuir,5114 Sackcourt-le-Bas.", "address", "91, Allée de la Wuir,5114 Sackcourt-le-Bas"), ("à Glaemumelln 43 b, Sackkerke (5114).", "address", "Glaemumelln 43 b, Sackkerke (5114)"),
        ("Volgens dr. Zelien Van den Bosch was", "name", "Zelien Van den Bosch"), ("Gezien met Tavowen Quordinckx op", "name", "Tavowen Quordinckx"), ("Contactpersoon: Quordinckx, T., na", "name", "Quordinckx, T"), ('<p title="Tavowen Bosch">', "name", "Tavowen Bosch"),
        ("Gezien met Ｔavo​wen Quordinckx.", "name", "Ｔavo​wen Quordinckx"), ("groeten,\n\ntavowen van den bosch", "name", "tavowen"), ("r&eacute;side Tavowen L&eacute;on.", "name", "Tavowen L&eacute;on"),
    ],
)
def test_items(text, kind, item):
    got = [(k, text[s:e]) for s, e, k, terms in p2.items(text, KNOWN, PLACES) if not terms]
    assert got == [(kind, item)]


@pytest.mark.parametrize("text", ["Staalnummer 34504485737 vermeldt 20,3 mmol", "op 05/12/2011 om 12:30", "https://beeld.zorg.example/8710777684 sinds", "(lot 5752970747-A) kamer 457, route 85", "Kenmerk: 45904822", "[PERSON-1] op [DATE-1]", "Gezien met Ziekenhuis Sint-Tromisart", "Volgens Tromisart ziekenhuis", "ter hoogte van den rug en le bas du dos", ""])
def test_no_items(text):
    assert [x for x in p2.placed_items(text, KNOWN, PLACES) if not x[3] and x[5]] == []


def test_corpus(spark):
    say = "Gezien met {} op 3 mei. Volgens {} was er koorts. De dosis Sulomidol ging omhoog en Sulomidol bleef."
    people = [f"{g} {f}" for g in ("Tavowen", "Zelien", "Mirarda") for f in ("Quordinckx", "Peulstein", "Drelmaert")]
    texts = [say.format(a, a) for a in people for _ in range(4)] + [say.format("Onno Nieuwnaam", "Onno Nieuwnaam"), "Nieuws: Peulstein belde.", "", None, "  ", "lang " * 30000]
    docs = [(f"d{i}", t, None, "x") for i, t in enumerate(texts)] + [("d0", texts[0], None, "x"), (None, "Tavowen", None, None)]
    docs = spark.createDataFrame(docs, "id string, raw_text string, pdf_pages array<struct<text:string,width:double,height:double>>, kind string")
    notes = [(i, f"d{i}", texts[i].split(" op ")[0][len("Gezien met ") :], "Persoon") for i in range(36)] + [(100 + i, f"d{i}", texts[i].split(" op ")[0][len("Gezien met ") :], "patient") for i in range(36)]
    notes = spark.createDataFrame([*notes, notes[0], (None, None, None, None)], "annotation_id long, document_id string, text string, tag string")
    done = spark.createDataFrame([("d1", 1, "Tavowen Quordinckx belde [PHONE-1]."), ("d1", 1, "Tavowen Quordinckx belde [PHONE-1]."), ("d2", 1, None), (None, None, "Zelien")], "document_id string, generation int, output_text string")
    loc = spark.createDataFrame([("7687", "Sint-Stopvoorde", "Saint-Stoperaux")], "postcode string, name_nl string, name_fr string")
    got = {tuple(r) for r in p2.personal_items(docs, done, notes, loc).select("document_id", "field", "item_no", "kind", "start_char").collect()}
    want = {(f"d{i}", "raw_text", 0, "name", t.index(n, at)) for i, t in enumerate(texts[:37]) for n in [t.split(" op ")[0][11:]] for at in (0, 20)}
    want |= {("d37", "raw_text", 0, "name", 8), ("d1", "output_text", 1, "name", 0)}
    assert got == want
    assert p2.personal_items(docs.limit(0), done.limit(0), notes.limit(0), loc.limit(0)).count() == 0


def test_rare_names_in_lower_case(spark):
    # enough annotated words that a family name annotated once is below the bound of known.names
    people = ["Tavowen Quordinckx"] * 4000 + ["Zelolf van Sorgiers", "Mirarda Jos"]
    text = "Verslag van zelolf van sorgiers en tavowen  sorgiers over jos. Gezien: zelolf jos"
    docs = [(f"d{i}", f"Gezien met {n} op 3 mei.", None) for i, n in enumerate(people)] + [("low", text, None)]
    docs = spark.createDataFrame(docs, "id string, raw_text string, pdf_pages array<struct<text:string,width:double,height:double>>")
    notes = spark.createDataFrame([(i, f"d{i}", n, "Persoon") for i, n in enumerate(people)], "annotation_id long, document_id string, text string, tag string")
    done = spark.createDataFrame([], "document_id string, generation int, output_text string")
    loc = spark.createDataFrame([("7687", "Sint-Stopvoorde", "Saint-Stoperaux")], "postcode string, name_nl string, name_fr string")
    got = {text[r.start_char : r.end_char] for r in p2.personal_items(docs, done, notes, loc).filter("document_id = 'low'").collect()}
    assert got == {"zelolf van sorgiers", "tavowen  sorgiers", "zelolf jos"}


def test_the_same_in_a_larger_corpus(spark):
    """Rows of a corpus stay as they are when twenty copies with other names join it: frequent and rare words are decided alike."""
    people = [(g, f) for g in ("Tavowen", "Zelien", "Mirarda") for f in ("Quordinckx", "Peulstein", "van Drelmaert")]
    say = "Gezien met {0} {1} op 3 mei. Bericht: {0} {1} kreeg Sulomidol. Bel 0470 11 22 33 of INSZ 63.03.04 214-53, staal {2}."

    def corpus(k):
        turn = lambda w: w if k == 0 else w + "abcdefghijklmnopqrstuvwxyz"[k]
        docs = [(f"{k}-{i}", say.format(turn(g), turn(f), f"0470 {i:02d} 22 {k:02d}"), None) for i, (g, f) in enumerate(people * 12)]
        notes = [(k * 1000 + i * 3 + j, d, x, tag) for i, (d, t, _) in enumerate(docs) for j, (x, tag) in enumerate(((t[11 : t.index(" op ")], "persoon"), ("0470 11 22 33", "phone_number"), ("63.03.04 214-53", "national_register_number")))]
        return docs, notes

    def found(parts):
        docs = spark.createDataFrame([d for p in parts for d in p[0]], "id string, raw_text string, pdf_pages array<struct<text:string,width:double,height:double>>")
        notes = spark.createDataFrame([n for p in parts for n in p[1]], "annotation_id long, document_id string, text string, tag string")
        none = spark.createDataFrame([], "document_id string, generation int, output_text string")
        loc = spark.createDataFrame([("7687", "Sint-Stopvoorde", "Saint-Stoperaux")], "postcode string, name_nl string, name_fr string")
        rows = p2.personal_items(docs, none, notes, loc).filter("document_id like '0-%'")
        return {tuple(r) for r in rows.select("document_id", "kind", "start_char", "end_char").collect()}

    small = found([corpus(0)])
    assert small == found([corpus(k) for k in range(21)])
    kinds = [k for d, k, *_ in small if d == "0-0"]
    assert sorted(kinds) == ["id_number", "name", "name", "phone"]
