import pytest

from palimpsest.llm import p1_scans as p1

WORDS = "de patiënt klaagt over hoofdpijn en misselijkheid sinds januari met lichte achteruitgang na wandelen in het bos; wegens vermoeidheid volgt rust"


@pytest.mark.parametrize(
    "line,page,form",
    [("3", 3, "alone"), ("- 3 -", 3, "alone"), ("p. 3", 3, "alone"), ("Pa9ina 3 van 5", 3, "alone"), ("Medisch verslag / 12   3/5", 3, "marked"), ("l/3", 1, "alone"), ("p. 3", 4, None), ("score 3", 3, "bare"), ("3 x", 3, "bare"), ("op 3 mei", 3, None)],
)
def test_own_number(line, page, form):
    got = p1.own_number(line, page)
    assert (got and got[2]) == form


def test_confusions():
    assert "gestart" in p1.undone("gcstart") and "dossier" in p1.undone("d0s5ier") and "médecin" in p1.undone("méclecin") and "1983" not in p1.undone("1983")
    assert p1.confused_key("Medisch verslag - 12") == p1.confused_key("Mcdlsch ver5lag 12")


def _docs():
    body = (WORDS + ". ") * 3
    page = lambda *lines: ("\n".join(lines), 1.0, 1.0)
    pages = [
        page("Medisch verslag / 4711   1/3", "De patiënt klaagt over hoofdpijn en misse-", "lijkheid sinds januari met lichte achter-"),
        page("Mediscli verslag / 4711   2/3", "uitgang na wandelen in het bos; Maag-", "en darmklachten wcgens vermoeidheid volgt", "rust in het bos met hoofdpijn en vermoeid¬"),
        page("Medisch verslag / 4711   3/3", "heid sinds januari.", "", "score 3"),
    ]
    rows = [("a", body * 5, pages, "x"), ("a", body * 5, pages, "x"), ("b", body * 5, None, None), ("c", None, [(None, None, None), ("", 1.0, 1.0)], "x"), ("d", "Medisch verslag " * 9, [], "x"), (None, body, pages, "x")]
    rows += [(f"n{i}", f"wegens vermoeidheid {WORDS} " * 4, [(f"Kenmerk: {i}\n\n{WORDS}.", 1.0, 1.0)], "x") for i in range(12)]
    return rows


def test_noise(spark):
    df = spark.createDataFrame(_docs(), "id string, raw_text string, pdf_pages array<struct<text:string,width:double,height:double>>, kind string")
    got = {(r.page_no, r.kind) for r in p1.scan_noise(df).filter("document_id = 'a'").collect()}
    want = {(1, "running_header"), (2, "running_header"), (3, "running_header"), (1, "page_number"), (2, "page_number"), (3, "page_number"), (1, "split_word"), (2, "split_word"), (2, "misread")}
    assert got == want
    assert p1.scan_noise(df).filter("document_id != 'a'").count() == 0
    assert p1.scan_noise(df.limit(0)).count() == 0


def test_paragraphs(spark):
    le, lt = p1.logs(*p1.prior())
    doc = p1.document([p[0] for p in _docs()[0][2]])
    p1.decode(doc, le, lt)
    runs = p1.body_runs(doc)
    assert [line for _, line in runs[0]][0].startswith("De patiënt") and runs[0][-1][1].startswith("heid sinds")
    assert [x for _, *x in p1.splits(runs[0])] == [["misse", "lijkheid"], ["achter", "uitgang"], ["Maag", "en"], ["vermoeid", "heid"]]
