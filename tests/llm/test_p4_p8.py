import pytest

from palimpsest.llm import p4_lookalike as p4
from palimpsest.llm import p8_mixture as p8
from palimpsest.llm.units import units

SCHEMA = "id string, raw_text string, pdf_pages array<struct<text:string,width:double,height:double>>, form string"


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("café", "café", True), ("ABC 12", "ＡＢＣ　１２", True), ("zwelling", "zwel​ling", True), ("a b", "a b", True), ("een\r\ntwee", "een\ntwee", True),
        ("fin", "ﬁn", True), ("o-p", "o‑p", True), ("wo­\nord", "wo-\nord", True), ("wo­ord", "woord", True), ("a \nb\n", "a\nb", True),
        ("café", "cafe", False), ("Dag", "dag", False), ("a  b", "a b", False), ("x1", "xl", False), ("a-b", "a–b", False), ("m²", "m2", False),
    ],
)
def test_plain_form(a, b, same):
    assert (p4.plain(a) == p4.plain(b)) is same


def test_readings_follow_the_dominant_script():
    assert p4.reading("vеrslag", True) == "verslag"  # one Cyrillic letter in a Latin word
    assert p4.reading("ор", True) == "op"  # only twins, in a Latin text
    assert p4.reading("ор", False) is None
    assert p4.reading("мир", True) is None  # a real Cyrillic word
    assert p4.reading("миp", True) == "мир"
    assert p4.reading("ёlève", True) == "ëlève"


def test_pairs(spark):
    page = lambda *t: [(x, 1.0, 1.0) for x in t]
    rows = [
        ("a", "een verslag", None, "x"), ("b", "een vеrslag", None, "x"), ("b", "een vеrslag", None, "x"), ("c", "een verslag", None, "x"),
        ("d", None, page("een verslag", "", None, "Een verslag"), "x"), ("e", "", page(" "), "x"), ("f", " ", None, None), (None, "een  verslag", None, None),
        ("g", "onbеkendq мир", None, "x"), ("h", "onbekеndq мир", None, "x"),
        ("i", "nietgezien" * 3000 + "е", None, "x"),
    ]
    df = units(spark.createDataFrame(rows, SCHEMA))
    got = {tuple(r) for r in p4.alike_pairs(df).collect()}
    assert got == {("a", 0, "b", 0), ("b", 0, "c", 0), ("a", 0, "d", 1), ("b", 0, "d", 1), ("c", 0, "d", 1), ("g", 0, "h", 0)}
    texts = {(r.document_id, r.page_no): r.text for r in p4.canonical_units(df).collect()}
    assert texts["b", 0] == "een verslag" and texts["f", 0] == "" and texts["i", 0].endswith("е")
    assert p4.alike_pairs(df.limit(0)).count() == 0


def test_mixture_reaches_shares_within_repeats(spark):
    rows = [(i, f"tekst {i} " + "mg dosis " * (i % 7 + 1), ["nl", "fr", None, "xx"][i % 4], ["a", "b", "c", "d", None][i % 5 if i % 3 else 0], 1) for i in range(600)]
    rows += [(600 + i, f"zelden {i}", "nl", "s", 1) for i in range(5)] + [(700, "tekst 1 mg dosis mg dosis ", "nl", "s", 1), (701, None, "nl", "a", 1), (702, " ", "nl", "a", 1), (0, rows[0][1], "nl", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 2), ("s", 0.05, 4), ("leeg", 0.0, 3)], "source_name string, target_share double, max_repeats int")
    out = p8.mixture(docs, goal).collect()
    assert len({r.doc_id for r in out}) == len(out)
    most = {"a": 1, "b": 2, "c": 2, "s": 4}
    assert all(1 <= r.repeats <= most[r.source] for r in out)
    used = {s: sum(r.tokens * r.repeats for r in out if r.source == s) for s in most}
    whole = sum(used.values())
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15), ("s", 0.05)):
        assert abs(used[s] / whole - share) < 0.02
    # the source that limits the mixture is used in full
    assert all(r.repeats == 4 for r in out if r.source == "s")
    assert p8.mixture(docs.limit(0), goal).count() == 0 and p8.mixture(docs, goal.limit(0)).count() == 0


def test_topics_are_fitted_on_all_texts(spark):
    # more texts than a bounded sample would take, and six kinds of words of which the last is rare
    kinds = ["koorts hoesten", "breuk gips", "hartslag bloeddruk", "huid uitslag", "oog bril", "tand kaak"]
    texts = [f"{kinds[i % 5] if i % 1000 else kinds[5]} patient{i}" for i in range(6000)]
    docs = spark.createDataFrame([(f"{i:06d}", p8.bags([t], {})[0].tobytes()) for i, t in enumerate(texts)], "k string, bag binary").repartition(4)
    centres, weights = p8.fit_topics(docs)
    assert centres.shape == (p8.TOPICS, p8.WORDS)
    seen = sum((p8.bags([t], {})[0] > 0).astype(int) for t in texts)
    assert weights == pytest.approx(1 + __import__("numpy").log(6001 / (1 + seen)), rel=1e-5)
    again, _ = p8.fit_topics(docs.repartition(7))
    assert centres == pytest.approx(again, abs=1e-5)


def test_rake_keeps_marginals():
    cells = [(s, lang, t, n) for s, lang, t, n in [("a", "nl", "x", 100), ("a", "fr", "x", 300), ("b", "nl", "y", 500), ("b", "fr", "x", 100), ("b", "nl", "x", 50)]]
    r = p8.rake(cells, {"a": (0.5, 1), "b": (0.5, 2)})
    n = {s: sum(r[c[:3]] * c[3] for c in cells if c[0] == s) for s in "ab"}
    assert n["a"] == pytest.approx(400) and n["b"] == pytest.approx(400) and max(r.values()) <= 2 + 1e-9
