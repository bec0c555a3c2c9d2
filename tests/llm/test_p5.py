import random

import pytest

from palimpsest.llm import p5_names as p5
from palimpsest.llm.graph import components
from palimpsest.llm.segments import near_pairs


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_segment_join_equals_brute_force(spark):
    r = random.Random(5)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(150)}
    got = {(x.a, x.b) for x in near_pairs(spark.createDataFrame([(1, w) for w in words] + [(2, "abcabc"), (None, "abcab"), (3, "")], "g int, s string"), ["g"], limits=[(1, 1), (3, 2), (7, 3)]).collect()}
    want = {(a, b) for a in words for b in words if (len(a), a) < (len(b), b) and lev(a, b) <= (1 if len(a) < 3 else 2 if len(a) < 7 else 3)}
    assert got == want


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


@pytest.mark.parametrize(
    "name,want",
    [
        ("Stig Hellemans", ("helemans", "stig")), ("Hellemans, Stig", ("helemans", "stig")), ("DE SMET ,Jo", ("desmet", "jo")), ("Jo v.d. Berg", ("vandenberg", "jo")),
        ("Jo Vn den Berg", ("vndenberg", "jo")), ("Van den Berg Jo", ("vandenberg", "jo")), ("- Dr. Jo Berg", ("berg", "jo")), ("Berg", ("berg", "")),
    ],
)
def test_readings(name, want):
    assert want in [r[:2] for r in p5.person_readings(name)]


def test_entities(spark):
    rows = [
        (1, "last_name", 1, "Quordinckx"), (2, "annotation", 1, "Tavowen Quordinckx"), (3, "annotation", 1, "QUORDINCKX, Tavowen"), (4, "annotation", 1, "Quordincks"), (5, "annotation", 1, "T. Quordinckx"),
        (6, "other_names", 1, "Zelien Quordinckx"), (7, "other_names", 1, "Z. Quordinckx"), (8, "other_names", 1, "AZ Sint-Volmazard"), (9, "annotation", 1, "Sint Volmazard az"), (10, "annotation", 1, "Algemeen Ziekenhuis St. Vomlazard"),
        (11, "other_names", 2, "Tavowen Quordinckx"), (12, "annotation", 2, "Tavowne Quordinckx"), (13, "annotation", 2, "Tavke Quordinckx"), (14, "annotation", 3, None), (15, "annotation", 3, "  "), (16, None, None, "Los"), (17, None, None, "Los"),
        (18, "annotation", 3, "Anders"), (19, "annotation", 3, "Anders"), (19, "annotation", 3, "Anders"), (20, "annotation", 3, "x" * 20000),
    ]
    names = spark.createDataFrame([(*r, "q") for r in rows], "name_id long, field string, settings_id long, name string, entity string")
    settings = spark.createDataFrame([(1, "Tavowen", None), (1, None, None), (2, None, None)], "settings_id long, first_name string, saved_at timestamp")
    nick = spark.createDataFrame([("Tavowen", "Tavke"), ("Zelien", "Zel")], "given_name string, nickname string")
    got = {(r.name_id_a, r.name_id_b) for r in p5.linked_pairs(p5.name_entities(names, settings, nick)).collect()}
    classes = [[1, 2, 3, 4, 5], [6, 7], [8, 9, 10], [11, 12, 13], [18, 19]]
    assert got == {(a, b) for c in classes for a in c for b in c if a < b}
    assert p5.name_entities(names.limit(0), settings.limit(0), nick.limit(0)).count() == 0


def test_a_misspelling_that_recurs_stays_one(spark):
    rows = [(i, "annotation", i, f"Tavowen Quordinckx{'abcdefghij'[i % 10]}") for i in range(1, 101)]
    rows += [(100 + i, "annotation", i, f"Tavowne Quordinckx{'abcdefghij'[i % 10]}") for i in range(1, 6)]
    # a name of its own: in as many dossiers as its neighbour, or far from every other
    rows += [(200 + i, "annotation", i, f"Zelien Quordinckx{'abcdefghij'[i % 10]}") for i in range(1, 6)]
    rows += [(300 + 2 * i + k, "annotation", 200 + i, f"{g} Quordinckx{'abcdefghij'[i % 10]}") for i in range(30) for k, g in enumerate(("Korvald", "Korvand"))]
    names = spark.createDataFrame(rows, "name_id long, field string, settings_id long, name string")
    settings = spark.createDataFrame([], "settings_id long, first_name string, saved_at timestamp")
    nick = spark.createDataFrame([], "given_name string, nickname string")
    got = {(r.name_id_a, r.name_id_b) for r in p5.linked_pairs(p5.name_entities(names, settings, nick)).collect()}
    assert got == {(i, 100 + i) for i in range(1, 6)}
