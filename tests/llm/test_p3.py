import random

import pytest

from palimpsest.llm import p3_addresses as p3

LOC = [("7687", "Sint-Stopvoorde", "Saint-Stoperaux"), ("5114", "Sackkerke", "Sackcourt-le-Bas"), ("8013", "Deustdonkel", "Deustimont")]


@pytest.mark.parametrize(
    "text,want",
    [
        ("7687  Sint-Stopvoorde,  Noeckulaikaai 64", ("7687", "64", "", "noeckulaikaai")), ("Noeckulaikaai 64 bus 3, St. Stopvorode", ("7687", "64", "", "noeckulaikaai")),
        ("Glaemumellaan 43/21, Sackcourt-le-Bas (5114)", ("5114", "43", "", "glaemumellaan")), ("5114 Sackkerke - Glaemumellaan 43 A b21, BELGIUM", ("5114", "43", "a", "glaemumellaan")),
        ("64, Allée du Wuir à 8013 Deustimont", ("8013", "64", "", "allee du wuir")), ("52 R. de la Zuiviers; Deustdonkel", ("8013", "52", "", "r de la zuiviers")),
        ("DEUSTIMONT FIECKEKENSTW 82 B7", ("8013", "82", "", "fieckekenstw")), ("Liesaumopln n° 50c te B-8013", ("8013", "50", "c", "liesaumopln")), ("Ergens", (None, "", "", "ergens")),
    ],
)
def test_parse(text, want):
    assert p3.parse(text, p3.Localities(LOC)) == want


def test_places(spark):
    r = random.Random(4)
    name = lambda: "".join(r.choice(["bra", "kel", "mu", "stri", "vo", "zen", "dor"]) for _ in range(3))
    rows, want, n = [], [], 0
    for i in range(40):
        street, code = name().capitalize(), r.choice(LOC)
        full, short = [(f"{street}laan", f"{street}ln."), (f"{street}steenweg", f"{street}stwg"), (f"Boulevard {street}", f"Bld. {street}")][i % 3]
        forms = [f"{full} {i + 10}, {code[0]} {code[1]}", f"{code[2].upper()}, {short.upper()} {i + 10}", f"- {i + 10} {short}; {code[0]}", f"{full[:-1]}{full[-1] * 2} {i + 10} bus 4 te {code[0]}"]
        want.append(list(range(n, n + 4)))
        rows += [(n + j, 1, j, f, "x") for j, f in enumerate(forms)]
        n += 4
    rows += [(n, 1, 0, f"Glaemumelkaai 43, 5114 Sackkerke", "x"), (n + 1, 1, 0, "Glaemumellaan 43, 5114 Sackkerke", "x"), (n + 2, 1, 0, None, "x"), (n + 3, 1, 0, " ", "x"), (n + 4, 1, 0, "x" * 9000, "x"), (n, 1, 0, "Glaemumelkaai 43, 5114 Sackkerke", "x")]
    rows += [(n + 5, 2, 0, "Onbekend pad, Nergens", "x"), (n + 6, 2, 0, "ONBEKEND PAD - NERGENS", "x")]
    df = spark.createDataFrame(rows, "addr_id long, settings_id long, line_no int, address string, street string")
    loc = spark.createDataFrame(LOC, "postcode string, name_nl string, name_fr string")
    lines, rules = p3.address_places(df, loc)
    got = {}
    for x in lines.collect():
        got.setdefault(x.place_id, []).append(x.addr_id)
    assert sorted(sorted(v) for v in got.values()) == sorted(want + [[n], [n + 1], [n + 4], [n + 5, n + 6]])
    assert {r.a: r.b for r in rules.collect()}.get("bld") == "boulevard"
    assert p3.address_places(df.limit(0), loc)[0].count() == 0
