import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import p6_language as p6

SAY = {
    "nl": ["De patiënt klaagt al enkele weken over hoofdpijn en koorts", "Wij plannen een onderzoek van de buik en bekijken dan ook de knie", "De verpleging gaf een dosis en noteerde lichte achteruitgang"],
    "fr": ["Le patient signale depuis quelques semaines des douleurs et de la fièvre", "Nous prévoyons une exploration du ventre et reverrons alors le genou", "L'équipe a donné une dose et noté un léger recul"],
    "de": ["Der Patient klagt seit einigen Wochen über Schmerzen und hat auch Fieber", "Wir planen eine Untersuchung und prüfen dann auch das linke Knie", "Die Pflege gab eine Dosis und notierte einen leichten Rückgang"],
    "en": ["The patient has for some weeks reported headaches and a mild fever", "We plan an examination of the abdomen and will look at the knee again", "Nursing staff gave a dose and noted a slight decline"],
}


def _docs(n=80, seed=1):
    r = random.Random(seed)
    text = lambda lang, k=6: ". ".join(f"{r.choice(SAY[lang])} {r.randint(1, 99)}" for _ in range(k)) + "."
    rows = []
    for i in range(n):
        lang = r.choice(list(SAY))
        label = r.choice([lang, lang.upper(), f"{lang}-BE"]) if r.random() < 0.85 else r.choice(["fr", "nl", None, "??"])
        rows.append((f"d{i}", text(lang), "text_file", label, lang))
    rows.append(("two", text("nl") + "\n\n" + text("fr", 3) + "\n\n" + text("nl"), "paste", "nl", "nl"))
    rows.append(("tags", f"<html><style>p{{}}</style><p>{text('de')}</p></html>", "html", "Deutsch", "de"))
    rows += [("two", rows[-2][1], "paste", "nl", "nl"), ("none", None, "pdf", "nl", ""), ("blank", " \n", "pdf", None, ""), ("digits", "123 456", "pdf", None, ""), (None, "tekst", "pdf", "nl", ""), ("long", text("en", 4000), "paste", "eng", "en")]
    return rows


def test_held_out_accuracy_and_two_languages(spark):
    rows = _docs()
    df = spark.createDataFrame(rows, "id string, raw_text string, source_kind string, lang_label string, lang string")
    got = {}
    for r in p6.document_languages(df).collect():
        got.setdefault(r.document_id, {})[r.lang] = r.confidence
    want = {i: {lang} for i, _, _, _, lang in rows if i and lang} | {"two": {"nl", "fr"}}
    assert {i: set(x) for i, x in got.items()} == want
    assert all(0 < c <= 1 for x in got.values() for c in x.values())


@pytest.mark.parametrize("label,lang", [("nl", "nl"), ("NL", "nl"), ("nl-BE", "nl"), ("Nederlands", "nl"), ("fra", "fr"), ("Français", "fr"), ("de-BE", "de"), ("eng", "en"), ("und", None), ("??", None), ("", None), (None, None)])
def test_labels(spark, label, lang):
    df = spark.createDataFrame([(label,)], "x string")
    assert df.select(p6.label_language(F.col("x"))).first()[0] == lang


def test_ngrams_stay_in_their_part():
    for n, (h, at) in zip(p6.ORDERS, p6.grams([" ab ", " ab cd ", " ab "])):
        assert np.diff(at).tolist() == [4 - n + 1, 7 - n + 1, 4 - n + 1]
        assert np.array_equal(h[: at[1]], h[at[2] :]) and np.array_equal(h[: at[1]], p6.grams([" ab "])[n - 2][0])


def test_no_rows(spark):
    df = spark.createDataFrame([], "id string, raw_text string, source_kind string, lang_label string")
    assert p6.document_languages(df).count() == 0
