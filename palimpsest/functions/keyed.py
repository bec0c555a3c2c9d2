"""Keyed choices: the same secret and text give the same pseudonym everywhere, without any state.

The secret is never part of a plan: it is given as a column (of a broadcast one-row table, or a
parameter of the session), so it doesn't reach plans and event logs as a literal unless a caller makes it one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.names import institution_language, split_title
from palimpsest.functions.text import let, match_case, normalize_key, strip

#: Our own lists; replace them by larger ones through the parameters.
FIRST_NAMES = [
    "Aline", "Amber", "Axel", "Basile", "Bente", "Camille", "Cedric", "Corneel", "Dorien", "Edgard", "Elke", "Fien", "Florian", "Gaspard", "Gerda", "Hanne", "Hilde", "Ilse", "Jasper", "Jelle", "Joost",
    "Katrien", "Kobe", "Lander", "Leonie", "Lieve", "Lucien", "Maarten", "Manon", "Margot", "Mathis", "Nele", "Noemie", "Odette", "Olivier", "Pauline", "Quinten", "Rosalie", "Ruben", "Sander", "Simone", "Stijn",
    "Tessa", "Thibault", "Ulrike", "Valerie", "Victor", "Wannes", "Yolande", "Zita",
]
#: Surnames are made of a head and a tail.
HEADS = ["Aerd", "Berk", "Bos", "Dael", "Doorn", "Eik", "Elst", "Gracht", "Hage", "Heide", "Hoev", "Kamp", "Kerk", "Linde", "Meer", "Molen", "Ooster", "Roos", "Schild", "Velde", "Water", "Wester", "Wilg", "Zand"]
TAILS = ["aert", "beek", "berg", "born", "broek", "dijk", "gem", "hout", "kens", "man", "mans", "mont", "poel", "rode", "steen", "tael", "vort", "winckel"]
SURNAMES = [h + t for h in HEADS for t in TAILS]
#: Our own parts of institutions' pseudonyms.
KINDS = {"fr": ["Polyclinique", "Institut Médical", "Maison de Soins"], "nl": ["Zorgcampus", "Medisch Huis", "Polikliniek"]}
PLACES = {
    "fr": ["Bellevue", "Bois Clair", "Claire Fontaine", "Grand Pré", "Haute Rive", "La Colline", "La Garenne", "Le Vallon", "Mon Repos", "Val Fleuri"],
    "nl": ["De Bron", "De Duinpan", "De Hoeve", "De Meander", "De Zonnewijzer", "Groenendal", "Heidepark", "Hoge Rielen", "Ter Beuken", "Veldzicht"],
}
NO_OTHER = {"fr": "Polyclinique Sans Nom", "nl": "Zorgcampus Zonder Naam"}
SEPARATOR = "\u001f"


def key_pads(secret_hex: Column) -> Column:
    """struct<inner, outer>: the padded keys of HMAC-SHA256 for a key of at most 64 bytes in hexadecimal; made once, used for every message."""
    key = F.rpad(F.lower(secret_hex), 128, "0")
    pad = lambda byte: F.unhex(F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.lpad(F.hex(F.conv(F.substring(key, i * 8 + 1, F.lit(8)), 16, 10).cast("long").bitwiseXOR(F.lit(int(byte * 4, 16)))), 8, "0")), ""
    ))
    return F.struct(pad("36").alias("inner"), pad("5c").alias("outer"))


def _mac(pads: Column, message: Column) -> Column:
    return F.sha2(F.concat(pads["outer"], F.unhex(F.sha2(F.concat(pads["inner"], F.encode(message, "utf-8")), 256))), 256)


def hmac_sha256(secret_hex: Column, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal of a text under a key of at most 64 bytes in hexadecimal."""
    return let(key_pads(secret_hex), lambda pads: _mac(pads, message))


def _number(h: Column, n: int, part: int = 0) -> Column:
    """A number from 0 to n - 1 from 13 digits of a hash, of its first to fourth part."""
    return F.conv(F.substring(h, 13 * part + 1, 13), 16, 10).cast("long") % n


def choice(secret_hex: Column, n: int, *parts: Column) -> Column:
    """A keyed number from 0 to n - 1 for the parts."""
    return _number(hmac_sha256(secret_hex, F.concat_ws(SEPARATOR, *parts)), n)


def _pick(values: list[str], h: Column, part: int = 0) -> Column:
    # one folded literal: an array of literals would be walked by every pass of the analyser
    return F.element_at(F.split(F.lit("|".join(values)), r"\|"), _number(h, len(values), part).cast("int") + 1)


def _first_unlike(draw, pads: Column, kind: str, key: Column, attempts: int, bad) -> Column:
    """draw(hash) of the first attempt whose result isn't bad; later ones are made only when the first is. Null if all are."""
    made = lambda a: draw(_mac(pads, F.concat_ws(SEPARATOR, F.lit(kind), key, a)))
    others = F.filter(F.transform(F.split(F.lit("|".join(map(str, range(1, attempts)))), r"\|"), made), lambda x: ~bad(x))
    first = made(F.lit("0"))
    return F.when(~bad(first), first).otherwise(F.get(others, F.lit(0)))


def automatic_shift(secret_hex: Column, subject: Column) -> Column:
    """Days of the keyed shift: 6 to 104 whole weeks, forward or back."""

    def days(h):
        return ((_number(h, 99) + 6) * 7 * F.when(_number(h, 2, 1) == 1, 1).otherwise(-1)).cast("int")

    return let(hmac_sha256(secret_hex, F.concat_ws(SEPARATOR, F.lit("date-shift"), subject)), days)


def person_of(pads: Column, key: Column, first: list[str] = FIRST_NAMES, last: list[str] = SURNAMES, attempts: int = 7) -> Column:
    """A name with as many words as a normalised key; another one is drawn while it equals the key."""
    words = F.greatest(F.size(F.split(key, " ")), F.lit(1))

    def draw(h):
        # one word is a given name, more are given names and a surname
        names = F.transform(F.sequence(F.lit(1), F.greatest(words - 1, F.lit(1))), lambda i: _pick(first, F.sha2(F.concat_ws(SEPARATOR, h, i.cast("string")), 256)))
        return F.concat_ws(" ", names, F.when(words > 1, _pick(last, h)))

    return _first_unlike(draw, pads, "person", key, attempts, lambda x: F.lower(x) == key)


def person_pseudonym(secret_hex: Column, text: Column, first: list[str] = FIRST_NAMES, last: list[str] = SURNAMES, attempts: int = 7) -> Column:
    """A name with as many words, title kept, case style kept; another one is drawn while it equals the source."""
    t = split_title(text)
    body = strip(t.body)
    return F.concat(t.title, match_case(let(key_pads(secret_hex), lambda pads: let(normalize_key(body), lambda key: person_of(pads, key, first, last, attempts))), body))


def institution_of(pads: Column, key: Column, text: Column, real: list[str] = (), last: list[str] = SURNAMES, attempts: int = 24) -> Column:
    """An institution's name in the language of the text, unlike its normalised key and the real names given."""
    real_keys = [r.casefold() for r in real]
    by_language = lambda values, h, part: F.when(french, _pick(values["fr"], h, part)).otherwise(_pick(values["nl"], h, part))
    french = institution_language(text) == "fr"

    def draw(h):
        return F.concat_ws(" ", by_language(KINDS, h, 0), F.when(_number(h, 3, 1) == 0, _pick(last, h, 2)).otherwise(by_language(PLACES, h, 3)))

    bad = lambda x: (F.lower(x) == key) | F.lower(x).isin(real_keys) if real_keys else F.lower(x) == key
    return F.coalesce(_first_unlike(draw, pads, "institution", key, attempts, bad), F.when(french, NO_OTHER["fr"]).otherwise(NO_OTHER["nl"]))


def institution_pseudonym(secret_hex: Column, text: Column, real: list[str] = (), last: list[str] = SURNAMES, attempts: int = 24) -> Column:
    """An institution's name in the language of the source, unlike the source and the real names given; case style kept."""
    name = let(key_pads(secret_hex), lambda pads: let(normalize_key(text), lambda key: institution_of(pads, key, text, real, last, attempts)))
    return match_case(name, text)


def hashed_stem(raw_text: Column, display_name: Column, value: Column) -> Column:
    """A file stem from the first of text, name and value that isn't empty: ten digits of its hash and "_deid"."""
    source = F.coalesce(F.when(raw_text != "", raw_text), F.when(display_name != "", display_name), value)
    return F.concat(F.substring(F.sha2(source, 256), 1, 10), F.lit("_deid"))
