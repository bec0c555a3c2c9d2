"""Problem 4: one form for texts that look the same.

Every text gets the compositions of NFC, one-column forms for full-width and half-width ones, plain
blanks for the blanks of other widths, "-" for the hyphens that look like it, spelled-out Latin
ligatures and \\n as line end; characters without a glyph and blanks at line ends are removed. A soft hyphen is without
a glyph inside a line and a hyphen at its end. Accents, case, digits, signs and runs of blanks stay.

Look-alike letters are repaired by script. A token's dominant script is the one with the most letters
that belong to it alone, where letters with a twin in the text's script are open; a token is mixed when
its letters come from several scripts, or all from another script than that of its text (which looks
the same just as well). In mixed tokens the letters of other scripts are replaced by their twins of the
dominant one when the result exists in the vocabulary of the corpus: the tokens of one script
in any of its texts, and the readings at which two mixed spellings meet.
Tokens with a letter that has no twin stay as they are, so real Greek or Cyrillic words are kept.

Null texts stay null and blank ones come out empty; neither takes part in pairs.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.units import units
from palimpsest.plans.session import materialize, spread, table

#: Cyrillic and Greek letters and the Latin letters that look the same.
TWINS = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
}
#: The same letters with marks, composed.
TWINS |= {chr(c): t for c in range(0x370, 0x530) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0] in TWINS and len(t := unicodedata.normalize("NFC", TWINS[d[0]] + d[1:])) == 1}
HYPHENS = "‐‑‒﹣"


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for c in range(0x80, 0x10000):
        ch = chr(c)
        kind, _, points = unicodedata.decomposition(ch).partition(" ")
        cat = unicodedata.category(ch)
        if cat == "Zs":
            out[c] = " "
        elif cat == "Cf" and c != 0xAD or 0xFE00 <= c <= 0xFE0F:
            out[c] = None
        elif kind in ("<wide>", "<narrow>") or 0xFB00 <= c <= 0xFB06:
            out[c] = unicodedata.normalize("NFKC", ch)
    return out | {ord(h): "-" for h in HYPHENS}


PLAIN = _table()
_odd = re.compile(r"[^\x09\x0a\x20-\x7eÀ-ÖØ-öø-ÿ]")
_ends = re.compile(r"[ \t]+(?=\n|\Z)")
_token = re.compile(r"[^\W\d_]+")
_other = re.compile("[Ͱ-ϿЀ-ԯ]")
_mixed = re.compile("(?:(?![Ͱ-ϿЀ-ԯ])[^\\W\\d_])*[Ͱ-ϿЀ-ԯ][^\\W\\d_]*")
_turn = str.maketrans(TWINS)
_back = [str.maketrans({v: k for k, v in TWINS.items() if lo <= ord(k) <= hi}) for lo, hi in ((0x400, 0x52F), (0x370, 0x3FF))]


def plain(text: str) -> str:
    """The text's form before the repair of look-alike letters."""
    if _odd.search(text):
        text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n\n").replace("\x85", "\n")
        text = text.translate(PLAIN)
        if "\xad" in text:
            text = re.sub("\xad(?=[ \t]*\n)", "-", text).replace("\xad", "")
        text = unicodedata.normalize("NFC", text)
    return _ends.sub("", text).strip("\n") if text.strip() else ""


def script(ch: str) -> int:
    """1 Cyrillic, 2 Greek, 0 Latin and all others."""
    return 1 if "Ѐ" <= ch <= "ԯ" else 2 if "Ͱ" <= ch <= "Ͽ" else 0


def reading(token: str, latin: bool) -> str | None:
    """What a mixed token reads as in its dominant script, None if it isn't mixed or a letter has no twin.

    latin: the text around it is mostly Latin, so a token of twins only is foreign in it.
    """
    own = [0, 0, 0]  # letters that only their script has
    every = {script(c) for c in token}
    for c in token:
        if (s := script(c)) == 0:
            own[0] += c not in _twin_of
        elif c not in TWINS:
            own[s] += 1
    if own == [0, 0, 0]:
        lead = 0 if latin or 0 in every else max(every)
    else:
        lead = max(range(3), key=lambda s: own[s])
    if every == {lead}:
        return None
    out = token.translate(_turn) if lead == 0 else token.translate(_back[lead - 1])
    return out if {script(c) for c in out} == {lead} else None


_twin_of = set(TWINS.values())


def mixed_tokens(text: str) -> dict[str, str]:
    """Readings of the mixed tokens of a plain text."""
    if not _other.search(text):
        return {}
    latin = len(_other.findall(text)) * 2 < sum(map(len, _token.findall(text)))
    found = {t: reading(t, latin) for t in set(_mixed.findall(text))}
    return {t: r for t, r in found.items() if r}


def repaired(text: str, known: set[str]) -> str:
    """text with the mixed tokens in `known` read in their dominant script."""
    turned = {t: r for t, r in mixed_tokens(text).items() if t in known}
    return _mixed.sub(lambda m: turned.get(m[0], m[0]), text) if turned else text


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _plain_rows(keep_text: bool):
    """Units with the hash of their text, that of its plain form and its mixed tokens; the form itself where it has
    any, or always with keep_text."""

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            forms = [plain(t) for t in texts]
            mixed = [mixed_tokens(f) for f in forms]
            cols = [
                b.column(0), b.column(1),
                pa.array([digest(t) for t in texts], pa.binary()),
                pa.array([None if m else digest(f) if f else None for f, m in zip(forms, mixed)], pa.binary()),
                pa.array([f if keep_text or m else None for f, m in zip(forms, mixed)], pa.string()),
                pa.array([[{"token": t, "reading": r} for t, r in m.items()] for m in mixed], pa.list_(pa.struct([("token", pa.string()), ("reading", pa.string())]))),
            ]
            yield pa.record_batch(cols, ["document_id", "page_no", "exact", "form", "text", "mixed"])

    return run


_PLAIN_SCHEMA = "document_id string, page_no int, exact binary, form binary, text string, mixed array<struct<token:string,reading:string>>"


def _vocabulary(batches):
    """Distinct tokens of one script, once for each run of batches up to a bounded set."""
    seen: set[str] = set()
    for b in batches:
        fresh: set[str] = set()
        for t in b.column(0).to_pylist():
            fresh.update(_token.findall(plain(t)))
        fresh = {t for t in fresh - seen if len({script(c) for c in t}) == 1 or t.isascii()}
        seen = fresh if len(seen) > 200_000 else seen | fresh
        yield pa.record_batch([pa.array(sorted(fresh), pa.string())], ["reading"])


def _apply(batches):
    for b in batches:
        forms = [repaired(t, set(k or ())) for t, k in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([digest(f) if f else None for f in forms], pa.binary()), pa.array(forms, pa.string())], ["document_id", "page_no", "exact", "form", "text"])


def canonical_units(rows: DataFrame, keep_text: bool = True) -> DataFrame:
    """(document_id, page_no, exact, form, text) of units (document_id, page_no, text).

    exact and form are hashes of the text and of its one form; form is null for blank texts. Without keep_text
    only the hashes are right, and no text of a clean unit is moved. Only units with mixed tokens are shuffled.
    """
    rows = spread(rows.select("document_id", "page_no", "text"))
    first = rows.mapInArrow(_plain_rows(keep_text), _PLAIN_SCHEMA)
    dirty = materialize(first.filter("size(mixed) > 0").drop("form").dropDuplicates(["document_id", "page_no", "exact"]))
    asked = dirty.select("exact", F.explode("mixed").alias("m")).select("exact", "m.*")
    # a reading counts as a word when some text has it in one script, or two different spellings meet in it
    met = asked.groupBy("reading").agg((F.min("token") != F.max("token")).alias("met"))
    words = rows.select("text").mapInArrow(_vocabulary, "reading string").distinct().withColumn("known", F.lit(True))
    words = materialize(met.join(words, "reading", "left").filter("met or known").select("reading"))
    known = asked.join(words, "reading").groupBy("exact").agg(F.collect_set("token").alias("known"))
    fixed = dirty.join(known, "exact", "left").select("document_id", "page_no", "exact", "text", "known").mapInArrow(_apply, "document_id string, page_no int, exact binary, form binary, text string")
    return first.filter("size(mixed) = 0").drop("mixed").unionByName(fixed)


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit in its one form."""
    out = canonical_units(units(table(spark, sf_dir, "imported_documents")))
    return out.dropDuplicates(["document_id", "page_no", "exact"]).select("document_id", "page_no", "text")


def alike_classes(rows: DataFrame) -> DataFrame:
    """(document_id, page_no, class_id, n_units, n_writings) of every unit whose form other code points have too.

    class_id is the hash of the form; n_writings the number of different code point sequences. Linear in the class: no pairs.
    """
    forms = materialize(canonical_units(rows, keep_text=False).filter("form is not null").select("document_id", "page_no", "exact", "form").distinct())
    sizes = forms.groupBy("form", "exact").agg(F.count("*").alias("n")).groupBy("form").agg(F.sum("n").alias("n_units"), F.count("*").alias("n_writings"))
    return forms.join(sizes.filter("n_writings > 1"), "form").select("document_id", "page_no", F.lower(F.hex("form")).alias("class_id"), "n_units", "n_writings")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_classes(units(table(spark, sf_dir, "imported_documents")))


def alike_pairs(rows: DataFrame) -> DataFrame:
    """(document_id_a, page_no_a, document_id_b, page_no_b): units of one form but different code points, a < b."""
    forms = materialize(canonical_units(rows, keep_text=False).filter("form is not null").select("document_id", "page_no", "exact", "form").distinct())
    several = forms.groupBy("form").agg((F.min("exact") != F.max("exact")).alias("several")).filter("several").select("form")
    inside = materialize(forms.join(several, "form"))
    a, b = (inside.select("form", *(F.col(c).alias(f"{c}_{s}") for c in ("document_id", "page_no", "exact"))) for s in "ab")
    before = (F.col("document_id_a") < F.col("document_id_b")) | ((F.col("document_id_a") == F.col("document_id_b")) & (F.col("page_no_a") < F.col("page_no_b")))
    return a.join(b, "form").filter(before & (F.col("exact_a") != F.col("exact_b"))).select("document_id_a", "page_no_a", "document_id_b", "page_no_b").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_pairs(units(table(spark, sf_dir, "imported_documents")))


QUERIES = {"p4_found": p4_found, "p4_text": p4_text, "p4_classes": p4_classes}
