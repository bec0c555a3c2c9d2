"""Recognisers of personal data: each has a group, a tag and a pattern; groups that are off are left out of the plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.operators.spans import drop_articles, merge_adjacent, regex_spans, without_overlaps

#: Groups in the order of the flags.
GROUPS = ["names", "locations", "institutions", "dates", "ages", "identifiers", "phone_numbers", "email_addresses", "urls"]
#: French month tokens of dates.
FRENCH_MONTHS = "janvier|janv|fevrier|février|fevr|févr|mars|avril|mai|juin|juillet|aout|août|septembre|sept|octobre|oct|novembre|nov|decembre|décembre|dec"
_MONTHS = f"{FRENCH_MONTHS}|januari|jan|februari|feb|maart|mrt|april|apr|mei|juni|jun|juli|jul|augustus|aug|september|sep|oktober|okt|november|december|january|february|march|may|june|july|august|october"
_YEAR = r"(?:(?:19|20|['`])?\d{2})"
_DIGIT, _MONTH_GUARD = "[0-9]", rf"(?iu)(?:{_MONTHS})"
_NAME = r"[\p{Lu}][\p{L}'’-]+"
_PARTICLE = r"(?:[Vv]an(?:\s+de[nr]?)?|[Dd]en?|[Dd]er|[Dd]u|[Ll]e|[Ll]a|[Tt]er)"


@dataclass(frozen=True)
class Recogniser:
    name: str
    group: str
    tag: str
    pattern: str
    capture: int = 0
    #: A cheap test that must hold for the pattern to be tried: one sign, or a Java pattern of words. A guard, not a condition of the result.
    guard: str | None = None


EMAIL = Recogniser("email", "email_addresses", "email", r"(?iU)(?<!\w)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?!\w)", guard="@")
RECOGNISERS = [
    EMAIL,
    Recogniser("url", "urls", "url", r"(?iU)(?<!\w)(?:https?://|www\.)[^\s<>\"']+[^\s<>\"'.,;:)]", guard="."),
    Recogniser("date_dmy_text", "dates", "datum", rf"(?iu)(?<![\w-])\d{{1,2}}[-/. ]{{0,2}}(?:{_MONTHS})\.?[-/. ]{_YEAR}(?!\w)", guard=_MONTH_GUARD),
    Recogniser("date_ymd_text", "dates", "datum", rf"(?iu)(?<![\w-]){_YEAR}[-/. ]{{0,2}}(?:{_MONTHS})\.?[-/. ]\d{{1,2}}(?!\w)", guard=_MONTH_GUARD),
    Recogniser("date_numbers", "dates", "datum", r"(?<![\d./-])(?:\d{1,2}([./-])\d{1,2}\1(?:\d{4}|\d{2})|\d{4}([./-])\d{1,2}\2\d{1,2})(?![\d/-]|\.\d)", guard=_DIGIT),
    Recogniser("national_number", "identifiers", "national_register_number", r"(?<![\d/.-])\d{2}[./ ]?\d{2}[./ ]?\d{2}[ -]?\d{3}[ .-]?\d{2}(?![\d/.-])", guard=_DIGIT),
    Recogniser("phone", "phone_numbers", "phone_number", r"(?<![\w/+-])(?:(?:\+|00)\d{2}[ ./-]?(?:\(0\))?|\(0\d{1,3}\)|0\d{1,3})[ ./-]?\d{2,3}(?:[ ./-]?\d{2,4}){2,3}(?![\w/-])", guard=_DIGIT),
    Recogniser("age", "ages", "leeftijd", r"(?iU)(?<!\w)\d{1,3}(?:\s*-?\s*(?:jaar|jarige|years?|ans|Jahre)(?:\s+(?:oud|old|alt))?)(?!\w)", guard=_DIGIT),
    Recogniser("hospital", "institutions", "hospital", rf"(?U)(?<!\w)(?:AZ|UZ|CHU|CHR|Clinique|Hopital|Hôpital|Ziekenhuis|Kliniek)(?:\s+(?:de|du|des|la|Ter|{_NAME}))+(?:\s+-\s+Site\s+\p{{Lu}}+)?", guard=r"AZ|UZ|CH[UR]|[CH][lo]|Hô|Zi|Kl"),
    Recogniser("institution", "institutions", "zorginstelling", rf"(?U)(?<!\w)(?:Woonzorgcentrum|WZC|Praktijk|Huisartsenpraktijk|Cabinet|Centre Médical|Rusthuis)(?:\s+(?:de|du|des|la|Ter|{_NAME}))+", guard=r"Wo|WZC|Pr|Hu|Ca|Ce|Ru"),
    Recogniser("postcode_locality", "locations", "location", rf"(?U)(?<![\w/.-])(?:B-?\s?|BE-?\s?)?\d{{4}}\s+{_NAME}(?!\w)", guard=_DIGIT),
    Recogniser("street", "locations", "location", rf"(?U)(?<!\w)(?:(?:Rue|Avenue|Boulevard|Place|Chaussée|Allée)(?:\s+(?:de la|de|du|des))?\s+{_NAME}|\p{{Lu}}[\p{{L}}-]+(?:straat|laan|steenweg|plein|kaai|dreef))\s+\d{{1,3}}\p{{L}}?(?!\w)", guard=_DIGIT),
    Recogniser("titled_person", "names", "persoon", rf"(?U)(?<!\w)(?:(?:[Dd]r|[Pp]rof|Mevr|Dhr|Pr|Mr|Mrs)\.?|dokter|docteur|Mme|Frau|Herrn?)\s+((?:{_PARTICLE}\s+)?{_NAME}(?:\s+(?:{_PARTICLE}|{_NAME}))*(?:,?\s+\p{{Lu}}\.)?)", 1),
]


#: A run of capitalised words with particles and initials between, or such words with a comma.
NAME_RUN = rf"(?U)(?<![\w@.-])(?:{_PARTICLE}\s+)?{_NAME}(?:,?[ \n](?:{_PARTICLE}[ \n])*(?:{_NAME}|\p{{Lu}}\.?(?![\w])))*"


#: A word of a run.
RUN_WORD = r"(?U)[\p{L}'’-]+"


def run_words(text: Column) -> Column:
    """The distinct words of all runs of a text, in lower case: all that general_names looks up."""
    runs = F.array_join(F.regexp_extract_all(text, F.lit(NAME_RUN), F.lit(0)), "\n")
    return F.array_distinct(F.transform(F.regexp_extract_all(runs, F.lit(RUN_WORD), F.lit(0)), F.lower))


def general_names(text: Column, given: list[str] | Column) -> Column:
    """Spans of persons without a title: runs of capitalised words from the first word on that is a given name of the list.

    A run that ends with its only given name begins one word earlier, as family names may come first. given may be a column, the
    array of those given names in lower case that are among the row's run_words: a list of any size then needs no place in the plan.
    """
    known = given if isinstance(given, Column) else F.split(F.lit("|".join(sorted({g.lower() for g in given if g and "|" not in g}))), r"\|")

    def cut(s):
        words = F.regexp_extract_all(s.text, F.lit(RUN_WORD), F.lit(0))
        hits = F.transform(words, lambda w: F.array_contains(known, F.lower(w)))

        at = F.array_position(hits, True).cast("int")
        first = F.when((at == F.size(words)) & (at > 1), at - 1).otherwise(at)
        # the letters and gaps before the first word that counts
        lead = F.coalesce(F.length(F.regexp_substr(s.text, F.concat(F.lit(rf"(?U)\A(?:[^\p{{L}}'’-]*{RUN_WORD[4:]}){{"), (first - 1).cast("string"), F.lit(r"}[^\p{L}'’-]*")))), F.lit(0))
        cut_off = F.struct(F.substring(s.text, lead + 1, F.length(s.text)).alias("text"), s.tag.alias("tag"), (s.start + lead).cast("int").alias("start"), s.end.alias("end"))
        return F.when(at > 0, cut_off)

    return F.filter(F.transform(regex_spans(text, NAME_RUN, "persoon"), cut), lambda s: s.isNotNull())


def recognise(text: Column, flags: dict[str, bool] | None = None, extra: list[tuple[str, str]] = (), recognisers: list[Recogniser] = RECOGNISERS, given: list[str] | Column = ()) -> Column:
    """Spans of a text, sorted and apart from each other.

    flags: groups that are on, all by default; a group that is off costs nothing. extra: (tag, Java pattern) of
    configured literals, which come first and don't depend on the flags. given: given names by which persons without a title are
    known, or the column general_names takes. With e-mail addresses off, no span may overlap one, so that they stay as they are. Neighbouring spans of persons or of
    locations are one.
    """
    on = lambda g: True if flags is None else flags.get(g, True)

    def spans(r: Recogniser) -> Column:
        found = regex_spans(text, r.pattern, r.tag, r.capture)
        if r.guard is None:
            return found
        test = text.rlike(r.guard) if len(r.guard) > 1 else F.contains(text, F.lit(r.guard))
        return F.when(test, found).otherwise(F.array().cast(found_type))

    found_type = "array<struct<text:string,tag:string,start:int,end:int>>"
    ranked = [] if on("email_addresses") else [spans(EMAIL)]
    ranked += [regex_spans(text, p, tag) for tag, p in extra]
    ranked += [spans(r) for r in recognisers if on(r.group)]
    if on("names") and (isinstance(given, Column) or given):
        ranked.append(general_names(text, given))
    if not ranked:
        return F.when(text.isNotNull(), F.array().cast(found_type))
    kept = without_overlaps(F.array(*ranked))
    if not on("email_addresses"):
        kept = F.filter(kept, lambda s: s.tag != EMAIL.tag)
    return drop_articles(text, merge_adjacent(text, kept))
