"""Spans of a text as arrays of structs, and what is done with them inside a row.

A span is struct<text, tag, start, end> with half-open code point offsets. All functions here are columns over
one row's arrays, so nothing is shuffled and a document's spans never leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import let, within_one_edit

SPAN = "struct<text:string,tag:string,start:int,end:int>"
#: Canonical tags and the placeholders' names; other tags are upper-cased.
PLACEHOLDER_NAMES = {
    "date": "DATE", "datum": "DATE", "person": "PERSON", "persoon": "PERSON", "location": "LOCATION", "locatie": "LOCATION", "hospital": "HOSPITAL", "ziekenhuis": "HOSPITAL",
    "institution": "INSTITUTION", "healthcare_institution": "INSTITUTION", "zorginstelling": "INSTITUTION", "age": "AGE", "leeftijd": "AGE",
}


def canonical_tag(tag: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(tag)), "[- ]", "_")


def placeholder_name(tag: Column) -> Column:
    key = canonical_tag(tag)
    table = F.create_map(*[F.lit(x) for kv in PLACEHOLDER_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.upper(key))


def regex_spans(text: Column, pattern: str, tag: str, group: int = 0) -> Column:
    """Spans of all matches of a Java pattern, or of its whole match when the group is 0.

    Offsets come from the text between matches: split keeps what extract_all leaves out. With a group, its text
    must occur in the match once; its offset is found inside the match.
    """
    rx = F.lit(pattern)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc, x):
        start = acc.at + F.length(x.gap)
        off = F.lit(0) if not group else F.instr(x.whole, x.part) - 1
        begin = start + off
        span = F.struct(x.part.alias("text"), F.lit(tag).alias("tag"), begin.cast("int").alias("start"), (begin + F.length(x.part)).cast("int").alias("end"))
        return F.struct((start + F.length(x.whole)).alias("at"), F.array_append(acc.out, span).alias("out"))

    whole = F.regexp_extract_all(text, rx, F.lit(0))
    inner = whole if not group else F.regexp_extract_all(text, rx, F.lit(group))
    gaps = F.split(text, pattern, -1)

    def placed(found):
        """found: struct<whole, part>. The text is cut once, and only where something was found."""
        zipped = F.filter(F.zip_with(found, gaps, lambda m, gap: F.struct(gap.alias("gap"), m.whole.alias("whole"), m.part.alias("part"))), lambda x: x.whole.isNotNull())
        return F.when(F.size(found) > 0, F.aggregate(zipped, zero, step, lambda a: F.filter(a.out, lambda s: F.length(s.text) > 0))).otherwise(F.array().cast(f"array<{SPAN}>"))

    pairs = F.transform(whole, lambda w: F.struct(w.alias("whole"), w.alias("part"))) if not group else F.zip_with(whole, inner, lambda w, p: F.struct(w.alias("whole"), p.alias("part")))
    return F.when(text.isNotNull(), let(pairs, placed))


def sort_spans(spans: Column) -> Column:
    """By start, end and tag."""
    keyed = F.transform(spans, lambda s: F.struct(s.start, s.end, s.tag, s.text))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s.text, s.tag, s.start, s.end))


def without_overlaps(ranked: Column) -> Column:
    """Spans that don't overlap, sorted by place; of those that do, the one of the first recogniser stays, then the longest, then the first.

    ranked: array of arrays of spans, in the order of their recognisers' priority.
    """
    flat = F.flatten(F.transform(ranked, lambda a, i: F.transform(a, lambda s: F.struct(i.alias("rank"), (s.start - s.end).alias("minus"), s.start, s.end, s.tag, s.text))))
    empty = F.array().cast("array<struct<rank:int,minus:int,start:int,end:int,tag:string,text:string>>")
    kept = F.aggregate(F.array_sort(flat), empty, lambda acc, s: F.when(F.exists(acc, lambda o: (s.start < o.end) & (o.start < s.end)), acc).otherwise(F.array_append(acc, s)))
    return sort_spans(F.transform(kept, lambda s: F.struct(s.text, s.tag, s.start, s.end)))


#: Tags whose neighbouring spans are one item when only this stands between them.
MERGED, SLACK = [["person", "persoon"], ["location", "locatie"]], r"\A[.\s,-]?[.\s]?\z"


def merge_adjacent(text: Column, spans: Column) -> Column:
    """Sorted spans without overlaps, neighbours of one tag (persons, locations) with a sign or a blank between as one span."""
    empty = F.array().cast(f"array<{SPAN}>")

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        gap = F.substring(text, last.end + 1, s.start - last.end)
        whole = F.struct(F.substring(text, last.start + 1, s.end - last.start).alias("text"), last.tag.alias("tag"), last.start.alias("start"), s.end.alias("end"))
        a, b = F.lower(last.tag), F.lower(s.tag)
        same = ((a.isin(MERGED[0]) & b.isin(MERGED[0])) | (a.isin(MERGED[1]) & b.isin(MERGED[1]))) & gap.rlike(SLACK)
        return F.when(same, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), whole)).otherwise(F.array_append(acc, F.struct(s.text.alias("text"), s.tag.alias("tag"), s.start.alias("start"), s.end.alias("end"))))

    return F.aggregate(spans, empty, step)


def drop_articles(text: Column, spans: Column) -> Column:
    """Without person spans that are an article before "patient"."""
    articles = ["de", "den", "der", "la", "le", "les"]

    def spurious(s):
        after = F.lower(F.ltrim(F.substring(text, s.end + 1, F.lit(24))))
        return canonical_tag(s.tag).isin("person", "persoon") & F.lower(s.text).isin(articles) & after.startswith("patient")

    return F.filter(spans, lambda s: ~spurious(s))


def numbered(spans: Column) -> Column:
    """Spans with their replacement: array of struct<text, tag, start, end, replacement>, in the order of the text.

    Within a canonical tag, spans in order of (end, start, text) take the number of the first earlier span within one
    edit, else the next number. A patient isn't numbered. This is a fold over the first match, no clustering: a
    text near two earlier spans with different numbers takes the first one's.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s.end, s.start, s.text, s.tag)))
    empty = F.array().cast("array<struct<name:string,text:string,n:int>>")

    def step(acc, s):
        name = placeholder_name(s.tag)
        mine = F.filter(acc.seen, lambda o: o["name"] == name)
        near = F.filter(mine, lambda o: within_one_edit(o["text"], s.text))
        same = F.when(F.get(mine, F.lit(0))["text"] == s.text, F.slice(mine, 1, 1)).otherwise(near)
        n = F.coalesce(F.get(same, F.lit(0)).n, F.coalesce(F.array_max(F.transform(mine, lambda o: o.n)), F.lit(0)) + 1)
        patient = canonical_tag(s.tag) == "patient"
        shown = F.when(patient, "[PATIENT]").otherwise(F.concat(F.lit("["), name, F.lit("-"), n.cast("string"), F.lit("]")))
        one = F.struct(s.start.alias("start"), s.end.alias("end"), s.text.alias("text"), s.tag.alias("tag"), shown.alias("replacement"))
        # a text that was seen adds nothing: the fold looks at distinct texts only
        known = patient | F.exists(mine, lambda o: o["text"] == s.text)
        seen = F.when(known, acc.seen).otherwise(F.array_append(acc.seen, F.struct(name.alias("name"), s.text.alias("text"), n.cast("int").alias("n"))))
        return F.struct(seen.alias("seen"), F.array_append(acc.out, one).alias("out"))

    start = F.struct(empty.alias("seen"), F.array().cast("array<struct<start:int,end:int,text:string,tag:string,replacement:string>>").alias("out"))
    done = F.aggregate(order, start, step, lambda a: F.array_sort(a.out))
    return F.transform(done, lambda s: F.struct(s.text, s.tag, s.start, s.end, s.replacement))


def render(text: Column, replaced: Column) -> Column:
    """The text with each span's replacement in its place; spans must be in order and apart."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        piece = F.substring(text, acc["at"] + 1, s.start - acc["at"])
        return F.struct(F.concat(acc.out, piece, s.replacement).alias("out"), s.end.alias("at"))

    return F.aggregate(replaced, zero, step, lambda a: F.concat(a.out, F.substring(text, a["at"] + 1, F.length(text))))


REFERENCES = "array<struct<replacement:string,originals:array<string>>>"


def merge_references(references: Column) -> Column:
    """Entries with one replacement as one entry with its originals in order without repeats; entries in order of first sight."""
    empty = F.array().cast(REFERENCES)

    def step(acc, x):
        known = F.exists(acc, lambda o: o.replacement == x.replacement)
        joined = F.transform(acc, lambda o: F.when(o.replacement == x.replacement, F.struct(o.replacement, F.array_distinct(F.concat(o.originals, x.originals)).alias("originals"))).otherwise(o))
        return F.when(known, joined).otherwise(F.array_append(acc, F.struct(x.replacement, F.array_distinct(x.originals).alias("originals"))))

    return F.aggregate(references, empty, step)


def references_of(replaced: Column) -> Column:
    """What each replacement stands for, in the order of the text."""
    return merge_references(F.transform(replaced, lambda s: F.struct(s.replacement.alias("replacement"), F.array(s.text).alias("originals"))))


def highlights(text: Column, references: Column) -> Column:
    """All places of all replacements in a text: struct<start, minus_length, text>, by start and the longest first."""

    def places(r):
        parts = F.split(text, F.concat(F.lit("\\Q"), r.replacement, F.lit("\\E")), -1)
        n = F.length(r.replacement)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,minus_length:int,text:string>>").alias("out"))

        def step(acc, p):
            at = acc["at"] + F.length(p)
            return F.struct((at + n).alias("at"), F.array_append(acc.out, F.struct(at.cast("int").alias("start"), (-n).cast("int").alias("minus_length"), r.replacement.alias("text"))).alias("out"))

        return F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), zero, step, lambda a: a.out)

    return F.array_sort(F.flatten(F.transform(references, places)))
