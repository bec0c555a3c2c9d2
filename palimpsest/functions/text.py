"""Text scalars as columns: white space, skeletons, page-text candidates, escapes, placeholders.

Null in, null out, unless stated. White space is Unicode white space, as listed in SPACES, so that the same
class can be written for any regular-expression engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space but the newline, as the content of a character class of code points.
SPACES = r"\t\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]"
PLACEHOLDER = r"\[[A-Z][A-Z0-9_+]*(?:-\d+)?\]"


def let(c: Column, use) -> Column:
    """use(c) with c computed once: a column used several times in an expression would be repeated in the plan."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[\n{SPACES}]+|[\n{SPACES}]+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, outer white space removed."""
    return F.trim(F.regexp_replace(c, rf"[\n{SPACES}]+", " "))


def normalize_key(c: Column) -> Column:
    return F.lower(collapse(c))


def normalize_whitespace(c: Column) -> Column:
    """One kind of line end and blank, lines trimmed, runs of blank lines as one, text trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    c = F.regexp_replace(c, rf"[{SPACES}]*\n[{SPACES}]*", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalize_page_text(c: Column) -> Column:
    """The form of extracted page text: form feeds end lines, other white space is one blank, two newlines at most in a row."""
    c = F.regexp_replace(c, r"\r\n?|\f", "\n")
    c = F.regexp_replace(c, rf"[{SPACES}]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def skeleton(c: Column) -> Column:
    return F.regexp_replace(c, rf"[\n{SPACES}]+", "")


def whitespace_quality(c: Column) -> Column:
    """5 for each blank between word characters, -4 for each newline there, -1 for each one-letter token."""
    count = lambda rx: F.regexp_count(c, F.lit(rx))
    return 5 * count(f"(?<={WORD}) (?={WORD})") - 4 * count(f"(?<={WORD})\n(?={WORD})") - count(rf"(?<!{WORD})\p{{L}}(?!{WORD})")


def best_candidate(candidates: Column) -> Column:
    """The best of an array of texts: the first that isn't empty, unless a later one has a longer skeleton, or the same skeleton and better
    white space; "" if all are null or empty. The fold keeps the order of the array, on which the result depends."""
    full = F.filter(candidates, lambda t: F.length(t) > 0)
    rated = F.transform(full, lambda t: F.struct(t.alias("t"), skeleton(t).alias("s"), whitespace_quality(t).alias("q")))

    def better(a, x):
        same = x.s == a.s
        wins = (F.length(x.s) > 0) & F.when(same, x.q > a.q).otherwise(F.length(x.s) > F.length(a.s))
        return F.when(wins, x).otherwise(a)

    best = F.aggregate(F.slice(rated, 2, F.greatest(F.size(rated), F.lit(1))), F.get(rated, F.lit(0)), better)
    return F.when(candidates.isNotNull(), F.coalesce(best.t, F.lit("")))


def affixes(c: Column) -> Column:
    """(lead, core, tail): outer white space apart from what is between."""
    part = lambda i: F.regexp_extract(c, rf"(?s)\A([\n{SPACES}]*)(.*?)([\n{SPACES}]*)\z", i)
    return F.struct(part(1).alias("lead"), part(2).alias("core"), part(3).alias("tail"))


def html_escape(c: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def is_placeholder(c: Column) -> Column:
    return c.rlike(rf"\A{PLACEHOLDER}\z")


def next_index(text: Column, tag: str) -> Column:
    """One more than the greatest number of the tag's placeholders in the text."""
    found = F.regexp_extract_all(text, F.lit(rf"\[{tag}-(\d{{1,9}})\]"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.cast("int"))), F.lit(0)) + 1


def within_one_edit(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance of one at most."""
    n = F.length(a)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b,
    )
    return (F.levenshtein(a, b, 1) >= 0) | ((n == F.length(b)) & (n > 1) & swapped)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / greater length; 1 for two empty texts."""
    return F.when((F.length(a) == 0) & (F.length(b) == 0), F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def distinct_ignoring_case(values: Column) -> Column:
    """Values in order without later repeats that differ in case only; nulls are dropped."""
    kept = F.filter(values, lambda x: x.isNotNull())
    empty = F.array().cast("array<string>")
    return F.aggregate(kept, empty, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def list_lines(c: Column) -> Column:
    """Entries of a text with one per line: trimmed, one leading bullet removed, no blanks, distinct ignoring case."""
    lines = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    clean = F.transform(lines, lambda x: strip(F.regexp_replace(strip(x), r"^[-*•]", "")))
    return distinct_ignoring_case(F.filter(clean, lambda x: x != ""))


def title_case(c: Column) -> Column:
    """First letter of every run of letters upper, the others lower."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?U)[\p{L}]+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def styled(r: Column, o: Column) -> Column:
    """r in the case style of o, which is trimmed: upper, lower or title case; else as it is."""
    cased = o.rlike(r"[\p{Lu}\p{Ll}]")
    return F.when(~cased, r).when(F.upper(o) == o, F.upper(r)).when(F.lower(o) == o, F.lower(r)).when(title_case(o) == o, title_case(r)).otherwise(r)


def match_case(replacement: Column, original: Column) -> Column:
    """replacement in the case style of original."""
    return let(replacement, lambda r: let(strip(original), lambda o: styled(r, o)))
