"""Problem 2: personal information in free text, found by what terms and their surroundings disclose.

Terms. For every capitalised word the corpus gives two counts: how often it occurs, and how often inside an
annotated person. Their ratio is the share of its occurrences that disclose a person; it is a
term's disclosure when it is SHARE or more (several times the share of words at large, so its pointwise mutual
information with the event "a person is named" is large), and the term is plain when it is below PLAIN_SHARE. The
co-occurrence with the word before gives the same for contexts: the mean disclosure of the words that follow it.

Names. A run of capitalised words, initials and particles, without leading titles and plain words, is a name when
its context or one of its words discloses a person and it isn't an organisation. Words in lower case are looked up one
by one, and those with only particles between them are one name.

Numbers. A number with the form of an identity or phone number is judged by the co-occurrence of its form with the word
before it: the share of such numbers that are annotated. A label that discloses makes it an item whatever its
check digits, one that doesn't rules it out, and without a known label its date and check digits decide.

E-mail addresses and postal addresses (a house number next to a street and a locality, in either order) disclose by their
form alone and are found first; names inside them are not counted again. Zero-width, full-width and look-alike
characters are resolved before, and positions are those of the text as it is.

Scale. Words and contexts that hold more than 1 in BOUND of all are known to every task; a table of bits rules out most of the
others; what remains is looked up in the full table by a join, and the runs concerned are decided behind it by the
same function. So a text's items don't depend on how large the corpus is.

Null and blank texts hold nothing. Redelivered and repeated rows count once.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.p3_addresses import MOST_LOCALITIES, Localities, squeeze
from palimpsest.llm.p4_lookalike import PLAIN, TWINS
from palimpsest.llm.p5_names import PARTICLES, TITLES, fold, maybe_organisation, organisation
from palimpsest.llm.units import units
from palimpsest.plans.session import materialize, spread, table

#: A term or context discloses from this share on, and is plain below the other. A known one holds more than 1 in BOUND of all.
SHARE, PLAIN_SHARE, BOUND = 0.5, 0.1, 8000
#: A plain word, a context and a number's label have been seen more often than this.
SEEN = {"p": 9, "c": 9, "n": 3}
#: Bits of the table that tells tasks which keys can't be in the full table.
MARKS = 1 << 23
PERSON_TAGS = ["patient", "person", "persoon"]
#: Tags of annotated numbers.
NUMBER_TAGS = {"phone": ["phone_number", "phone", "telefoonnummer"], "id_number": ["national_register_number", "id", "id_number"]}
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

_entity = re.compile(r"&(?:#\d{1,6}|#x[0-9a-fA-F]{1,5}|[A-Za-z]{2,8}\d?);")
_odd = re.compile(r"[^\x00-\x7eÀ-ÖØ-öø-ÿœŒ°«»’“”–…€µ]")
_odd_or_entity = re.compile(f"{_entity.pattern}|{_odd.pattern}")


def resolved(text: str) -> tuple[str, list[int] | None]:
    """The text with odd characters resolved and, if any were, the original position of each character and of the end."""
    entities = "&" in text and _entity.search(text) is not None
    if not entities and not _odd.search(text):
        return text, None
    out: list[str] = []
    at: list[int] = []
    last = 0

    def add(i: int, c: str) -> None:
        """The character c for the one at i."""
        r = TWINS.get(c) or (PLAIN.get(ord(c), c) if ord(c) > 127 else c)
        if c == "\xad" or r is None:
            return
        if unicodedata.combining(c):
            if out and out[-1] and len(n := unicodedata.normalize("NFC", out[-1][-1] + c)) == 1:
                out[-1] = out[-1][:-1] + n
            return
        out.append(r)
        at.extend([i] * len(r))

    for m in (_odd_or_entity if entities else _odd).finditer(text):
        i = m.start()
        out.append(text[last:i])
        at.extend(range(last, i))
        c = m[0] if len(m[0]) == 1 else html.unescape(m[0])
        if len(c) == 1:
            add(i, c)
        else:
            out.append(m[0])
            at.extend(range(i, m.end()))
        last = m.end()
    out.append(text[last:])
    at.extend(range(last, len(text) + 1))
    return "".join(out), at


_email = re.compile(r"(?<![\w.+%-])[\w.%+-]+\s?(?:@|\(at\)|\[at\]|\(a\)|\{at\})\s?[\w-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[\w-]+)+", re.I)
_at_sign = re.compile(r"@|[(\[{]at?[)\]}]", re.I)
_phone = re.compile(r"(?<![\w+/.,-])(?:(?:\+|00)\d{2}[ .\-/]{0,2}(?:\(0\)[ ]?)?\d|\(0\d{1,3}\)\s?\d|0\d)(?:[ .\-/\n]?\d){6,11}(?![\w/]|[.,-]\d)")
_url = re.compile(r"https?://\S+")
_date = re.compile(r"\d{1,2}([./-])\d{1,2}\1(?:\d{4}|\d{2})(?!\d)|\d{4}-\d{2}-\d{2}")
_national = re.compile(r"(?<![\w+/.,-])(\d{2})([ ./-]?)(\d{2})([ ./-]?)(\d{2})[ ./\-]?(\d{3})[ ./\-]?(\d{2})(?![\w]|[/.,-]\d)")
_card = re.compile(r"(?<![\w+/.,-])(\d{3})([ -]?)(\d{7})([ -]?)(\d{2})(?![\w]|[/.,-]\d)")
_residence = re.compile(r"(?<![\w/-])B[ -]?\d{2,9}[ -]?\d{2,7}(?:[ -]?\d{2})?(?![\w]|[/-]\d)")
def _valid_national(m: re.Match) -> bool:
    digits = re.sub(r"\D", "", m[0])
    n, check = int(digits[:9]), int(digits[9:])
    return check in (97 - n % 97, 97 - (n + 2_000_000_000) % 97)


def _dated(m: re.Match) -> bool:
    month, day = int(m[3]) % 20, int(m[5])
    return month <= 12 and day <= 31


_label = re.compile(r"(?<![^\W\d_])[^\W\d_]{3,}")
_digits = re.compile(r"\d")


def label_of(text: str, start: int) -> str:
    """The last word of three letters or more before a number, folded, "" without one in its paragraph's last characters."""
    found = _label.findall(text, max(0, start - 30), start)
    return fold(found[-1]) if found else ""


#: Nine digits or more with what may stand between digits of one number.
_zone = re.compile(r"\d(?:[ ./()\n+-]{0,4}\d){8,}")


def number_candidates(text: str) -> list[list[tuple[int, int, str, bool]]]:
    """(start, end, kind, good) of what has the form of an identity or phone number, by form, the first form first; good: its
    date, check digits or separators are those of one."""
    forms: list[list[tuple[int, int, str, bool]]] = [[], [], [], []]
    for z in _zone.finditer(text):
        # a number's first sign may stand before its first digit, and what follows it is looked at
        a, b = max(0, z.start() - 4), z.end() + 3
        for m in _national.finditer(text, a, b):
            apart = bool(m[2] and m[4]) or not m[0].isdigit()
            good = _dated(m) and (_valid_national(m) or apart and len(re.sub(r"\d", "", m[0])) >= 2)
            forms[0].append((*m.span(), "id_number", good))
        for m in _card.finditer(text, a, b):
            good = int(m[1] + m[3]) % 97 in (int(m[5]), int(m[5]) % 97) or bool(m[2] and m[4])
            forms[1].append((*m.span(), "id_number", good))
        for m in _residence.finditer(text, a, b):
            if 9 <= len(_digits.findall(m[0])) <= 12:
                forms[2].append((*m.span(), "id_number", True))
        for m in _phone.finditer(text, a, b):
            if 9 <= len(_digits.findall(m[0])) <= 14 and "\n\n" not in m[0] and not _date.match(m[0]):
                forms[3].append((*m.span(), "phone", True))
    return forms


class Taken:
    """Ranges that are taken, for tests whether another one is free of them; ranges of one group come in order."""

    def __init__(self, ranges=()):
        self.ranges = sorted((x[0], x[1]) for x in ranges)
        self.starts = [a for a, _ in self.ranges]
        self.reach, far = [], -1
        for _, b in self.ranges:
            far = max(far, b)
            self.reach.append(far)

    def covers(self, at: int) -> bool:
        i = bisect_right(self.starts, at)
        return i > 0 and self.reach[i - 1] > at

    def free(self, s: int, e: int) -> bool:
        i = bisect_right(self.starts, s)
        return not (i and self.reach[i - 1] > s) and not (i < len(self.starts) and self.starts[i] < e)

    def within(self, s: int, e: int) -> list[tuple[int, int]]:
        """The ranges that meet [s, e)."""
        return [x for x in self.ranges[bisect_right(self.reach, s) : bisect_right(self.starts, e - 1)] if x[1] > s]

    def next(self, at: int) -> int | None:
        """The first start behind a position."""
        i = bisect_right(self.starts, at)
        return self.starts[i] if i < len(self.starts) else None


def numbers(text: str, labels: dict[str, float]) -> list[tuple[int, int, str]]:
    """Identity and phone numbers: labels has the share of numbers of a kind ("id_number:label") that disclose."""
    out: list[tuple[int, int, str]] = []
    for form in number_candidates(text):
        taken = Taken(out)
        for s, e, kind, good in form:
            share = labels.get(f"{kind}:{label_of(text, s)}")
            if (good if share is None else share >= SHARE or good and share >= PLAIN_SHARE) and taken.free(s, e):
                out.append((s, e, kind))
    return out


_house = re.compile(r"(?<![\w/.:+\-(])(?<!\d[.,:/])(?:(?i:n°|nr\.?|no\.?)\s*)?\d{1,3}(?:\s?[A-Da-d](?![\w'’]))?(?!\w|\.\d|,\d(?!\d{3}(?!\d))|[:/%-]\d{1,2}[:/-]|h\d|:\d| ?(?:mg|mm|kg|g|mmol|uur|h|dagen|weken|maanden|jours?|semaines?|mois|keer|fois|times|Mal|hours|heures)\b)")
_types = {
    "rue", "r", "avenue", "av", "ave", "boulevard", "boul", "bld", "bd", "bvd", "place", "pl", "chaussee", "chee", "ch", "allee", "all", "al", "square", "sq", "quai", "impasse", "route", "rte", "chemin", "clos", "cours",
}
_joins = {"de", "du", "des", "la", "le", "les", "l", "d"}
_suffix = re.compile(r"(?:straat|str|laan|ln|steenweg|steenwg|stwg|stw|plein|pln|pl|kaai|dreef|drf|dr|k|lei|weg|baan|berg|singel|dijk)$")
_box = r"(?:[\s,]*(?:bus|boîte|boite|bte|bt|box|b)\.?\s?\d{1,3}[a-z]?\b|\s?/\s?\d{1,3}\b)?"
_after = re.compile(_box + r"[\s,;:–\-]*(?:\b(?:te|à|a|in|À|A|TE)\s+)?[\s(]*(?:(?:BE|B|be|b)[\s-]*)?(\d{4})?(?!\d)[)\s,;–\-]*", re.I)
_before = re.compile(r"(?:^|[^\w])((?:(?:BE|B|be|b)[\s-]*)?(?:\d{4}\s*)?(?:(?:Sint|Saint|St|Ste|Sainte)[.\s-]+)?[^\W\d_][\w'’-]*(?:-[\w-]+)*(?:\s*\(\d{4}\))?|(?:(?:BE|B|be|b)[\s-]*)?\d{4})\s*[,;–\-\s]\s*$", re.I)
_token_end = re.compile(r"([^\W\d_][\w'’-]*)\.?$")
_token_on = re.compile(r"[\s,]*([^\W\d_][\w'’]*(?:-[\w'’]+)*)(\.?)")
_loc_on = re.compile(r"(?:(?:Sint|Saint|St|Ste|Sainte)[.\s-]+)?[^\W\d_]+(?:-[^\W\d_]+)*", re.I)


class Places:
    """Localities, for the recognition of addresses in text."""

    def __init__(self, rows):
        self.loc = Localities(rows)

    def named(self, s: str) -> bool:
        k = squeeze(s)
        if len(k) < 5:
            return False
        if k in self.loc.codes:
            return True
        return any(n for d in Localities._without(k) for n in self.loc.less.get(d, ())) if len(k) > 6 else False

    def coded(self, s: str | None) -> bool:
        return bool(s) and s in self.loc.by_code


def token_back(text: str, low: int, end: int) -> tuple[int, str, bool] | None:
    """(start, word, whether a comma follows) of the last word before a position, with only blanks, commas and a stop between."""
    rest = text[low:end].rstrip()
    comma = False
    while rest.endswith(","):
        rest, comma = rest[:-1].rstrip(), True
    last = rest.rsplit(None, 1)[-1] if rest else ""
    m = _token_end.search(last, last.rfind(",") + 1)
    return (low + len(rest) - len(last) + m.start(), m[1], comma) if m else None


def _street_before(text: str, end: int, plain: frozenset) -> int | None:
    """Start of the street whose last word ends before `end`, where the house number follows."""
    last = token_back(text, max(0, end - 60), end)
    if not last or len(last[1]) < 3:
        return None
    start, word = last[0], fold(last[1])
    if (french := _typed_before(text, start)) is not None:
        return french
    if word in _types or word in _joins or last[1].casefold() in plain:
        return None
    return start if last[1][0].isupper() or _suffix.search(word) else None


def _typed_before(text: str, at: int) -> int | None:
    """Start of a French type of street before a position, with only articles between."""
    for _ in range(4):
        b = token_back(text, max(0, at - 30), at)
        if not b or b[2]:
            return None
        w = fold(b[1]).strip("'’")
        if w in _types:
            return b[0]
        if w not in _joins:
            return None
        at = b[0]
    return None


def _street_after(text: str, at: int) -> tuple[int, int] | None:
    """(start, end) of a street that begins with a French type behind a house number, or is one Dutch word."""
    m = _token_on.match(text, at)
    if not m:
        return None
    w, end = fold(m[1]), m.end()
    if w not in _types:
        return None
    for _ in range(4):
        n = _token_on.match(text, end)
        if not n:
            return None
        end = n.end(1)
        if fold(n[1]).strip("'’") not in _joins:
            return m.start(1), end
    return None


def addresses(text: str, places: Places, plain: frozenset = frozenset()) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for m in _house.finditer(text):
        s, e = m.span()
        last = out[-1][1] if out else 0
        if s < last:
            continue
        ways = []
        if (start := _street_before(text, s, plain)) is not None:
            ways.append((start, e))
        if on := _street_after(text, e):
            ways.append((s, on[1]))
        for start, stop in ways:
            if start < last:
                continue
            a = _after.match(text, stop)
            end, good = stop, False
            if places.coded(a[1]):
                good, end = True, a.end(1)
            n = _loc_on.match(text, a.end())
            if n and places.named(n[0]):
                good, end = True, n.end()
                if tail := _tail_code.match(text, end):
                    end = tail.end()
            elif good and n and n[0][0].isupper() and text[a.end(1) : n.start()].isspace() and "\n" not in text[a.end(1) : n.start()]:
                end = n.end()
            b = _before.search(text, max(last, start - 50), start)
            if b:
                digits = re.findall(r"\d{4}", b[1])
                if any(places.coded(c) for c in digits) or not good and not digits and places.named(b[1]):
                    good, start = True, b.start(1)
            if good:
                out.append((start, end, "address"))
                break
    return out


_tail_code = re.compile(r"\s*\((\d{4})\)")
_cap = r"[A-ZÀ-ÖØ-ÞŒ]"
_piece = rf"(?:{_cap}[\w]*(?:['’][^\W\d_]+)?(?:-[^\W\d_]+)*(?:\.-{_cap})?\.?|(?:van|den|der|de|du|le|la|ter|ten|von|v\.\s?d\.|[dltv]\.|d['’])(?!\w))"
_run = re.compile(rf"(?<![\w@\[/]){_cap}[\w]*(?:['’][^\W\d_]+)?(?:-{_cap}?[^\W\d_]+|\.-{_cap}\.?)*\.?(?:(?:[ \t]+|\n|\r\n?|\s?,\s?(?={_cap}))(?:{_piece}))*")
_word = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_titles = TITLES | {"herrn", "mevr", "dhr", "dok", "arts", "zuster", "soeur", "frère"}
_letters = re.compile(r"[^\W\d_]+")
_low = re.compile(r"[a-zà-öø-ÿœ]{3,}(?:-[a-zà-öø-ÿœ]+)*")
_lower = re.compile(r"(?<![\w@.\-+])[a-zà-öø-ÿœ]{3,}(?:-[a-zà-öø-ÿœ]+)*(?![\w@]|-\w)")
_joined = re.compile(r"[\w.]\s$")
_initial = re.compile(rf"^{_cap}\.?(?:-{_cap}\.?)?$")


def context_of(text: str, start: int) -> str:
    """The word before a position, folded; the mark of an attribute or a tag; or the beginning."""
    before = text[max(0, start - 40) : start].split()
    if not before:
        return "^"
    w = before[-1]
    if '="' in w:
        return w[w.rfind(" ") + 1 :].split('"')[0].casefold() + '"'
    if w.endswith(">"):
        return ">"
    return fold(w[-24:])


@lru_cache(1 << 16)
def words_of(run: str) -> tuple[tuple[int, str, str, str], ...]:
    """(place, word, folded, without case) of the words of a run."""
    return tuple((m.start(), m[0], fold(m[0]), m[0].casefold()) for m in _word.finditer(run))


def _cooccurrence(batches):
    """Of each batch the counts of (context, term) of capitalised words, and (context label, term digits, kind, document) of numbers."""
    head = re.compile(rf"{_cap}[^\W\d_]*(?:-[^\W\d_]+)*")
    tagged = re.compile(rf">({_cap}[^\W\d_]*(?:-[^\W\d_]+)*)")
    attribute = re.compile(rf'(\w+)="({_cap}[^\W\d_]*(?:-[^\W\d_]+)*)')
    for b in batches:
        c: Counter = Counter()
        rows: list[tuple] = []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            t, _ = resolved(t)
            words = t.split()
            for left, w in zip(["", *words], words):
                if w[0].isupper() and (m := head.match(w)):
                    c[">" if left.endswith(">") else fold(left[-24:]), m[0].casefold()] += 1
            if "<" in t:
                for m in tagged.finditer(t):
                    c[">", m[1].casefold()] += 1
                for m in attribute.finditer(t):
                    c[m[1].casefold() + '="', m[2].casefold()] += 1
            seen = {(label_of(t, s), "".join(_digits.findall(t, s, e)), kind) for form in number_candidates(t) for s, e, kind, _ in form}
            rows += [(label, digits, 1, kind, d) for label, digits, kind in seen]
        rows += [(*k, n, None, None) for k, n in c.items()]
        cols = list(zip(*rows)) or [()] * 5
        types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([pa.array(x, ty) for x, ty in zip(cols, types)], ["context", "term", "n", "kind", "document_id"])


def _inside(batches):
    for b in batches:
        c: Counter = Counter()
        for t in b.column(0).to_pylist():
            for w in re.findall(rf"{_cap}[^\W\d_]*(?:-[^\W\d_]+)*", resolved(t)[0]):
                if len(w) > 1:
                    c[w.casefold()] += 1
        yield pa.record_batch([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["term", "n"])


class Known:
    """Tables of bounded size that every task has.

    Frequent terms that disclose (names), frequent plain words, frequent contexts, the shares of frequent labels of numbers,
    and bits that tell which keys ("t", "p" or "c" and the word) aren't in the full table.
    """

    def __init__(self, names, plain, contexts, labels=None, marks=None):
        self.names, self.plain, self.contexts = frozenset(names), frozenset(plain), frozenset(contexts)
        self.labels, self.marks = labels or {}, marks
        self.barred: set[str] = set()
        self.dead: dict[str, bool] = {}

    def is_plain(self, run: str) -> bool:
        if (out := self.dead.get(run)) is None:
            if len(self.dead) > 200_000:  # only saves asking again
                self.dead.clear()
            out = self.dead[run] = is_plain(words_of(run), self.plain)
        return out

    def may(self, key: str) -> bool:
        """False only for keys that aren't in the full table; the join decides the others."""
        return self.marks is None or bool(self.marks[(k := zlib.crc32(key.encode()) % MARKS) >> 3] >> (k & 7) & 1)

    def lower(self, words: set[str]) -> set[str]:
        """Those of the words in lower case that may be terms."""
        words = words - self.plain - self.barred
        out = {w for w in words if w in self.names or self.may("t" + w)}
        self.barred |= words - out
        if len(self.barred) > 200_000:  # only saves asking again
            self.barred = set()
        return out

    def with_keys(self, keys) -> Extended:
        """These tables and the keys that the full table has."""
        return Extended(self, keys)


class Either:
    """Two sets as one, without a copy."""

    def __init__(self, many, few):
        self.many, self.few = many, few

    def __contains__(self, x) -> bool:
        return x in self.few or x in self.many


class Extended:
    """Known tables with some keys of the full one."""

    def __init__(self, known: Known, keys):
        of = lambda k: {x[1:] for x in keys if x[0] == k}
        self.names, self.plain, self.contexts = Either(known.names, of("t")), Either(known.plain, of("p")), Either(known.contexts, of("c"))


def number_labels(pairs: DataFrame, annotations: DataFrame) -> dict[str, float]:
    """The share of numbers of a kind behind a label that are annotated, of labels that hold more than 1 in BOUND of all numbers."""
    kind = F.lower("tag")
    tags = F.when(kind.isin(NUMBER_TAGS["phone"]), "phone").when(kind.isin(NUMBER_TAGS["id_number"]), "id_number")
    marked = annotations.select("document_id", tags.alias("kind"), F.regexp_replace("text", r"\D", "").alias("term")).filter("kind is not null and term != ''").distinct()
    numbers = pairs.filter("kind is not null").select("document_id", "kind", "term", F.col("context").alias("label"))
    shares = numbers.join(marked.withColumn("hit", F.lit(1)), ["document_id", "kind", "term"], "left").groupBy("kind", "label").agg(F.count("*").alias("n"), (F.count("hit") / F.count("*")).alias("share"))
    least = (numbers.count() or 0) / BOUND
    return {f"{r.kind}:{r.label}": r.share for r in shares.filter((F.col("n") > max(least, SEEN["n"])) & (F.col("label") != "")).collect()}


def disclosure(docs: DataFrame, annotations: DataFrame) -> tuple[DataFrame, Known]:
    """The full table of keys ("t" + a term that discloses, "p" + a plain word, "c" + a context that discloses), and the bounded ones."""
    texts = spread(docs.select(F.col("id").alias("document_id"), F.col("raw_text").alias("text")).filter("text is not null"))
    counted = texts.mapInArrow(_cooccurrence, "context string, term string, n long, kind string, document_id string")
    pairs = materialize(counted.groupBy("context", "term", "kind", "document_id").agg(F.sum("n").alias("n")))
    labels = number_labels(pairs, annotations)
    pairs = pairs.filter("kind is null")
    marked = annotations.filter(F.lower("tag").isin(PERSON_TAGS) & F.col("text").isNotNull()).dropDuplicates(["annotation_id"]).select("text")
    inside = marked.mapInArrow(_inside, "term string, n long").groupBy("term").agg(F.sum("n").alias("inside"))
    terms = pairs.groupBy("term").agg(F.sum("n").alias("n")).join(inside, "term", "full").fillna(0)
    terms = materialize(terms.withColumn("share", F.least(F.lit(1.0), F.col("inside") / F.greatest("n", F.lit(1)))))
    totals = terms.agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).first()
    least, least_in = (totals.n or 0) / BOUND, (totals.inside or 0) / BOUND
    around = pairs.join(terms.select("term", "share"), "term").groupBy("context").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("share")) / F.sum("n")).alias("share"))
    shows = terms.filter((F.col("share") >= SHARE) & (F.col("inside") > 0)).select(F.concat(F.lit("t"), "term").alias("key"), (F.col("inside") > max(least_in, 2)).alias("often"))
    plain = terms.filter((F.col("share") < PLAIN_SHARE) & (F.col("n") > SEEN["p"])).select(F.concat(F.lit("p"), "term").alias("key"), (F.col("n") > least).alias("often"))
    leads = around.filter((F.col("share") >= SHARE) & (F.col("n") > SEEN["c"]) & ~F.col("context").isin("", ">", "^") & ~F.col("context").rlike(r"^\p{L}\.?$")).select(F.concat(F.lit("c"), "context").alias("key"), (F.col("n") > least).alias("often"))
    # initials are parts of names, not contexts
    keys = materialize(shows.unionByName(plain).unionByName(leads))
    # fewer than BOUND of each kind
    often = [r.key for r in keys.filter("often").select("key").collect()]
    of = lambda k: [x[1:] for x in often if x[0] == k]
    marks = bytearray(MARKS // 8)
    # one bit for each hash of a key, MARKS / 32 rows at most, whatever the corpus
    hashed = keys.select((F.crc32(F.encode("key", "utf-8")) % MARKS).alias("k"))
    for r in hashed.groupBy(F.expr("k div 32").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(k % 32))")).alias("bits")).collect():
        marks[r["at"] * 4 : r["at"] * 4 + 4] = r.bits.to_bytes(4, "little")
    return keys.select("key"), Known(of("t"), of("p"), of("c"), labels, bytes(marks))


@lru_cache(1 << 16)
def pieces_of(run: str) -> tuple[tuple[int, str], ...]:
    """A run cut where a full stop follows a word that is no initial or title, or a paragraph ends."""
    out, at = [], 0
    for w in _word.finditer(run):
        rest = run[w.end() : w.end() + 4]
        if rest.startswith(".") and len(w[0]) > 2 and fold(w[0]) not in _titles or "\n\n" in rest.replace("\r", ""):
            out.append((at, run[at : w.end()]))
            nxt = _word.search(run, w.end())
            if not nxt:
                return tuple(out)
            at = nxt.start()
    if at < len(run):
        out.append((at, run[at:]))
    return tuple(out)


def segments(text: str, plain: frozenset):
    """Runs of capitalised words with their places; single plain words, which are never names, are left out."""
    for m in _run.finditer(text):
        run = m[0]
        if run.isalpha():
            if run.casefold() not in plain:
                yield m.start(), run
            continue
        for at, piece in pieces_of(run):
            yield m.start() + at, piece


def is_french(text: str) -> bool:
    return len(re.findall(r"\b(?:le|la|les|du|une|pour)\b", text)) > len(re.findall(r"\b(?:het|een|van|op|the|of|der|die|und)\b", text))


_organisation = lru_cache(1 << 16)(lambda words: organisation(list(words)))


@lru_cache(1 << 16)
def _letters_of(s: str) -> tuple[str, ...]:
    return tuple(_letters.findall(fold(s)))


_elided = re.compile(r"[DdLlQqJj]['’][a-zà-ÿ]")


def run_name(text: str, s0: int, run: str, busy: Taken, known: Known | Extended, french) -> tuple[int, int, bool, list[str], str] | None:
    """(start, end, sure, terms, context) of the name that a run may hold; an unsure one depends on its terms. french() tells whether the
    text is French."""
    ws = words_of(run)
    if is_plain(ws, known.plain):
        return None
    # leading words that disclose nothing, and titles
    i, n = 0, len(ws)
    ctx = None
    while i < n:
        p, w, f, c = ws[i]
        title = f in _titles and (len(f) > 1 or f == "m" and i + 1 < n and run[p + 1 : p + 2] == "." and run[p + 2 : p + 3] != "-" and fold(ctx or "").strip(".") not in _titles and french())
        if title or i and w.islower() or f == "d'apres" or _elided.match(w) and c[2:] in known.plain or (c in known.plain and f not in PARTICLES and i + 1 < n and not _initial.match(w)):
            ctx = f + (run[p + len(w) : p + len(w) + 1].strip())
            i += 1
            continue
        break
    if i >= n:
        return None
    ws = list(ws[i:])
    start = s0 + ws[0][0]
    if busy.covers(start):
        return None
    # trailing words that disclose nothing
    while len(ws) > 1 and ws[-1][3] in known.plain and len(ws[-1][1]) > 2 and ws[-1][2] not in PARTICLES:
        ws.pop()
    while len(ws) > 1 and ws[-1][1].islower():
        ws.pop()
    end = s0 + ws[-1][0] + len(ws[-1][1])
    cut = busy.next(start)
    if cut is not None and cut < end:
        end = cut
        ws = [x for x in ws if s0 + x[0] < cut]
    if not any(len(f) > 2 for _, _, f, _ in ws) or all(f in PARTICLES or len(f) < 2 for _, _, f, _ in ws):
        return None
    if len(ws) == 1 and ws[0][3] in known.plain:
        return None
    terms = [c for _, w, f, c in ws if len(w) > 1 and f not in PARTICLES]
    ctx = ctx if ctx and fold(ctx).strip(".") in _titles else context_of(text, start)
    titled = fold(ctx).strip(".") in _titles and len(ctx.strip(".")) > 1
    sure = ctx in known.contexts or titled or any(t in known.names for t in terms)
    if not sure and all(t in known.plain for t in terms):
        return None
    before = text[max(0, start - 30) : start]
    flat = [x for _, _, f, _ in ws for x in f.split("-")]
    dotted = _letters_of(text[start : end + 1])
    after = list(_letters_of(text[end + 1 : end + 17])[:2]) if text[end : end + 1] in (" ", "\n", "-") else []
    prev = _letters.findall(fold(before))[-2:] if _joined.search(before) else []
    if maybe_organisation([*flat, *dotted, *after, *prev]) or len(dotted) > len(flat) or prev and len(prev[-1]) < 3:
        flat, after, prev = tuple(flat), tuple(after), tuple(prev)
        if _organisation(flat) or dotted != flat and _organisation(dotted) or after and (_organisation((*flat, after[0])) or _organisation((*flat, *after))):
            return None
        if prev and (_organisation((*prev[-1:], *flat)) or _organisation((*prev, *flat))):
            return None
    return (start, end, sure, terms, ctx) if sure or terms else None


def is_plain(ws, plain) -> bool:
    """A run of plain words only, with what stands between them, is never a name."""
    return all(c in plain or i and w.islower() or _elided.match(w) and c[2:] in plain for i, (_, w, _, c) in enumerate(ws))


#: What of the text around a run decides on it.
BEFORE, AFTER = 48, 24


def names(text: str, busy: Taken, known: Known) -> list[tuple[int, int, list[str], tuple | None]]:
    """(start, end, asked, around) of runs that name a person, or may: an open one asks for keys of the full table, and around has
    what run_name needs to decide when they are known."""
    out = []
    seen: list[bool] = []

    def french() -> bool:
        if not seen:
            seen.append(is_french(text))
        return seen[0]

    for s0, run in segments(text, known.plain):
        if known.is_plain(run):
            continue
        ws = words_of(run)
        # rare words that may be plain move the ends of the name, and may be its context
        open_words = [(f, c) for _, w, f, c in ws if c not in known.plain and c not in known.names and len(c) > 1 and (known.may("p" + c) or _elided.match(w) and known.may("p" + c[2:]))]
        got = run_name(text, s0, run, busy, known, french)
        if not open_words:
            if got is None:
                continue
            start, end, sure, terms, ctx = got
            if sure:
                out.append((start, end, [], None))
                continue
            asked = ["t" + t for t in terms if known.may("t" + t)] + (["c" + ctx] if known.may("c" + ctx) else [])
        else:
            asked = [k + c for _, _, f, c in ws if len(c) > 1 for k in "tp" if known.may(k + c)] + ["p" + c[2:] for _, w, _, c in ws if _elided.match(w)]
            asked += ["c" + x for x in {context_of(text, s0 + p) for p, *_ in ws} if known.may("c" + x)]
            start, end = s0, s0 + len(run)
        if asked:
            a, b = max(0, s0 - BEFORE), min(len(text), s0 + len(run) + AFTER)
            inside = [x for r in busy.within(a, b) for x in (max(r[0], a) - a, min(r[1], b) - a)]
            has_m = any(f == "m" for _, _, f, _ in ws)
            out.append((start, end, asked, (a, text[a:b], s0 - a, len(run), has_m and french(), inside)))
    return out


def decided(around: tuple, known: Known) -> tuple[int, int] | None:
    """(start, end) inside the text around a run, with known extended by the keys that the full table has."""
    _, window, at, size, french, inside = around[:6]
    got = run_name(window, at, window[at : at + size], Taken(list(zip(inside[::2], inside[1::2]))), known, lambda: french)
    return got[:2] if got and got[2] else None


def lower_names(text: str, covered: Taken, known: Known) -> list[tuple[int, int, list[str], int, bool]]:
    """(start, end, asked, lead, alone) of words in lower case that may be names. lead is the end of the one before it with
    only particles between, or -1; a word that isn't alone is a name only beside another one, or behind a context that is asked for."""
    out = []
    may = {w for w in known.lower(set(_low.findall(text))) if (f := fold(w)) not in PARTICLES and f not in _titles}
    if not may:
        return out
    places = []
    for w in may:
        i = text.find(w)
        while i >= 0:
            if (m := _lower.match(text, i)) and m[0] == w:
                places.append((i, w))
            i = text.find(w, i + len(w))
    last = -1
    for s, w in sorted(places):
        if covered.covers(s):
            continue
        gap = text[last:s] if last >= 0 and s - last < 30 else ""
        lead = last if gap[:1].isspace() and "\n\n" not in gap.replace("\r", "") and all(fold(x).strip(".'’") in {*PARTICLES, "d"} for x in gap.split()) else -1
        asked = [] if w in known.names else ["t" + w]
        alone = len(w) > 4
        if not alone:
            ctx = context_of(text, s)
            alone = ctx in known.contexts
            if not alone and known.may("c" + ctx):
                asked.append("c" + ctx)
        out.append((s, s + len(w), asked, lead, alone))
        last = s + len(w)
    return out


def items(text: str, known: Known, places: Places) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, asked) in the text as it is; asked are the keys on which an open name depends, else empty."""
    return [x[:4] for x in placed_items(text, known, places)]


def placed_items(text: str, known: Known, places: Places) -> list[tuple]:
    """(start, end, kind, asked, lead, alone, around) of items: lead and alone of lower_names, lead null for others; around of open
    runs, with the original places of its characters where these differ."""
    t, at = resolved(text)
    got = [(m.start(), m.end(), "email") for m in _email.finditer(t)] if _at_sign.search(t) else []
    urls = [(m.start(), m.end(), "url") for m in _url.finditer(t)] if "://" in t else []
    taken, linked = Taken(got), Taken(urls)
    got += [x for x in numbers(t, known.labels) if taken.free(*x[:2])]
    taken = Taken(got)
    got = [x for x in got if not linked.covers(x[0])]
    got += [x for x in addresses(t, places, known.plain) if taken.free(*x[:2])]
    named = names(t, Taken(got + urls), known)
    out = [(*x, [], None, True, None) for x in got] + [(s, e, "name", asked, None, True, around) for s, e, asked, around in named]
    out += [(s, e, "name", asked, lead, alone, None) for s, e, asked, lead, alone in lower_names(t, Taken([*got, *urls, *named]), known)]
    if not at:
        return out
    spots = lambda x: x and (*x, at[x[0] : x[0] + len(x[1]) + 1])
    return [(at[s], at[e - 1] + 1, k, asked, lead if lead is None or lead < 0 else at[lead - 1] + 1, alone, spots(around)) for s, e, k, asked, lead, alone, around in out]


_AROUND = pa.struct([("origin", pa.int32()), ("window", pa.string()), ("at", pa.int32()), ("size", pa.int32()), ("french", pa.bool_()), ("inside", pa.list_(pa.int32())), ("spots", pa.list_(pa.int32()))])
_AROUND_SQL = "struct<origin:int,window:string,at:int,size:int,french:boolean,inside:array<int>,spots:array<int>>"
_FIELDS = [f.name for f in _AROUND]
_ITEM = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("asked", pa.list_(pa.string())), ("lead", pa.int32()), ("alone", pa.bool_()), ("around", _AROUND)])
_SCHEMA = f"document_id string, field string, item_no int, items array<struct<start:int,stop:int,kind:string,asked:array<string>,lead:int,alone:boolean,around:{_AROUND_SQL}>>"
_PLACED = "document_id string, field string, item_no int, start_char int, end_char int, lead int, alone boolean"


def _found(known: Known, rows):
    def run(batches):
        places = Places(rows)
        names_of = [f.name for f in _ITEM]
        for b in batches:
            found = [[dict(zip(names_of, (*x[:6], x[6] and dict(zip(_FIELDS, (*x[6], None)))))) for x in placed_items(t, known, places)] for t in b.column(3).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(found, pa.list_(_ITEM))], ["document_id", "field", "item_no", "items"])

    return run


def _decided(known: Known):
    """Open names with the keys that the full table has: those that are names, with their places."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                keys, around, place = r["keys"] or [], r["around"], (r["document_id"], r["field"], r["item_no"])
                if around is None:  # a word in lower case
                    if any(k[0] == "t" for k in keys) or not any(k[0] == "t" for k in r["asked"]):
                        rows.append((*place, r["start_char"], r["end_char"], r["lead"], r["alone"] or any(k[0] == "c" for k in keys)))
                elif got := decided(tuple(around[f] for f in _FIELDS), known.with_keys(keys)):
                    s, e = got
                    own = around["spots"]
                    rows.append((*place, *((own[s], own[e - 1] + 1) if own else (around["origin"] + s, around["origin"] + e)), None, True))
            cols = list(zip(*rows)) or [()] * 7
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.record_batch([pa.array(x, ty) for x, ty in zip(cols, types)], [c.split()[0] for c in _PLACED.split(", ")])

    return run


def texts_of(docs: DataFrame, processed: DataFrame) -> DataFrame:
    """(document_id, field, item_no, text) of every text that may hold personal information, blank ones left out."""
    u = units(docs).select("document_id", F.when(F.col("page_no") == 0, "raw_text").otherwise("pdf_page").alias("field"), F.col("page_no").alias("item_no"), "text")
    out = processed.filter("document_id is not null").select("document_id", F.lit("output_text").alias("field"), F.col("generation").cast("int").alias("item_no"), F.col("output_text").alias("text"))
    return u.unionByName(out).filter(F.col("text").rlike(r"(?U)\S"))


def lower_runs(words: DataFrame) -> DataFrame:
    """Names in lower case, from their first word to their last one; one word at least stands for itself."""
    place = ["document_id", "field", "item_no"]
    w = Window.partitionBy(*place).orderBy("start_char")
    begins = F.coalesce((F.lag("end_char").over(w) != F.col("lead")).cast("int"), F.lit(1))
    runs = words.dropDuplicates([*place, "start_char", "end_char"]).withColumn("begins", begins).withColumn("run", F.sum("begins").over(w))
    rest = [c for c in words.columns if c not in (*place, "start_char", "end_char", "lead", "alone")]
    runs = runs.groupBy(*place, "run").agg(*(F.first(c).alias(c) for c in rest), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.max("alone").alias("alone"))
    return runs.filter("alone").select(*place, *rest, "start_char", "end_char")


def personal_items(docs: DataFrame, processed: DataFrame, annotations: DataFrame, localities: DataFrame) -> DataFrame:
    """(document_id, field, item_no, kind, start_char, end_char): one row per item found."""
    keys, known = disclosure(docs, annotations)
    rows = [tuple(r) for r in localities.select("postcode", "name_nl", "name_fr").distinct().limit(MOST_LOCALITIES + 1).collect()]
    if len(rows) > MOST_LOCALITIES:
        raise ValueError("more localities than a country has")
    scanned = spread(texts_of(docs, processed)).mapInArrow(_found(known, rows), _SCHEMA)
    each = scanned.select("document_id", "field", "item_no", F.explode("items").alias("i"))
    each = materialize(each.select("document_id", "field", "item_no", "i.kind", F.col("i.start").alias("start_char"), F.col("i.stop").alias("end_char"), "i.asked", "i.lead", "i.alone", "i.around"))
    place = ["document_id", "field", "item_no", "start_char", "end_char"]
    sure = each.filter("size(asked) = 0").select("kind", *place, "lead", "alone")
    opened = each.filter("size(asked) > 0").drop("kind").dropDuplicates(place)
    # place by place, a run and a word in lower case never begin alike
    got = each.filter("size(asked) > 0").select(*place, F.explode("asked").alias("key")).distinct().join(keys, "key", "left_semi").groupBy(*place).agg(F.collect_set("key").alias("keys"))
    named = opened.join(got, place, "left").mapInArrow(_decided(known), _PLACED).select(F.lit("name").alias("kind"), *place, "lead", "alone")
    kept = materialize(sure.unionByName(named))
    return kept.filter("lead is null").drop("lead", "alone").unionByName(lower_runs(kept.filter("lead is not null")))


def _of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_items(*(table(spark, sf_dir, t) for t in ("imported_documents", "processed_documents", "backend_annotations", "localities")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir).select("document_id", "field", "item_no", "kind", "start_char").distinct()


def _rewritten(batches):
    for b in batches:
        out = []
        for t, found in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            parts, at = [], 0
            for s, e, k in sorted({(x["start_char"], x["end_char"], x["kind"]) for x in found or ()}):
                if s >= at:
                    parts += [t[at:s], PLACEHOLDER[k]]
                    at = e
            out.append("".join(parts) + t[at:])
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string())], ["document_id", "field", "item_no", "text"])


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, field, item_no, text) of every distinct text that isn't blank, items replaced by typed placeholders."""
    found = _of(spark, sf_dir).groupBy("document_id", "field", "item_no").agg(F.collect_set(F.struct("start_char", "end_char", "kind")).alias("items"))
    texts = texts_of(table(spark, sf_dir, "imported_documents"), table(spark, sf_dir, "processed_documents")).dropDuplicates(["document_id", "field", "item_no"])
    return texts.join(found, ["document_id", "field", "item_no"], "left").mapInArrow(_rewritten, "document_id string, field string, item_no int, text string")


QUERIES = {"p2_found": p2_found, "p2_text": p2_text}
