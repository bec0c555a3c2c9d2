"""Problem 3: writings of one postal address, matched by rewrites mined from the addresses themselves.

An address is parsed into a place (postcode, house number, letter) and a street. A missing postcode comes
from the locality's name, in either language and with up to two typing errors. Box numbers, countries and the order of
the parts don't matter.

Streets of one place that agree in all words but one vote for a rewrite of that word, or of its ending:
the shorter one becomes the longer one. Votes are counted over distinct places and streets, and a rewrite is kept
when its pair is significant (likelihood ratio against the words' own frequencies) and most of the
words it would touch have been seen with it. Streets are written anew by the kept rewrites and
matched again, until no new rewrite appears; rewrites stay a table and are applied by joins of words. What then still differs by typing errors is linked by
near_pairs inside a place, as are equal streets.

Addresses without a number or without a known locality link to those with the same letters and digits only; null
and blank ones link to nothing. Alternatives of a word are compared with the most frequent one of
their place only, so no pairs are formed within a group.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from palimpsest.llm.graph import components
from palimpsest.llm.p5_names import fold, near_word
from palimpsest.llm.segments import near_pairs
from palimpsest.plans.session import by_key, materialize, table

#: A country's list of localities is sent to the tasks; a longer list is refused.
MOST_LOCALITIES = 100_000
#: Votes a rewrite needs.
VOTES = 3
#: Chi-square of one degree of freedom at p = 0.001; the share of touched words seen with the rewrite.
SIGNIFICANT, SURE = 10.83, 0.3
#: Edits between streets of one place, by the shorter one's length.
EDITS = [(1, 1), (8, 2), (12, 3)]
COUNTRY = re.compile(r"\b(?:belgie|belgique|belgium|belgien)\b")
SAINT = {"st": "sint", "ste": "sainte"}


def _near(a: str, b: str, most: int) -> bool:
    """Banded edit distance up to most, a transposition counting one."""
    if abs(len(a) - len(b)) > most:
        return False
    if near_word(a, b):
        return True
    if most < 2:
        return False
    prev, row = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        new = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            c = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, prev[j - 2] + 1)
            new[j] = c
        if min(new) > most:
            return False
        prev, row = row, new
    return row[-1] <= most


def squeeze(s: str) -> str:
    return "".join(SAINT.get(w, w) for w in re.findall(r"[a-z]+", fold(s)))


class Localities:
    """Names of localities by postcode and by name, exact and with typing errors."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.by_code: dict[str, set[str]] = {}
        self.codes: dict[str, set[str]] = {}
        self.words = 1
        for code, *names in rows:
            for n in names:
                if code and n and (key := squeeze(n)):
                    self.by_code.setdefault(code, set()).add(key)
                    self.codes.setdefault(key, set()).add(code)
                    self.words = max(self.words, len(re.findall(r"[a-z]+", fold(n))))
        self.less: dict[str, set[str]] = {}
        for key in self.codes:
            for d in self._without(key):
                self.less.setdefault(d, set()).add(key)

    @staticmethod
    def _without(w: str) -> set[str]:
        one = {w[:i] + w[i + 1 :] for i in range(len(w))}
        return {w} | one

    def find(self, words: list[str], code: str | None) -> tuple[int, int, set[str]] | None:
        """(start, stop, codes) of the run of words that names the locality, of a postcode if known."""
        runs = [(i, j, "".join(SAINT.get(w, w) for w in words[i:j])) for i in range(len(words)) for j in range(i + 1, min(len(words), i + self.words) + 1)]
        names = self.by_code.get(code or "")
        if names:
            for i, j, r in runs:
                if r in names:
                    return i, j, {code}
            near = [(i, j, r) for i, j, r in runs if any(_near(r, n, 2 if len(n) > 7 else 1) for n in names)]
            if near:
                i, j, _ = min(near, key=lambda x: (min(abs(len(x[2]) - len(n)) for n in names), x[0]))
                return i, j, {code}
            return None
        exact = [(i, j, r) for i, j, r in runs if r in self.codes]
        if exact:
            i, j, r = max(exact, key=lambda x: (len(x[2]), -x[0]))
            return i, j, self.codes[r]
        best = None
        for i, j, r in runs:
            if len(r) > 5:
                for n in {n for d in self._without(r) for n in self.less.get(d, ())}:
                    d = 1 if near_word(r, n) else 2
                    if _near(r, n, d) and (best is None or d < best[0]):
                        best = (d, i, j, n)
        return (best[1], best[2], self.codes[best[3]]) if best else None


_code = re.compile(r"(?<![\w])(?:(?:be|b)[\s\-]*)?(\d{4})(?!\w)")
_box = re.compile(r"(?<=\d)\s*[a-z]?(?:\s*/\s*\w{1,4}\b)|\b(?:bus|boite|bte|box|bt)\.?\s*(?:nr\.?\s*)?\d*\w{1,4}\b|(?<=[\d\s])b\.?\s?\d+\b")
_number = re.compile(r"(?:\b(?:nr|no|n)\b\.?\s*)?(?<!\w)(\d{1,4})(?:\s?([a-z])(?!\.|\s+(?:de|du|des|d)\b))?(?![\w])")
_small = {"te", "a", "in", "be", "b", "nr", "no", "n"}


def parse(address: str, places: Localities) -> tuple[str | None, str, str, str]:
    """(postcode, number, letter, street); postcode and number are null or empty when not found."""
    s = fold(re.sub(r"(?<!\w)[àÀ](?!\w)", " te ", address)).replace("n°", " nr ").replace("nº", " nr ")
    s = COUNTRY.sub(" ", re.sub(r"\bno\b(?=\s*\d)", "nr", s))
    code, cut = None, None
    for m in _code.finditer(s):
        if m[1] in places.by_code or code is None:
            code, cut = m[1], m
            if m[1] in places.by_code:
                break
    if cut:
        s = s[: cut.start()] + " | " + s[cut.end() :]
    slash = re.search(r"(\d+\s*[a-z]?)\s*/\s*\w{1,4}\b", s)
    if slash:
        s = s[: slash.start()] + slash[1] + " " + s[slash.end() :]
    s = _box.sub(" ", s)
    m = _number.search(s)
    number, letter = (m[1].lstrip("0") or "0", m[2] or "") if m else ("", "")
    if m:
        s = s[: m.start()] + " | " + s[m.end() :]
    words = re.findall(r"[a-z]+|\|", s)
    plain = [w for w in words if w != "|"]
    hit = places.find(plain, code if code in places.by_code else None)
    if hit:
        if code not in places.by_code:
            code = min(hit[2])
        street = plain[: hit[0]] + plain[hit[1] :]
        if street and hit[0] and plain[hit[0] - 1] in ("te", "a", "in"):
            street = plain[: hit[0] - 1] + plain[hit[1] :]
    else:
        # parts by separators; the street is next to the number
        parts = [re.findall(r"[a-z]+", p) for p in re.split(r"[,;()|]|\s-\s", s)]
        parts = [p for p in parts if any(w not in _small for w in p)]
        street = plain if code is None or len(parts) < 2 else max(parts, key=len) if m is None else _beside(s)
    while len(street) > 1 and street[-1] in _small:
        street = street[:-1]
    while len(street) > 1 and street[0] in _small - {"a"}:
        street = street[1:]
    return (code if code in places.by_code else None), number, letter, " ".join(street)


def _beside(s: str) -> list[str]:
    """Words of the part before the number's mark, or else after it."""
    left, _, right = s.rpartition("|") if s.count("|") == 1 else s.partition("|")
    for p in (re.split(r"[;()]|\s-\s", left)[-1], re.split(r"[;()]|\s-\s", right)[0]):
        if words := [w for w in re.findall(r"[a-z]+", p) if w not in _small]:
            return words
    return re.findall(r"[a-z]+", s)


def _parsed(rows: list[tuple[str, str, str]]):
    def run(batches):
        places = Localities(rows)
        for b in batches:
            got = [parse(a, places) for a in b["address"]]
            key = [re.sub(r"[\W_]+", "", fold(a)) for a in b["address"]]
            place = [f"{c}|{n}|{x}" if c and n and st else None for c, n, x, st in got]
            yield pd.DataFrame({"address": b["address"], "letters": key, "place": place, "street": [g[3] for g in got]})

    return run


def _stem(a: str, b: str) -> int:
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return i


def rewrites_of(word: str, lead: str) -> list[tuple[str, str]]:
    """Rewrites that turn the shorter of two words of one place into the longer: the word itself, or an ending ("~x")
    with up to three letters before the difference. The shorter one has the longer one's letters in their order, else
    it is another kind of street and no abbreviation."""
    a, b = (word, lead) if (len(word), word) < (len(lead), lead) else (lead, word)
    rest = iter(b)
    if len(a) == len(b) or not all(c in rest for c in a):
        return []
    n = _stem(a, b)
    if n < 4:
        return [(a, b)] if a[0] == b[0] and len(a) < len(b) else []
    return [("~" + a[n - k :], "~" + b[n - k :]) for k in range(0, 4) if len(a) - n + k > 1 or a[n - k :] == "k"]


def _candidates(batches):
    for b in batches:
        rows = [(x, y, r.place, r.mask, r.word) for r in b.itertuples() for x, y in rewrites_of(r.word, r.lead)]
        yield pd.DataFrame(rows, columns=["a", "b", "place", "mask", "word"])


def _touching(batches):
    """What could be rewritten in each word: itself and its endings."""
    for b in batches:
        rows = [(k, w) for w in b["word"] for k in {w, *("~" + w[i:] for i in range(max(2, len(w) - 12), len(w)))}]
        yield pd.DataFrame(rows, columns=["a", "word"])


def _cut(batches):
    """Every word with its places of endings: place 0 is the word itself."""
    for b in batches:
        rows = [(w, i, w if i == 0 else "~" + w[i:]) for w in b["word"] for i in (0, *range(2, len(w)))]
        yield pd.DataFrame(rows, columns=["word", "place", "a"])


def rewritten(forms: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """forms with the words of a column rewritten by rules (a, b): a whole word by its rule, else its longest ending that has one."""
    words = forms.select(F.explode(F.split(column, " ")).alias("word")).filter("word != ''").distinct()
    hits = words.mapInPandas(_cut, "word string, place int, a string").join(rules, "a")
    ending = F.expr("substring(b, 2, length(b))")
    hits = hits.withColumn("new", F.when(F.col("place") == 0, F.col("b")).when(~F.endswith("word", ending), F.concat(F.expr("substring(word, 1, place)"), ending))).filter("new is not null")
    new = hits.groupBy("word").agg(F.min_by("new", "place").alias("new"))
    one = forms.select(F.col(column).alias("_s")).distinct().select("_s", F.posexplode(F.split("_s", " ")).alias("_i", "word"))
    done = one.join(new, "word", "left").groupBy("_s").agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("new", "word").alias("w")))).alias("ws"))
    done = done.select("_s", F.array_join(F.transform("ws", lambda x: x.w), " ").alias("_new"))
    return forms.join(done, F.col(column) == F.col("_s"), "left").withColumn(column, F.coalesce("_new", column)).drop("_s", "_new")


@F.pandas_udf(BooleanType())
def _one_slip(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near_word(x, y) for x, y in zip(a, b)], dtype=bool)


def with_kind(forms: DataFrame, kinds: DataFrame) -> DataFrame:
    """forms with kind: a street's first word when it is, or is one slip from, one of the kinds (word); "" else."""
    first = forms.select(F.regexp_extract("form", r"^(\S+) ", 1).alias("word")).filter("word != ''").distinct()
    same = first.join(kinds, "word", "left_semi").select("word", F.col("word").alias("kind"))
    both = first.withColumn("k", F.lit(False)).unionByName(kinds.select("word").distinct().withColumn("k", F.lit(True)))
    pairs = near_pairs(both.select(F.lit(0).alias("all"), F.col("word").alias("s")).distinct(), ["all"], limits=[(1, 1), (3, 2)])
    pairs = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("length(b) > 3").filter(_one_slip("a", "b"))
    near = pairs.join(kinds.select(F.col("word").alias("b")).distinct(), "b").groupBy(F.col("a").alias("word")).agg(F.min("b").alias("kind")).join(first, "word", "left_semi")
    named = same.unionByName(near.join(same.select("word"), "word", "left_anti")).withColumnRenamed("word", "_first")
    return forms.withColumn("_word", F.regexp_extract("form", r"^(\S+) ", 1)).join(named, F.col("_word") == F.col("_first"), "left").withColumn("kind", F.coalesce("kind", F.lit(""))).drop("_word", "_first")


def mine(streets: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, sure): new significant rewrites from distinct (place, street): sure ones hold for most words they touch, the others only
    where the place has the rewritten street too. known: (a), rewrites of earlier rounds."""
    words = streets.select("place", "street", F.posexplode(F.split("street", " ")).alias("i", "word"), F.split("street", " ").alias("w"))
    slots = words.select("place", "word", F.expr("array_join(transform(w, (x, j) -> if(j = i, '*', x)), ' ')").alias("mask")).filter("length(word) > 0")
    # alternatives of a slot that begin alike; single words need four letters in common, as nothing else ties them
    slots = slots.withColumn("tie", F.when(F.col("mask") == "*", F.substring("word", 1, 4)).otherwise(F.substring("word", 1, 1)))
    # a word used in more places leads; the longer one at a tie
    seen = words.groupBy("word").agg(F.countDistinct("street").alias("n"))
    slots = materialize(slots.join(seen, "word"))
    lead = slots.groupBy("place", "mask", "tie").agg(F.max_by("word", F.struct("n", F.length("word"), "word")).alias("lead"), F.max_by("word", F.struct(F.length("word"), "n", "word")).alias("longest"))
    led = slots.join(lead, ["place", "mask", "tie"])
    votes = led.select("place", "mask", "word", F.explode(F.array_distinct(F.array("lead", "longest"))).alias("lead")).filter("word != lead")
    cast = votes.mapInPandas(_candidates, "a string, b string, place string, mask string, word string")
    pairs = materialize(cast.groupBy("a", "b").agg(F.countDistinct("place", "mask").alias("n"), F.countDistinct("word").alias("words")))
    total = max(pairs.agg(F.sum("n")).first()[0] or 0, 1)
    ends = pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    starts = pairs.groupBy("a").agg(F.sum("n").alias("na"))
    touched = words.select("word").distinct().mapInPandas(_touching, "a string, word string").join(pairs.select("a").distinct(), "a").groupBy("a").agg(F.count("*").alias("touched"))
    strong = pairs.filter(F.col("n") >= VOTES).join(ends, "b").join(starts, "a").join(touched, "a", "left").fillna(1, ["touched"]).join(known, "a", "left_anti")
    expected = F.greatest(F.col("na") * F.col("nb") / total, F.lit(1e-9))
    strong = strong.filter(2 * F.col("n") * F.log(F.col("n") / expected) > SIGNIFICANT)
    strong = strong.withColumn("sure", ~F.startswith("a", F.lit("~")) | (F.col("words") / F.greatest("touched", F.lit(1)) >= SURE))
    best = strong.groupBy("a", "sure").agg(F.max_by("b", F.struct("n", F.length("b"), "b")).alias("b"))
    return best.groupBy("a").agg(F.max_by("b", "sure").alias("b"), F.max("sure").alias("sure"))


def address_places(lines: DataFrame, localities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(addr_id, place_id) of every distinct addr_id with a text, and the rewrites (a, b) that were mined."""
    spark = lines.sparkSession
    rows = lines.select("addr_id", "address").filter("addr_id is not null").dropDuplicates(["addr_id"]).filter(F.col("address").rlike(r"(?U)[\p{L}\p{N}]"))
    names = [tuple(r) for r in localities.select("postcode", "name_nl", "name_fr").distinct().limit(MOST_LOCALITIES + 1).collect()]
    if len(names) > MOST_LOCALITIES:
        raise ValueError("more localities than a country has")
    parsed = materialize(by_key(rows.select("address").distinct(), "address").mapInPandas(_parsed(names), "address string, letters string, place string, street string"))
    placed = parsed.filter("place is not null")
    rules = spark.createDataFrame([], "a string, b string")
    current = placed.select("place", "street").distinct().withColumn("form", F.col("street"))
    # every round has new left sides, of which there are no more than words and endings
    while True:
        current = materialize(current)
        found = materialize(mine(current.select("place", F.col("form").alias("street")).distinct(), rules.select("a")))
        fresh, weak = found.filter("sure").select("a", "b"), found.filter("not sure").select("a", "b")
        if fresh.isEmpty():
            break
        rules = rules.unionByName(fresh)
        current = rewritten(current, "form", fresh)
    # articles are often left out
    joined = lambda c: F.regexp_replace(c, r"\b(?:de|du|des|la|le|l|d)\b| ", "")
    forms = rewritten(current.withColumn("alt", F.col("form")), "alt", weak)
    forms = materialize(forms.withColumn("s", joined("form")).withColumn("alt", joined("alt")))
    alike = forms.filter("s != alt").select("place", F.col("s").alias("a"), F.col("alt").alias("b"), F.lit(1).alias("edits")).distinct()
    # streets of different leading kinds (the words that rewrites lead to) are never linked
    forms = materialize(with_kind(forms, rules.filter(~F.startswith("b", F.lit("~"))).select(F.col("b").alias("word"))))
    strings = materialize(forms.select("place", "kind", "s").union(forms.select("place", "kind", "alt")).distinct())
    close = near_pairs(strings, ["place", "kind"], limits=EDITS)
    # two edits in the last letters make another kind of street, unless they are one transposition
    tail = lambda c: F.right(c, F.lit(4))
    letters = lambda c: F.array_sort(F.split(tail(c), ""))
    close = close.filter((F.col("edits") < 2) | (F.levenshtein(tail("a"), tail("b")) < 2) | (letters("a") == letters("b")))
    close = close.select("place", "a", "b", "edits").unionByName(alike)
    key = lambda c: F.concat_ws("|", "place", c)
    roots = components(close.select(key("a").alias("a"), key("b").alias("b")))
    forms = forms.withColumn("node", key("s")).join(roots, "node", "left").select("place", "street", F.coalesce("root", "node").alias("place_id"))
    found = parsed.join(forms, ["place", "street"], "left").select("address", F.coalesce("place_id", F.concat(F.lit("?"), "letters")).alias("place_id"))
    return rows.join(found, "address").select("addr_id", "place_id"), rules


def p3_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address line with its place's class: the least addr_id of the place and its number of lines."""
    lines, _ = address_places(table(spark, sf_dir, "custom_address_lines"), table(spark, sf_dir, "localities"))
    lines = materialize(lines)
    return lines.join(lines.groupBy("place_id").agg(F.min("addr_id").alias("class_id"), F.count("*").alias("n_lines")), "place_id").select("addr_id", "class_id", "n_lines")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = address_places(table(spark, sf_dir, "custom_address_lines"), table(spark, sf_dir, "localities"))
    lines = materialize(lines)
    a, b = (lines.select("place_id", F.col("addr_id").alias(f"addr_id_{s}")) for s in "ab")
    return a.join(b, "place_id").filter("addr_id_a < addr_id_b").select("addr_id_a", "addr_id_b")


QUERIES = {"p3_found": p3_found, "p3_places": p3_places}
