"""Problem 5: spellings of one person or organisation within a dossier, linked by a pigeonhole segment join.

Each distinct spelling of a dossier is parsed once. An organisation is its kind (abbreviations
resolved) and the rest of its words; a person is a family name with its particles and a given name, initials or
neither. Where the order is open (two words, no comma, no particle), the word that more dossiers use
decides; if neither is in common use, both orders are tried.

Family names, organisations' names and given names within the same family are joined by
segments.near_pairs. Family names link within FAMILY_EDITS. A given name in
common use is itself and no misspelling of another one; an unlisted form beside one that is TIMES as common is a
misspelling. Other given names belong to the nearest one of their family. Nicknames belong to the given name the list has for them or that they are formed from. Initials,
nicknames and family names alone belong to the person of the family they fit, if that is one; if
several fit, to the dossier's patient if it is among them, else to none. A last_name record is the patient.
Equal spellings within a dossier are always linked.

Null and blank names and names without a dossier link to nothing.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from palimpsest.llm.graph import components
from palimpsest.llm.segments import near_pairs
from palimpsest.plans.session import materialize, table

SHORT = 7
#: A given name is in common use when so many dossiers have it, unless it isn't listed and a form within the edits of a
#: misspelling is used in TIMES as many: misspellings recur by chance as data grow, in proportion to the name.
COMMON, TIMES = 3, 10

#: Words of organisations by kind; several words first.
KINDS = {
    "hospital": ["algemeen ziekenhuis", "a z", "az", "ziekenhuis", "ziekenh", "zkh", "zh", "hopital", "hop", "hospital"],
    "clinic": ["clinique", "clin", "cl", "kliniek"],
    "centre": ["centre medical", "ctre med", "c m", "cm", "centre med", "medisch centrum"],
    "home": ["woonzorgcentrum", "woonzorgc", "w z c", "wzc", "rusthuis", "maison de repos", "m r s"],
    "practice": ["huisartsenpraktijk", "groepspraktijk", "praktijk", "prakt", "cabinet medical", "cabinet", "cab"],
}
PARTICLES = {"van", "den", "der", "de", "du", "des", "le", "la", "les", "ter", "ten", "te", "von", "vande", "vanden", "d", "het", "t"}
TITLES = {"dr", "dokter", "docteur", "doctor", "prof", "professor", "professeur", "pr", "dhr", "mevr", "mevrouw", "meneer", "heer", "m", "mme", "mlle", "monsieur", "madame", "mr", "mrs", "ms", "herr", "frau", "hr", "fr", "mw"}
ARTICLES = {"de", "du", "des", "la", "le", "l", "d"}
ENDINGS = ("tje", "je", "ke", "oo", "ou", "uy", "iy", "ay", "ey", "oy", "y", "i")

_kinds = sorted(((w.split(), k) for k, ws in KINDS.items() for w in ws), key=lambda x: -len(x[0]))
_by_edge: dict[str, list] = {}
for _ws, _k in _kinds:
    for _w in {_ws[0], _ws[-1]}:
        _by_edge.setdefault(_w, []).append((_ws, _k))
_long_kinds = [(w[0], k) for w, k in _kinds if len(w) == 1 and len(w[0]) >= 7]


@lru_cache(1 << 16)
def fold(s: str) -> str:
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFKD", s.replace("œ", "oe").replace("æ", "ae"))
    return "".join(c for c in s if not unicodedata.combining(c)).casefold()


_heads, _tails = {w[:3] for w, _ in _long_kinds}, {w[-3:] for w, _ in _long_kinds}


def maybe_organisation(words: list[str]) -> bool:
    """Whether any of the words may be one that tells a kind: a quick test before organisation. One edit leaves a long word's
    beginning or end as it is."""
    return any(w in _by_edge or len(w) > 5 and (w[:3] in _heads or w[-3:] in _tails) for w in words)


def squash(s: str) -> str:
    """Folded letters only, with the spellings of one sound made equal."""
    s = re.sub(r"[\W\d_]+", "", fold(s))
    for a, b in (("cks", "x"), ("ks", "x"), ("sck", "sk"), ("ck", "k"), ("y", "ie"), ("ij", "ie"), ("ph", "f"), ("th", "t"), ("qu", "kw"), ("c", "k"), ("z", "s")):
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s)


def near_word(a: str, b: str) -> bool:
    """Within one edit or one transposition."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:]


def _core(words: list[str]) -> str:
    return "".join({"st": "sint", "ste": "sainte"}.get(w, w) for w in words if w not in ARTICLES)


def organisation(words: list[str]) -> tuple[str, str] | None:
    """(kind, name) of folded words, None if no word tells a kind."""
    if len(words) < 2:
        return None
    # the longest kind first, at the beginning before the end
    near = [x for w in {words[0], words[-1]} for x in _by_edge.get(w, ())]
    for ws, kind in sorted(near, key=lambda x: -len(x[0])) if len(near) > 1 else near:
        for at in (0, len(words) - len(ws)):
            if at >= 0 and words[at : at + len(ws)] == ws and len(words) > len(ws):
                return kind, _core(words[:at] + words[at + len(ws) :])
    for at in (0, len(words) - 1):
        if len(words[at]) > 5:
            for w, kind in _long_kinds:
                if abs(len(words[at]) - len(w)) < 2 and (words[at][0] == w[0] or words[at][-1] == w[-1]) and near_word(words[at], w):
                    return kind, _core(words[:at] + words[at + 1 :])
    if len(words) > 2:
        for at in (0, len(words) - 2):
            if words[at][:1] == "c" and near_word(" ".join(words[at : at + 2]), "centre medical"):
                return "centre", _core(words[:at] + words[at + 2 :])
    return None


_initials = re.compile(r"(?:[^\W\d_]\.?-?){1,3}")


def is_initials(part: str) -> bool:
    p = part.strip()
    return bool(p) and (len(p) == 1 or bool(_initials.fullmatch(p)) and ("." in p or "-" in p))


def person_readings(name: str) -> list[tuple[str, str, str, str, int]]:
    """(family, given, initials, key words of given, open) readings of a person's name as typed.

    open: 1 for the usual order of an open form, 2 for the other one, else 0.
    """
    name = re.sub(r"^[\s\-*•–·]+", "", name).strip()
    name = re.sub(r"(?i)\bv\. ?d\. ?", "van den ", name)
    name = re.sub(r"(?i)(?<=\s)t\. ?(?=\w\w)", "ter ", name)
    left, comma, right = name.partition(",")
    words = [w for w in re.split(r"\s+", left.strip()) if w]
    while len(words) > 1 and fold(words[0]).rstrip(".") in TITLES and not (len(words) == 2 and is_initials(words[0])):
        words = words[1:]

    def out(family: list[str], given: list[str], order: int = 0):
        f, g = squash(" ".join(family)), " ".join(given).strip()
        if is_initials(g):
            return f, "", "".join(re.findall(r"[^\W\d_]", fold(g))), "", order
        return f, fold(re.sub(r"[\s.]+", "", g.replace("-", ""))), "", fold(g), order

    if comma and right.strip():
        return [out(words, right.split())]
    if len(words) == 1:
        return [out(words, [])]
    low = [fold(w) for w in words]
    if low[0] in PARTICLES:  # family first
        if is_initials(words[-1]) or len(words) > 2 and low[-2] not in PARTICLES:
            return [out(words[:-1], words[-1:])]
        return [out(words, [])]
    at = next((i for i, w in enumerate(low) if 0 < i < len(low) - 1 and (w in PARTICLES or len(w) < 5 and not is_initials(w))), 0)
    if at:
        return [out(words[at:], words[:at])]
    if is_initials(words[0]):
        return [out(words[1:], words[:1])]
    if is_initials(words[-1]):
        return [out(words[:-1], words[-1:])]
    if len(words) == 2:
        return [out(words[1:], words[:1], 1), out(words[:1], words[1:], 2)]
    return [out(words[-1:], words[:-1], 1), out(words[:1], words[1:], 2)]


def _parsed(batches):
    for b in batches:
        rows = []
        for sid, name in zip(b["settings_id"], b["name"]):
            words = re.findall(r"[^\W\d_]+", fold(name))
            if not words:
                continue
            if org := organisation(words):
                rows.append((sid, name, "o:" + org[0], squash(org[1]), "", "", 0))
                continue
            for family, given, initials, _, order in person_readings(name):
                if family:
                    rows.append((sid, name, "p", family, given, initials, order))
        yield pd.DataFrame(rows, columns=["settings_id", "name", "kind", "family", "given", "initials", "ord"])


_SCHEMA = "settings_id long, name string, kind string, family string, given string, initials string, ord int"


def nickname_fits(nick: str, given: str) -> bool:
    """The nickname is a beginning or an end of the given name, with or without an ending of nicknames."""
    if nick == given or len(nick) > len(given) + 2:
        return False
    if len(nick) >= 2 and given.startswith(nick):
        return True
    for e in ENDINGS:
        base = nick[: -len(e)]
        if nick.endswith(e) and base and (given.startswith(base) and (len(base) > 1 or e == "oo") or len(base) > 2 and given.endswith(base)):
            return True
    return False


@F.pandas_udf(BooleanType())
def _fits(nick: pd.Series, given: pd.Series) -> pd.Series:
    return pd.Series([nickname_fits(a, b) for a, b in zip(nick, given)], dtype=bool)


def _nick_keys(batches):
    """Beginnings and ends of given names, and what nicknames leave of them; a listed one shares the first letter or an end."""
    for b in batches:
        rows = []
        for r in b.itertuples():
            g, own = r.given, (r.fam, r.given, r.person, r.patient)
            rows += [(*own, "given", k) for k in {*(f"^{g[:i]}" for i in range(1, len(g) + 1)), *(f"{g[i:]}$" for i in range(0, len(g) - 2))}]
            bases = {g[: -len(e)] for e in ENDINGS if g.endswith(e) and len(g) > len(e)}
            rows += [(*own, "nick", k) for k in {f"^{g}", *(f"^{x}" for x in bases), *(f"{x}$" for x in bases if len(x) > 2)}]
        yield pd.DataFrame(rows, columns=["fam", "given", "person", "patient", "side", "key"])


#: Edits that one misspelling makes, by the length of the shorter name: of a given name, and of a family or organisation.
GIVEN_EDITS, FAMILY_EDITS = [(1, 1), (5, 2)], [(1, 1), (SHORT, 2)]


def recurring_slips(known: DataFrame) -> DataFrame:
    """(g, meant) of the forms of known (g, d, usual, l) that aren't listed and misspell one that TIMES as many dossiers use as a
    given name; meant is its number of dossiers."""
    pairs = near_pairs(known.filter(F.col("d") >= COMMON).select(F.lit(0).alias("all"), F.col("g").alias("s")), ["all"], limits=GIVEN_EDITS)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    forms = known.filter("not l").select(F.col("g").alias("a"), F.col("d").alias("da"))
    return both.join(forms, "a").join(known.select(F.col("g").alias("b"), "usual"), "b").filter(F.col("usual") >= F.col("da") * TIMES).groupBy(F.col("a").alias("g")).agg(F.max("usual").alias("meant"))


def name_entities(names: DataFrame, settings: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(name_id, settings_id, entity) of every distinct name_id with a name and a dossier."""
    rows = names.select("name_id", F.col("settings_id").cast("long").alias("settings_id"), "field", "name")
    rows = rows.filter("name_id is not null and settings_id is not null and trim(name) != ''").dropDuplicates(["name_id"])
    patients = settings.filter("settings_id is not null").groupBy("settings_id").agg(F.max_by("first_name", F.struct(F.col("first_name").isNotNull(), F.col("saved_at"))).alias("first_name"))
    fold_sql = lambda c: F.lower(F.translate(F.regexp_replace(c, r"[\s.\-]+", ""), "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÉÈÊËÀÂÄÁÇÏÎÖÔÜÛ", "aaaaaaceeeeiiiinooooouuuuyyEEEEAAAACIIOOUU"))
    # spellings; a last_name record is the patient with the dossier's first name
    spelled = rows.filter("field is null or field != 'last_name'").select("settings_id", "name").distinct()
    parsed = spelled.mapInPandas(_parsed, _SCHEMA)
    own = rows.filter("field = 'last_name'").select("settings_id", "name").distinct().mapInPandas(_family_only, "settings_id long, name string, family string")
    own = own.join(patients, "settings_id", "left").select("settings_id", F.concat(F.lit("\u0001"), F.col("name")).alias("name"), F.lit("p").alias("kind"), "family", F.coalesce(fold_sql(F.col("first_name")), F.lit("")).alias("given"), F.lit("").alias("initials"), F.lit(-1).alias("ord"))
    read = materialize(parsed.unionByName(own))

    # the words that several dossiers use as given names
    listed = nicknames.select(fold_sql(F.col("given_name")).alias("g")).unionByName(nicknames.select(fold_sql(F.col("nickname")).alias("g"))).distinct().withColumn("l", F.lit(True))
    used = read.filter("kind = 'p' and given != ''").groupBy(F.col("given").alias("g")).agg(F.countDistinct("settings_id").alias("d"), F.countDistinct(F.when(F.col("ord") != 2, F.col("settings_id"))).alias("usual"))
    known = materialize(used.join(listed, "g", "full").filter((F.col("d") >= COMMON) | F.col("l")).select("g", F.coalesce("d", F.lit(1)).alias("d"), F.coalesce("usual", F.lit(0)).alias("usual"), F.col("l").isNotNull().alias("l")))
    # a misspelling counts as the name it stands for when the order is decided
    known = materialize(known.join(recurring_slips(known), "g", "left").select("g", F.coalesce("meant", "d").alias("d"), F.col("meant").isNull().alias("itself")))
    read = read.join(known, read.given == known.g, "left").withColumn("d", F.coalesce("d", F.lit(0))).drop("g")
    most = F.max("d").over(Window.partitionBy("settings_id", "name"))
    read = materialize(read.withColumn("most", most).filter((F.col("ord") <= 0) | (F.col("d") == F.col("most"))).withColumn("common", F.coalesce("itself", F.lit(False))).drop("d", "most", "itself"))

    # families and organisations
    group = ["settings_id", "kind"]
    strings = read.select(*group, F.col("family").alias("s")).distinct()
    key = lambda c: F.concat_ws("\u0001", "settings_id", "kind", c)
    close = near_pairs(strings, group, limits=FAMILY_EDITS)
    roots = components(close.select(key("a").alias("a"), key("b").alias("b")))
    read = read.withColumn("node", key("family")).join(roots, "node", "left").withColumn("fam", F.coalesce("root", "node")).drop("root", "node")
    read = materialize(read)

    # given names of a family: common ones stand for themselves, others for the nearest common one, else for each other
    people = read.filter("kind = 'p' and given != ''").groupBy("fam", "given").agg(F.max("common").alias("common"), F.max(F.col("ord") == -1).alias("patient"))
    pairs = near_pairs(people.select("fam", F.col("given").alias("s")), ["fam"], limits=GIVEN_EDITS)
    both = pairs.select("fam", "a", "b", "edits").unionByName(pairs.select("fam", F.col("b").alias("a"), F.col("a").alias("b"), "edits"))
    flag = people.select("fam", F.col("given").alias("a"), F.col("common").alias("ca"), F.col("patient").alias("pa"))
    flags = flag.select("fam", F.col("a").alias("b"), F.col("ca").alias("cb"), F.col("pa").alias("pb"))
    both = both.join(flag, ["fam", "a"]).join(flags, ["fam", "b"])
    to_common = both.filter("not ca and (cb or pb) and not pa").groupBy("fam", "a").agg(F.min_by("b", F.struct("edits", "b")).alias("b"))
    rare = both.filter("not ca and not cb").join(to_common, ["fam", "a"], "left_anti").join(to_common.select("fam", F.col("a").alias("b")), ["fam", "b"], "left_anti").select("fam", "a", "b")
    gkey = lambda c: F.concat_ws("\u0002", "fam", c)
    groots = components(to_common.unionByName(rare).select(gkey("a").alias("a"), gkey("b").alias("b")))
    people = people.withColumn("node", gkey("given")).join(groots, "node", "left").withColumn("person", F.coalesce("root", "node")).select("fam", "given", "common", "patient", "person")
    people = materialize(people)

    # nicknames stand for the person of the family they fit
    keys = people.mapInPandas(_nick_keys, "fam string, given string, person string, patient boolean, side string, key string")
    short = keys.filter("side = 'nick'").select("fam", "key", F.col("given").alias("nick"), F.col("person").alias("nick_person"))
    pair = short.join(keys.filter("side = 'given'").drop("side"), ["fam", "key"]).filter("nick_person != person").drop("key").distinct()
    inlist = nicknames.select(fold_sql(F.col("nickname")).alias("nick"), fold_sql(F.col("given_name")).alias("given")).distinct().withColumn("listed", F.lit(True))
    pair = pair.join(F.broadcast(inlist), ["nick", "given"], "left").filter(F.col("listed") | _fits("nick", "given"))
    one = pair.groupBy("fam", "nick_person").agg(F.countDistinct("person").alias("n"), F.first("person").alias("target"), F.max(F.when(F.col("patient"), F.col("person"))).alias("own"))
    one = one.withColumn("target", F.when(F.col("n") == 1, F.col("target")).otherwise(F.col("own"))).filter("target is not null").select(F.col("nick_person").alias("a"), F.col("target").alias("b"))
    nroots = materialize(components(one)) if not one.isEmpty() else None
    if nroots is not None:
        people = people.join(nroots, people.person == nroots.node, "left").withColumn("person", F.coalesce("root", "person")).drop("node", "root")
    people = materialize(people)
    persons = people.groupBy("fam", "person").agg(F.max("patient").alias("patient"), F.collect_set(F.when(F.col("common") | F.col("patient"), F.substring("given", 1, 1))).alias("firsts"), F.collect_set(F.substring("given", 1, 1)).alias("all_firsts"))

    # initials and family names alone
    loose = read.filter("kind = 'p' and given = ''").select("settings_id", "name", "fam", "initials", "ord").distinct()
    letters = persons.select("fam", "person", "patient", F.explode(F.array_append(F.when(F.size("firsts") > 0, F.col("firsts")).otherwise(F.col("all_firsts")), F.lit(""))).alias("letter"))
    picked = letters.groupBy("fam", "letter").agg(F.count("*").alias("n"), F.first("person").alias("only"), F.max(F.when(F.col("patient"), F.col("person"))).alias("own"))
    picked = picked.select("fam", "letter", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("own")).alias("person"))
    loose = loose.withColumn("letter", F.substring("initials", 1, 1)).join(picked, ["fam", "letter"], "left").select("settings_id", "name", F.coalesce("person", F.concat_ws("\u0003", "fam", "initials")).alias("entity"), F.lit(1).alias("rank"))
    full = read.filter("kind = 'p' and given != ''").join(people.select("fam", "given", "person"), ["fam", "given"]).select("settings_id", "name", F.col("person").alias("entity"), F.when(F.col("ord") == 2, 3).otherwise(2).alias("rank"))
    orgs = read.filter("kind != 'p'").select("settings_id", "name", F.col("fam").alias("entity"), F.lit(0).alias("rank"))
    # a spelling of open order is the reading that more spellings share
    every = loose.unionByName(full).unionByName(orgs)
    sizes = every.groupBy("entity").agg(F.countDistinct("name").alias("n"))
    every = every.join(sizes, "entity").groupBy("settings_id", "name").agg(F.max_by("entity", F.struct("n", -F.col("rank"), "entity")).alias("entity"))
    named = rows.withColumn("name", F.when(F.col("field") == "last_name", F.concat(F.lit("\u0001"), F.col("name"))).otherwise(F.col("name")))
    return named.join(every, ["settings_id", "name"], "left").select("name_id", "settings_id", F.coalesce("entity", F.concat_ws("\u0004", "settings_id", "name")).alias("entity"))


def _family_only(batches):
    for b in batches:
        b = b.assign(family=[squash(re.sub(r"^[\s\-*•–·]+", "", n)) for n in b["name"]])
        yield b[b["family"] != ""][["settings_id", "name", "family"]]


def linked_pairs(entities: DataFrame) -> DataFrame:
    a, b = (entities.select("entity", F.col("name_id").alias(f"name_id_{s}")) for s in "ab")
    return a.join(b, "entity").filter("name_id_a < name_id_b").select("name_id_a", "name_id_b")


def _of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(name_entities(*(table(spark, sf_dir, t) for t in ("name_records", "patient_settings", "given_nicknames"))))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every linked name record with its class: the least name_id of the entity and the entity's number of records."""
    e = _of(spark, sf_dir)
    least = e.groupBy("entity").agg(F.min("name_id").alias("entity_id"), F.count("*").alias("n_records"))
    return e.join(least, "entity").select("name_id", "settings_id", "entity_id", "n_records")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_pairs(_of(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_entities": p5_entities}
