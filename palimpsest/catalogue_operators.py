"""More queries of the core: one for each operator that catalogue.py doesn't run, with the SQL that states the same.

Values that the SQL needs (lists, formats) are written out in it, so that a wrong table of ours fails the comparison.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalogue import TEST_SECRET, WS, query
from palimpsest.functions import dates, keyed, names, text
from palimpsest.operators import cleanup, corpus, documents, export, html, recognise, spans
from palimpsest.plans.session import materialize, spread, table
from palimpsest.sources import files
from palimpsest.streaming import flow

_EDGE = rf"[\n{WS}]"
_STRIP = rf"'^{_EDGE}+|{_EDGE}+$', '', 'g'"


def _latest(spark, d, *columns):
    """The rows of imported documents that arrived last."""
    rows = table(spark, d, "imported_documents").select("id", *columns, "arrived_at")
    return flow.latest_per_key(rows, "id", ["arrived_at"]).drop("arrived_at")


_LATEST = "(select * from (select *, row_number() over (partition by id order by arrived_at desc) as k from imported_documents) where k = 1)"

# sources


@query(rf"""
select distinct doc_id, md5(text) as decoded from documents where text is not null""")
def decoded_texts(spark, d):
    """Texts written as bytes, in Latin-1 where they fit it and aren't UTF-8 by chance, and decoded again."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    one_byte = F.col("text").rlike(r"\A[\x00-\x7f\x{a0}-\x{ff}]*\z") & F.col("text").rlike(r"[\x{e0}-\x{ff}][\x00-\x7f]")
    content = F.when(one_byte, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return t.select("doc_id", F.md5(files.decode(content)).alias("decoded")).distinct()


@query(rf"""
with a as (select distinct regexp_replace(text, {_STRIP}) as raw_text from documents where text is not null)
select sha256(raw_text) as id, 'paste' as source_kind, 'Pasted text' as display_name, 'pending' as status, cast(length(raw_text) as integer) as n from a where raw_text <> ''""")
def pasted_documents(spark, d):
    return files.pasted(table(spark, d, "documents")).select("id", "source_kind", "display_name", "status", F.length("raw_text").alias("n")).distinct()


@query("""
select name || '.parquet' as display_name, 'error' as status, 'The file type is not supported.' as error_message from (values ('backend_annotations'), ('custom_address_lines'), ('customer'), ('documents'), ('embeddings'), ('events'),
  ('given_nicknames'), ('imported_documents'), ('lineitem'), ('localities'), ('mix_targets'), ('name_records'), ('nation'), ('orders'), ('part'), ('patient_settings'), ('processed_documents'), ('region'), ('supplier')) t(name)""")
def import_error_rows(spark, d):
    """The folder of the tables read as documents: files of a kind that isn't supported are rows with an error."""
    return files.read_documents(spark, d).select("display_name", "status", "error_message")


@query("""
select id, status, exact, error from (values ('blank-document', 'pass', false, 'The PDF does not contain readable text.'), ('multi-page-native', 'pass', true, null), ('native-simple', 'pass', true, null), ('positioned-words-spacing', 'pass', true, null),
  ('text-plus-blank-page', 'pass', true, null), ('tj-array-spacing', 'pass', true, null)) t(id, status, exact, error)""")
def pdf_corpus(spark, d):
    """The cases of the PDF corpus: files are made, read and compared with what is expected."""
    return corpus.run_cases(corpus.cases(spark, corpus.STARTER)).select("id", F.col("result.status").alias("status"), F.col("result.exact").alias("exact"), "error")


@query("select 'pass' as status, cast(6 as bigint) as n")
def pdf_corpus_counts(spark, d):
    return corpus.counts(corpus.run_cases(corpus.cases(spark, corpus.STARTER)))


@query(rf"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?|\f', chr(10), 'g'), '[{WS}]+', ' ', 'g'), '(^|\n) +| +(\n|$)', '\1\2', 'g') as t from documents where false""")
def pdf_pages_written(spark, d):
    """Documents written as PDF files and read again that don't come back with their words: none."""
    from palimpsest.sources.pdf import extract_pages, pdf_file

    t = spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"))
    # what isn't a sign on paper can't come back from it
    shown = F.regexp_replace("text", r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}]+", " ")
    made = t.select("doc_id", F.md5("text").alias("h"), shown.alias("t")).distinct()
    written = materialize(made.select(F.concat_ws("-", F.col("doc_id").cast("string"), "h").alias("id"), pdf_file(F.array("t"), F.array(F.lit(595.0)), F.array(F.lit(842.0))).alias("content")))
    read = extract_pages(written).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.col("texts")[1].alias("t")))), lambda p: p.t), "").alias("back"))
    both = made.withColumn("id", F.concat_ws("-", F.col("doc_id").cast("string"), "h")).join(read, "id", "left")
    return both.filter(text.skeleton(F.col("t")) != F.coalesce(text.skeleton(F.col("back")), F.lit(""))).select("doc_id", "t")


@query("""
select settings_id, epoch_us(saved_at) as saved, any_value(strftime(birthdate, '%Y-%m-%d')) as born,
  any_value(cast(case when date_shift_days is null or date_shift_days = 0 then null else sign(date_shift_days) * least(greatest(abs(date_shift_days), 10), 728) end as integer)) as days,
  any_value(case when mode in ('placeholders', 'smart_pseudonyms') then mode else 'placeholders' end) as mode, any_value(coalesce(deidentify_filenames, true)) as files
from patient_settings group by 1, 2""")
def loaded_settings(spark, d):
    """Settings as saved, all strings, with their types again."""
    s = table(spark, d, "patient_settings")
    lines = lambda c: F.array_join(c, "\n").alias(c)
    raw = s.select(
        "settings_id", F.unix_micros("saved_at").alias("saved"), "first_name", "last_name", F.date_format("birthdate", "d/M/yyyy").alias("birthdate"), F.col("date_shift_days").cast("string"),
        lines("other_names"), lines("custom_addresses"), F.col("deidentify_filenames").cast("string"), "mode",
    )
    done = files.load_settings(raw, keep=["settings_id", "saved"])
    return done.select("settings_id", "saved", F.col("birthdate").cast("string").alias("born"), F.col("date_shift_days").alias("days"), "mode", F.col("deidentify_filenames").alias("files")).distinct()


# scalars


@query(rf"""
with a as (select distinct settings_id, epoch_us(saved_at) as saved, nullif(regexp_replace(first_name, {_STRIP}), '') as f, nullif(regexp_replace(last_name, {_STRIP}), '') as l from patient_settings)
select settings_id, saved, concat_ws(' ', f, l) as person from a""")
def typed_persons(spark, d):
    s = table(spark, d, "patient_settings").select("settings_id", F.unix_micros("saved_at").alias("saved"), names.person_value(F.col("first_name"), F.col("last_name")).alias("person"))
    return s.distinct()


@query("""
select postcode, name_nl, coalesce(nullif(trim(name_fr), '') || ' 12, ', '12, ') || concat_ws(' ', nullif(trim(postcode), ''), nullif(trim(name_nl), '')) as place from localities""")
def typed_addresses(spark, d):
    a = table(spark, d, "localities")
    return a.select("postcode", "name_nl", names.address_value(F.col("name_fr"), F.lit(" 12 "), F.col("postcode"), F.col("name_nl")).alias("place"))


_W, _G = r"[\pL\pN]", r"[^\pL\pN]"
_PARTS = rf"""
a as (select distinct name_id, trim(regexp_replace(name, '{_EDGE}+', ' ', 'g')) as c from name_records where name is not null),
b as (select name_id, c, trim(regexp_extract(c, '^([^,]*),(.*)$', 1)) as l, trim(regexp_extract(c, '^([^,]*),(.*)$', 2)) as r, len(regexp_extract_all(c, '{_W}+')) as n from a),
p as (select name_id, c, case when l <> '' and r <> '' then r when n > 1 then regexp_extract(c, '{{rx}}', 1) else c end as g,
  case when l <> '' and r <> '' then l when n > 1 then regexp_extract(c, '{{rx}}', 2) else '' end as f from b)""".replace(
    "{rx}", rf"(?i)^(.*?{_W}.*?){_G}+((?:(?:al|bin|da|de|del|della|den|der|di|du|el|la|le|st|ter|ten|van|vande|vanden|von){_G}+|{_W}+ ?[''’`] ?)*{_W}+{_G}*)$"
)


@query(rf"""
with {_PARTS},
q as (select name_id, c, array_to_string(regexp_extract_all(g, '{_W}+'), ' ') as g, array_to_string(regexp_extract_all(f, '{_W}+'), ' ') as f from p),
v as (select name_id, case when c = '' then [] when g <> '' and f <> '' then [c, g || ' ' || f, f || ' ' || g, f || ', ' || g] else [c] end as v from q)
select name_id, array_to_string([v[i] for i in range(1, len(v) + 1) if list_position([lower(x) for x in v], lower(v[i])) = i], '|') as variants from v""")
def person_variants(spark, d):
    n = table(spark, d, "name_records").filter("name is not null").select("name_id", "name").distinct()
    return n.select("name_id", F.array_join(names.person_variants(F.col("name")), "|").alias("variants"))


@query(rf"""
with a as (select distinct addr_id, trim(regexp_replace(address, '{_EDGE}+', ' ', 'g')) as c, regexp_extract_all(address, '{_W}+') as t from custom_address_lines where address is not null),
b as (select addr_id, c, t, coalesce(list_position([i < len(t) and regexp_full_match(t[i], '\d{{4,5}}') for i in range(1, len(t) + 1)], true), 0) as k from a),
s as (select addr_id, c, t, case when k > 0 then t[1:k - 1] else t end as s, case when k > 0 then array_to_string(t[k:], ' ') else '' end as loc from b),
e as (select *, len(s) as n, len(s) > 1 and regexp_matches(s[1], '\d') and len([x for x in s[2:] if regexp_matches(x, '\pL')]) > 0 as first,
  len(s) > 1 and regexp_matches(s[len(s)], '\d') and len([x for x in s[1:len(s) - 1] if regexp_matches(x, '\pL')]) > 0 as last from s),
p as (select addr_id, c, array_to_string(t, ' ') as words, loc, case when first then array_to_string(s[2:], ' ') when last then array_to_string(s[1:n - 1], ' ') else '' end as street, case when first then s[1] when last then s[n] else '' end as nr from e),
v as (select addr_id, case when c = '' then [] when nr = '' then [c, words] when loc = '' then [c, words, street || ' ' || nr, nr || ' ' || street]
  else [c, words, street || ' ' || nr || ' ' || loc, nr || ' ' || street || ' ' || loc, street || ' ' || nr, nr || ' ' || street] end as v from p),
w as (select addr_id, [x for x in v if x <> ''] as v from v)
select addr_id, array_to_string([v[i] for i in range(1, len(v) + 1) if list_position([lower(x) for x in v], lower(v[i])) = i], '|') as variants from w""")
def address_variants(spark, d):
    a = table(spark, d, "custom_address_lines").filter("address is not null").select("addr_id", "address").distinct()
    return a.select("addr_id", F.array_join(names.address_variants(F.col("address")), "|").alias("variants"))


@query("""
with w as (select name_id, regexp_extract_all(name, '\\pL+|[^\\pL]+') as p from (select distinct name_id, name from name_records where name is not null))
select name_id, array_to_string([upper(substr(x, 1, 1)) || lower(substr(x, 2)) for x in p], '') as titled from w""")
def title_case(spark, d):
    n = table(spark, d, "name_records").filter("name is not null").select("name_id", "name").distinct()
    return n.select("name_id", text.title_case(F.col("name")).alias("titled"))


@query(rf"""
select distinct id, regexp_extract(raw_text, '^({_EDGE}*)', 1) as lead, regexp_replace(raw_text, {_STRIP}) as core from imported_documents where raw_text is not null""")
def fragment_affixes(spark, d):
    i = table(spark, d, "imported_documents").filter("raw_text is not null").select("id", text.affixes(F.col("raw_text")).alias("a"))
    return i.select("id", "a.lead", "a.core").distinct()


@query("""
select distinct id, replace(replace(replace(replace(replace(raw_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped from imported_documents where raw_text is not null""")
def escaped_texts(spark, d):
    i = table(spark, d, "imported_documents").filter("raw_text is not null")
    return i.select("id", text.html_escape(F.col("raw_text"), True).alias("escaped")).distinct()


@query("""
with a as (select distinct name_id, settings_id, regexp_replace(name, '[^ -~]', '', 'g') as n from name_records where name is not null),
l as (select settings_id, min(n) as m from a group by 1)
select name_id, round(case when length(n) = 0 and length(m) = 0 then 1.0 else 1 - levenshtein(n, m) / greatest(length(n), length(m)) end, 6) as similarity from a join l using (settings_id)""")
def name_similarity(spark, d):
    """Names beside the first one of their dossier, without what isn't ASCII, as the SQL counts bytes."""
    a = table(spark, d, "name_records").filter("name is not null").select("name_id", "settings_id", F.regexp_replace("name", r"[^ -~]", "").alias("n")).distinct()
    first = a.groupBy("settings_id").agg(F.min("n").alias("m"))
    return a.join(first, "settings_id").select("name_id", F.round(text.similarity(F.col("n"), F.col("m")), 6).alias("similarity"))


@query(rf"""
with a as (select doc_id, text, replace(text, ' ', chr(10)) as r from documents where text is not null),
g as (select doc_id, doc_id % 2 = 0 as plain_first, text, r, len([i for i in range(1, len(string_split(text, ' '))) if regexp_matches(string_split(text, ' ')[i], '[\pL\pN_]$') and regexp_matches(string_split(text, ' ')[i + 1], '^[\pL\pN_]')]) as gaps from a)
select doc_id, md5(case when regexp_replace(text, '{_EDGE}+', '', 'g') = '' then case when plain_first then text else r end when gaps > 0 or plain_first then text else r end) as best from g where text <> ''
union all select doc_id, md5('') from g where text = ''""")
def best_text(spark, d):
    """Of a text and the same with every blank as a line end, in either order and behind an empty one, the first or the better one."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", "text", F.replace("text", F.lit(" "), F.lit("\n")).alias("r"))
    either = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.array(F.lit(""), "text", "r")).otherwise(F.array(F.lit(""), "r", "text"))
    return t.select("doc_id", F.md5(text.best_candidate(either)).alias("best"))


@query("""
with s as (select settings_id, max_by(birthdate, saved_at) as b from patient_settings where birthdate is not null group by 1),
m(k, name) as (values (1, 'janvier'), (1, 'janv'), (1, 'januari'), (1, 'jan'), (2, 'fevrier'), (2, 'février'), (2, 'fevr'), (2, 'févr'), (2, 'februari'), (2, 'feb'), (3, 'mars'), (3, 'maart'), (3, 'mrt'), (4, 'avril'), (4, 'april'), (4, 'apr'), (5, 'mai'), (5, 'mei'),
  (6, 'juin'), (6, 'juni'), (6, 'jun'), (7, 'juillet'), (7, 'juli'), (7, 'jul'), (8, 'aout'), (8, 'août'), (8, 'augustus'), (8, 'aug'), (9, 'septembre'), (9, 'september'), (9, 'sept'), (9, 'sep'), (10, 'octobre'), (10, 'oktober'), (10, 'oct'), (10, 'okt'),
  (11, 'novembre'), (11, 'november'), (11, 'nov'), (12, 'decembre'), (12, 'décembre'), (12, 'december'), (12, 'dec')),
y as (select settings_id, b, unnest([strftime(b, '%d'), cast(day(b) as varchar)]) as dd from s),
v as (select settings_id, dd || ' ' || name || dot || ' ' || yy as variant from (select *, unnest([strftime(b, '%Y'), strftime(b, '%y')]) as yy from y) y join m on m.k = month(y.b), (values (''), ('.')) t(dot))
select distinct settings_id, variant from v""")
def smart_birthdate_names(spark, d):
    """Spellings of birth dates with a month's name, as they are looked for when dates are shifted."""
    s = flow.latest_per_key(table(spark, d, "patient_settings").filter("birthdate is not null").select("settings_id", "birthdate", "saved_at"), "settings_id", ["saved_at"])
    v = s.select("settings_id", F.explode(dates.birthdate_variants(F.col("birthdate"), dates.SMART_BIRTH_MONTHS)).alias("variant"))
    return v.filter(F.col("variant").rlike(r"\p{L}"))


# keyed choices

_PAD = {k: bytes(b ^ int(v, 16) for b in bytes.fromhex(TEST_SECRET).ljust(64, b"\0")).hex() for k, v in (("i", "36"), ("o", "5c"))}


def _hmac(message: str) -> str:
    return f"sha256(from_hex('{_PAD['o']}') || from_hex(sha256(from_hex('{_PAD['i']}') || encode({message}))))"


def _number(h: str, n: int, part: int = 0) -> str:
    return f"(cast(list_sum([(strpos('0123456789abcdef', substr({h}, {13 * part} + j, 1)) - 1) * (16 ** (13 - j)) for j in range(1, 14)]) as bigint) % {n})"


def _picked(values: list[str], h: str, part: int = 0) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{_number(h, len(values), part)} + 1]"


@query(f"select distinct name_id, {_hmac('name')} as mac from name_records where name is not null")
def keyed_hashes(spark, d):
    n = table(spark, d, "name_records").filter("name is not null").select("name_id", "name").distinct()
    return n.select("name_id", keyed.hmac_sha256(F.lit(TEST_SECRET), F.col("name")).alias("mac"))


@query(f"""
with s as (select settings_id, max_by(date_shift_days, saved_at) as manual, lower(concat_ws(' ', max_by(first_name, saved_at), max_by(last_name, saved_at))) as subject from patient_settings where first_name is not null and last_name is not null group by 1),
m as (select *, {_hmac("'date-shift' || chr(31) || subject")} as h from s)
select settings_id, cast(coalesce(manual, ({_number("h", 99)} + 6) * 7 * case when {_number("h", 2, 1)} = 1 then 1 else -1 end) as integer) as days from m""")
def effective_shifts(spark, d):
    """The shift of every dossier with a named patient: its own one, or the automatic one of the patient's name."""
    s = table(spark, d, "patient_settings").filter("first_name is not null and last_name is not null").groupBy("settings_id").agg(*[F.max_by(c, "saved_at").alias(c) for c in ("first_name", "last_name")], F.max_by("date_shift_days", "saved_at").alias("m"))
    auto = keyed.automatic_shift(F.lit(TEST_SECRET), F.lower(F.concat_ws(" ", "first_name", "last_name")))
    return s.select("settings_id", F.coalesce(F.col("m").cast("int"), auto).alias("days"))


_PERSON = f"array_to_string([{_picked(keyed.FIRST_NAMES, 'sha256(h || chr(31) || i)')} for i in range(1, greatest(n - 1, 1) + 1)], ' ') || case when n > 1 then ' ' || {_picked(keyed.SURNAMES, 'h')} else '' end"
_PERSON_MAC = _hmac("'person' || chr(31) || k || chr(31) || '0'")


@query(f"""
with a as (select distinct settings_id, lower(trim(regexp_replace(name, '{_EDGE}+', ' ', 'g'))) as k from name_records where field = 'last_name' and trim(name) <> ''),
b as (select settings_id, k, len(string_split(k, ' ')) as n, {_PERSON_MAC} as h from a)
select settings_id, k as name, lower({_PERSON}) as pseudonym from b""")
def family_pseudonyms(spark, d):
    """Pseudonyms of family names in lower case: a given name for one word, given names and a surname for more."""
    n = table(spark, d, "name_records").filter("field = 'last_name' and trim(name) != ''").select("settings_id", text.normalize_key(F.col("name")).alias("name")).distinct()
    return n.select("settings_id", "name", keyed.person_pseudonym(F.lit(TEST_SECRET), F.col("name")).alias("pseudonym"))


@query(f"""
with a as (select distinct settings_id, lower(trim(regexp_replace(name, '{_EDGE}+', ' ', 'g'))) as k from name_records where field = 'last_name' and regexp_matches(name, '[\\pL\\pN]')),
b as (select settings_id, k, len(string_split(k, ' ')) as n, {_PERSON_MAC} as h from a)
select settings_id, k as name, 'op bezoek bij ' || lower({_PERSON}) || ' in de week' as text from b""")
def smart_cleanup(spark, d):
    """A sentence with the patient's family name, cleaned with pseudonyms."""
    n = table(spark, d, "name_records").filter(F.col("field") == "last_name").filter(F.col("name").rlike(r"[\p{L}\p{N}]")).select("settings_id", text.normalize_key(F.col("name")).alias("name")).distinct()
    src = n.withColumn("src", F.struct(F.concat(F.lit("op bezoek bij "), F.col("name"), F.lit(" in de week")).alias("text"), F.array().cast(spans.REFERENCES).alias("references")))
    done = cleanup.cleanup(src, "src", "r", {"first_name": F.lit(None).cast("string"), "last_name": F.col("name")}, secret_hex=F.lit(TEST_SECRET), shift=F.lit(7))
    return done.select("settings_id", "name", "r.text")


@query(f"""
with a as (select distinct lower(text) as t from backend_annotations where lower(tag) in ('hospital', 'institution', 'healthcare_institution', 'ziekenhuis', 'zorginstelling')),
b as (select t, ' ' || t || ' ' as p, lower(trim(regexp_replace(t, '{_EDGE}+', ' ', 'g'))) as k from a),
l as (select t, k, p, {" + ".join(f"cast(contains(p, '{w}') as integer)" for w in ("clinique", "hopital", "hôpital", "centre", "cabinet", "maison", "sante", "santé"))} as fr,
  {" + ".join(f"cast(contains(p, '{w}') as integer)" for w in ("ziekenhuis", "kliniek", "praktijk", "zorg", "centrum", "az ", " uz", "uz "))} as nl from b),
g as (select t, fr > nl or fr = nl and strpos('13579bdf', substr(sha256(p), 2, 1)) > 0 as french, {_hmac("'institution' || chr(31) || k || chr(31) || '0'")} as h from l)
select t as text, lower(case when french then {_picked(keyed.KINDS["fr"], "h")} else {_picked(keyed.KINDS["nl"], "h")} end || ' ' || case when {_number("h", 3, 1)} = 0 then {_picked(keyed.SURNAMES, "h", 2)}
  when french then {_picked(keyed.PLACES["fr"], "h", 3)} else {_picked(keyed.PLACES["nl"], "h", 3)} end) as pseudonym from g""")
def institution_pseudonyms(spark, d):
    """Pseudonyms of institutions in lower case, in the language of their names."""
    a = table(spark, d, "backend_annotations").filter(F.lower("tag").isin(documents.INSTITUTION_TAGS)).select(F.lower("text").alias("text")).distinct()
    return a.select("text", keyed.institution_pseudonym(F.lit(TEST_SECRET), F.col("text")).alias("pseudonym"))


# recognition and spans

_RUNS = "[0-9./-]+"
_DATE = "|".join(rf"\d{{1,2}}{s}\d{{1,2}}{s}(?:\d{{4}}|\d{{2}})|\d{{4}}{s}\d{{1,2}}{s}\d{{1,2}}" for s in ("/", "-", r"\."))


@query(rf"""
with a as (select distinct id, raw_text from imported_documents where raw_text is not null),
r as (select id, unnest(regexp_extract_all(raw_text, '{_RUNS}')) as run from a),
m as (select id, regexp_extract(run, '^({_DATE})(?:$|\.$|\.[./-])', 1) as literal from r)
select id, literal, count(*) as n from m where literal <> '' group by 1, 2""")
def numeric_dates(spark, d):
    """Numeric dates of all documents, in runs of digits and separators that begin with one."""
    one = [r for r in recognise.RECOGNISERS if r.name == "date_numbers"]
    i = spread(table(spark, d, "imported_documents").filter("raw_text is not null").select("id", "raw_text").distinct())
    return i.select("id", F.explode(recognise.recognise(F.col("raw_text"), recognisers=one)).alias("s")).groupBy("id", F.col("s.text").alias("literal")).agg(F.count("*").alias("n"))


@query(rf"""
with a as (select distinct id, raw_text from imported_documents where raw_text is not null),
r as (select id, unnest(regexp_extract_all(raw_text, '{_RUNS}')) as run from a),
m as (select id, regexp_extract(run, '^({_DATE})(?:$|\.$|\.[./-])', 1) as literal from r)
select id, count(*) as n from m where literal <> '' group by 1""")
def dates_beside_phones(spark, d):
    """Numeric dates tagged as dates when identity and phone numbers are looked for in the same texts: no date is taken for a phone."""
    some = [r for r in recognise.RECOGNISERS if r.name in ("date_numbers", "national_number", "phone")]
    i = spread(table(spark, d, "imported_documents").filter("raw_text is not null").select("id", "raw_text").distinct())
    found = i.select("id", F.explode(recognise.recognise(F.col("raw_text"), recognisers=some)).alias("s"))
    return found.filter("s.tag = 'datum'").groupBy("id").agg(F.count("*").alias("n"))


@query(r"""
with a as (select distinct id, regexp_replace(raw_text, '([^\pL\pN_])', '\1\1', 'g') as t from imported_documents where raw_text is not null),
m as (select id, unnest(regexp_extract_all(t, '(^|[^\pL\pN_])((?i)\d{1,3}(?:(?:\s\s)*(?:--)?(?:\s\s)*(?:jaar|jarige|years?|ans|jahre))(?:(?:\s\s)+(?:oud|old|alt))?)($|[^\pL\pN_])', 2)) as x from a)
select id, lower(regexp_replace(x, '([^\pL\pN_])[^\pL\pN_]', '\1', 'g')) as literal, count(*) as n from m group by 1, 2""")
def ages(spark, d):
    one = [r for r in recognise.RECOGNISERS if r.name == "age"]
    i = spread(table(spark, d, "imported_documents").filter("raw_text is not null").select("id", "raw_text").distinct())
    return i.select("id", F.explode(recognise.recognise(F.col("raw_text"), recognisers=one)).alias("s")).groupBy("id", F.lower("s.text").alias("literal")).agg(F.count("*").alias("n"))


@query(r"""
with a as (select distinct id, raw_text as t from imported_documents where raw_text is not null)
select id, sum(len([w for w in regexp_extract_all(t, '[\pL\pN\pM_\x{200c}\x{200d}]+') if lower(w) in ('de', 'den', 'der', 'la', 'le', 'les')])) as n,
  sum(len(regexp_extract_all(t, '(?i)(?:^|[^\pL\pN\pM_\x{200c}\x{200d}])(?:de|den|der|la|le|les) *patient'))
  - len(regexp_extract_all(t, '(?i)(?:^|[^\pL\pN\pM_\x{200c}\x{200d}])(?:de|den|der|la|le|les)patient'))) as dropped from a group by 1""")
def spurious_articles(spark, d):
    """Articles tagged as persons, and those of them before "patient", which are dropped."""
    i = table(spark, d, "imported_documents").filter("raw_text is not null").select("id", "raw_text").distinct()
    found = i.withColumn("s", spans.regex_spans(F.col("raw_text"), r"(?iU)(?<!\w)(?:den|der|de|les|la|le)(?!\w)", "persoon"))
    return found.select("id", F.size("s").cast("decimal(38,0)").alias("n"), (F.size("s") - F.size(spans.drop_articles(F.col("raw_text"), F.col("s")))).cast("decimal(38,0)").alias("dropped"))


@query("""
with a as (select distinct document_id, annotation_id, start_char, end_char, tag, text from backend_annotations where text is not null and start_char is not null and end_char is not null)
select document_id, annotation_id, cast(row_number() over (partition by document_id order by start_char, end_char, tag, text, annotation_id) as integer) as place from a""")
def sorted_spans(spark, d):
    """Places of annotations among those of their document; equal ones in the order of their numbers."""
    a = table(spark, d, "backend_annotations").filter("text is not null and start_char is not null and end_char is not null").select("document_id", "annotation_id", "start_char", "end_char", "tag", "text").distinct()
    span = F.struct("text", "tag", F.col("start_char").alias("start"), F.col("end_char").alias("end"))
    s = a.groupBy("document_id").agg(spans.sort_spans(F.collect_list(span)).alias("s"), F.array_sort(F.collect_list(F.struct("start_char", "end_char", "tag", "text", "annotation_id"))).alias("ids"))
    same = F.arrays_zip("s", F.col("ids"))
    each = s.select("document_id", F.posexplode(same).alias("i", "x"))
    return each.filter("x.s.start = x.ids.start_char and x.s.text = x.ids.text").select("document_id", F.col("x.ids.annotation_id").alias("annotation_id"), (F.col("i") + 1).cast("int").alias("place"))


@query("""
with recursive a as (select distinct annotation_id, document_id, start_char as s, end_char as e, regexp_replace(text, '[^ -~]', '', 'g') as t, case regexp_replace(lower(trim(tag)), '[- ]', '_', 'g') when 'date' then 'DATE' when 'datum' then 'DATE' when 'person' then 'PERSON'
    when 'persoon' then 'PERSON' when 'location' then 'LOCATION' when 'locatie' then 'LOCATION' when 'hospital' then 'HOSPITAL' when 'ziekenhuis' then 'HOSPITAL' when 'institution' then 'INSTITUTION' when 'healthcare_institution' then 'INSTITUTION' when 'zorginstelling' then 'INSTITUTION'
    when 'age' then 'AGE' when 'leeftijd' then 'AGE' else upper(regexp_replace(lower(trim(tag)), '[- ]', '_', 'g')) end as name from backend_annotations where text is not null and start_char is not null and end_char is not null),
o as (select *, row_number() over (partition by document_id, name order by e, s, t, annotation_id) as i from a where name <> 'PATIENT'),
f(document_id, name, i, annotation_id, n, seen) as (
  select document_id, name, i, annotation_id, 1, [{'t': t, 'n': 1}] from o where i = 1
  union all
  select o.document_id, o.name, o.i, o.annotation_id,
    coalesce([x.n for x in f.seen if damerau_levenshtein(x.t, o.t) <= 1][1], list_max([x.n for x in f.seen]) + 1),
    list_append(f.seen, {'t': o.t, 'n': coalesce([x.n for x in f.seen if damerau_levenshtein(x.t, o.t) <= 1][1], list_max([x.n for x in f.seen]) + 1)})
  from f join o on o.document_id = f.document_id and o.name = f.name and o.i = f.i + 1)
select document_id, name, cast(n as integer) as n, count(*) as uses from f group by all""")
def annotation_numbering(spark, d):
    """How often each number is used by the annotations of a document, without what isn't ASCII, as the SQL counts bytes."""
    a = table(spark, d, "backend_annotations").filter("text is not null and start_char is not null and end_char is not null").select("annotation_id", "document_id", "start_char", "end_char", "text", "tag").distinct()
    a = a.select("document_id", F.struct(F.regexp_replace("text", "[^ -~]", "").alias("text"), "tag", F.col("start_char").alias("start"), F.col("end_char").alias("end")).alias("s"))
    each = a.groupBy("document_id").agg(spans.numbered(F.collect_list("s")).alias("n")).select("document_id", F.explode("n").alias("x")).filter("x.replacement != '[PATIENT]'")
    return each.groupBy("document_id", spans.placeholder_name(F.col("x.tag")).alias("name"), F.regexp_extract("x.replacement", r"-(\d+)\]$", 1).cast("int").alias("n")).agg(F.count("*").alias("uses"))


@query("""
with a as (select distinct annotation_id, document_id, start_char as s, end_char as e, text as t from backend_annotations where text is not null and start_char is not null and end_char is not null),
i as (select distinct id, raw_text from imported_documents where raw_text is not null),
o as (select document_id, s, max(e) as e from a group by 1, 2),
k as (select *, coalesce(max(e) over (partition by document_id order by s rows between unbounded preceding and 1 preceding), -1) as reach from o),
h as (select document_id, s, e, row_number() over (partition by document_id order by s) as r, lag(e, 1, 0) over (partition by document_id order by s) as p from k where reach <= s)
select h.document_id as id, string_agg(substr(raw_text, p + 1, s - p) || '[X]', '' order by r) || substr(any_value(raw_text), max(e) + 1) as shown from h join i on i.id = h.document_id group by 1""")
def rendered_marks(spark, d):
    """Documents with a mark in place of every annotation that doesn't begin in an earlier one."""
    a = table(spark, d, "backend_annotations").filter("text is not null and start_char is not null and end_char is not null")
    o = a.groupBy("document_id", "start_char").agg(F.max("end_char").alias("end_char"))
    s = o.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end")))).alias("s"))
    free = F.aggregate("s", F.array().cast("array<struct<start:int,end:int,replacement:string,reach:int>>"), lambda acc, x: F.array_append(acc, F.struct(x.start.alias("start"), x.end.alias("end"), F.when(F.coalesce(F.try_element_at(acc, F.lit(-1)).reach, F.lit(-1)) <= x.start, "[X]").alias("replacement"), F.greatest(x.end, F.coalesce(F.try_element_at(acc, F.lit(-1)).reach, F.lit(-1))).alias("reach"))))
    i = table(spark, d, "imported_documents").filter("raw_text is not null").select("id", "raw_text").distinct()
    both = i.join(s.withColumn("n", F.filter(free, lambda x: x.replacement.isNotNull())), F.col("id") == F.col("document_id"))
    return both.select("id", spans.render(F.col("raw_text"), F.col("n")).alias("shown"))


@query("""
with p as (select distinct document_id, generation, output_text as t, unnest([r.replacement for r in placeholder_references]) as r from processed_documents where output_text is not null),
q as (select distinct * from p where r <> ''),
s as (select document_id, generation, r, string_split(t, r) as parts from q)
select document_id, generation, r as shown, cast(list_sum([length(x) for x in parts[1:i]]) + (i - 1) * length(r) as integer) as start_char from (select *, unnest(range(1, len(parts))) as i from s)""")
def highlight_ranges(spark, d):
    """Every place of every replacement in the outputs."""
    p = table(spark, d, "processed_documents").filter("output_text is not null").select("document_id", "generation", "output_text", "placeholder_references").distinct()
    h = p.select("document_id", "generation", F.explode(spans.highlights(F.col("output_text"), F.filter("placeholder_references", lambda r: r.replacement != ""))).alias("h"))
    return h.select("document_id", "generation", F.col("h.text").alias("shown"), F.col("h.start").alias("start_char")).distinct()


@query("""
with p as (select distinct document_id, generation, output_text as t, length(output_text) // 2 as mid, unnest([r.replacement for r in placeholder_references]) as r from processed_documents where output_text is not null),
s as (select document_id, generation, mid, r, string_split(t, r) as parts from p where r <> ''),
h as (select document_id, generation, mid, r, list_sum([length(x) for x in parts[1:i]]) + (i - 1) * length(r) as s from (select *, unnest(range(1, len(parts))) as i from s))
select document_id, generation, max(length(r)) as length from h where s <= mid and mid < s + length(r) group by 1, 2""")
def covering_ranges(spark, d):
    """The longest replacement over the middle of each output."""
    p = table(spark, d, "processed_documents").filter("output_text is not null").select("document_id", "generation", "output_text", "placeholder_references").distinct()
    places = spans.highlights(F.col("output_text"), F.filter("placeholder_references", lambda r: r.replacement != ""))
    c = p.select("document_id", "generation", export.covering(places, F.floor(F.length("output_text") / 2)).alias("c"))
    return c.filter("c is not null").groupBy("document_id", "generation").agg(F.max(F.length("c.text")).cast("long").alias("length"))


# rewriting

_WORDS = r"regexp_extract_all(t, '[\pL\pN\pM_\x{200c}\x{200d}]+')"


@query(rf"""
with a as (select distinct doc_id, text as t from documents where text is not null)
select doc_id, cast(len([w for w in {_WORDS} if lower(w) = 'toestel']) as integer) as patients, cast(len([w for w in {_WORDS} if lower(w) = 'dosis']) as integer) as persons, cast(len([w for w in {_WORDS} if lower(w) = 'staalnummer']) as integer) as places from a""")
def literal_cleanup(spark, d):
    """How often three configured words are replaced: as the patient, another person and an address."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", "text").distinct().withColumn("src", F.struct("text", F.array().cast(spans.REFERENCES).alias("references")))
    own = {"first_name": F.lit(None).cast("string"), "last_name": F.lit("toestel"), "other_names": F.array(F.lit("Dosis")), "custom_addresses": F.array(F.lit("staalnummer"))}
    done = cleanup.cleanup(t, "src", "r", own)
    more = lambda rx: F.regexp_count("r.text", F.lit(rx)) - F.regexp_count("text", F.lit(rx))
    return done.select("doc_id", more(r"\[PATIENT\]").alias("patients"), more(r"\[PERSON-\d+\]").alias("persons"), more(r"\[LOCATION-\d+\]").alias("places"))


@query(r"""
with a as (select distinct id, regexp_replace(display_name, '^(.+)\.[^.]*$', '\1') as t from imported_documents where display_name is not null)
select id, cast(len([w for w in regexp_extract_all(t, '[\pL\pN]+') if lower(w) in ('verslag', 'scan')]) as integer) as n from a""")
def filename_cleanup(spark, d):
    """How often two configured words are replaced in file names, where an underscore ends a word."""
    i = table(spark, d, "imported_documents").filter("display_name is not null").select("id", export.source_stem(F.col("display_name")).alias("t")).distinct()
    src = i.withColumn("src", F.struct(F.col("t").alias("text"), F.array().cast(spans.REFERENCES).alias("references")))
    done = cleanup.cleanup(src, "src", "r", {"first_name": F.lit("scan"), "last_name": F.lit("Verslag")}, name_like=True)
    return done.select("id", F.regexp_count("r.text", F.lit(r"\[PATIENT\]")).alias("n"))


_OFF = {g: False for g in recognise.GROUPS}


@query(rf"""
with a as (select distinct doc_id, text, regexp_matches(text, '[^\n{WS}]') as f, replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' ') as t from documents where text is not null),
b as (select doc_id, text, f, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '[{WS}]*\n[{WS}]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') as t from a)
select doc_id, case when f then regexp_replace(t, '^[\n{WS}]+|[\n{WS}]+$', '', 'g') else text end as text from b""")
def unrecognised_documents(spark, d):
    """Documents processed with every group off and nothing configured: normalised, blank ones as they are."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", "text").distinct()
    return documents.deidentify(t, "text", "r", flags=_OFF).select("doc_id", "r.text")


@query("select distinct id, raw_text as text from imported_documents where source_kind = 'html' and raw_text is not null")
def html_passed_on(spark, d):
    """HTML processed with every group off: the page as it was, its tags and attributes as they stand."""
    i = spread(table(spark, d, "imported_documents").filter("source_kind = 'html' and raw_text is not null").select("id", "raw_text").distinct())
    return documents.deidentify_html(i, "raw_text", "r", ["id"], flags=_OFF).select("id", "r.text")


@query(f"""
select id as document_id, case when coalesce(regexp_matches(raw_text, '[^\\n{WS}]'), false) then 'ready' else 'error' end as status,
  case when coalesce(regexp_matches(raw_text, '[^\\n{WS}]'), false) then null else 'The document has no text.' end as error_message from {_LATEST}""")
def document_status(spark, d):
    return documents.process_documents(table(spark, d, "imported_documents")).select("document_id", "status", "error_message")


@query(rf"""
with a as (select id, pdf_pages, raw_text from {_LATEST} where source_kind = 'pdf' and len(pdf_pages) > 0 and regexp_matches(raw_text, '[^\n{WS}]'))
select id as document_id, cast(len(pdf_pages) as integer) as n_pages, cast(len([p for p in pdf_pages if regexp_matches(coalesce(p.text, ''), '[^\n{WS}]')]) as integer) as n_full from a""")
def paged_documents(spark, d):
    """Paged documents keep their pages, blank ones too."""
    p = _latest(spark, d, "source_kind", "raw_text", "pdf_pages").filter("source_kind = 'pdf' and size(pdf_pages) > 0").filter(~F.col("raw_text").rlike(documents.BLANK)).withColumn("pages", F.col("pdf_pages.text"))
    done = documents.deidentify_pages(p, "pages", "r", flags=_OFF)
    return done.select(F.col("id").alias("document_id"), F.size("r.pages").alias("n_pages"), F.size(F.filter("r.pages", lambda x: x != "")).alias("n_full"))


# export

_SAFE = """case when upper(s) in ('CON', 'PRN', 'AUX', 'NUL', 'COM1', 'COM2', 'COM3', 'COM4', 'COM5', 'COM6', 'COM7', 'COM8', 'COM9', 'LPT1', 'LPT2', 'LPT3', 'LPT4', 'LPT5', 'LPT6', 'LPT7', 'LPT8', 'LPT9') then s || '-file' else s end"""


@query(rf"""
with a as (select distinct id, source_kind, path, display_name, regexp_replace(display_name, '^(.+)\.[^.]*$', '\1') as s from imported_documents),
b as (select *, regexp_replace(regexp_replace(regexp_replace(strip_accents(s), '[^\x00-\x7f]', '', 'g'), '[^A-Za-z0-9._-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g') as c from a),
e as (select id, source_kind, display_name, lower(regexp_extract(path, '(\.[^./]+)$', 1)) as own, case when c = '' then 'document' else c end as s from b)
select id, case when source_kind = 'paste' then display_name else {_SAFE} || case when source_kind = 'html' and own <> '' then own when source_kind = 'pdf' then '.pdf' else '.txt' end end as export_name from e""")
def export_names(spark, d):
    i = table(spark, d, "imported_documents").select("id", "source_kind", "path", "display_name", "raw_text").distinct()
    return export.export_name(i, F.lit(False), F.lit(False), F.lit(False)).select("id", "export_name").distinct()


@query("""
select distinct i.id, i.source_kind, p.generation, p.output_text as shown from imported_documents i join (select * from (select *, row_number() over (partition by document_id order by generation desc) as k from processed_documents) where k = 1) p on p.document_id = i.id""")
def rendered_exports(spark, d):
    docs = table(spark, d, "imported_documents").select("id", "source_kind").distinct()
    both = export.exported(docs, table(spark, d, "processed_documents").distinct())
    return both.select("id", "source_kind", "generation", export.render_output(F.col("source_kind"), F.col("output_text"), F.lit(False)).alias("shown"))


@query(f"""
with p as (select document_id, max_by(output_text, generation) as o from processed_documents group by 1)
select i.id, md5(coalesce(p.o, case when i.error_message is not null then concat_ws(chr(10) || chr(10), i.error_message, i.raw_text) end, i.raw_text, '')) as shown from {_LATEST} i left join p on p.document_id = i.id""")
def shown_texts(spark, d):
    p = table(spark, d, "processed_documents").groupBy(F.col("document_id").alias("id")).agg(F.max_by("output_text", "generation").alias("o"))
    both = _latest(spark, d, "raw_text", "error_message").join(p, "id", "left")
    return both.select("id", F.md5(export.shown_text(F.col("o"), F.col("raw_text"), F.col("error_message"))).alias("shown"))


@query(f"""
select id, p.document_id is not null and status <> 'processing' and source_kind is not null and source_kind <> 'paste' as can_export from {_LATEST} i left join (select distinct document_id from processed_documents) p on p.document_id = i.id""")
def exportable(spark, d):
    """May be exported: processed, nothing under way, and here no pasted text."""
    p = table(spark, d, "processed_documents").select(F.col("document_id").alias("id")).distinct().withColumn("done", F.lit(True))
    both = _latest(spark, d, "source_kind", "status").join(p, "id", "left")
    return both.select("id", flow.can_export(F.coalesce("done", F.lit(False)), F.col("status") == "processing", F.col("source_kind").isNull(), F.col("source_kind") == "paste").alias("can_export"))


@query("""
with a as (select distinct id, source_kind, display_name, 'x-' || display_name as e from imported_documents where display_name is not null)
select id, case when source_kind = 'paste' then e else e || ' (' || display_name || ')' end as shown from a""")
def report_names(spark, d):
    i = table(spark, d, "imported_documents").filter("display_name is not null").select("id", "source_kind", "display_name").distinct()
    return i.select("id", export.report_name(F.concat(F.lit("x-"), F.col("display_name")), F.col("display_name"), F.col("source_kind"), F.lit(True)).alias("shown"))


@query("""
with s as (select distinct settings_id, epoch_us(saved_at) as saved, mode, case when date_shift_days <> 0 then cast(sign(date_shift_days) * least(greatest(abs(date_shift_days), 10), 728) as integer) end as m from patient_settings)
select settings_id, saved, case when mode = 'smart_pseudonyms' then case when m is null then 'Date shift: +21 days (auto)' else 'Date shift: ' || case when m >= 0 then '+' else '' end || m || ' days (manual)' end else 'Date shift: Not used' end as line from s""")
def date_shift_lines(spark, d):
    s = table(spark, d, "patient_settings").select("settings_id", F.unix_micros("saved_at").alias("saved"), "mode", "date_shift_days").distinct()
    return s.select("settings_id", "saved", export.date_shift_line(F.col("mode"), dates.safe_shift(F.col("date_shift_days")), F.lit(21)).alias("line"))


@query(r"""
with i as (select distinct id, status, error_message from imported_documents), l as (select document_id, max_by(placeholder_references, generation) as refs from processed_documents group by 1),
d as (select i.id, refs from i join l on l.document_id = i.id), r as (select unnest(refs) as r from d),
m as (select '- ' || unnest(r.originals) || ' => ' || r.replacement as line from r where not regexp_full_match(r.replacement, '\[[A-Z][A-Z0-9_+]*(-\d+)?\]')),
x as (select 'Exported' as section, '- ' || id as line from d union all select 'Skipped', '- ' || id || ': ' || case when status = 'error' then coalesce(error_message, 'The import failed.') else 'Not processed.' end from i where id not in (select document_id from l) union all select 'Mappings', line from m),
e(section) as (values ('Exported'), ('Skipped'), ('Mappings'))
select e.section, coalesce(x.line, '- None') as line from e left join x on x.section = e.section""")
def export_report(spark, d):
    docs = table(spark, d, "imported_documents").select("id", "status", "error_message").distinct()
    p = table(spark, d, "processed_documents")
    done = export.exported(docs, p).select(F.col("id").alias("shown"), F.col("placeholder_references").alias("references"))
    return export.report_table(done, export.skipped(docs, p).select(F.col("id").alias("shown"), "reason"))


@query(r"""
with r as (select distinct document_id, generation, unnest(placeholder_references) as r from processed_documents)
select distinct document_id, generation, case when regexp_full_match(r.replacement, '\[[A-Z][A-Z0-9_+]*(-\d+)?\]') then 'Placeholder for: ' else 'Pseudonym for: ' end || array_to_string(r.originals, '; ') as tip from r""")
def tooltips(spark, d):
    p = table(spark, d, "processed_documents").select("document_id", "generation", F.explode("placeholder_references").alias("r"))
    return p.select("document_id", "generation", export.tooltip(F.col("r.replacement"), F.col("r.originals")).alias("tip")).distinct()


@query("""
with a as (select doc_id, row_number() over (order by doc_id) as n from documents)
select doc_id, 'pasted-' || case when n < 1000 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end || '.txt' as export_name from a""")
def pasted_numbers(spark, d):
    return export.pasted_names(table(spark, d, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "export_name")


@query(r"""
with a as (select distinct id, coalesce(display_name, 'pasted.txt') as name from imported_documents)
select id, name, case when k = 1 then name else regexp_replace(name, '^(.+?)(\.[^.]*)?$', '\1-' || k || '\2') end as unique_name
from (select id, name, row_number() over (partition by name order by id) as k from a)""")
def unique_real_names(spark, d):
    """The documents' own names; pasted texts share one."""
    i = table(spark, d, "imported_documents").select("id", F.coalesce("display_name", F.lit("pasted.txt")).alias("name")).distinct()
    return export.unique_names(i, "name", ["id"]).select("id", "name", "unique_name")


# versions and streams


@query(f"""
with r as (select document_id, max_by(output_text, generation) as o from processed_documents group by 1)
select i.id, case when r.document_id is not null then 'ready' else i.status end as status, case when r.document_id is not null then null else i.error_message end as error_message, md5(r.o) as output from {_LATEST} i left join r on r.document_id = i.id""")
def merged_results(spark, d):
    res = table(spark, d, "processed_documents").groupBy("document_id").agg(F.max_by("output_text", "generation").alias("output_text")).withColumn("error_message", F.lit(None).cast("string"))
    return flow.merge_results(_latest(spark, d, "status", "error_message"), res).select("id", "status", "error_message", F.md5("output_text").alias("output"))


@query("""
with g as (select document_id, max(generation) as generation from processed_documents group by 1)
select distinct p.document_id, p.generation from processed_documents p join g on g.document_id = p.document_id and g.generation = p.generation where p.document_id in (select id from imported_documents)""")
def current_generation(spark, d):
    """Results for the current generation of documents that still exist."""
    p = table(spark, d, "processed_documents").select("document_id", "generation")
    now = p.groupBy(F.col("document_id").alias("id")).agg(F.max("generation").alias("generation"))
    kept = table(spark, d, "imported_documents").select("id").distinct().join(now, "id")
    return flow.current_results(p, kept).distinct()


@query(f"""
select id, case when raw_text is not null and settings_id = 1 then 'pending' else status end as status, cast(1 + cast(raw_text is not null and coalesce(settings_id = 1, false) as integer) as integer) as generation from {_LATEST}""")
def reset_documents(spark, d):
    """After a change of dossier 1 its documents with a text are pending again."""
    i = _latest(spark, d, "raw_text", "settings_id", "status").withColumn("generation", F.lit(1))
    return flow.reset(i, F.coalesce(F.col("settings_id") == 1, F.lit(False))).select("id", "status", "generation")


@query("select distinct id from imported_documents where id not in (select document_id from processed_documents)")
def remaining_documents(spark, d):
    """Documents that are left when those with a result are removed."""
    return flow.without_removed(table(spark, d, "imported_documents").select("id").distinct(), table(spark, d, "processed_documents").select(F.col("document_id").alias("id")))


@query("select document_id, max(generation) as generation, cast(length(max_by(output_text, generation)) as integer) as n from processed_documents group by 1")
def streamed_latest(spark, d):
    """Results as a stream in one run: the newest of each document is processed and written."""
    from palimpsest.plans.session import shared_dir, streamed
    import uuid

    at = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    stream = streamed(spark, d, "processed_documents")
    done = lambda b: b.select("document_id", "generation", F.length("output_text").alias("n"))
    flow.run(stream, done, lambda b, n: b.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/checkpoint", key="document_id").awaitTermination()
    # the newest of all batches, however many the files came in
    return flow.latest_per_key(spark.read.parquet(f"{at}/out").select("document_id", "generation", "n"), "document_id", ["generation"])


@query(f"""
select id as document_id, case when coalesce(regexp_matches(raw_text, '[^\\n{WS}]'), false) then 'ready' else 'error' end as status, cast(0 as bigint) as patients from {_LATEST}""")
def smart_documents(spark, d):
    """All imported documents with pseudonyms and shifted dates, each with the settings of its own dossier: no patient is left as a
    placeholder."""
    s = table(spark, d, "patient_settings").select("settings_id", *documents.PER_DOSSIER, "saved_at").filter("settings_id is not null")
    own = flow.latest_per_key(s, "settings_id", ["saved_at"]).withColumn("date_shift_days", dates.safe_shift(F.col("date_shift_days")).cast("int"))
    done = documents.process_documents(table(spark, d, "imported_documents"), secret_hex=F.lit(TEST_SECRET), given=table(spark, d, "given_nicknames"), dossiers=own)
    return done.select("document_id", "status", F.coalesce(F.regexp_count("output_text", F.lit(r"\[PATIENT\]")), F.lit(0)).cast("long").alias("patients"))


@query(r"""
with a as (select distinct id, len(pdf_pages) as n from imported_documents where source_kind = 'pdf' and len(pdf_pages) > 0)
select id, true as is_pdf, cast(n as integer) as pages from a""")
def exported_pdf_files(spark, d):
    """Files that paged documents are exported as, by their first bytes and the pages that are read from them (one sheet each here)."""
    from palimpsest.sources.pdf import extract_pages

    i = table(spark, d, "imported_documents").filter("source_kind = 'pdf' and size(pdf_pages) > 0").select("id", "source_kind", "raw_text", "pdf_pages").dropDuplicates(["id"])
    # pages of the scans have about 60 lines, so they fit on a sheet of twice the height
    sizes = F.transform("pdf_pages", lambda p: F.struct((p.width * 2).alias("width"), (p.height * 4).alias("height")))
    made = materialize(spread(i).select("id", export.render_content(F.col("source_kind"), F.col("raw_text"), F.transform("pdf_pages", lambda p: F.coalesce(p.text, F.lit(""))), sizes, F.lit(False)).alias("content")))
    n = extract_pages(made).groupBy("id").agg(F.count("*").cast("int").alias("pages"))
    return made.select("id", (F.substring(F.decode(F.substring("content", 1, 5), "US-ASCII"), 1, 5) == "%PDF-").alias("is_pdf")).join(n, "id")
