"""Queries of the core operators over the driver's tables, and the SQL that states the same results.

A query without SQL is one that SQL can't state (parsers, ordered folds, keyed hashing); tests hold it against a
brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import dates, keyed, names, text
from palimpsest.operators import cleanup, documents, export, html, recognise, spans
from palimpsest.plans.session import by_key, spread, table
from palimpsest.sources import files
from palimpsest.streaming import flow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Spaces of text.SPACES for an engine that knows \x{..} and no Unicode classes.
WS = r"\t\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A secret for the queries below only.
TEST_SECRET = "5e" * 32


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses of all documents replaced by numbered placeholders, with what each stands for."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    found = docs.withColumn("s", recognise.recognise(F.col("text"), recognisers=[recognise.EMAIL])).withColumn("n", spans.numbered(F.col("s")))
    return found.select("doc_id", spans.render(F.col("text"), F.col("n")).alias("output_text"), spans.references_of(F.col("n")).alias("placeholder_references"))


@query(rf"""
with a as (select doc_id, replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' ') as t from documents where text is not null),
b as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '[{WS}]*\n[{WS}]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') as t from a)
select doc_id, regexp_replace(t, '^[\n{WS}]+|[\n{WS}]+$', '', 'g') as norm from b""")
def normalize_whitespace(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", text.normalize_whitespace(F.col("text")).alias("norm"))


@query(rf"""
with p as (select distinct id, unnest(pdf_pages) as page, generate_subscripts(pdf_pages, 1) as page_no from imported_documents),
a as (select distinct id, page_no, regexp_replace(regexp_replace(page.text, '\r\n?|\f', chr(10), 'g'), '[{WS}]+', ' ', 'g') as t from p where page.text is not null)
select id, cast(page_no as integer) as page_no, regexp_replace(regexp_replace(regexp_replace(t, ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\n{WS}]+|[\n{WS}]+$', '', 'g') as norm from a""")
def normalize_page_text(spark, d):
    pages = table(spark, d, "imported_documents").select("id", F.posexplode("pdf_pages").alias("i", "p")).filter("p.text is not null")
    return pages.select("id", (F.col("i") + 1).alias("page_no"), text.normalize_page_text(F.col("p.text")).alias("norm")).distinct()


@query(rf"select doc_id, regexp_replace(text, '[\n{WS}]+', '', 'g') as skeleton from documents where text is not null")
def text_skeleton(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.skeleton(F.col("text")).alias("skeleton"))


def _between(sep: str) -> str:
    return f"len(list_filter(range(1, len(string_split(text, {sep}))), lambda i: regexp_matches(string_split(text, {sep})[i], '[\\pL\\pN_]$') and regexp_matches(string_split(text, {sep})[i + 1], '^[\\pL\\pN_]')))"


@query(rf"""
select doc_id, cast(5 * {_between("' '")} - 4 * {_between("chr(10)")}
    - len(list_filter(regexp_extract_all(text, '[\pL\pN_]+'), lambda w: regexp_matches(w, '^\pL$'))) as integer) as quality
from documents where text is not null""")
def whitespace_quality(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.whitespace_quality(F.col("text")).alias("quality"))


_EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"


def _offsets(rx: str, tab: str, key: str, col: str) -> str:
    """Matches with offsets by the text between them."""
    return f"""
with a as (select {key}, {col} as t, string_split_regex({col}, '{rx}') as gaps, regexp_extract_all({col}, '{rx}') as hits from {tab} where regexp_matches({col}, '{rx}')),
b as (select {key}, unnest(range(1, len(hits) + 1)) as i, gaps, hits from a),
c as (select {key}, hits[i] as text, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as s from b)
select {key}, text, cast(s as integer) as start_char, cast(s + length(text) as integer) as end_char from c"""


@query(_offsets(_EMAIL, "documents", "doc_id", "text"))
def email_spans(spark, d):
    docs = table(spark, d, "documents").filter(F.contains("text", F.lit("@")))
    found = docs.select("doc_id", F.explode(recognise.recognise(F.col("text"), recognisers=[recognise.EMAIL])).alias("s"))
    return found.select("doc_id", F.col("s.text").alias("text"), F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"))


@query(f"""
with recursive a as (select doc_id, string_split_regex(text, '{_EMAIL}') as gaps, regexp_extract_all(text, '{_EMAIL}') as hits from documents where text is not null),
f(doc_id, i, seen, shown) as (
  select doc_id, 0, cast([] as struct(t varchar, n integer)[]), gaps[1] from a
  union all
  select f.doc_id, i + 1, list_append(seen, {{'t': hits[i + 1], 'n': coalesce([x.n for x in seen if damerau_levenshtein(x.t, hits[i + 1]) <= 1][1], coalesce(list_max([x.n for x in seen]), 0) + 1)}}),
    shown || '[EMAIL-' || coalesce([x.n for x in seen if damerau_levenshtein(x.t, hits[i + 1]) <= 1][1], coalesce(list_max([x.n for x in seen]), 0) + 1) || ']' || gaps[i + 2]
  from f join a on a.doc_id = f.doc_id where i < len(hits))
select f.doc_id, shown as output_text, cast(len(list_distinct([x.n for x in seen])) as integer) as n from f join a on a.doc_id = f.doc_id where i = len(hits)""")
def email_placeholders(spark, d):
    return flagship(spark, d).select("doc_id", "output_text", F.size("placeholder_references").alias("n"))


@query()
def recognised_spans(spark, d):
    """All recognisers over the documents: one row per span."""
    docs = spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(recognise.recognise(F.col("text"))).alias("s")).select("doc_id", "s.*")


@query()
def flag_pruned_spans(spark, d):
    """With e-mail addresses and dates off, no span touches an address and no date is found."""
    docs = spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(recognise.recognise(F.col("text"), {"email_addresses": False, "dates": False})).alias("s")).select("doc_id", "s.*")


_TAGS = "case regexp_replace(lower(trim(tag)), '[- ]', '_', 'g') " + " ".join(f"when '{k}' then '{v}'" for k, v in spans.PLACEHOLDER_NAMES.items()) + " else upper(regexp_replace(lower(trim(tag)), '[- ]', '_', 'g')) end"


@query(f"select distinct annotation_id, tag, {_TAGS} as placeholder from backend_annotations")
def canonical_tags(spark, d):
    return table(spark, d, "backend_annotations").select("annotation_id", "tag", spans.placeholder_name(F.col("tag")).alias("placeholder")).distinct()


@query(f"select document_id, {_TAGS} as placeholder, count(distinct annotation_id) as n, count(distinct text) as n_texts from backend_annotations group by 1, 2")
def spans_by_tag(spark, d):
    a = table(spark, d, "backend_annotations").select("document_id", "annotation_id", "text", spans.placeholder_name(F.col("tag")).alias("placeholder")).distinct()
    return a.groupBy("document_id", "placeholder").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"))


@query("""
select document_id, annotation_id, cast(row_number() over (partition by document_id order by start_char, end_char, tag, annotation_id) as integer) as place
from (select distinct document_id, annotation_id, start_char, end_char, tag from backend_annotations)""")
def span_order(spark, d):
    a = table(spark, d, "backend_annotations").select("document_id", "annotation_id", "start_char", "end_char", "tag").distinct()
    return a.select("document_id", "annotation_id", F.row_number().over(Window.partitionBy("document_id").orderBy("start_char", "end_char", "tag", "annotation_id")).alias("place"))


@query()
def annotation_numbers(spark, d):
    """Annotations of every document numbered and rendered into its text."""
    a = table(spark, d, "backend_annotations").filter("text is not null and start_char is not null and end_char is not null").dropDuplicates(["annotation_id"])
    found = a.groupBy(F.col("document_id").alias("id")).agg(F.collect_list(F.struct("text", "tag", F.col("start_char").alias("start"), F.col("end_char").alias("end"))).alias("s"))
    docs = flow.latest_per_key(table(spark, d, "imported_documents").filter("raw_text is not null").select("id", "raw_text", "arrived_at"), "id", ["arrived_at"])
    both = docs.join(found, "id").withColumn("n", spans.without_overlaps(F.array("s"))).withColumn("n", spans.numbered(F.col("n")))
    return both.select("id", spans.render(F.col("raw_text"), F.col("n")).alias("output_text"), spans.references_of(F.col("n")).alias("placeholder_references"))


@query("""
with r as (select document_id, unnest(placeholder_references) as r from processed_documents),
o as (select distinct document_id, r.replacement as replacement, unnest(r.originals) as original from r)
select document_id, replacement, count(*) as n, string_agg(original, '|' order by original) as originals from o group by 1, 2""")
def merged_references(spark, d):
    p = table(spark, d, "processed_documents").groupBy("document_id").agg(F.flatten(F.collect_list("placeholder_references")).alias("r"))
    one = p.select("document_id", F.explode(spans.merge_references(F.col("r"))).alias("m")).filter("size(m.originals) > 0")
    return one.select("document_id", "m.replacement", F.size("m.originals").cast("long").alias("n"), F.array_join(F.array_sort("m.originals"), "|").alias("originals"))


@query(r"""
with r as (select distinct document_id, generation, unnest(placeholder_references) as r from processed_documents)
select distinct document_id, generation, r.replacement as replacement, regexp_full_match(r.replacement, '\[[A-Z][A-Z0-9_+]*(-\d+)?\]') as is_placeholder from r""")
def placeholder_predicate(spark, d):
    p = table(spark, d, "processed_documents").select("document_id", "generation", F.explode("placeholder_references").alias("r"))
    return p.select("document_id", "generation", "r.replacement", text.is_placeholder(F.col("r.replacement")).alias("is_placeholder")).distinct()


@query(r"""
select distinct document_id, generation, cast(coalesce(list_max(list_transform(regexp_extract_all(output_text, '\[DATE-(\d{1,9})\]', 1), lambda x: cast(x as integer))), 0) + 1 as integer) as next_date,
  cast(coalesce(list_max(list_transform(regexp_extract_all(output_text, '\[PERSON-(\d{1,9})\]', 1), lambda x: cast(x as integer))), 0) + 1 as integer) as next_person
from processed_documents where output_text is not null""")
def next_placeholder_index(spark, d):
    p = table(spark, d, "processed_documents").filter("output_text is not null")
    return p.select("document_id", "generation", text.next_index(F.col("output_text"), "DATE").alias("next_date"), text.next_index(F.col("output_text"), "PERSON").alias("next_person")).distinct()


_W, _G = r"[\pL\pN]", r"[^\pL\pN]"
_PERSON = rf"(?i)^(.*?{_W}.*?){_G}+((?:(?:{'|'.join(names.PARTICLES)}){_G}+|{_W}+ ?[''’`] ?)*{_W}+{_G}*)$"


@query(rf"""
with a as (select distinct name_id, trim(regexp_replace(name, '[\n{WS}]+', ' ', 'g')) as c from name_records where name is not null),
b as (select name_id, c, trim(regexp_extract(c, '^([^,]*),(.*)$', 1)) as l, trim(regexp_extract(c, '^([^,]*),(.*)$', 2)) as r, len(regexp_extract_all(c, '{_W}+')) as n from a)
select name_id, case when l <> '' and r <> '' then r when n > 1 then trim(regexp_extract(c, '{_PERSON}', 1)) else c end as given,
  case when l <> '' and r <> '' then l when n > 1 then trim(regexp_extract(c, '{_PERSON}', 2)) else '' end as family from b""")
def person_parts(spark, d):
    n = table(spark, d, "name_records").filter("name is not null").select("name_id", "name").distinct()
    return n.select("name_id", names.person_parts(F.col("name")).alias("p")).select("name_id", "p.given", "p.family")


@query(rf"""
with a as (select distinct addr_id, regexp_extract_all(address, '{_W}+') as t from custom_address_lines where address is not null),
b as (select addr_id, t, coalesce(list_position(list_transform(range(1, len(t) + 1), lambda i: i < len(t) and regexp_full_match(t[i], '\d{{4,5}}')), true), 0) as k from a),
c as (select addr_id, case when k > 0 then t[1:k - 1] else t end as s, case when k > 0 then t[k:] else [] end as r from b),
e as (select addr_id, s, r, len(s) as n,
  len(s) > 1 and regexp_matches(s[1], '\d') and len(list_filter(s[2:], lambda x: regexp_matches(x, '\pL'))) > 0 as first,
  len(s) > 1 and regexp_matches(s[len(s)], '\d') and len(list_filter(s[1:len(s) - 1], lambda x: regexp_matches(x, '\pL'))) > 0 as last from c)
select addr_id, case when first then array_to_string(s[2:], ' ') when last then array_to_string(s[1:n - 1], ' ') else array_to_string(s, ' ') end as street,
  case when first then s[1] when last then s[n] else '' end as number, coalesce(r[1], '') as postcode, array_to_string(r[2:], ' ') as city from e""")
def address_parts(spark, d):
    a = table(spark, d, "custom_address_lines").filter("address is not null").select("addr_id", "address").distinct()
    return a.select("addr_id", names.address_parts(F.col("address")).alias("p")).select("addr_id", "p.street", "p.number", "p.postcode", "p.city")


_MONTH_ROWS = ", ".join(f"({k}, '{m}')" for k, v in dates.BIRTH_MONTHS.items() for m in v)


@query(f"""
with s as (select settings_id, max_by(birthdate, saved_at) as b from patient_settings where birthdate is not null group by 1),
p as (select settings_id, b, unnest([strftime(b, '%d'), cast(day(b) as varchar)]) as dd from s),
q as (select settings_id, b, dd, unnest([strftime(b, '%m'), cast(month(b) as varchar)]) as mm from p),
y as (select settings_id, b, dd, mm, unnest([strftime(b, '%Y'), strftime(b, '%y')]) as yy from q),
m(k, name) as (values {_MONTH_ROWS}),
v as (select settings_id, dd || sep || mm || sep || yy as variant from y, (values ('/'), ('-'), ('.')) t(sep)
  union select settings_id, yy || sep || mm || sep || dd from y, (values ('/'), ('-'), ('.')) t(sep) where length(yy) = 4
  union select settings_id, dd || ' ' || name || dot || ' ' || yy from y join m on m.k = month(y.b), (values (''), ('.')) t(dot))
select distinct settings_id, variant from v""")
def birthdate_variants(spark, d):
    s = flow.latest_per_key(table(spark, d, "patient_settings").filter("birthdate is not null").select("settings_id", "birthdate", "saved_at"), "settings_id", ["saved_at"])
    return s.select("settings_id", F.explode(dates.birthdate_variants(F.col("birthdate"))).alias("variant"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as parsed from orders")
def birthdate_parse(spark, d):
    """Order dates written in six formats by turns and read again."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    forms = F.element_at(F.array(*[F.date_format("day", f) for f in dates.BIRTH_FORMATS]), (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int"))
    return o.select("o_orderkey", dates.parse_birthdate(forms).cast("string").alias("parsed"))


@query("""
with a as (select o_orderkey, cast(o_orderdate as date) + interval 10 day as x from orders)
select o_orderkey, case o_orderkey % 3 when 0 then strftime(x, '%d/%m/%Y') when 1 then strftime(x, '%Y-%m-%d') else strftime(x, '%d.%m.%y') end as shifted from a""")
def date_shift_render(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    lit = F.element_at(F.array(F.date_format("day", "dd/MM/yyyy"), F.date_format("day", "yyyy-MM-dd"), F.date_format("day", "dd.MM.yy")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    return o.select("o_orderkey", dates.shift_literal(lit, F.lit(10)).alias("shifted"))


_FR = ", ".join(f"'{m}'" for m in dates.MONTHS["fr_full"])


@query(f"""
with a as (select o_orderkey, cast(o_orderdate as date) + interval 7 day as x from orders)
select o_orderkey, cast(day(x) as varchar) || ' ' || [{_FR}][month(x)] || ' ' || strftime(x, '%Y') as shifted from a where day(x - interval 7 day) < 10
union all select o_orderkey, strftime(x, '%d') || ' ' || [{_FR}][month(x)] || ' ' || strftime(x, '%Y') from a where day(x - interval 7 day) >= 10""")
def date_shift_textual(spark, d):
    """French textual dates moved by a week: the widths of the day and the style of the month stay."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    month = F.element_at(F.array(*map(F.lit, dates.MONTHS["fr_full"])), F.month("day"))
    return o.select("o_orderkey", dates.shift_literal(F.concat_ws(" ", F.dayofmonth("day").cast("string"), month, F.year("day").cast("string")), F.lit(7)).alias("shifted"))


@query("""
select o_orderkey, cast(case when o_orderkey % 2 = 0 then year(o_orderdate) when year(o_orderdate) % 100 <= 30 then 2000 + year(o_orderdate) % 100 else 1900 + year(o_orderdate) % 100 end as integer) as pivot_year from orders""")
def year_pivot(spark, d):
    o = table(spark, d, "orders")
    tok = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy")).otherwise(F.concat(F.lit("'"), F.date_format("o_orderdate", "yy")))
    return o.select("o_orderkey", dates.expand_year(tok).alias("pivot_year"))


@query("""
with a as (select distinct settings_id, epoch_us(saved_at) as saved, cast(date_shift_days as integer) as x from patient_settings),
b as (select settings_id, saved, case when x is null or x = 0 then null else cast(sign(x) as integer) * least(greatest(abs(x), 10), 728) end as days from a)
select settings_id, saved, cast(days as integer) as days, case when days >= 0 then '+' else '' end || cast(cast(days as integer) as varchar) || case when abs(days) = 1 then ' day' else ' days' end as shown,
  cast(case when days < 0 then days + 728 else days - 10 + 719 end as integer) as slider from b""")
def safe_shift(spark, d):
    s = table(spark, d, "patient_settings").select("settings_id", F.unix_micros("saved_at").alias("saved"), dates.safe_shift(F.col("date_shift_days")).alias("days")).distinct()
    return s.select("settings_id", "saved", "days", dates.format_shift(F.col("days")).alias("shown"), dates.days_to_slider(F.col("days")).alias("slider"))


def _hits(words: list[str]) -> str:
    return " + ".join(f"cast(contains(p, '{w}') as integer)" for w in words)


@query(f"""
with a as (select distinct text, ' ' || lower(text) || ' ' as p from backend_annotations where lower(tag) in ('hospital', 'ziekenhuis', 'institution', 'zorginstelling')),
b as (select text, p, {_hits(names.FRENCH_MARKERS)} as fr, {_hits(names.DUTCH_MARKERS)} as nl from a)
select text, case when fr > nl then 'fr' when nl > fr then 'nl' when ascii(substr(sha256(p), 2, 1)) % 2 = case when ascii(substr(sha256(p), 2, 1)) > 90 then 0 else 1 end then 'fr' else 'nl' end as lang from b""")
def institution_language(spark, d):
    a = table(spark, d, "backend_annotations").filter(F.lower("tag").isin("hospital", "ziekenhuis", "institution", "zorginstelling")).select("text").distinct()
    return a.select("text", names.institution_language(F.col("text")).alias("lang"))


@query("""
select distinct id, substr(sha256(case when coalesce(raw_text, '') <> '' then raw_text when coalesce(display_name, '') <> '' then display_name else 'x' end), 1, 10) || '_deid' as stem from imported_documents""")
def filename_hash(spark, d):
    return table(spark, d, "imported_documents").select("id", keyed.hashed_stem(F.col("raw_text"), F.col("display_name"), F.lit("x")).alias("stem")).distinct()


_RES = ", ".join(f"'{x}'" for x in export.RESERVED)


@query(rf"""
with a as (select distinct id, regexp_replace(display_name, '^(.+)\.[^.]*$', '\1') as s from imported_documents where display_name is not null),
b as (select id, regexp_replace(regexp_replace(regexp_replace(translate(s, '{export.ACCENTED}', '{export.PLAIN}'), '[^\x00-\x7f]', '', 'g'), '[^A-Za-z0-9._-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g') as s from a),
c as (select id, case when s = '' then 'document' else s end as s from b)
select id, case when upper(s) in ({_RES}) then s || '-file' else s end as stem from c""")
def sanitize_stem(spark, d):
    i = table(spark, d, "imported_documents").filter("display_name is not null").select("id", "display_name").distinct()
    return i.select("id", export.sanitize_stem(export.source_stem(F.col("display_name"))).alias("stem"))


@query(r"""
with a as (select distinct id, case when source_kind = 'html' then 'nota.html' else 'nota.txt' end as name from imported_documents)
select id, name, case when k = 1 then name else regexp_replace(name, '^(.+?)(\.[^.]*)$', '\1-' || k || '\2') end as unique_name
from (select id, name, row_number() over (partition by name order by id) as k from a)""")
def unique_names(spark, d):
    """Two names shared by all documents: each name a hot group."""
    i = table(spark, d, "imported_documents").select("id", F.when(F.col("source_kind") == "html", "nota.html").otherwise("nota.txt").alias("name")).distinct()
    return export.unique_names(i, "name", ["id"]).select("id", "name", "unique_name")


@query(r"""
select distinct id, case when lower(regexp_extract(path, '(\.[^./]+)$', 1)) = '.txt' then 'text_file' when lower(regexp_extract(path, '(\.[^./]+)$', 1)) in ('.html', '.htm') then 'html'
  when lower(regexp_extract(path, '(\.[^./]+)$', 1)) = '.pdf' then 'pdf' end as kind from imported_documents""")
def file_kind(spark, d):
    return table(spark, d, "imported_documents").select("id", files.file_kind(F.col("path")).alias("kind")).distinct()


@query(rf"""
with a as (select distinct id, list_transform(pdf_pages, lambda p: regexp_replace(coalesce(p.text, ''), '^[\n{WS}]+|[\n{WS}]+$', '', 'g')) as ps from imported_documents where pdf_pages is not null)
select id, array_to_string(list_filter(ps, lambda p: p <> ''), chr(10) || chr(10)) as joined from a""")
def pdf_page_join(spark, d):
    i = table(spark, d, "imported_documents").filter("pdf_pages is not null")
    return i.select("id", files.join_pages(F.col("pdf_pages.text")).alias("joined")).distinct()


@query("""
select id, source_kind, status, epoch_us(arrived_at) as arrived from (select *, row_number() over (partition by id order by arrived_at desc) as k from imported_documents) where k = 1""")
def latest_delivery(spark, d):
    i = table(spark, d, "imported_documents").select("id", "source_kind", "status", "arrived_at")
    return flow.latest_per_key(i, "id", ["arrived_at"]).select("id", "source_kind", "status", F.unix_micros("arrived_at").alias("arrived"))


@query("""
select document_id, max(generation) as generation from processed_documents group by 1""")
def latest_generation(spark, d):
    return flow.latest_per_key(table(spark, d, "processed_documents").select("document_id", "generation"), "document_id", ["generation"])


@query("select distinct id, settings_id from imported_documents where status = 'pending' and raw_text is not null")
def processable(spark, d):
    return flow.processable(table(spark, d, "imported_documents")).select("id", "settings_id").distinct()


@query("""
with l as (select document_id as id, max(generation) as generation from processed_documents group by 1)
select distinct i.id, i.display_name, l.generation from imported_documents i join l on i.id = l.id""")
def export_join(spark, d):
    docs = table(spark, d, "imported_documents").select("id", "display_name").distinct()
    return export.exported(docs, table(spark, d, "processed_documents")).select("id", "display_name", "generation")


@query("""
select distinct id, case when status = 'error' then coalesce(error_message, 'The import failed.') else 'Not processed.' end as reason
from imported_documents i where not exists (select 1 from processed_documents p where p.document_id = i.id)""")
def skipped_anti_join(spark, d):
    docs = table(spark, d, "imported_documents").select("id", "status", "error_message").distinct()
    return export.skipped(docs, table(spark, d, "processed_documents")).select("id", "reason")


@query("""
with d as (select distinct id from imported_documents), p as (select distinct document_id from processed_documents)
select count(document_id) as exported_count, count(*) - count(document_id) as skipped_count from d left join p on d.id = p.document_id""")
def export_summary(spark, d):
    return export.export_summary(table(spark, d, "imported_documents"), table(spark, d, "processed_documents"))


@query(r"""
with r as (select distinct document_id, generation, unnest(placeholder_references) as r from processed_documents),
o as (select document_id, generation, r.replacement as replacement, unnest(r.originals) as original from r where not regexp_full_match(r.replacement, '\[[A-Z][A-Z0-9_+]*(-\d+)?\]'))
select document_id, generation, '- ' || original || ' => ' || replacement as line from o""")
def report_lines(spark, d):
    p = table(spark, d, "processed_documents").select("document_id", "generation", "placeholder_references").distinct()
    return p.select("document_id", "generation", F.explode(export.mapping_lines(F.col("placeholder_references"))).alias("line"))


@query("""
select distinct document_id, generation, case when coalesce(len(warnings), 0) = 0 then '' else 'Warning(s): ' || array_to_string(warnings, '; ') end as shown from processed_documents""")
def warnings_text(spark, d):
    return table(spark, d, "processed_documents").select("document_id", "generation", export.warnings_text(F.col("warnings")).alias("shown")).distinct()


@query("""
with l as (select distinct settings_id, name as family from name_records where field = 'last_name'),
n as (select distinct settings_id, name from name_records where field <> 'last_name')
select n.settings_id, n.name, l.family from n join l on n.settings_id = l.settings_id
where regexp_full_match(n.name || l.family, '[ -~]*') and damerau_levenshtein(n.name, l.family) <= 1""")
def near_duplicate_names(spark, d):
    """Names within one edit of the family name of their dossier, ASCII only, as the SQL counts bytes."""
    both = _beside_family(spark, d).filter(F.concat("name", "family").rlike(r"\A[ -~]*\z"))
    return both.filter(text.within_one_edit(F.col("name"), F.col("family"))).select("settings_id", "name", "family")


@query()
def near_duplicate_names_all(spark, d):
    """near_duplicate_names over all rows, letters of any script counted as one."""
    return _beside_family(spark, d).filter(text.within_one_edit(F.col("name"), F.col("family"))).select("settings_id", "name", "family")


def _beside_family(spark, d):
    """(settings_id, name, family): every other name of a dossier beside its family names."""
    n = table(spark, d, "name_records").select("settings_id", "field", "name")
    last = n.filter("field = 'last_name'").select("settings_id", F.col("name").alias("family")).distinct()
    other = n.filter("field != 'last_name'").select("settings_id", "name").distinct()
    return other.join(last, "settings_id")


@query(r"""
select name_id, case when regexp_matches(name, '(?is)^((?:(?:dr\.?|dokter|docteur|arts|prof\.?|professeur|pr\.?)\s+)+)(.+)$') then regexp_extract(name, '(?is)^((?:(?:dr\.?|dokter|docteur|arts|prof\.?|professeur|pr\.?)\s+)+)(.+)$', 1) else '' end as title,
  case when regexp_matches(name, '(?is)^((?:(?:dr\.?|dokter|docteur|arts|prof\.?|professeur|pr\.?)\s+)+)(.+)$') then regexp_extract(name, '(?is)^((?:(?:dr\.?|dokter|docteur|arts|prof\.?|professeur|pr\.?)\s+)+)(.+)$', 2) else name end as body
from (select distinct name_id, name from name_records where name is not null)""")
def person_titles(spark, d):
    n = table(spark, d, "name_records").filter("name is not null").select("name_id", "name").distinct()
    return n.select("name_id", names.split_title(F.col("name")).alias("t")).select("name_id", "t.title", "t.body")


@query(rf"""
with a as (select distinct settings_id, epoch_us(saved_at) as saved, list_filter(list_transform(other_names, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^[\n{WS}]+|[\n{WS}]+$', '', 'g'), '^[-*•]', ''), '^[\n{WS}]+|[\n{WS}]+$', '', 'g')), lambda x: x <> '') as v from patient_settings where other_names is not null and not contains(array_to_string(other_names, ''), chr(10)))
select settings_id, saved, cast(len(list_filter(range(1, len(v) + 1), lambda i: list_position(list_transform(v, lambda y: lower(y)), lower(v[i])) = i)) as integer) as n from a""")
def list_entries(spark, d):
    s = table(spark, d, "patient_settings").filter("other_names is not null").select("settings_id", F.unix_micros("saved_at").alias("saved"), F.array_join("other_names", "\n").alias("t"), F.array_join("other_names", "").alias("u")).distinct()
    return s.filter(~F.contains("u", F.lit("\n"))).select("settings_id", "saved", F.size(text.list_lines(F.col("t"))).alias("n"))


@query()
def html_text(spark, d):
    i = spread(table(spark, d, "imported_documents").filter("source_kind = 'html' and raw_text is not null").select("id", "raw_text"))
    return i.select("id", html.html_to_text(F.col("raw_text")).alias("text")).distinct()


@query()
def deidentified_documents(spark, d):
    """All imported documents with all recognisers."""
    return documents.process_documents(table(spark, d, "imported_documents"))


@query()
def dossier_cleanup(spark, d):
    """Every document cleaned of the literals of its own dossier: settings are columns of a join, not literals of the plan."""
    docs = flow.latest_per_key(table(spark, d, "imported_documents").filter("raw_text is not null").select("id", "raw_text", "settings_id", "arrived_at"), "id", ["arrived_at"])
    s = flow.latest_per_key(table(spark, d, "patient_settings").select("settings_id", "first_name", "last_name", "birthdate", "other_names", "custom_addresses", "saved_at"), "settings_id", ["saved_at"])
    both = by_key(docs.join(s, "settings_id", "left"), "id").withColumn("src", F.struct(F.col("raw_text").alias("text"), F.array().cast(spans.REFERENCES).alias("references")))
    per_row = {k: F.col(k) for k in ("first_name", "last_name", "birthdate", "other_names", "custom_addresses")}
    return cleanup.cleanup(both, "src", "r", per_row).select("id", "r.text", "r.references", "r.warnings")
