"""Guaranteed cleanup: configured literals that remain in a text are replaced, whatever the recognisers found.

Settings may be configured for all rows, as Python values, or differ per row, as columns. In both cases a
literal's text is matched as whole words, ignoring case, the longest first, and never inside a placeholder that is
already there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dates import SMART_BIRTH_MONTHS, birthdate_variants, shift_literal
from palimpsest.functions.keyed import key_pads, person_of
from palimpsest.functions.names import split_title, ADDRESS_SEPARATORS, PERSON_SEPARATORS, address_sequences, address_variants, java_tokens, literal_pattern, person_sequences, person_variants
from palimpsest.functions.text import PLACEHOLDER, let, next_index, normalize_key, strip, styled
from palimpsest.operators.spans import REFERENCES, merge_references

#: Columns of the patterns.
PATIENT, BIRTH, OTHERS, ADDRESSES = "_c_patient", "_c_birth", "_c_others", "_c_addresses"
WARNING = "Guaranteed cleanup replaced configured literals that remained after recognition."


@dataclass(frozen=True)
class Settings:
    """What is configured for one patient. None and empty lists configure nothing."""

    first_name: str | None = None
    last_name: str | None = None
    birthdate: str | None = None
    other_names: tuple[str, ...] = ()
    custom_addresses: tuple[str, ...] = ()
    date_shift_days: int | None = None
    mode: str = "placeholders"
    flags: dict = field(default_factory=dict)

    def columns(self) -> dict[str, Column]:
        """What is configured, as columns; what isn't is left out, and so is its part of the plan."""
        text = lambda x: F.lit(x).cast("string")
        out: dict[str, Column] = {}
        if self.first_name or self.last_name:
            out |= {"first_name": text(self.first_name), "last_name": text(self.last_name)}
        if self.birthdate:
            out["birthdate"] = F.lit(self.birthdate).cast("date")
        for k in ("other_names", "custom_addresses"):
            if values := [v for v in getattr(self, k) if v and v.strip()]:
                out[k] = F.array(*map(F.lit, values))
        if self.date_shift_days is not None:
            out["date_shift_days"] = F.lit(self.date_shift_days).cast("int")
        return out

    def literals(self) -> list[tuple[str, str]]:
        """(tag, Java pattern) of the configured names and addresses, which are recognised before anything else."""
        full = " ".join(x for x in (self.first_name, self.last_name) if x and x.strip())
        out = [("patient", literal_pattern(person_sequences(full) + [java_tokens(x) for x in (self.first_name, self.last_name) if x], PERSON_SEPARATORS))]
        out += [("persoon", literal_pattern(person_sequences(v), PERSON_SEPARATORS)) for v in self.other_names if v]
        out += [("location", literal_pattern(address_sequences(v), ADDRESS_SEPARATORS)) for v in self.custom_addresses if v]
        return [(t, p) for t, p in out if p]


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\\$1")


def literals_pattern(variants: Column, separators: str = r"[\s,.'’`-]+", name_like: bool = False) -> Column:
    """A Java pattern for an array of variants, null when none has a word. An alternative for placeholders comes first, so that
    what is in one is passed over."""
    edge = r"[^\W_]" if name_like else r"\w"
    words = F.transform(variants, lambda v: F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit(r"(?U)[^\W_]+"), F.lit(0)))
    full = F.filter(words, lambda w: F.size(w) > 0)
    ranked = F.array_sort(F.array_distinct(F.transform(full, lambda w: F.struct((-F.length(F.array_join(w, " "))).alias("n"), F.array_join(F.transform(w, _escape), separators).alias("p")))))
    body = F.array_join(F.transform(ranked, lambda x: x.p), "|")
    return F.when(body != "", F.concat(F.lit(rf"(?iU)(?-i:{PLACEHOLDER})|(?<!{edge})(?:"), body, F.lit(rf")(?!{edge})")))


def replace_literals(state: Column, pattern: Column, replacement) -> Column:
    """struct<text, references> after replacing what the pattern matches outside of placeholders; unchanged for a null pattern.

    replacement: a column, or a function from what was matched to a column.
    """
    made = replacement if callable(replacement) else lambda m: replacement

    def done(s):
        found = F.transform(F.regexp_extract_all(s.text, pattern, F.lit(0)), lambda m: F.struct(m.alias("m"), F.when(~m.rlike(rf"\A{PLACEHOLDER}\z"), made(m)).alias("r")))

        def put(found):
            shown = F.filter(found, lambda x: x.r.isNotNull())
            # the last gap has no match behind it
            pieces = F.zip_with(found, F.split(s.text, pattern, -1), lambda x, gap: F.concat(gap, F.coalesce(x.r, x.m, F.lit(""))))
            text = F.array_join(pieces, "")
            new = F.transform(shown, lambda x: F.struct(x.r.alias("replacement"), F.array(x.m).alias("originals")))
            return F.when(F.size(shown) > 0, F.struct(text.alias("text"), merge_references(F.concat(s.references, new)).alias("references"))).otherwise(F.struct(s.text, s.references))

        return let(found, put)

    return let(state, lambda s: F.when(pattern.isNull() | s.text.isNull(), F.struct(s.text, s.references)).otherwise(done(s)))


def patient_variants(first_name: Column, last_name: Column) -> Column:
    """Full name in its orders, and each of its parts alone."""
    full = F.concat_ws(" ", F.when(F.trim(first_name) != "", first_name), F.when(F.trim(last_name) != "", last_name))
    return F.concat(person_variants(full), F.array(F.coalesce(first_name, F.lit("")), F.coalesce(last_name, F.lit(""))))


def prepared(df: DataFrame, settings: dict[str, Column], name_like: bool = False, secret_hex: Column | None = None) -> tuple[DataFrame, list[str]]:
    """df with the patterns of a row's settings, and their columns: what cleanup looks for, apart from any text.

    Where many texts share their settings, the patterns are made once, before the texts join them. Each step is a projection of its
    own, so no step is computed twice.
    """
    person_sep, address_sep = (r"[\s,._/-]+",) * 2 if name_like else (r"[\s,.'’`-]+", r"[\W_]+")
    none = F.array().cast("array<string>")
    made: list[str] = []
    filled = lambda k: F.filter(F.coalesce(settings[k], none), lambda v: F.trim(v) != "")

    def pattern_of(variants, sep):
        return lambda v: literals_pattern(variants(v), sep, name_like)

    def with_sources(df, column, values, variants):
        """column: patterns of configured names with their pseudonyms, made in steps."""
        c = F.col(column)
        df = df.withColumn("_pads", key_pads(secret_hex)).withColumn(column, F.transform(values, lambda v: F.struct(v.alias("v"), split_title(v).alias("t"))))
        df = df.withColumn(column, F.transform(c, lambda x: F.struct(x.v.alias("v"), x.t.title.alias("title"), strip(x.t.body).alias("body"), normalize_key(x.t.body).alias("key"))))
        df = df.withColumn(column, F.transform(c, lambda x: F.struct(x.v.alias("v"), x.title.alias("title"), x.body.alias("body"), person_of(F.col("_pads"), x.key).alias("name"))))
        pseudonym = lambda x: F.concat(x.title, styled(x["name"], x.body))
        return df.withColumn(column, F.transform(c, lambda x: F.struct(literals_pattern(variants(x.v), person_sep, name_like).alias("pattern"), pseudonym(x).alias("pseudonym")))).drop("_pads")

    smart = secret_hex is not None
    if "last_name" in settings:
        first, last = settings["first_name"], settings["last_name"]
        if smart:
            full = F.concat_ws(" ", F.when(F.trim(first) != "", first), F.when(F.trim(last) != "", last))
            parts = F.filter(F.array(full, first, last), lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")
            df = with_sources(df, PATIENT, F.array_distinct(parts), person_variants)
        else:
            df = df.withColumn(PATIENT, literals_pattern(patient_variants(first, last), person_sep, name_like))
        made.append(PATIENT)
    if "birthdate" in settings:
        # separators of dates are kept apart: 1-2-1990 isn't 12-1990
        spellings = birthdate_variants(settings["birthdate"], SMART_BIRTH_MONTHS) if smart else birthdate_variants(settings["birthdate"])
        ranked = F.array_sort(F.transform(spellings, lambda v: F.struct((-F.length(v)).alias("n"), _escape(v).alias("v"))))
        rx = F.concat(F.lit(rf"(?iU)(?-i:{PLACEHOLDER})|(?<!\w)(?:"), F.array_join(F.transform(ranked, lambda x: x.v), "|"), F.lit(r")(?!\w)"))
        df = df.withColumn(BIRTH, F.when(settings["birthdate"].isNotNull(), rx))
        made.append(BIRTH)
    if smart and "other_names" in settings:
        df = with_sources(df, OTHERS, filled("other_names"), person_variants)
        made.append(OTHERS)
    for key, column, variants, sep in (("other_names", OTHERS, person_variants, person_sep), ("custom_addresses", ADDRESSES, address_variants, address_sep)):
        if key in settings and column not in made:
            df = df.withColumn(column, F.transform(filled(key), pattern_of(variants, sep)))
            made.append(column)
    return df, made


def cleanup(df: DataFrame, source: str, out: str, settings: dict[str, Column] | list[str], name_like: bool = False, secret_hex: Column | None = None, shift: Column | None = None) -> DataFrame:
    """Adds out, struct<text, references, warnings>: the guaranteed cleanup of source, struct<text, references>, for a row's settings.

    The patient's names become [PATIENT]; spellings of the birth date the next DATE; each other name the next PERSON;
    each address the next LOCATION. A number that wasn't used is taken by the next literal. Null text stays null.
    With a secret and a shift, names become the pseudonym of the configured name in the case style of what was matched, and
    spellings of the birth date are shifted. settings may also be the columns that prepared() made; null in them looks for nothing.
    Each step is a projection of its own, so no step is computed twice.
    """
    kind = "struct<text:string,references:" + REFERENCES + ">"
    none = F.array().cast("array<string>")
    placeholder = lambda s, tag: F.concat(F.lit(f"[{tag}-"), next_index(s.text, tag).cast("string"), F.lit("]"))
    own: list[str] = []
    if isinstance(settings, dict):
        df, own = prepared(df, settings, name_like, secret_hex)
    columns = own or settings
    smart = secret_hex is not None
    c = F.col("_clean")

    def each(s, column, replace):
        values = F.col(column)
        return F.when(F.size(values) > 0, F.aggregate(values, s.cast(kind), lambda acc, p: replace(acc, p).cast(kind))).otherwise(s.cast(kind))

    next_one = lambda tag: lambda acc, p: replace_literals(acc, p, placeholder(acc, tag))
    pseudonym = lambda acc, p: replace_literals(acc, p["pattern"], lambda m: styled(p["pseudonym"], m))
    df = df.withColumn("_clean", F.struct(F.col(source).text.alias("text"), F.coalesce(F.col(source).references, F.array().cast(REFERENCES)).alias("references")))
    if PATIENT in columns:
        df = df.withColumn("_clean", each(c, PATIENT, pseudonym) if smart else replace_literals(c, F.col(PATIENT), F.lit("[PATIENT]")))
    if BIRTH in columns:
        new = (lambda m: F.coalesce(shift_literal(m, shift), placeholder(c, "DATE"))) if smart else placeholder(c, "DATE")
        df = df.withColumn("_clean", replace_literals(c, F.col(BIRTH), new))
    if OTHERS in columns:
        df = df.withColumn("_clean", each(c, OTHERS, pseudonym if smart else next_one("PERSON")))
    if ADDRESSES in columns:
        df = df.withColumn("_clean", each(c, ADDRESSES, next_one("LOCATION")))
    warnings = F.when(c.text != F.col(source).text, F.array(F.lit(WARNING))).otherwise(none)
    return df.withColumn(out, F.struct(c.text.alias("text"), c.references.alias("references"), warnings.alias("warnings"))).drop("_clean", *own)
