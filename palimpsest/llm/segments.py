"""Pigeonhole segment join: pairs of strings within a small edit distance, inside groups.

The edits allowed depend on the shorter string's length. A string that allows k is cut into k + 1 segments; one within k
edits has one of them unchanged, at a place that is shifted by less than the edits left on both sides allow. So each string looks
up its substrings near every segment's place in an inverted index of the segments, by group, length, segment number and
text. Candidates are verified by the banded edit distance. Segments of very short strings may be empty, so no string is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.session import by_key

#: (least length, edits): edits between strings whose shorter one has the length.
LIMITS = [(1, 1), (3, 2)]


def near_pairs(strings: DataFrame, group: list[str], text: str = "s", limits: list[tuple[int, int]] = LIMITS) -> DataFrame:
    """(*group, a, b, edits) with a < b in (length, text): distinct strings of a group within the edits that the shorter one allows.

    strings: distinct (*group, text). Empty and null strings and null groups have no pairs.
    """
    rows = by_key(strings.select(*group, F.col(text).alias("s")).filter("s != ''"), "s")
    allowed = lambda n: "case " + " ".join(f"when {n} >= {low} then {k}" for low, k in sorted(limits, reverse=True)) + " else 0 end"
    n, most = "length(s)", max(k for _, k in limits)
    at = lambda size, i, k: f"int(floor({size} * ({i}) / ({k} + 1)))"
    own = f"transform(sequence(0, {allowed(n)}), i -> struct({n} as len, i as seg, substring(s, {at(n, 'i', allowed(n))} + 1, {at(n, 'i + 1', allowed(n))} - {at(n, 'i', allowed(n))}) as piece))"
    index = rows.select(*group, F.col("s").alias("t"), F.expr(f"inline({own})"))
    # the shorter string's length l, its edits k, and the difference d in length
    lens = f"filter(transform(sequence(greatest({n} - {most}, 1), {n}), l -> struct(l as l, {allowed('l')} as k, {n} - l as d)), x -> x.d <= x.k)"
    first, size = at("x.l", "i", "x.k"), f"{at('x.l', 'i + 1', 'x.k')} - {at('x.l', 'i', 'x.k')}"
    places = f"filter(sequence({first} - int(floor((x.k - x.d) / 2)), {first} + int(floor((x.k + x.d) / 2))), p -> p >= 0 and p + ({size}) <= {n})"
    probe = rows.select(*group, "s", F.expr(f"inline(array_distinct(flatten(flatten(transform({lens}, x -> transform(sequence(0, x.k), i -> transform({places}, p -> struct(x.l as len, i as seg, substring(s, p + 1, {size}) as piece))))))))"))
    found = probe.join(index, [*group, "len", "seg", "piece"])
    found = found.filter((F.length("t") < F.length("s")) | ((F.length("t") == F.length("s")) & (F.col("t") < F.col("s"))))
    found = found.select(*group, F.col("t").alias("a"), F.col("s").alias("b")).distinct()
    return found.withColumn("edits", F.levenshtein("a", "b", most)).filter(f"edits >= 0 and edits <= {allowed('length(a)')}")
