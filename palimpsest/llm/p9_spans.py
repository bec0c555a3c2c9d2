"""Problem 9: long exact spans shared between records, by difference-cover anchors.

A perfect difference cover modulo a period has for any two positions i and j some d below the period with both i + d and
j + d in it. So two equal passages of the least length hold an equal window, shorter than it by the period, that starts at
a cover position in both. Only windows at cover positions are hashed. The period follows the length: 133 for 240 code points,
with 12 positions in it.

Anchors that occur in two or more records are extended: every window of the least length around such an
anchor is hashed with 128 bits, and the windows that occur in two or more records are exactly the
starts of shared passages. This is linear in the text and in the group: no pairs are formed, and a
passage held by a third of all records costs one combined row per task and start.

Records with equal texts are one class first; a class of two or more is shared as a whole when long
enough. A record's null text has no length and shares nothing; an empty or short one shares nothing.
Repeated rows of one doc_id are one record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.hashing import FIRST, SECOND, Rolling, code_points
from palimpsest.plans.session import join_counted, materialize, spread, table

#: The least length of a shared passage, unless another one is asked for.
LENGTH = 240


def difference_cover(order: int) -> list[int]:
    """Singer's perfect difference set of order + 1 residues modulo order^2 + order + 1 (order prime).

    The powers of a primitive element of GF(order^3) that lie in a plane over GF(order).
    """
    q, v = order, order * order + order + 1
    for c in range(1, q**3):
        c0, c1, c2 = c % q, c // q % q, c // q // q
        x, hits = (1, 0, 0), []
        for k in range(v):
            if x[2] == 0:
                hits.append(k)
            x = (x[2] * c0 % q, (x[0] + x[2] * c1) % q, (x[1] + x[2] * c2) % q)  # times t, with t^3 = c0 + c1 t + c2 t^2
        if len(hits) == q + 1 and len({(i - j) % v for i in hits for j in hits}) == v:
            return hits
    raise ValueError("order must be prime")


class Cover:
    """The difference cover for passages of a length: the greatest prime order whose period leaves windows of four ninths of it."""

    def __init__(self, length: int):
        if length < 13:
            raise ValueError("passages have 13 code points at least")
        order = max(q for q in range(2, length) if q * q + q + 1 <= max(length * 5 // 9, 7) and all(q % d for d in range(2, int(q**0.5) + 1)))
        self.length, self.period = length, order * order + order + 1
        self.width = length - self.period + 1
        self.places = np.array(difference_cover(order))


_one, _two = Rolling(*FIRST), Rolling(*SECOND)


def _anchors(cover: Cover):
    def run(batches):
        for b in batches:
            keys, at, hashes = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = _one.windows(code_points(text), cover.width)
                p = (np.arange(0, len(h), cover.period)[:, None] + cover.places).ravel()
                p = p[p < len(h)]
                keys.append(np.full(len(p), key))
                at.append(p)
                hashes.append(h[p].view(np.int64))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(hashes), pa.int64())], ["cid", "pos", "h"])

    return run


def _windows(cover: Cover):
    def run(batches):
        for b in batches:
            keys, at, first, second = [], [], [], []
            for key, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                points = code_points(text)
                one, two = _one.windows(points, cover.length), _two.windows(points, cover.length)
                edge = np.zeros(len(one) + cover.period + 1, np.int32)
                p = np.asarray(found)
                np.add.at(edge, np.clip(p - cover.period + 1, 0, len(one)), 1)
                np.add.at(edge, np.clip(p + 1, 0, len(one)), -1)
                s = np.flatnonzero(np.cumsum(edge[: len(one)]) > 0)
                keys.append(np.full(len(s), key))
                at.append(s)
                first.append(one[s].view(np.int64))
                second.append(two[s].view(np.int64))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(first), pa.int64()), pa.array(np.concatenate(second), pa.int64())], ["cid", "pos", "h", "h2"])

    return run


def shared_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share, spans) of every distinct doc_id.

    spans are the half-open ranges [start, stop) that occur in another doc_id's text in pieces of at
    least `length` code points. A doc_id with several different texts counts all of them.
    """
    cover = Cover(length)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = rows.withColumn("k", F.when(F.length("text") >= length, F.sha2("text", 256)))
    long = spread(keyed.filter("k is not null"), "k")
    # numbers of classes are made once and written, so no two texts share one
    classes = materialize(long.groupBy("k").agg(F.first("text").alias("text"), F.count("*").alias("n"), (F.min("doc_id") != F.max("doc_id")).alias("many")).withColumn("cid", F.monotonically_increasing_id()))
    anchors = classes.select("cid", "text").mapInArrow(_anchors(cover), "cid long, pos int, h long")
    grouped = materialize(anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("cid").alias("a"), F.max("cid").alias("b")).filter("a != b").select("h", "n"))
    total = grouped.agg(F.sum("n")).first()[0] or 0
    near = join_counted(anchors, grouped, "h", "n", total).groupBy("cid").agg(F.collect_list("pos").alias("pos"))
    # classes of several records are shared as a whole; they still serve as the others' partners
    windows = materialize(classes.select("cid", "text").join(near, "cid").mapInArrow(_windows(cover), "cid long, pos int, h long, h2 long"))
    both = windows.withColumn("w", F.struct("h", "h2")).select("cid", "pos", "w")
    twice = materialize(both.groupBy("w").agg(F.count("*").alias("n"), F.min("cid").alias("a"), F.max("cid").alias("b")).filter("a != b").select("w", "n"))
    count = twice.agg(F.sum("n")).first()[0] or 0
    starts = join_counted(both, twice, "w", "n", count).groupBy("cid").agg(F.array_sort(F.collect_set("pos")).alias("starts"))
    spans = F.expr(f"""aggregate(starts, cast(array() as array<struct<start:int,stop:int>>), (acc, s) ->
        if(size(acc) > 0 and s <= element_at(acc, -1).stop,
           concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, s + {length} as stop))),
           concat(acc, array(struct(s as start, s + {length} as stop)))))""")
    whole = F.expr("array(struct(0 as start, length(text) as stop))")
    found = materialize(classes.join(starts, "cid", "left").filter("many or starts is not null").select("k", "n", F.when(F.col("many"), whole).otherwise(spans).alias("spans")))
    matched = join_counted(keyed.filter("k is not null").select("doc_id", "k"), found, "k", "n", classes.agg(F.sum("n")).first()[0] or 0).select("doc_id", F.col("spans"), "k").distinct()
    per_text = keyed.select("doc_id", "k", F.length("text").alias("n")).distinct().join(matched, ["doc_id", "k"], "left")
    covered = F.expr("coalesce(aggregate(spans, 0L, (a, s) -> a + s.stop - s.start), 0L)")
    per_text = per_text.select("doc_id", F.col("n").cast("long").alias("n"), covered.alias("c"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"))
    out = per_text.groupBy("doc_id").agg(F.sum("n").alias("n_chars"), F.sum("c").alias("shared_chars"), F.flatten(F.collect_list("spans")).alias("spans"))
    return out.select("doc_id", "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0).alias("shared_share"), "spans")


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_shared(spark, sf_dir).filter("shared_chars > 0").select("doc_id")


QUERIES = {"p9_found": p9_found, "p9_shared": p9_shared}
ORACLE = {
    "p9_found": f"""
with w as (select doc_id, unnest(range(1, length(text) - {LENGTH} + 2)) as i, text from documents where length(text) >= {LENGTH}),
h as (select doc_id, substr(text, i, {LENGTH}) as s from w)
select distinct doc_id from h where s in (select s from h group by s having min(doc_id) <> max(doc_id))"""
}
