"""Problem 7: token ids of every document, each content-defined chunk encoded once.

Where a rolling hash of the last WINDOW code points has its low bits at zero, the text is cut at the next safe point, so equal
passages of different documents fall into equal chunks wherever they stand. Distinct chunks are encoded once. A safe
point is a single blank between two visible ASCII characters: the tokenizer's pattern starts a piece there whatever comes
before or after, so from one safe point to another the ids agree exactly with those of the whole text, and such chunks
are joined as they are. A text that goes on for MOST code points without a safe point is cut anyway; there the join is
repaired by encoding again the text between the last safe point of one chunk and the first one of the next, or
whole chunks where they have none.

Null and empty texts have defined ids: an empty list. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.hashing import FIRST, Rolling, code_points
from palimpsest.plans.session import join_counted, materialize, spread, table

#: A chunk has 2**BITS code points or some more on average, LEAST to MOST of them (the last of a text may be shorter).
WINDOW, BITS, LEAST, MOST = 16, 11, 512, 1 << 16


def tokenizer_dir() -> str:
    return os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


@lru_cache(2)
def encoder(folder: str):
    """The tiktoken encoding of byte_bpe_50k, its tokens' bytes and, by id, whether a token starts with a
    blank and a visible ASCII character, and whether it ends with a visible ASCII character."""
    import tiktoken

    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    size = max(ranks.values()) + 1
    of, starts, ends = [b""] * size, np.zeros(size, bool), np.zeros(size, bool)
    for b, i in ranks.items():
        of[i] = b
        starts[i] = len(b) > 1 and b[0] == 32 and 33 <= b[1] <= 126
        ends[i] = 33 <= b[-1] <= 126
    return enc, of, starts, ends


_roll = Rolling(*FIRST)


_safe = re.compile("(?<=[!-~]) (?=[!-~])")


def chunks_of(text: str) -> tuple[list[str], bool]:
    """Content-defined chunks, whose concatenation is the text, and whether all are cut at safe points."""
    n = len(text)
    if n <= LEAST:
        return ([text] if text else []), True
    h = _roll.windows(code_points(text), WINDOW)
    marks = np.flatnonzero((h & np.uint64((1 << BITS) - 1)) == 0) + WINDOW
    out, at, safe = [], 0, True
    for mark in [*marks.tolist(), n]:
        if mark - at < LEAST and mark < n:
            continue
        m = _safe.search(text, mark) if mark < n else None
        cut = m.start() if m else n
        while cut - at > MOST:
            # the next safe point within reach, else anywhere
            m = _safe.search(text, at + LEAST, at + MOST)
            end = m.start() if m else at + MOST
            safe = safe and m is not None
            out.append(text[at:end])
            at = end
        if cut > at:
            out.append(text[at:cut])
            at = cut
    return out, safe


def stitch(parts: list[np.ndarray], folder: str) -> np.ndarray:
    """Ids of the concatenation of chunks from the ids of each."""
    enc, of, starts, ends = encoder(folder)
    if len(parts) < 2:
        return parts[0] if parts else np.empty(0, np.int32)
    out, dirty = [], []

    def repair() -> None:
        if dirty:
            text = b"".join(of[i] for part in dirty for i in part.tolist()).decode("utf-8")
            out.append(np.asarray(enc.encode_ordinary(text), np.int32))
            dirty.clear()

    last = len(parts) - 1
    for k, ids in enumerate(parts):
        safe = np.flatnonzero(starts[ids[1:]] & ends[ids[:-1]]) + 1
        lo, hi = (0 if k == 0 else safe[0] if len(safe) else -1), (len(ids) if k == last else safe[-1] if len(safe) else -1)
        if lo < 0 or hi < 0:  # no safe point
            dirty.append(ids)
            continue
        dirty.append(ids[:lo])
        if lo:
            repair()
        out.append(ids[lo:hi])
        dirty.append(ids[hi:])
    repair()
    return np.concatenate(out) if out else np.empty(0, np.int32)


def _chunked(batches):
    for b in batches:
        uid, seq, key, text, safe = [], [], [], [], []
        for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parts, good = chunks_of(t)
            safe += [good] * len(parts)
            uid += [u] * len(parts)
            seq += range(len(parts))
            text += parts
            key += [xxhash.xxh3_128_digest(p.encode()) for p in parts]
        yield pa.record_batch([pa.array(uid, pa.int64()), pa.array(seq, pa.int32()), pa.array(key, pa.binary()), pa.array(text, pa.string()), pa.array(safe, pa.bool_())], ["uid", "seq", "key", "chunk", "safe"])


def _encoded(folder: str):
    def run(batches):
        enc = encoder(folder)[0]
        for b in batches:
            ids = enc.encode_ordinary_batch(b.column(1).to_pylist(), num_threads=1)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(ids, pa.list_(pa.int32()))], ["key", "n", "ids"])

    return run


def _stitched(folder: str):
    """Column function: ids of documents from those of their chunks in order; null for null."""

    @F.pandas_udf("array<int>")
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else stitch([np.asarray(x, np.int32) for x in p], folder) for p in parts], dtype=object)

    return run


def encode_corpus(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folder: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of docs, repeated rows included; null and empty texts get an empty list.

    Shuffles: the chunks to make them distinct (combined before the shuffle), their ids to the
    documents (hot chunks by a broadcast of bounded size), the documents' parts by row.
    """
    folder = folder or tokenizer_dir()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    full = F.coalesce(F.length("text"), F.lit(0)) > 0
    # a row's number in the scan, so that repeated rows and null ids stay apart; written, as it is read twice
    numbered = materialize(spread(rows, "doc_id", F.xxhash64("text")).withColumn("uid", F.monotonically_increasing_id()))
    chunks = numbered.filter(full).select("uid", "text").mapInArrow(_chunked, "uid long, seq int, key binary, chunk string, safe boolean")
    distinct = chunks.groupBy("key").agg(F.first("chunk").alias("chunk"), F.count("*").alias("n"))
    encoded = materialize(distinct.mapInArrow(_encoded(folder), "key binary, n long, ids array<int>"))
    total = encoded.agg(F.sum("n")).first()[0] or 0
    parts = join_counted(chunks.select("uid", "seq", "key", "safe"), encoded, "key", "n", total).select("uid", "safe", F.struct("seq", "ids").alias("part"))
    whole = parts.groupBy("uid").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.min("safe").alias("safe"))
    lists = F.transform("parts", lambda p: p.ids)
    # only documents with a join to repair are sent to Python
    ids = whole.select("uid", F.coalesce(_stitched(folder)(F.when(~F.col("safe"), lists)), F.flatten(lists)).alias("ids"))
    return numbered.select("uid", "doc_id").join(ids, "uid", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


QUERIES = {"p7_ids": p7_ids}
