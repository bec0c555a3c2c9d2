"""Problem 8: one mixture of texts in which every source takes its target share of the tokens.

Every distinct text is one unit, held by the record with the smallest (source, doc_id) among those
whose source is a target; so no text is used more often than its source's max_repeats, however many
records repeat it. Sizes are tokens of byte_bpe_50k. Records without a text, with a blank one or with
a source that is no target are in the mixture zero times.

1. The mixture's size is the largest at which no source needs more than max_repeats of its tokens:
   the least of max_repeats * tokens / share.
2. Iterative proportional fitting over the cells source x language x topic rakes the cells' tokens
   until sources take the target shares and languages and topics the shares they have in the corpus.
   A cell's rate (uses per text) never exceeds max_repeats; what a full cell can't take goes to the
   other cells of its source. The source step is last, so source shares are exact; language and topic
   marginals are met as far as the repeat limits allow.
3. A text is used floor(rate) times, and once more with the probability of the rest: sequential
   Poisson sampling takes, in each source, the texts with the smallest u / probability (u uniform by a
   keyed hash of the text) until the source's tokens are reached. The threshold is found by a
   histogram of that number, refined in one of its bins until that has few rows, and an exact order within it, so no
   source, however large, is sorted in one task.

Topics are clusters of the corpus's texts, fitted on all texts that may be in the mixture: their words are counted once and kept
beside their sizes, and every step of the fit passes over these counts.

Empty tables give an empty mixture. Ties in u / probability are ordered by the text's hash.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.p7_encode import encoder, tokenizer_dir
from palimpsest.plans.session import by_key, materialize, table

ROUNDS, BINS = 60, 4096
LANGS = ["nl", "fr", "de", "en"]
#: Topics are clusters of the corpus: TOPICS centres over WORDS hashed words, fitted on all texts in STEPS passes at most.
TOPICS, WORDS, STEPS = 6, 512, 12
#: A source's threshold is looked for in finer bins until one has fewer rows.
SORTED = 100_000
_words = re.compile(r"[^\W\d_]{4,}")


def bags(texts: list[str], cache: dict[str, int]) -> np.ndarray:
    """A row for each text: counts of its hashed words, damped."""
    out = np.zeros((len(texts), WORDS), np.float32)
    if len(cache) > 200_000:  # only saves hashing again
        cache.clear()
    for row, t in zip(out, texts):
        at = []
        for w in _words.findall(t.lower()):
            if (k := cache.get(w)) is None:
                k = cache[w] = zlib.crc32(w.encode()) % WORDS
            at.append(k)
        if at:
            row += np.bincount(at, minlength=WORDS)
    return np.log1p(out).astype(np.float16)


def _damped(column: pa.Array) -> np.ndarray:
    """Rows of bags as they were written."""
    at, data = np.frombuffer(column.buffers()[1], np.int32)[column.offset], column.buffers()[2]
    return np.frombuffer(data, np.float16, len(column) * WORDS, int(at)).reshape(-1, WORDS).astype(np.float32)


def _norms(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Lengths of the weighted rows."""
    return np.maximum(np.sqrt(np.square(x) @ np.square(weights)), 1e-9)


def _summed(rows: list[tuple]) -> list[tuple]:
    """Rows (label, number, vector) added up by their labels, in the order of these."""
    out: dict[str, tuple] = {}
    for label, n, v in sorted(rows, key=lambda r: (r[0], r[1], r[2].tobytes())):
        out[label] = (label, out[label][1] + n, out[label][2] + v) if label in out else (label, n, v)
    return [*out.values()]


def _least(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[1], r[0]))[:1]


def _over(counted: DataFrame, of, combine) -> list[tuple]:
    """combine(of(k, bags)) over all batches of texts: rows (label, number, vector), of which a task sends as few as a batch has."""

    def run(batches):
        rows: list[tuple] = []
        for b in batches:
            if b.num_rows:
                rows = combine([*rows, *((str(r[0]), float(r[1]), np.asarray(r[2], np.float64)) for r in of(b.column("k"), _damped(b.column("bag"))))])
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2].tobytes() for r in rows], pa.binary())], ["label", "n", "v"])

    sent = counted.select("k", "bag").mapInArrow(run, "label string, n double, v binary").collect()
    return combine([(r.label, r.n, np.frombuffer(bytes(r.v), np.float64)) for r in sent])


def fit_topics(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(centres, weights of the words): spherical k-means over all texts and words weighted by rarity; the first centres are far from each other.

    counted has the columns k and bag. Each step is a pass over the bags from which every task sends a row for each centre.
    """
    have = _over(counted, lambda k, x: [("", len(x), (x > 0).sum(0))], _summed)
    n, seen = have[0][1:] if have else (0.0, np.zeros(WORDS))
    weights = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    c = np.zeros((0, WORDS), np.float32)

    def farthest(k, x):
        """The text that is least like any centre; at the beginning, and of equal ones, the one with the least hash. Texts without words are none."""
        norms = _norms(x, weights)
        like = (x @ (c * weights).T).max(1) / norms if len(c) else np.zeros(len(x))
        like[norms <= 1e-9] = np.inf
        least = like.min()
        at = min(np.flatnonzero(like == least), key=lambda i: k[int(i)].as_py())
        return [(k[int(at)].as_py(), least, x[at] * weights / norms[at])] if least < np.inf else []

    while len(c) < TOPICS:
        found = _over(counted, farthest, _least)
        if not found:
            break
        c = np.vstack([c, found[0][2].astype(np.float32)])
    if not len(c):
        return np.zeros((1, WORDS), np.float32), weights

    def parts(k, x):
        # the nearest centre doesn't depend on a row's length
        near = (x @ (c * weights).T).argmax(1)
        own = np.zeros((len(c), len(x)), np.float32)
        own[near, np.arange(len(x))] = 1 / _norms(x, weights)
        total = (own @ x) * weights
        return [(i, (near == i).sum(), total[i]) for i in np.unique(near)]

    for _ in range(STEPS):
        new = c.copy()
        for i, m, v in _over(counted, parts, _summed):
            new[int(i)] = v / m
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.array_equal(new, c):
            break
        c = new
    return c, weights


def _counted(folder: str):
    """Tokens of texts, and their bags."""

    def run(batches):
        enc, cache = encoder(folder)[0], {}
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)]
            bag = [x.tobytes() for x in bags(texts, cache)]
            yield pa.record_batch([*(b.column(c) for c in ("k", "doc_id", "source", "lang")), pa.array(n, pa.int64()), pa.array(bag, pa.binary())], ["k", "doc_id", "source", "lang", "tokens", "bag"])

    return run


def _assigned(centres: np.ndarray, weights: np.ndarray):
    """Texts with the topic of the nearest centre instead of their bag."""

    def run(batches):
        for b in batches:
            topic = [f"topic{k}" for k in (_damped(b.column("bag")) @ (centres * weights).T).argmax(1)] if b.num_rows else []
            yield pa.record_batch([*(b.column(c) for c in ("k", "doc_id", "source", "lang")), pa.array(topic, pa.string()), b.column("tokens")], ["k", "doc_id", "source", "lang", "topic", "tokens"])

    return run


def rake(cells: list[tuple[str, str, str, int]], shares: dict[str, tuple[float, int]]) -> dict[tuple[str, str, str], float]:
    """Uses per text of each cell (source, lang, topic, tokens), for shares {source: (share, max_repeats)}."""
    cells = [c for c in cells if c[3] > 0 and shares.get(c[0], (0, 0))[0] > 0 and shares[c[0]][1] > 0]
    if not cells:
        return {}
    have = np.array([c[3] for c in cells], float)
    axes = [np.unique([c[i] for c in cells], return_inverse=True) for i in range(3)]
    sources, at = axes[0]
    share = np.array([shares[s][0] for s in sources])
    share /= share.sum()
    cap = np.array([shares[s][1] for s in sources], float)[at]
    size = (np.bincount(at, have * cap) / share).min()
    want = [size * share, *(size * np.bincount(i, have) / have.sum() for _, i in axes[1:])]
    w = have * np.minimum((want[0] / np.bincount(at, have))[at], cap)

    def to_sources(w: np.ndarray) -> np.ndarray:
        """Scales each source's cells to its tokens; cells at their limit stay there and the others take the rest."""
        full = np.zeros(len(w), bool)
        for _ in range(len(w) + 1):
            rest = want[0] - np.bincount(at, np.where(full, have * cap, 0), len(sources))
            free = np.bincount(at, np.where(full, 0, w), len(sources))
            w = np.where(full, have * cap, w * (np.maximum(rest, 0) / np.maximum(free, 1e-300))[at])
            over = ~full & (w > have * cap * (1 + 1e-12))
            if not over.any():
                return np.minimum(w, have * cap)
            full |= over
        return w

    for _ in range(ROUNDS):
        for a in (1, 2):
            i = axes[a][1]
            w = np.minimum(w * (want[a] / np.maximum(np.bincount(i, w), 1e-300))[i], have * cap)
            w = np.maximum(w, have * 1e-9)
        w = to_sources(w)
    return {c[:3]: float(x) for c, x in zip(cells, w / have)}


def mixture(docs: DataFrame, targets: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, repeats) of every text that is used at least once."""
    spark = docs.sparkSession
    # targets: one row per source, a configuration table
    shares: dict[str, tuple[float, int]] = {}
    for r in targets.select("source_name", "target_share", "max_repeats").filter("source_name is not null").distinct().collect():
        shares.setdefault(r[0], (max(r[1] or 0.0, 0.0), max(r[2] or 0, 0)))
    known = [s for s, (share, most) in shares.items() if share > 0 and most > 0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang").filter(F.col("source").isin(known) & F.col("text").rlike(r"(?U)\S"))
    lang = F.lower(F.substring("lang", 1, 2))
    first = F.struct("source", "doc_id", F.when(lang.isin(LANGS), lang).otherwise("other").alias("lang"))
    keyed = by_key(rows.withColumn("k", F.sha2("text", 256)), "k")
    units = keyed.groupBy("k").agg(F.min(first).alias("r"), F.first("text").alias("text")).select("k", "r.doc_id", "r.source", "r.lang", "text")
    counted = materialize(units.mapInArrow(_counted(folder or tokenizer_dir()), "k string, doc_id long, source string, lang string, tokens long, bag binary"))
    centres, weights = fit_topics(counted)
    sized = materialize(counted.mapInArrow(_assigned(centres, weights), "k string, doc_id long, source string, lang string, topic string, tokens long"))
    # at most len(known) x 5 x TOPICS rows, whatever the data
    cells = [(r.source, r.lang, r.topic, r.n) for r in sized.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("n")).collect()]
    rates = rake(cells, shares)
    got = {c[:3]: c[3] for c in cells}
    wanted: dict[str, float] = {}
    for c, r in rates.items():
        wanted[c[0]] = wanted.get(c[0], 0.0) + r * got[c]
    schema = "source string, lang string, topic string, base int, rest double"
    # rates within rounding of a whole number are whole
    split = [(*c, int(np.floor(r + 1e-9)), max(0.0, float(r - np.floor(r + 1e-9)))) for c, r in rates.items()]
    plan = F.broadcast(spark.createDataFrame([(*x[:4], x[4] if x[4] > 1e-9 else 0.0) for x in split], schema))
    u = (F.xxhash64("k", F.lit("mixture")).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    drawn = sized.join(plan, ["source", "lang", "topic"]).withColumn("xi", F.when(F.col("rest") > 0, u / F.col("rest")))
    drawn = materialize(drawn)
    sure = {r.source: r.n for r in drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("base")).alias("n")).collect()}
    # per source the range of xi that holds its threshold, and the tokens still needed at its beginning
    edges = {s: (0.0, 4.0, wanted.get(s, 0.0) - sure.get(s, 0)) for s in known}
    wide = set(known)
    schema = "source string, lo double, hi double, need double"
    while wide:
        ranges = F.broadcast(spark.createDataFrame([(s, *edges[s]) for s in wide], schema))
        at = F.when(F.col("xi") >= F.col("hi"), BINS).otherwise(F.floor((F.col("xi") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).cast("int")
        inside = drawn.join(ranges, "source").filter("xi is not null and xi >= lo and (xi < hi or hi = 4.0)").withColumn("bin", at)
        # at most (BINS + 1) x len(known) rows
        bins: dict[str, list] = {}
        for r in inside.groupBy("source", "bin").agg(F.sum("tokens").alias("n"), F.count("*").alias("rows")).collect():
            bins.setdefault(r.source, []).append(r)
        for s in [*wide]:
            lo, hi, left = edges[s]
            hit = None
            for b in sorted(bins.get(s, ()), key=lambda b: b.bin):
                if b.n >= left:
                    hit = b
                    break
                left -= b.n
            step = (hi - lo) / BINS
            if hit is None:  # all are used
                edges[s] = (float("inf"), float("inf"), left)
            else:
                edges[s] = (hi, float("inf"), left) if hit.bin == BINS else (lo + hit.bin * step, lo + (hit.bin + 1) * step, left)
            # ranges narrower than the hash's steps can't be divided
            if hit is None or hit.rows <= SORTED or hit.bin == BINS or step < 1e-13:
                wide.discard(s)
    last = F.broadcast(spark.createDataFrame([(s, *edges[s]) for s in known], schema))
    drawn = drawn.join(last, "source")
    inside = drawn.filter("xi >= lo and xi < hi").withColumn("before", F.sum("tokens").over(Window.partitionBy("source").orderBy("xi", "k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    # the text at the threshold is used when that brings the source closer to its tokens
    inside = inside.select("k", "source", (F.col("before") + F.col("tokens") / 2 <= F.col("need")).cast("int").alias("more"))
    used = drawn.join(inside, ["k", "source"], "left").withColumn("repeats", F.col("base") + F.coalesce("more", F.when(F.col("xi") < F.col("lo"), 1).otherwise(0)))
    return used.filter("repeats > 0").select("doc_id", "source", "lang", "topic", "tokens", F.col("repeats").cast("int").alias("repeats"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report: per source its target and reached share, texts, uses and tokens; sources without a use too."""
    targets = table(spark, sf_dir, "mix_targets")
    used = p8_mix(spark, sf_dir).groupBy("source").agg(F.count("*").alias("texts"), F.sum("repeats").alias("uses"), F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    out = targets.withColumnRenamed("source_name", "source").join(F.broadcast(used), "source", "left").fillna(0, ["texts", "uses", "used_tokens", "most_repeats"])
    whole = F.sum("used_tokens").over(Window.partitionBy())
    return out.select("source", "target_share", "max_repeats", "texts", "uses", "most_repeats", "used_tokens", F.when(whole > 0, F.col("used_tokens") / whole).otherwise(0.0).alias("actual_share"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
