"""Problem 6: language of documents and of their segments, with confidences.

The classifier is a sparse multinomial logistic regression over TF-IDF weights of hashed character
n-grams, trained by follow-the-regularised-leader (proximal, per-coordinate rates) with an elastic net, and
calibrated by one temperature on held-out sentences. Term frequencies are relative to a sentence's
n-grams; document frequencies are counted over all documents. Labels may be wrong, so it is trained again CLEANINGS times: documents and
sentences whose label the last model contradicts take no part in the next training, nor in calibration.
Training uses a sample of SAMPLE labelled documents a language at most, those with the least hash of
their id, and SENTENCES of each at most, those with the least hash; everything else covers all data and whole texts.

A text's sentences are labelled together (Viterbi over calibrated log-probabilities, weighted by their letters,
with a cost for a change of language), which gives segments. A language is one of the document's
when a segment in it is at least a whole short paragraph: LETTERS letters, or all the document has.

A document whose text is null or has no letter has no language. Redelivered rows of an id count once.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.p1_scans import clean
from palimpsest.plans.session import materialize, spread, table

LANGS = ["nl", "fr", "de", "en"]
DIM, ORDERS = 1 << 16, (2, 3, 4)
#: Bounds of what is trained on: documents of a language, and sentences of a document, those with the least hash of each.
SAMPLE, SENTENCES, CLEANINGS = 160, 40, 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-3, 1e-2
SWITCH, LETTERS = 6.0, 50

#: Names and codes of the languages.
LABELS = {
    "nl": ["nl", "nld", "dut", "nederlands", "dutch", "néerlandais", "niederländisch", "vlaams"],
    "fr": ["fr", "fra", "fre", "français", "francais", "french", "frans", "französisch"],
    "de": ["de", "deu", "ger", "deutsch", "german", "duits", "allemand"],
    "en": ["en", "eng", "english", "engels", "anglais", "englisch"],
}


def label_language(label: Column) -> Column:
    """The language that a label names, null if none; regions and case don't matter."""
    key = F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)", 1)
    out = F.lit(None).cast("string")
    for lang, names in LABELS.items():
        out = F.when(key.isin(names), lang).otherwise(out)
    return out


_tag = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->|<[^<>]*>", re.S | re.I)
_cut = re.compile(r"(?<=[.!?;:])\s+(?=[^\W\d_])|\n\s*\n")
_low = re.compile(r"(?<![\w@.])[a-zà-öø-ÿœ]+(?![\w@])")
_gaps = re.compile(r"[\W\d_]+")


def readable(text: str, kind: str | None) -> str:
    if kind == "html":
        text = html.unescape(_tag.sub("\n\n", text))
    return clean(text)


def sentences(text: str, kind: str | None) -> list[tuple[int, int, str]]:
    """(start, stop, letters) of the sentences of the readable text; letters is what the classifier sees: the words
    without a capital, as names tell nothing of a language. A text without any such word is one sentence of all its words."""
    text = readable(text, kind)
    text = re.sub(r"[-¬]\n(?=[a-zà-ÿ])", "", text)
    out, at = [], 0
    for m in [*_cut.finditer(text), None]:
        end = m.start() if m else len(text)
        if words := _low.findall(text, at, end):
            out.append((at, end, f" {' '.join(words)} "))
        at = m.end() if m else end
    if not out and (letters := _gaps.sub(" ", text.lower()).strip()):
        out.append((0, len(text), f" {letters} "))
    return out


def grams(parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashed n-grams of all parts one after the other, and where each part's begin (with the end of the last);
    n-grams don't cross parts."""
    joined = "\x00".join(parts) + "\x00"
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(c == 0)
    lengths = np.diff(ends, prepend=-1) - 1
    part = np.repeat(np.arange(len(parts)), lengths + 1)
    place = np.arange(len(c))
    out = []
    h = c
    with np.errstate(over="ignore"):
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint64(1000003) + c[n - 1 :]
            if n in ORDERS:
                x = h[place[: len(h)] + n - 1 < ends[part[: len(h)]]] + np.uint64(n)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append(((x >> np.uint64(40)).astype(np.int64) & (DIM - 1), np.concatenate([[0], np.cumsum(np.maximum(lengths - n + 1, 0))])))
    return out


def scores(parts: list[str], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logits of each part; weights hold the inverse document frequencies."""
    sums, total = np.zeros((len(parts), weights.shape[1]), np.float32), np.zeros(len(parts))
    for h, at in grams(parts):
        n = np.diff(at)
        full = n > 0
        if full.any():
            sums[full] += np.add.reduceat(weights[h], at[:-1][full], axis=0)
        total += n
    return sums / np.maximum(total, 1)[:, None] + bias


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(parts: list[str], labels: np.ndarray, idf: np.ndarray, rounds: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (times idf) and bias by FTRL-proximal over the parts in their order."""
    k = len(LANGS)
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def solve(i):
        zi, ni = z[i], n[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    orders = grams(parts)
    features = [np.unique(np.concatenate([h[at[s] : at[s + 1]] for h, at in orders]), return_counts=True) for s in range(len(parts))]
    for _ in range(rounds):
        for s in range(len(parts)):
            ids, counts = features[s]
            if not len(ids):
                continue
            i = np.append(ids, DIM)
            x = np.append(counts / counts.sum() * idf[ids] * SCALE, 1.0)[:, None]
            w = solve(i)
            p = np.exp(log_softmax((w * x).sum(0, keepdims=True)))[0]
            p[labels[s]] -= 1
            g = x * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = solve(np.arange(DIM + 1))
    return (w[:DIM] * idf[:, None] * SCALE).astype(np.float32), w[DIM].astype(np.float32)


#: Relative frequencies are small; this brings the features near one.
SCALE = 10.0


def temperature(z: np.ndarray, labels: np.ndarray) -> float:
    """The temperature at which held-out labels are most likely, one more of them being wrong than is known: without a
    mistake any confidence could be raised for ever."""
    wrong = 1 / (len(z) + 1)
    target = np.full(z.shape, wrong / (z.shape[1] - 1))
    target[np.arange(len(z)), labels] = 1 - wrong
    return float(min(np.geomspace(0.005, 5, 80), key=lambda t: -(target * log_softmax(z / t)).sum(1).mean()))


def _frequencies(batches):
    df, docs = np.zeros(DIM, np.int64), 0
    for b in batches:
        cut = [[x for *_, x in sentences(text, kind)] for text, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        cut = [parts for parts in cut if parts]
        if not cut:
            continue
        orders = grams([x for parts in cut for x in parts])
        first = np.cumsum([0, *map(len, cut)])
        docs += len(cut)
        for k in range(len(cut)):
            seen = np.zeros(DIM, bool)
            for h, at in orders:
                seen[h[at[first[k]] : at[first[k + 1]]]] = True
            df += seen
    i = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(df[i], docs), pa.int64())], ["gram", "n"])


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, bias and temperature, from documents (id, raw_text, source_kind, lang_label)."""
    texts = spread(docs.filter("raw_text is not null").select("raw_text", "source_kind"))
    idf, total = np.zeros(DIM), 1
    # DIM rows at most, whatever the corpus
    for r in texts.mapInArrow(_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        if r.gram < 0:
            total = max(r.n, 1)
        else:
            idf[r.gram] = r.n
    idf = np.where(idf > 0, np.log((1 + total) / (1 + idf)) + 1.0, 0.0)
    labelled = docs.filter(F.col("raw_text").rlike(r"\p{L}") & F.col("id").isNotNull()).select("id", label_language(F.col("lang_label")).alias("lang"))
    # ids first, repeated ones once; their texts in one more scan
    chosen = None
    for lang in LANGS:
        least = labelled.filter(F.col("lang") == lang).select("id", "lang").groupBy("id").agg(F.first("lang").alias("lang")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        chosen = least if chosen is None else chosen.unionByName(least)
    picked = docs.filter("raw_text is not null").select("id", "raw_text", "source_kind").join(F.broadcast(chosen), "id").dropDuplicates(["id", "lang"])
    parts, labels, fold, owner = [], [], [], []
    for d in sorted(picked.collect(), key=lambda d: (LANGS.index(d.lang), hash_of(d.id), d.id)):  # SAMPLE documents a language at most
        mine = sorted({x for *_, x in sentences(d.raw_text, d.source_kind) if len(x) > 20}, key=lambda x: (hash_of(x), x))[:SENTENCES]
        parts += mine
        labels += [LANGS.index(d.lang)] * len(mine)
        fold += [hash_of(d.id) % 5] * len(mine)
        owner += [d.id] * len(mine)
    if not parts:
        return np.zeros((DIM, len(LANGS)), np.float32), np.zeros(len(LANGS), np.float32), 1.0
    labels, fold = np.array(labels), np.array(fold)
    order = np.random.default_rng(1).permutation(len(parts))
    learn = [i for i in order if fold[i]]
    weights, bias = train([parts[i] for i in learn], labels[learn], idf)
    # a document whose sentences together contradict its label is left out, and so is a sentence that does
    _, doc = np.unique(owner, return_inverse=True)
    for _ in range(CLEANINGS):
        z = log_softmax(scores(parts, weights, bias))
        whole = np.zeros((doc.max() + 1, len(LANGS)))
        np.add.at(whole, doc, z)
        agree = (z.argmax(1) == labels) & (whole.argmax(1)[doc] == labels)
        learn = [i for i in order if fold[i] and agree[i]]
        if not learn:
            return weights, bias, 1.0
        weights, bias = train([parts[i] for i in learn], labels[learn], idf, 2)
    held = np.flatnonzero((fold == 0) & agree)
    t = temperature(scores([parts[i] for i in held], weights, bias), labels[held]) if len(held) else 1.0
    return weights, bias, t


def hash_of(s: str) -> int:
    return zlib.crc32(s.encode())


def segments(parts: list[tuple[int, int, str]], logp: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(language, start, stop, letters, confidence) of the runs of sentences in one language."""
    n = np.array([sum(map(str.isalpha, x)) for *_, x in parts])
    em = (logp * (np.minimum(n, 200) / 30)[:, None]).tolist()
    k = len(LANGS)
    score, back = em[0], []
    for row in em[1:]:
        best = max(range(k), key=lambda q: score[q])
        arg = [s if score[s] >= score[best] - SWITCH else best for s in range(k)]
        score = [max(score[s], score[best] - SWITCH) + row[s] for s in range(k)]
        back.append(arg)
    s = max(range(k), key=lambda q: score[q])
    path = [s]
    for arg in reversed(back):
        s = arg[s]
        path.append(s)
    path.reverse()
    out, i = [], 0
    while i < len(path):
        j = i
        while j < len(path) and path[j] == path[i]:
            j += 1
        w = np.maximum(n[i:j], 1)
        conf = float((np.exp(logp[i:j, path[i]]) * w).sum() / w.sum())
        out.append((path[i], parts[i][0], parts[j - 1][1], int(n[i:j].sum()), conf))
        i = j
    return out


_SEG = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("letters", pa.int32()), ("confidence", pa.float64())])


def _identified(weights: np.ndarray, bias: np.ndarray, t: float):
    def run(batches):
        for b in batches:
            docs = [sentences(x, k) for x, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            flat = [x for d in docs for *_, x in d]
            logp = log_softmax(scores(flat, weights, bias) / t) if flat else np.zeros((0, len(LANGS)))
            out, at = [], 0
            for d in docs:
                segs = segments(d, logp[at : at + len(d)]) if d else []
                at += len(d)
                out.append([{"lang": LANGS[s], "start": a, "stop": e, "letters": n, "confidence": c} for s, a, e, n, c in segs])
            yield pa.record_batch([b.column(0), b.column(3), pa.array(out, pa.list_(_SEG))], ["document_id", "label", "segments"])

    return run


def document_segments(docs: DataFrame) -> DataFrame:
    """(document_id, label, segments) of every row with an id and a text; label is the language its label names, or null.

    Positions of segments are those of the readable text: without markup, odd characters resolved.
    """
    model = fit(docs)
    rows = docs.filter("id is not null and raw_text is not null").select("id", "raw_text", "source_kind", label_language(F.col("lang_label")).alias("label"))
    return spread(rows).mapInArrow(_identified(*model), "document_id string, label string, segments array<struct<lang:string,start:int,stop:int,letters:int,confidence:double>>")


def document_languages(docs: DataFrame) -> DataFrame:
    """(document_id, label, lang, letters, confidence, is_main): the languages of every distinct document with letters."""
    seg = document_segments(docs).withColumn("s", F.explode("segments")).select("document_id", "label", F.col("s.*"), F.aggregate("segments", F.lit(0), lambda a, x: a + x.letters).alias("whole"))
    per = seg.groupBy("document_id", "lang").agg(
        F.max("label").alias("label"), F.max("whole").alias("whole"), F.max("letters").alias("longest"),
        F.sum(F.col("letters") * F.col("confidence")).alias("sure"), F.sum("letters").alias("letters"),
    )
    # read twice below; without this the texts would be labelled twice
    per = materialize(per.filter((F.col("longest") >= LETTERS) | (F.col("longest") * 2 > F.col("whole"))))
    main = per.groupBy("document_id").agg(F.max_by("lang", F.struct("letters", "lang")).alias("main"), F.count("*").alias("n_langs"))
    return per.join(main, "document_id").select("document_id", "label", "lang", "letters", (F.col("sure") / F.greatest("letters", F.lit(1))).alias("confidence"), (F.col("lang") == F.col("main")).alias("is_main"), "n_langs")


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct document's languages with their letters and confidence."""
    return document_languages(table(spark, sf_dir, "imported_documents"))


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct document's segments in order, each with its language and confidence."""
    seg = document_segments(table(spark, sf_dir, "imported_documents")).select("document_id", F.posexplode("segments").alias("segment_no", "s"))
    return seg.select("document_id", "segment_no", "s.*").dropDuplicates(["document_id", "segment_no"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = document_languages(table(spark, sf_dir, "imported_documents"))
    return langs.filter("n_langs > 1 or label is null or label != lang").select("document_id", "lang")


QUERIES = {"p6_found": p6_found, "p6_languages": p6_languages, "p6_segments": p6_segments}
