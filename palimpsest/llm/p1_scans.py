"""Problem 1: pages of scans as continuous paragraphs.

Lines of a page are labelled by a hidden Markov model with the states header, number, body and break.
Its observations are layout features: place on the page, length against the page's width, how the line
begins and ends, whether it is a page number's form with this page's own number, and on how many of the
document's pages its top or bottom line recurs. Recurrence is compared after mapping characters
that scanning confuses to one, so altered copies count. Its tables start from a prior and are counted anew over the labels
of the whole corpus (hard expectation maximisation, in tables of fixed size).

A word that ends a body line with a hyphen goes on in the next body line, over headers and page ends, when
the corpus has the joined word, or has neither the hyphenated compound nor a word that takes its place.
A rare token is misread when undoing one confusion of scanning gives a word the corpus has
several times as often; digits inside words are all undone at once. In headers and page numbers, letters
among digits are misread digits. Look-alike characters of other scripts and forms are resolved first, so they
are no misreadings.

Null pages count as empty, so page numbers stay array positions; documents without pages give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.p3_addresses import _near as near_within
from palimpsest.llm.p4_lookalike import TWINS, plain
from palimpsest.plans.session import materialize, spread, table

#: What scanning makes of a character or pair, as (read, meant).
CONFUSED = [("c", "e"), ("l", "i"), ("f", "t"), ("0", "o"), ("9", "g"), ("5", "s"), ("1", "l"), ("1", "i"), ("6", "b"), ("6", "é"), ("8", "b"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("vv", "w")]
#: A misread token is so many times rarer than the word meant, which occurs at least LEAST times.
RARER, LEAST = 4, 4
#: Words more frequent than 1 in COMMON of all, of which there are fewer than COMMON, are known to all tasks; but for misread
#: ones they are no suspects.
COMMON = 50_000

#: Letters and digits of a line from which its recurrence tells something: shorter ones recur by chance.
SHORTEST = 6

HEADER, NUMBER, BODY, BREAK = range(4)
_twins = str.maketrans(TWINS)
_signs = re.compile(r"[\W_]+")
_foreign = re.compile("[Ͱ-ϿЀ-ԯ]")
_word = re.compile(r"[^\W_]+")
_tail_hyphen = re.compile(r"([^\W\d_]+)[-¬]\s*$")
_head_word = re.compile(r"\s*([^\W\d_]+)(?![@\w])")
_digit = "[0-9lIOoSBZ|]"
_label = r"[^\W\d_][^\W_]{0,5}\.?"
_own = re.compile(
    rf"(?:^|\s|\|)(?:({_label})\s*({_digit}{{1,4}})(?:\s*(?:van|of|sur|von|de|/)\s*{_digit}{{1,4}})?|[-–]\s*({_digit}{{1,4}})\s*[-–]|({_digit}{{1,4}})\s*/\s*{_digit}{{1,4}}|({_digit}{{1,4}}))\s*$"
)
_own_first = re.compile(rf"^\s*(?:({_label})\s*({_digit}{{1,4}})(?:\s*(?:van|of|sur|von|de|/)\s*{_digit}{{1,4}})?|[-–]\s*({_digit}{{1,4}})\s*[-–]|({_digit}{{1,4}})\s*/\s*{_digit}{{1,4}}|({_digit}{{1,4}}))(?=\s|$|\|)")
_to_digit = str.maketrans("lIOoSBZ|", "11005821")
_same = str.maketrans("1il|0o9g5s68bé", "llllooggssbbbe".replace("e", "c"), "")


def clean(text: str | None) -> str:
    """A page's look without odd characters; hyphens of all kinds that end a line as "-"."""
    t = plain(text) if text else ""
    return t.translate(_twins) if _foreign.search(t) else t


def confused_key(line: str) -> str:
    """A line with the characters that scanning confuses made equal, without signs."""
    k = line.lower()
    for a, b in (("rn", "m"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("vv", "w")):
        k = k.replace(a, b)
    k = k.translate(_same).replace("e", "c").replace("t", "f")
    for a, b in (("rn", "m"), ("lc", "k"), ("ll", "u"), ("ch", "dl")):
        k = k.replace(a, b)
    return _signs.sub("", k)


def own_number(line: str, page: int) -> tuple[int, int, str] | None:
    """(start, stop, form) of this page's own number at a line's end or beginning: form "alone", "marked" (with a word or signs) or "bare"."""
    for rx in (_own, _own_first):
        m = rx.search(line)
        if m and m[1] and confused_key(m[1]) not in _labels:
            # no page word: the number alone may still be the page's
            m = _bare.search(line) if rx is _own else None
        if not m:
            continue
        got = [g for g in (m.groups() if m.re is _bare else m.groups()[1:]) if g]
        if got[0].translate(_to_digit).lstrip("0") != str(page):
            continue
        s, e = m.span()
        if not line[:s].strip(" |") and not line[e:].strip(" |"):
            if not any(c.isdigit() for c in got[0]) and len(m[0].strip()) == len(got[0]) and not (len(got[0]) == 1 and got[0] in "lI"):
                continue
            return s, e, "alone"
        bare = m[0].strip(" |") == got[0]
        return s, e, "bare" if bare else "marked"
    return None


_bare = re.compile(rf"(?:^|\s|\|)(?:[-–]\s*({_digit}{{1,4}})\s*[-–]|({_digit}{{1,4}})\s*/\s*{_digit}{{1,4}}|({_digit}{{1,4}}))\s*$")
_labels = {confused_key(w) for w in ("pagina", "page", "seite", "blz", "pag", "p", "s")}


def edges(lines: list[str]) -> dict[int, int]:
    """Numbers of the first and last two lines that aren't blank, by their place: 1 first, 2 second, 3 last, 4 last but one."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    out: dict[int, int] = {}
    for place, i in ((2, full[1:2]), (4, full[-2:-1]), (1, full[:1]), (3, full[-1:])):
        for j in i:
            out[j] = place
    if len(full) == 1:
        out[full[0]] = 1
    return out


def stripped(line: str, number: tuple[int, int, str] | None) -> str:
    return line[: number[0]] + line[number[1] :] if number else line


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    return min(len(a), len(b)) >= 8 and near_within(a, b, max(2, len(a) // 8))


class Page:
    """A page's lines, the features of each and, after decoding, their labels."""

    __slots__ = ("labels", "lines", "numbers", "obs")


def document(pages: list[str | None]) -> list[Page]:
    """Pages with their lines' observations."""
    out, keys = [], []
    for k, text in enumerate(pages):
        p = Page()
        p.lines = clean(text).split("\n")
        p.numbers = {}
        mine = {}
        for i, place in edges(p.lines).items():
            line = p.lines[i]
            num = own_number(line, k + 1)
            if num:
                p.numbers[i] = num
            key = confused_key(stripped(line, num))
            if len(key) >= SHORTEST:
                mine[i] = (place, key)
        out.append(p)
        keys.append(mine)
    # how many other pages have a line's key at the same side
    counts: Counter = Counter(x for mine in keys for x in {(pl < 3, key) for pl, key in mine.values()})
    # altered copies keep their beginning or end
    tips: dict[tuple, set] = {}
    for side, key in counts:
        for e in ((side, 0, key[:4]), (side, 1, key[-4:])):
            tips.setdefault(e, set()).add(key)
    for k, p in enumerate(out):
        width = max((len(x) for x in p.lines), default=0)
        obs = []
        place = edges(p.lines)
        for i, line in enumerate(p.lines):
            if not line.strip():
                obs.append(0)
                continue
            again = 0
            if i in keys[k]:
                pl, key = keys[k][i]
                side = pl < 3
                near = tips[side, 0, key[:4]] | tips[side, 1, key[-4:]]
                again = int(counts[side, key] > 1 or any(x != key and _alike(key, x) for x in near))
            num = p.numbers.get(i)
            form = 0 if not num else {"alone": 1, "marked": 2, "bare": 3}[num[2]]
            short = len(line) < 0.75 * width
            ends = line.rstrip()[-1] in ".:!?,"
            # place 0..4, recurring, number's form, short, sentence end
            obs.append(1 + (((place.get(i, 0) * 2 + again) * 4 + form) * 2 + short) * 2 + ends)
        p.obs = obs
        out[k] = p
    return out


OBS = 1 + 5 * 2 * 4 * 2 * 2


def prior() -> tuple[np.ndarray, np.ndarray]:
    """Weights (as counts) of observations by state and of transitions, before the corpus is seen."""
    e = np.full((4, OBS), 0.01)
    e[BREAK, 0] = 50.0
    for o in range(1, OBS):
        x = o - 1
        ends, short, form, again, place = x & 1, x >> 1 & 1, x >> 2 & 3, x >> 4 & 1, x >> 5
        if place and again:
            e[HEADER, o] = 4.0
        # a number alone, or with a word for pages inside a line at the edge, is the page's
        if place and form in (1, 2):
            e[NUMBER, o] = 5.0 if form == 1 else 3.0
        e[BODY, o] = 4.0 if not place else 1.5 if not again and form not in (1, 2) else 0.05
    t = np.array([[0.1, 0.4, 3.0, 1.5], [0.4, 0.05, 2.0, 1.5], [0.3, 0.2, 8.0, 1.5], [0.3, 0.2, 4.0, 0.5]])
    return e, t


def decode(pages: list[Page], le: np.ndarray, lt: np.ndarray) -> None:
    """Most likely labels of each page's lines, from log tables."""
    for p in pages:
        n = len(p.obs)
        if not n:
            p.labels = []
            continue
        em = le[:, p.obs].T.tolist()
        score, back = em[0], []
        rows = lt.tolist()
        for i in range(1, n):
            new, arg = [], []
            for s in range(4):
                best = max(range(4), key=lambda q: score[q] + rows[q][s])
                arg.append(best)
                new.append(score[best] + rows[best][s] + em[i][s])
            score = new
            back.append(arg)
        s = max(range(4), key=lambda q: score[q])
        labels = [s]
        for arg in reversed(back):
            s = arg[s]
            labels.append(s)
        p.labels = labels[::-1]


def logs(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.log(e / e.sum(1, keepdims=True)), np.log(t / t.sum(1, keepdims=True))


def _counting(batches):
    """Counts of (kind, state, to) over the labels that the prior gives: kind 0 observations, 1 transitions."""
    le, lt = logs(*prior())
    e, t = np.zeros((4, OBS)), np.zeros((4, 4))
    for b in batches:
        for pages in b.column(0).to_pylist():
            doc = document(pages)
            decode(doc, le, lt)
            for p in doc:
                np.add.at(e, (p.labels, p.obs), 1)
                np.add.at(t, (p.labels[:-1], p.labels[1:]), 1)
    rows = [(k, i, j, float(m[i, j])) for k, m in ((0, e), (1, t)) for i, j in zip(*np.nonzero(m))]
    cols = list(zip(*rows)) or [(), (), (), ()]
    yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())], ["kind", "state", "at", "n"])


def learn(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log tables counted over the corpus; the result has 4 * OBS + 16 numbers at most, whatever the corpus."""
    e, t = prior()
    for r in docs.select("pages").mapInArrow(_counting, "kind int, state int, at int, n double").groupBy("kind", "state", "at").agg(F.sum("n").alias("n")).collect():
        (e if r.kind == 0 else t)[r.state, r.at] += r.n
    return logs(e, t)


def undone(token: str) -> set[str]:
    """What a token may have been before scanning: one confusion undone, or all its digits."""
    out = set()
    if any(c.isdigit() for c in token):
        if not any(c.isalpha() for c in token) or sum(c.isdigit() for c in token) > 6:
            return out
        options = [[y for x, y in CONFUSED if x == c] if c.isdigit() else [c] for c in token]
        if all(options):
            made = [""]
            for o in options:
                made = [m + x for m in made for x in o]
            out.update(made)
        return {x for x in out if x.isalpha()}
    for x, y in CONFUSED:
        if x.isalpha():
            i = token.find(x)
            while i >= 0:
                out.add(token[:i] + y + token[i + len(x) :])
                i = token.find(x, i + 1)
    return out


def body_runs(doc: list[Page]) -> list[list[tuple[int, str]]]:
    """Paragraphs of the document as lists of (page, line); a paragraph goes on over headers and page ends."""
    out: list[list[tuple[int, str]]] = []
    run: list[tuple[int, str]] = []
    for k, p in enumerate(doc):
        seen = False
        for i, (line, label) in enumerate(zip(p.lines, p.labels)):
            if label == BODY and line.strip():
                if run and run[-1][0] == k and p.lines[i - 1].strip() and run[-1][1].rstrip()[-1:] in ".:!?" and len(run[-1][1]) < 0.75 * max(map(len, p.lines)):
                    out.append(run)
                    run = []
                seen = True
                run.append((k, line))
            elif label == BREAK and run and run[-1][0] == k and seen:
                # a break before the page's last body line ends the paragraph, one after it only at a sentence's end
                if any(la == BODY and x.strip() for x, la in zip(p.lines[i + 1 :], p.labels[i + 1 :])) or run[-1][1].rstrip()[-1:] in ".:!?":
                    out.append(run)
                    run = []
    return [*out, run] if run else out


def splits(run: list[tuple[int, str]]) -> list[tuple[int, str, str]]:
    """(index in run, left, right) of words that end a line with a hyphen and go on in the next."""
    out = []
    for j in range(len(run) - 1):
        a = _tail_hyphen.search(run[j][1])
        if a and (b := _head_word.match(run[j + 1][1])):
            before = run[j][1][: a.start()][-1:]
            if before not in ("@", ".", "/", "_", "-") and run[j + 1][1][b.end() : b.end() + 1] not in ("@", "_"):
                out.append((j, a[1], b[1]))
    return out


CONJUNCTIONS = {"en", "of", "et", "ou", "und", "oder", "and", "or", "tot", "à"}


def findings(pages: list[str | None], le: np.ndarray, lt: np.ndarray, common: frozenset) -> list[tuple[int, str, str | None, str | None]]:
    """(page_no, kind, token, other): sure cases have no token; "split" asks for token (joined) and other (compound),
    "suspect" asks for token."""
    doc = document(pages)
    decode(doc, le, lt)
    out: set[tuple[int, str, str | None, str | None]] = set()
    heads: Counter = Counter()
    head_pages: dict[tuple[int, bool], set[int]] = {}
    for k, p in enumerate(doc):
        for i, label in enumerate(p.labels):
            num = p.numbers.get(i)
            line = p.lines[i]
            if label == HEADER:
                # recurrence is an observation of the model; a header stands on two pages or more
                if (p.obs[i] - 1) >> 4 & 1:
                    out.add((k + 1, "running_header", None, None))
                for w in _word.findall(stripped(line, num)):
                    if any(c.isdigit() for c in w) and any(c in "lIOoSB" for c in w) and all(c.isdigit() or c in "lIOoSB" for c in w):
                        out.add((k + 1, "misread", None, None))
            if num and label in (NUMBER, HEADER):
                out.add((k + 1, "page_number", None, None))
                if any(c.isalpha() or c == "|" for c in "".join(re.findall(r"(?<![^\W\d])[0-9lIOoSBZ|]{1,4}(?![^\W\d])", line[num[0] : num[1]]))) and not re.fullmatch(r"[\s|]*[^\d]*\d+\D*\d*[\s|]*", line[num[0] : num[1]]):
                    out.add((k + 1, "misread", None, None))
                elif re.search(r"(?<![^\W_])(?:[lIOoSBZ]*\d[lIOoSBZ]+\d*|[lIOoSBZ]+\d+|[lIO]{1,2})(?![^\W_])", line[num[0] : num[1]]):
                    out.add((k + 1, "misread", None, None))
                for w in _word.findall(line[num[0] : num[1]]):
                    if len(w) > 2 and w.lower() not in common:
                        out.add((k + 1, "suspect", w.lower(), None))
            if label == HEADER:
                for w in _word.findall(stripped(line, num)):
                    if len(w) > 2 and w.lower() not in common:
                        out.add((k + 1, "suspect", w.lower(), None))
    for run in body_runs(doc):
        cut = {j: (a, b) for j, a, b in splits(run)}
        for j, (a, b) in cut.items():
            low = (a + b).lower()
            if low in common:
                out.add((run[j][0] + 1, "split_word", None, None))
            else:
                kind = "split" if b[0].islower() and b.lower() not in CONJUNCTIONS else "split_if_known"
                out.add((run[j][0] + 1, kind, low, f"{a}-{b}".lower()))
                out.add((run[j][0] + 1, "suspect", low, None))
        for j, (k, line) in enumerate(run):
            s = line
            if j - 1 in cut:
                s = s[len(cut[j - 1][1]) + len(s) - len(s.lstrip()) :]
            if j in cut:
                s = s[: s.rstrip().rfind(cut[j][0])]
            for w in _word.findall(s):
                if len(w) > 2 and (lw := w.lower()) not in common:
                    out.add((k + 1, "suspect", lw, None))
    return list(out)


def _vocabulary(batches):
    """Counts of lower-case words of each batch, hyphenated compounds too; a word cut by a line end isn't counted."""
    rx = re.compile(r"[^\W_]+(?:-[^\W_]+)*(?![-¬]?\n|\w)")
    for b in batches:
        c: Counter = Counter()
        for t in b.column(0).to_pylist():
            c.update(rx.findall(clean(t).lower()))
        for w in [w for w in c if "-" in w]:
            for x in w.split("-"):
                c[x] += c[w]
        yield pa.record_batch([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])


def _readings(batches):
    for b in batches:
        token, reading = [], []
        for t in b.column(0).to_pylist():
            u = undone(t)
            token += [t] * len(u)
            reading += u
        yield pa.record_batch([pa.array(token, pa.string()), pa.array(reading, pa.string())], ["token", "word"])


def _found(le, lt, common):
    def run(batches):
        for b in batches:
            rows = [(d, *r) for d, pages in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in findings(pages, le, lt, common)]
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            yield pa.record_batch([pa.array(c, ty) for c, ty in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["document_id", "page_no", "kind", "token", "other"])

    return run


def meant_words(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(token, reading): what misread tokens were, by the corpus's counts; other tokens have no row."""
    readings = asked.mapInArrow(_readings, "token string, word string").join(words, "word").filter(F.col("n") >= F.when(F.length("token") < 4, 50 * LEAST).otherwise(LEAST))
    own = words.withColumnRenamed("word", "token").withColumnRenamed("n", "own")
    meant = readings.join(own, "token", "left").filter(F.col("n") >= RARER * F.coalesce("own", F.lit(0)))
    return meant.groupBy("token").agg(F.max_by("word", F.struct("n", "word")).alias("reading"))


def scan_model(docs: DataFrame):
    """Documents with pages, the model's tables, the words' counts and the set of common words."""
    has = docs.filter("id is not null and size(pdf_pages) > 0").select(F.col("id").alias("document_id"), F.col("pdf_pages.text").alias("pages"))
    has = spread(has, "document_id")
    le, lt = learn(has)
    texts = spread(docs.select(F.col("raw_text").alias("text")).filter("text is not null"))
    words = materialize(texts.mapInArrow(_vocabulary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    often = words.filter(F.col("n") > max(total // COMMON, LEAST)).select("word")
    # a frequent word that is itself a misreading of a far more frequent one stays a suspect
    common = frozenset(r.word for r in often.join(meant_words(often.withColumnRenamed("word", "token"), words), F.col("word") == F.col("token"), "left_anti").collect())
    return has, le, lt, words, common


def scan_noise(docs: DataFrame, model=None) -> DataFrame:
    """(document_id, page_no, kind, token, reading): noise found on the pages; reading is the word meant by a misread token,
    or the joined word of a divided one."""
    has, le, lt, words, common = model or scan_model(docs)
    found = materialize(has.mapInArrow(_found(le, lt, common), "document_id string, page_no int, kind string, token string, other string").distinct())
    sure = found.filter("token is null").select("document_id", "page_no", "kind", F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("reading"))
    asked = found.filter("kind = 'suspect'").select("token").distinct()
    meant = meant_words(asked, words)
    misread = found.filter("kind = 'suspect'").join(meant, "token").select("document_id", "page_no", F.lit("misread").alias("kind"), "token", "reading")
    cut = found.filter("kind in ('split', 'split_if_known')").join(words.select(F.col("word").alias("token"), F.col("n").alias("joined")), "token", "left")
    cut = cut.join(words.select(F.col("word").alias("other"), F.col("n").alias("compound")), "other", "left").join(meant.select("token", F.lit(True).alias("altered")), "token", "left")
    divided = (F.col("joined") > 0) | F.col("altered") | ((F.col("kind") == "split") & F.col("compound").isNull())
    cut = cut.filter(divided).select("document_id", "page_no", F.lit("split_word").alias("kind"), "token", F.col("token").alias("reading"))
    return sure.unionByName(misread).unionByName(cut).distinct()


def _assembled(le, lt, common):
    """Paragraphs of a document, with its misread tokens and divided words repaired."""
    token = re.compile(r"[^\W_]+")

    def run(batches):
        for b in batches:
            texts = []
            for pages, fixes in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                meant = {f["token"]: f["reading"] for f in fixes or () if f["kind"] == "misread" and f["token"]}
                joined = {f["token"] for f in fixes or () if f["kind"] == "split_word" and f["token"]}
                doc = document(pages)
                decode(doc, le, lt)
                out = []
                for r in body_runs(doc):
                    cut = {j: (x + y).lower() for j, x, y in splits(r)}
                    text = ""
                    for j, (_, line) in enumerate(r):
                        line = line.strip()
                        if j in cut and (cut[j] in joined or cut[j] in common):
                            text += line[:-1]
                        else:
                            text += line + ("" if j in cut else " ")
                    out.append(token.sub(lambda m: _cased(m[0], meant.get(m[0].lower())), text.rstrip()))
                texts.append("\n\n".join(out))
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["document_id", "text"])

    return run


def _cased(token: str, reading: str | None) -> str:
    if not reading:
        return token
    return reading.upper() if token.isupper() and len(token) > 1 else reading.capitalize() if token[:1].isupper() else reading


def p1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, text) of every distinct scanned document as continuous paragraphs."""
    docs = table(spark, sf_dir, "imported_documents")
    model = scan_model(docs)
    fixes = scan_noise(docs, model).filter("token is not null").groupBy("document_id").agg(F.collect_set(F.struct("kind", "token", "reading")).alias("fixes"))
    has, le, lt, _, common = model
    return has.dropDuplicates(["document_id"]).join(fixes, "document_id", "left").mapInArrow(_assembled(le, lt, common), "document_id string, text string")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise(table(spark, sf_dir, "imported_documents")).select("document_id", "page_no", "kind").distinct()


QUERIES = {"p1_found": p1_found, "p1_text": p1_text}
