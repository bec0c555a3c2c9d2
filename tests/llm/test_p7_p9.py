import json
import random

from tokenizers import Tokenizer

from palimpsest.llm import p7_encode, p9_spans

WORDS = "de patiënt klaagt 12 mg over hoofdpijn l'état (stable) ok, naïve 😀 x​y   tab\tend".split(" ")


def _texts(n=60, seed=1):
    r = random.Random(seed)
    shared = [" ".join(r.choice(WORDS) for _ in range(90)) for _ in range(4)]
    out = [None, "", " ", "a", "<|endoftext|> is text", "x" * 9000, " " * 700, "é" * 700, "a\n\n\n b\r\n" * 100]
    for _ in range(n):
        parts = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 60)))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, 1), r.choice(shared))
        out.append(r.choice([" ", "\n\n", "", "  \n"]).join(parts))
    return out + out[10:14]


def test_ids_equal_direct_encoding(spark):
    texts = _texts()
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, "a", 3), (None, "zonder id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = p7_encode.encode_corpus(df).collect()
    tok = Tokenizer.from_file(p7_encode.tokenizer_dir() + "/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    want = sorted((str(i), json.dumps(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), json.dumps(list(r.ids))) for r in got) == want


def test_chunks_are_the_text_and_content_defined():
    for t in _texts():
        assert "".join(p7_encode.chunks_of(t or "")[0]) == (t or "")
    r = random.Random(2)
    body = "".join(r.choice("abcdefgh ") for _ in range(5000))
    a, b = p7_encode.chunks_of("voor" + body)[0], p7_encode.chunks_of("een ander begin " * 9 + body)[0]
    assert len(set(a) & set(b)) > len(a) * 0.7


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert p7_encode.encode_corpus(none).count() == 0
    assert p9_spans.shared_spans(none).count() == 0


def brute(texts, length):
    where = {}
    for i, t in texts:
        for s in range(len(t or "") - length + 1):
            where.setdefault(t[s : s + length], set()).add(i)
    out = {}
    for i, t in texts:
        hit = set()
        for s in range(len(t or "") - length + 1):
            if len(where[t[s : s + length]]) > 1:
                hit |= set(range(s, s + length))
        out[i] = out.get(i, 0) + len(hit)
    return out


def test_cover_aligns_every_pair_of_positions():
    cover = p9_spans.Cover(p9_spans.LENGTH)
    c, v = set(cover.places.tolist()), cover.period
    assert len(c) == 12 and {(a - b) % v for a in c for b in c} == set(range(v))


def test_shared_spans_equal_brute_force(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdeé 😀") for _ in range(n))
    base = [word(r.randint(200, 700)) for _ in range(12)]
    texts = [(0, None), (1, ""), (2, base[0]), (3, base[0]), (3, base[0]), (4, base[0][:239]), (5, base[1][:240]), (6, "x" + base[1][:240] + "y")]
    for i in range(7, 40):
        b = r.choice(base)
        n = r.choice([100, 239, 240, 241, 300])
        s = r.randint(0, max(0, len(b) - n))
        texts.append((i, word(r.randint(0, 150)) + b[s : s + n] + word(r.randint(0, 150))))
    texts.append((40, base[3] * 3))  # repeats within one record are no sharing
    df = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id long, text string, k string")
    got = {x.doc_id: x.shared_chars for x in p9_spans.shared_spans(df).collect()}
    assert got == brute(list(dict.fromkeys(texts)), p9_spans.LENGTH)


def test_spans_of_another_length(spark):
    r = random.Random(11)
    body = "".join(r.choice("abcde ") for _ in range(90))
    texts = [(1, body + "x" * 30), (2, "y" * 17 + body[:61]), (3, body[:39]), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x.doc_id: x.shared_chars for x in p9_spans.shared_spans(df, length=40).collect()}
    assert got == brute(texts, 40)


def test_texts_without_safe_points(spark):
    long = "日本語" * 40_000
    texts = ["a" * 70_000 + " b", long, long + " einde van de tekst " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = p7_encode.encoder(p7_encode.tokenizer_dir())[0]
    assert {r.doc_id: list(r.ids) for r in p7_encode.encode_corpus(df).collect()} == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
