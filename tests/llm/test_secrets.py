"""All spans, the models' own among them, against a plain re-implementation, and rates on samples of another making."""

import random
import re
import uuid

import pytest

from gradewright.llm import secrets as S

BASE = ((r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", lambda m: len(m[0]) >= 24))


def mixed(s):
    return bool(re.search("[0-9]", s) and re.search("[A-Za-z]", s)) or len(re.findall("[a-z][A-Z]|[A-Z][a-z]", s)) >= S.CASE_CHANGES


def steps(s, table):
    c = [S.ALPHABET.find(x) + 1 for x in s]
    return [table[a * (S.SIZE + 1) + b] for a, b in zip(c, c[1:])]


def parts(s, table):
    """Parts whose ratio rises to MIN_TOTAL, cut where it has fallen by as much or to nothing, widened to separators, and joined where they overlap."""
    found, begin, end, run, best = [], 0, 0, 0.0, 0.0
    for i, x in enumerate(steps(s, table), 1):
        run += x
        if run > best:
            end, best = i + 1, run
        elif run <= 0 or run < best - S.MIN_TOTAL:
            if best >= S.MIN_TOTAL:
                found.append((begin, end, best))
            begin, end, run, best = i, i, 0.0, 0.0
    if best >= S.MIN_TOTAL:
        found.append((begin, end, best))
    out = []
    for a, b, score in found:
        while a and s[a - 1] not in "=/_-":
            a -= 1
        while b < len(s) and s[b] not in "=/_-":
            b += 1
        if b - a >= S.LEAST and score >= S.MIN_MEAN * (b - a) and mixed(s[a:b]):
            if out and out[-1][1] > a:
                out[-1] = (min(out[-1][0], a), b)
            else:
                out.append((a, b))
    return out


def expected(text, table):
    base = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m))
    more = []
    for m in re.finditer(S.CANDIDATE, text):
        total = sum(steps(m[0], table))
        if mixed(m[0]) and total >= S.MIN_TOTAL and total >= S.MIN_MEAN * len(m[0]):
            more.append((m.start(), 3, m.end()))
        else:
            more += [(m.start() + a, 3, m.start() + b) for a, b in parts(m[0], table)]
    more = [x for x in more if not any(s < x[2] and x[0] < e for s, _, e in base)]
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + more))


@pytest.fixture(scope="module")
def table(spark):
    return [float(f"{x:.6f}") for x in S.train(spark.createDataFrame(S.labelled_samples(), "text string, label int"))]


def test_spans(spark, table):
    rng = random.Random(12)
    chars = S.ALPHABET[:62]
    word = lambda: rng.choice(S.IDENTIFIER_WORDS)
    key = lambda: "".join(rng.choices(chars, k=rng.randint(8, 60)))
    make = (word, key, lambda: "/".join(word() for _ in range(rng.randint(1, 6))), lambda: f"{word()}_{word()}={key()}", lambda: f"/{word()}/{key()}/{word()}/{key()}", lambda: "é𝔘 ", lambda: f'token: "{key()}"',
            lambda: "AKIA" + key().upper(), lambda: uuid.UUID(int=rng.getrandbits(128)).hex, lambda: "\n", lambda: "".join(rng.choices(S.ALPHABET, k=rng.randint(15, 300))), lambda: "Ab" * rng.randint(4, 30), lambda: "=" * 30)
    texts = [None, "", *(" ".join(rng.choice(make)() for _ in range(rng.randint(1, 40))) for _ in range(100)), " ".join(f"token={key()}" for _ in range(700)), key() * 60]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(8)
    got = {r.doc_id: r.spans for r in S.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == expected(t or "", table), t and t[:200]
    assert sum("markov" in x for x in got.values()) > 40


def test_samples_of_another_making(spark, table):
    """Keys of base 32, base 58, base 64 and UUIDs; names of other words, in five notations."""
    import base64

    rng = random.Random(77)
    raw = lambda n: bytes(rng.getrandbits(8) for _ in range(n))
    b58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    keys = [f() for _ in range(100) for f in (lambda: base64.b32encode(raw(20)).decode(), lambda: base64.b64encode(raw(24)).decode(), lambda: "".join(rng.choices(b58, k=32)), lambda: base64.urlsafe_b64encode(raw(30)).decode())]
    words = "kitchen garden river mountain window teacher planet orange silver winter summer bridge castle doctor engine farmer guitar harbor island jacket ladder market needle office pepper rabbit saddle ticket umbrella violin".split()
    names = []
    for i in range(400):
        w = rng.choices(words, k=4)
        names.append(("_".join(w), "-".join(w), "/".join(w), w[0] + "".join(x.title() for x in w[1:]), "_".join(w).upper() + "_2024")[i % 5])
    d = spark.createDataFrame([(i, f"a {t} b") for i, t in enumerate(keys + names)], "doc_id long, text string")
    hit = {r.doc_id for r in S.scan(d).filter("n_markov > 0").select("doc_id").collect()}
    assert sum(i < 400 for i in hit) >= 380 and sum(i >= 400 for i in hit) <= 8
