"""Whole licence texts as they are shipped, in other spellings and wrappings, against a plain re-implementation."""

import hashlib
import re
from pathlib import Path

import pytest

from gradewright.llm import licenses

LOWER = {i: i + 32 for i in range(65, 91)}
SHIPPED = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0-Perl"}


def digest(text):
    out = re.sub(licenses.COPYRIGHT_LINE, "\n", text.translate(LOWER))
    out = f" {re.sub(licenses.PUNCTUATION, ' ', out).strip(' ')} "
    for a, b in licenses.SPELLINGS:
        out = out.replace(f" {a} ", f" {b} ").replace(f" {a} ", f" {b} ")
    return hashlib.sha256(out.strip(" ").encode()).hexdigest()


def scan(spark, texts, **table):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    return [r for r in sorted(licenses.scan(docs, licenses.known(spark, **table)).collect(), key=lambda r: r.doc_id)]


def test_own_texts(spark):
    whole = [(n, t) for n, t, w in licenses.listed() if w]
    texts = []
    for n, t in whole:
        wrapped = re.sub(r"(.{50,70}) ", "\\1\n// ", t)
        texts += [t, t.upper(), wrapped, f"Copyright (c) 2019-2021 Jane Doe <j@x.org>\nCopyright Example, Inc.\n\n{t}\n", t.replace("License", "Licence"), t + " changed", "Intro\n" + t]
    got = scan(spark, texts)
    names = {}
    for n, t in whole:
        names[digest(t)] = min(n, names.get(digest(t), n))
    for r, t in zip(got, texts):
        assert r.canonical_sha256 == digest(t) and r.license == names.get(digest(t)), t[:80]
    for i, (n, t) in enumerate(whole):
        assert [r.license for r in got[7 * i : 7 * i + 5]] == [names[digest(t)]] * 5, (n, t[:60])
        assert got[7 * i + 5].license is None and got[7 * i + 6].license is None


@pytest.mark.skipif(not Path("/usr/share/common-licenses").is_dir(), reason="no shipped licence texts here")
def test_shipped_texts(spark):
    names = sorted(n for n in SHIPPED if Path("/usr/share/common-licenses", n).is_file())
    texts = [Path("/usr/share/common-licenses", n).read_text() for n in names]
    got = scan(spark, texts + [t.upper() for t in texts])
    assert [r.license for r in got] == [SHIPPED[n] for n in names] * 2


def test_wrapped_at_the_word(spark):
    """A line of the text that begins with the word itself is no copyright line."""
    isc = dict(licenses.TEXTS)["ISC"]
    wrapped = isc.replace("the above copyright notice", "the above\ncopyright notice")
    bsd = dict(licenses.TEXTS)["BSD-3-Clause"].replace("SHALL THE COPYRIGHT HOLDER", "SHALL THE\nCOPYRIGHT HOLDER")
    assert [r.license for r in scan(spark, [wrapped, bsd])] == ["ISC", "BSD-3-Clause"]


def test_spellings_side_by_side(spark):
    a, b = scan(spark, ["licence licence licence sub license", "license license license sublicense"])
    assert a.canonical_sha256 == b.canonical_sha256


def test_large_table_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MAX_KNOWN", 20)
    table = licenses.known(spark)
    docs = spark.createDataFrame([(1, dict(licenses.TEXTS)["MIT"]), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.license) for r in licenses.scan(docs, table).collect()) == [(1, "MIT"), (2, None)]
    monkeypatch.setattr(licenses, "MAX_KNOWN", 5)
    with pytest.raises(ValueError, match="notices"):
        licenses.scan(docs, table)
