"""Source divergence against SQL and against a plain version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import difference, oracle
from conftest import SMALL
from pricepanel.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, min_docs=10, most=10):
    """rows of (text, lang, source) -> set of result rows, with every pair and term written out."""
    groups, docs_of = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text)]
        groups[lang, source].update(words)
        docs_of[lang].update(set(words))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {k[0] for k in groups}:
        kept = [t for t, n in docs_of[lang].items() if n >= min_docs]
        own = {s: c for (k, s), c in groups.items() if k == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            found = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            out += [(lang, s, "pair", o, -x, i) for i, (x, o) in enumerate(sorted(found, key=lambda r: (r[0], r[1].encode())), 1)]
            found = [(-f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            found = sorted(found, key=lambda r: (r[0], r[1].encode()))[:most]
            out += [(lang, s, "term", t, -x, i) for i, (x, t) in enumerate(found, 1)]
    return set(out)


def made(spark, rows):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "text string, lang string, source string, rank int, term string")
    got = [tuple(r) for r in divergence.Audit(docs).report().collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(rng, n=300, sources=7):
    words = ["Alpha", "beta", "été", "Éa", "x1y", "don't", "漢字", "no-w", "q_r", "\x00z", "Z"] + [f"w{c}" for c in "abcdefgh"]
    for i in range(n):
        s = int(rng.integers(0, sources) ** 2 % sources)
        use = words[s : s + 9]
        lang = [None, "", "en", "de"][int(rng.integers(0, 4))]
        yield " ".join(rng.choice(use, rng.integers(0, 40))), lang, [None, "", "b", "B", "é", "z", "src1"][s]


@pytest.mark.parametrize("block", [2_000_000, 5])
def test_equals_plain_version(spark, monkeypatch, block):
    """Also when every block spills at once, segments are short and sums leave often."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SEGMENT", 1_000 if block > 5 else 2)
    monkeypatch.setattr(divergence, "SUMS", 1_000_000 if block > 5 else 3)
    monkeypatch.setattr(divergence, "TOGETHER", 200_000 if block > 5 else 4)
    rows = list(corpus(np.random.default_rng(8)))
    assert made(spark, rows) == plain(rows)


def test_edges(spark):
    assert made(spark, []) == set()
    lonely = [(None, None, None), ("", "en", "a"), ("rare words", "en", "b"), ("12 34", "en", "c")]
    assert made(spark, lonely) == plain(lonely)
    assert ("en", "a", "pair", "b", 0, 1) in made(spark, lonely)
    copies = [("same Text here " * 50, "en", s) for s in "ab" for _ in range(30)] + [("same " * 20_000, "en", "c")]
    got = made(spark, copies)
    assert got == plain(copies)
    assert ("en", "a", "pair", "b", 0, 2) in got


def test_equals_sql(spark):
    got = queries.QUERIES["op12_source_divergence"](spark, SMALL).toPandas()
    assert difference(got, oracle(SMALL).execute(queries.SQL["op12_source_divergence"]).df()) is None
    assert set(got["part"]) == {"pair", "term"}
