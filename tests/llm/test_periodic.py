"""Runs of periodic words against brute force."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pricepanel.llm import periodic, queries
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def brute(words, least=24):
    """All runs, by comparing every pair of distances; a stretch keeps its smallest period."""
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (
        len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2],
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def as_words(numbers):
    return [b"w%d" % x for x in numbers]


def shapes(rng):
    """Texts with nested, adjacent and long-period repetition."""
    yield []
    yield [1] * 23
    yield [1] * 24
    yield [1] * 500
    for q in (2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65, 100, 130):
        unit = rng.integers(0, 1000, q).tolist()
        yield unit * 3
        yield unit * 3 + unit[:-1]
        yield (unit * 3)[:-1]
        yield rng.integers(0, 9, 11).tolist() + unit * 4 + rng.integers(0, 9, 11).tolist()
        # A period that is highly periodic itself.
        yield ([1] * q + [2]) * 4
        yield ([1, 2] * q + [3]) * 3 + [1]
        yield (([1] * q + [2]) * 3 + [5, 6]) * 4
        yield ([1] * q + rng.integers(0, 3, 4).tolist()) * 5
        yield unit * 3 + rng.integers(0, 99, q).tolist() + unit * 3
    a, b = [1], [1, 2]
    for _ in range(12):
        a, b = b, b + a  # Fibonacci words hold many overlapping runs
        yield b


def test_search_equals_brute_force():
    rng = np.random.default_rng(5)
    texts = [as_words(t) for t in shapes(rng)]
    texts += [as_words(rng.integers(0, k, n)) for k in (1, 2, 3, 4) for n in (24, 60, 200, 700)]
    together = periodic.search(texts)
    for words, got in zip(texts, together):
        assert got == brute(words), len(words)
        assert got == periodic.search([words])[0]
    short = periodic.search(texts, least=3)
    for words, got in zip(texts, short):
        assert got == brute(words, least=3)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 30)), max_size=5)
)
def test_search_on_drawn_texts(parts):
    words = as_words([x for unit, times in parts for x in unit * times])
    assert periodic.search([words, words[1:], words[::-1]]) == [brute(words), brute(words[1:]), brute(words[::-1])]


def test_hash_collisions_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic, "_mix", lambda x: x % np.uint64(3))
    rng = np.random.default_rng(6)
    for words in [as_words(t) for t in shapes(rng)][:90]:
        got = periodic.search([words])[0]
        assert set(got) <= set(brute(words))


def test_query_on_whole_table(spark):
    rows = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    checked = 0
    for r in docs:
        if len((r["text"] or "").split()) <= 1500:  # brute force is quadratic
            assert rows[r["doc_id"]] == expected(r["doc_id"], r["text"])
            checked += 1
    assert checked > 150 and any(v[0] for v in rows.values())


def test_edges(spark):
    texts = [None, "", " \t\r\n", "a", "a " * 30, "a b " * 20, "x\x1cy " * 12 + "z", "b c " * 24, "é " * 24, "q" * 100_000]
    schema = "doc_id long, text string, runs string, N_RUNS int, start int, collapsed int"
    docs = spark.createDataFrame([(i // 2, t, "r", 1, 2, 3) for i, t in enumerate(texts)] + [(None, "k " * 25, None, 1, 2, 3)], schema)
    got = periodic.digests(docs).collect()
    assert len(got) == len(texts) + 1
    by_text = {r["text"]: r["n_runs"] for r in got}
    assert by_text["a " * 30] == 1 and by_text["a b " * 20] == 1 and by_text[None] == 0 and by_text["x\x1cy " * 12 + "z"] == 0
    assert by_text["b c " * 24] == 1
    shown = {r["text"]: r["collapsed"] for r in periodic.collapse(docs).collect()}
    assert shown["a " * 30] == "a" and shown["a b " * 20] == "a b" and shown[None] == "" and shown["k " * 25] == "k"
    found = {r["text"]: r["runs"] for r in periodic.runs(docs).collect()}
    assert [tuple(x) for x in found["a b " * 20]] == [(0, 40, 2)] and found[""] == []
    changed = periodic.planted(docs).collect()
    assert len(changed) == len(texts) + 1 and [r["text"] for r in changed if r["doc_id"] is None] == ["k " * 25]
    empty = docs.limit(0)
    for f in (periodic.digests, periodic.collapse, periodic.runs):
        assert f(empty).count() == 0
    ids = docs.withColumn("text", F.lit("one two three four five six seven"))
    assert periodic.planted(ids).count() == len(texts) + 1


@pytest.mark.parametrize("doc_id", [1, 3, 17, 28, 40, 56, 64, 77, 91, 100])
def test_planted_equals_contract(spark, doc_id):
    text = " ".join(f"w{i % 13}" for i in range(97))
    docs = spark.createDataFrame([(i, text) for i in range(doc_id * 5, doc_id * 5 + 40)], "doc_id long, text string")
    for r in periodic.digests(periodic.planted(docs)).drop("text").collect():
        assert tuple(r)[1:] == expected(r["doc_id"], text)
