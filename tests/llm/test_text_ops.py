"""Language ID, personal data, token files, line dedup and BPE against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import difference, oracle
from conftest import SMALL
from pricepanel.llm import bpe, langid, linededup, pii, queries, tokenfile
from pricepanel.session import scratch
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n", "a", "It's  2 o'clock, WE'LL see!", "Straße ΣΑΣ İstanbul naïve é", "x\x1cy\x85z w",
    "a<|endoftext|>b <|startoftext|>", "漢字 한국어 한", "😀👍🏽 ①②", "q" * 3000, "ab" * 700 + "é" * 90, "́x", "don't 'S 'Ve",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, score string")


def test_codec_equals_library(library):
    codec = bpe.Codec(open(VOCABULARY, encoding="utf-8").read())
    rng = np.random.default_rng(4)
    letters = [chr(c) for c in range(0x250)] + ["́", "Σ", "字", "😀", "<|endoftext|>", "'ll", " "]
    texts = ODD[1:] + ["".join(rng.choice(letters, n)) for n in rng.integers(0, 200, 300)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_encode_and_decode_frames(spark, library):
    docs = frame(spark, ODD)
    rows = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False) and r["score"] == "keep"
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("texts", [ODD, []])
def test_round_trip_digests(spark, library, texts):
    import hashlib

    for r in bpe.round_trip_digests(frame(spark, texts), VOCABULARY).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_files(spark, library):
    texts = [*ODD, *["same text"] * 5]
    docs = spark.createDataFrame([(None if i == 3 else i - 4, t) for i, t in enumerate(texts)], "doc_id long, text string")
    path = scratch(spark, "tokens")
    tokenfile.write(docs.repartition(3), path, VOCABULARY)
    rows = tokenfile.read(spark, path).orderBy(F.asc_nulls_first("doc_id")).collect()
    want = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0]))
    start = 0
    for r, (i, text) in zip(rows, want, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)


def test_token_files_of_nothing(spark):
    path = scratch(spark, "tokens")
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), path, VOCABULARY)
    assert tokenfile.read(spark, path).count() == 0


def test_language_on_held_out_texts(spark):
    got = queries.op1_language(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().merge(got, on="doc_id", validate="1:1")
    assert (docs["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in docs["doc_id"]]).all()
    held = docs[docs["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95
    assert docs["score"].between(0, 1).all()


def test_language_edge_cases(spark):
    some = {"en": b"the cat and the dog and the house " * 40, "de": "der hund und die katze über das haus ".encode() * 40}
    docs = frame(spark, [None, "", "12 34 !?", "the house and the dog and the cat", "die katze und der hund über das haus", "THE DOG AND THE CAT " * 9000])
    got = {r["doc_id"]: r for r in langid.predict(docs, some).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["und", "und", "und", "en", "de", "en"]
    assert [got[i]["rejected"] for i in range(6)] == [True, True, True, False, False, False]
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}
    one = langid.predict(docs.filter("doc_id > 2"), {"en": some["en"]}).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0)}
    assert langid.fit(spark.createDataFrame([(None, "en"), ("x y", None), ("12", "en")], "text string, lang string")) == {}


def test_language_of_many_copies_is_learned(spark):
    docs = spark.range(30_000).selectExpr("'hot words of one text' AS text", "'xx' AS lang")
    rest = spark.createDataFrame([(f"other text {i}", lang) for i in range(12) for lang in ("xx", "yy")], "text string, lang string")
    learned = langid.fit(docs.unionByName(rest))
    assert sorted(learned) == ["xx", "yy"]
    assert sorted(learned["xx"].decode().split("\n")) == sorted(["hot words of one text"] + [f"other text {i}" for i in range(12)])


def test_keep_known_keeps_columns(spark):
    docs = spark.createDataFrame(
        [(i, ("the red house and the dog " if i % 2 else "das rote haus und der hund ") * 5, "en" if i % 2 else "de", "x") for i in range(60)]
        + [(60, "123", None, "x"), (61, None, "en", "x")],
        "doc_id long, text string, lang string, rejected string",
    )
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(60))
    assert langid.keep_known(docs.limit(0)).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def fits(kind, m):
        d = [int(c) for c in m if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            doubled = [v * 2 - 9 * (v > 4) if i % 2 else v for i, v in enumerate(d[::-1])]
            return 12 <= len(d) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if fits(k, m.group())]
    return [f"{k}:{a}:{z}" for a, _, k, z in sorted(found)]


def test_pii_against_plain_patterns(spark):
    rng = np.random.default_rng(8)
    parts = ["1", "23", "255", "256", ".", "-", " ", "+", "(", ")", "a", "@", ".com", "é", "😀", "\n", "4111 1111 1111 1111", "5500-0000-0000-0004", "10.0.0.1", "x@y.z", "+1 (555) 123-4567", "a@b.c_d@e.f"]
    texts = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 30, 1500)]
    texts += [None, "", "1" * 5000, "1." * 400, "a." * 900 + "@x.y", "+1" + " 1" * 900, "a" * 5000 + "@b.c" * 3, "0255.1.1.001", "1 " * 2000]
    rows = pii.find(frame(spark, texts).withColumnRenamed("score", "spans")).collect()
    for r in rows:
        base = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in PLAIN]
        assert base == plain_spans(r["text"]), r["text"]


def test_pii_added_kinds_and_context(spark):
    texts = ["IBAN DE89370400440532013000 ok", "DE89370400440532013001", "my SSN 123-45-6789", "123-45-6789", "ssn 000-12-3456", "call +1 555 123 4567"]
    got = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["spans"]] for r in pii.find(frame(spark, texts)).collect()}
    assert got == {0: [("iban", 1.0)], 1: [], 2: [("ssn", 0.5)], 3: [], 4: [], 5: [("phone", 0.7)]}
    assert pii.digests(frame(spark, [])).count() == 0


def test_pii_plan_is_native(spark):
    plan = queries.op4_pii(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_line_dedup_query(spark):
    got = queries.op8_line_dedup(spark, SMALL).toPandas()
    assert difference(got, oracle(SMALL).execute(queries.SQL["op8_line_dedup"]).df()) is None


def test_line_dedup_edges(spark):
    texts = [*["Footer \nunique %d" % i for i in range(4)], "footer", "FOOTER\nfooter\n\n", None, "", " \t\v\nx", "É\nfooter\r"]
    got = {r["doc_id"]: r for r in linededup.dedup(frame(spark, texts).withColumnRenamed("score", "n_lines"), 3).collect()}
    assert [got[i]["kept_text"] for i in range(10)] == [*["unique %d" % i for i in range(4)], "", "\n", "", "", " \t\v\nx", "É"]
    assert [got[i]["n_dropped"] for i in range(10)] == [1, 1, 1, 1, 1, 2, 0, 0, 0, 1]
    again = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "doc_id long, text string")
    assert {r["n_dropped"] for r in linededup.dedup(again, 3).collect()} == {0}
    kept = linededup.rewrite(frame(spark, texts), 3)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"]: r["text"] for r in kept.collect()}[6] is None
    assert linededup.dedup(frame(spark, []), 3).count() == 0


def test_line_state_is_reversible(spark):
    first = frame(spark, [f"common\nonly {i}" for i in range(5)])
    second = frame(spark, ["common\nrising"] * 4).withColumn("doc_id", F.col("doc_id") + 100)
    refs = linededup.references(first).cache()
    filters = linededup.filters_of(refs, 4, 2).cache()
    more, grown = (x.cache() for x in linededup.change(refs, filters, second, 1, 4, 2))
    whole = linededup.references(first.unionByName(second))
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, whole.collect()))
    hot = {(r["hi"], r["lo"]) for r in more.collect() if r["refs"] >= 4}
    held = {r["shard"]: linededup._load(r) for r in grown.collect()}
    assert len(hot) == 2 and all(held[lo % 2].contains(np.array([hi]))[0] for hi, lo in hot)
    back, shrunk = linededup.change(more, grown, second, -1, 4, 2)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, refs.collect()))
    assert sum((linededup._load(r).slots > 0).sum() for r in shrunk.collect()) == 1


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    f = linededup.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20000)
    assert f.contains(others).mean() < 0.002
    for k in keys[:1500].tolist():
        assert f.delete(k)
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.01
    assert Counter(f.slots.ravel() > 0)[True] == 1500
