"""The pipeline's decisions, row by row, against a plain chain of its five stages; and
language identification against plain compression."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pandas as pd
import public_tokenizers
import pytest
import zstandard as zstd
from conftest import SMALL
from pricepanel.llm import langid, queries
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def plain_language(text, dictionaries):
    """(language, margin) by compressing the blocks of a text with every dictionary."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data, sizes = text.lower().encode(), {}
    level = langid.FINE_LEVEL if len(data) <= langid.FINE_BYTES else langid.LEVEL
    for lang, content in dictionaries.items():
        raw = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=level)
        coder = zstd.ZstdCompressor(dict_data=raw, level=level, write_content_size=False, write_dict_id=False)
        sizes[lang] = sum(len(coder.compress(data[i : i + 4096])) for i in range(0, len(data), 4096))
    order = sorted(sizes, key=lambda k: (sizes[k], k))
    return order[0], (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return langid.fit(docs.filter(~langid.held_out()))


def test_language_equals_plain_compression(spark, learned):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op1_language"](spark, SMALL).collect():
        assert (r["lang_pred"], r["score"]) == plain_language(docs[r["doc_id"]], learned)


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'xyz'[j]} " * 40, f"l{i}") for i in range(300) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.fit(docs)
    assert len(got) == 300
    # The texts of a language share its bytes evenly.
    assert all(sum(t in d for t in (f"{x}".encode() for x in "xyz")) == 3 for d in got.values())


def language(rows, learned):
    out = {}
    for i, t in rows.items():
        lang, margin = plain_language(t, learned)
        if lang != "und" and margin >= langid.NARROW:
            out[i] = t
    return out


def lines(rows):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows.items():
        for line in t.split("\n"):
            holders[key(line)].add(i)
    gone = {k for k, v in holders.items() if k and len(v) >= 10}
    return {i: "\n".join(x for x in t.split("\n") if key(x) not in gone) for i, t in rows.items()}


def near(rows):
    bags = {}
    for i, t in rows.items():
        w = t.lower().split()
        bags[i] = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    by_shingle = defaultdict(set)
    for i, bag in bags.items():
        for s in bag:
            by_shingle[s].add(i)
    group = {i: i for i in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, bag in bags.items():
        for j in {j for s in bag for j in by_shingle[s] if j > i}:
            shared = sum((bag & bags[j]).values())
            if shared / (bag.total() + bags[j].total() - shared) >= 0.8:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {i: t for i, t in rows.items() if root(i) == i}


def decontaminated(rows, folder):
    pd.DataFrame({"doc_id": list(rows), "text": list(rows.values())}).to_parquet(folder / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/d.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    found = {r[0] for r in con.execute(queries.SQL["op2_decontaminate"]).fetchall()}
    return {i: t for i, t in rows.items() if i not in found}


def test_run_equals_plain_chain(spark, learned, tmp_path):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    top = int(table.doc_id.max()) + 1
    long = next(t for t in table.text if len(t.split()) > 300)
    words = long.split()
    planted = [
        None, "", "12 34 !!", long, " ".join(words[:-4]), " ".join([*words[:150], *["zzz"] * 4, *words[150:]]),
        f"{long[: len(long) // 3]}\n{item}\nthe end of it", *[f"shared line of ten\n{table.text[k]}" for k in range(11)],
    ]
    more = pd.DataFrame({"doc_id": range(top, top + len(planted)), "text": planted, "lang": None, "source": "planted", "n_chars": [len(t or "") for t in planted]})
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    data = tmp_path / "data"
    extra = spark.createDataFrame(more.astype(object).where(more.notna(), None).values.tolist(), "doc_id long, text string, lang string, source string, n_chars long")
    whole = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(extra.select(*[F.col(f.name).cast(f.dataType) for f in schema]))
    whole.write.parquet(str(data / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(data / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(data)).collect()}

    rows = {r["doc_id"]: r["text"] for r in whole.select("doc_id", "text").collect()}
    learned = langid.fit(whole.filter(~langid.held_out()))
    kept = [rows, language(rows, learned)]
    kept.append(lines(kept[-1]))
    kept.append(near(kept[-1]))
    kept.append(decontaminated(kept[-1], tmp_path))
    assert all(len(a) > len(b) for a, b in ((kept[0], kept[1]), (kept[2], kept[3]), (kept[3], kept[4])))
    assert any(kept[1][i] != kept[2][i] for i in kept[2])
    assert set(got) == set(kept[-1])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in kept[-1].items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
