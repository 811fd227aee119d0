"""Decontamination, near duplicates, repeated strings, resharding and the pipeline against brute force."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from compare import difference, oracle
from conftest import SMALL
from pricepanel.llm import components, decontaminate, minhash, neardup_vectors, queries, reshard, substrings
from pyspark.sql import functions as F

RNG = np.random.default_rng(6)
LETTERS = np.array(list("abcdefghijklmnopqrstuvwxyz"))


def words(n):
    return ["".join(RNG.choice(LETTERS, 5)) for _ in range(n)]


def edited(w, *at):
    return [f"x{i}" if i in at else x for i, x in enumerate(w)]


def groups_of(pairs, nodes):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 7), (200, 201), (5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    want = groups_of(pairs, {x for p in pairs for x in p if p[0] != p[1]})
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaks_against_all_windows(spark):
    items = [words(n) for n in (14, 20, 33, 59, 4)] + [["again"] * 12]
    docs = {}
    for i, w in enumerate(items):
        docs[i] = words(30) + w + words(40)
        docs[20 + i] = edited(w, len(w) - 1)  # alone, shorter by its last shingle
        docs[40 + i] = words(3) + edited(w, 0, len(w) // 2) + words(3)
        docs[60 + i] = words(8) + w[: len(w) // 2] + ["inserted"] + w[len(w) // 2 :]
        docs[80 + i] = w[: max(1, len(w) * 6 // 10)] + words(30)
    docs[100] = items[2] + words(5) + items[3] + items[2]
    want = {}
    for d, w in docs.items():
        for k, item in enumerate(items):
            size = len(item)
            if size >= 5 and len(w) >= 5:
                best = max(jaccard(grams(w[a : a + size]), grams(item)) for a in range(max(1, len(w) - size + 1)))
                if best >= 0.8:
                    want[d, k] = round(best, 9)
    rows = [(d, " ".join(w).upper() if d % 3 else ", ".join(w), "c") for d, w in docs.items()] + [(200, None, "c"), (201, "", "c"), (None, " ".join(items[1]), "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.leaks(table, bench).collect()}
    assert got.pop((None, 1)) == 1.0
    assert got == want and len(want) > 8
    kept = decontaminate.keep_clean(table, bench)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == set(docs) - {d for d, _ in want} | {200, 201}
    assert decontaminate.leaks(table, bench.limit(0)).count() == 0 and decontaminate.leaks(table.limit(0), bench).count() == 0


def test_leaks_of_items_in_another_order(spark):
    items = [words(n) for n in (60, 100, 120, 200, 7)] + [["again", "and"] * 30 + words(40)]
    docs = []
    for w in items:
        half, quarter = len(w) // 2, len(w) // 4
        swapped, moved = w[half:] + w[:half], w[quarter : 2 * quarter] + w[:quarter] + w[2 * quarter :]
        docs += [swapped, words(30) + swapped + words(40), words(9) + moved + words(7), w[half:] + w[:half] + w[half:], words(5) + w[half:], moved[:-3]]
    want = {}
    for d, w in enumerate(docs):
        for k, item in enumerate(items):
            size = len(item) - 4
            own, shared = [tuple(w[i : i + 5]) for i in range(len(w) - 4)], grams(item)
            best = max((jaccard(Counter(own[a : a + size]), shared) for a in range(max(1, len(own) - size + 1))), default=0)
            if best >= 0.8:
                want[d, k] = round(best, 9)
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.leaks(table, bench).collect()}
    assert got == want and len(want) > 12


@pytest.mark.parametrize("name", ["op2_decontaminate", "op3_near_vectors", "op9_minhash"])
def test_pair_queries_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    assert difference(got, oracle(SMALL).execute(queries.SQL[name]).df()) is None


def test_multi_index_holds_every_print_within_the_radius():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        flipped = rng.choice(64, rng.integers(0, decontaminate.RADIUS + 1), replace=False)
        per_block = np.bincount(flipped // (64 // decontaminate.BLOCKS), minlength=decontaminate.BLOCKS)
        assert per_block.min() <= decontaminate.NEAR


def test_decontamination_plan_is_native(spark):
    plan = queries.op2_decontaminate(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_near_documents_against_all_pairs(spark):
    base, other = words(120), words(60)
    texts = [base, base, edited(base, 3), edited(base, 3, 90), edited(base, 60, 61, 62), edited(base, *range(0, 120, 11)), other, other + words(2), words(80), ["same"] * 50, ["same"] * 45, ["same"] * 20, ["one"], ["one"], ["two", "words"]]
    texts += [edited(base, i, i + 1) for i in range(10, 60)]
    sets = [minhash.shingles(w, minhash.WordHashes()) for w in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if minhash.similarity(sets[i], sets[j]) >= 0.8]
    for i, j in pairs[:40]:  # the exact measure itself, against counters of words
        if min(len(texts[i]), len(texts[j])) >= 5:
            assert jaccard(grams(texts[i]), grams(texts[j])) >= 0.8
    want = groups_of(pairs, range(len(texts)))
    rows = [(i, " ".join(w), "k") for i, w in enumerate(texts)] + [(500, None, "k"), (501, "", "k"), (502, " \n", "k"), (None, " ".join(base), "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string").repartition(5)
    got = {r["doc_id"]: r for r in minhash.report(docs).collect()}
    assert {i: got[i]["component_id"] for i in want} == want
    assert all(got[i]["kept"] == (want[i] == i) for i in want)
    assert all(got[i]["kept"] for i in (500, 501, 502, None))
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([i for i in want if want[i] == i] + [500, 501, 502, None])
    assert minhash.keep_first(docs.limit(0)).count() == 0


def test_near_documents_among_a_template(spark):
    # 0.75 alike through the template, the planted pairs 0.82; their ids lie far apart in every bucket.
    template, texts = words(200), []
    for k in range(600):
        w = list(template)
        w[40:45] = texts[-1][40:45] if k < 120 and k % 2 else words(5)
        w[110:125] = words(15)
        texts.append(w)
    ids = np.random.default_rng(31).permutation(len(texts))
    found = [grams(w) for w in texts]
    near = [(int(ids[i]), int(ids[i + 1])) for i in range(0, 120, 2)]
    assert all(jaccard(found[i], found[i + 1]) >= 0.8 for i in range(0, 120, 2))
    others = [jaccard(found[i], found[j]) for i in range(100, 140) for j in range(140, 400)]
    assert 0.74 < np.mean(others) and max(others) < 0.8
    docs = spark.createDataFrame([(int(i), " ".join(w)) for i, w in zip(ids, texts)], "doc_id long, text string")
    want = groups_of(near, range(len(texts)))
    assert {r["doc_id"]: r["component_id"] for r in minhash.report(docs).collect()} == want


def test_repeated_ids_leave_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A  b c d e f"), (3, "x"), (3, "y"), (4, "y")], "doc_id long, text string")
    assert Counter(r["doc_id"] for r in minhash.keep_first(docs).collect()) == {1: 1, 3: 1}


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(9)
    agree = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 200).astype(np.uint64)
        b = np.concatenate([a[:178], rng.integers(0, 2**63, 22).astype(np.uint64)])
        a, b = np.concatenate([a, a[:50]]), np.concatenate([b, b[:50]])
        agree.append((minhash.signature(minhash.strips(a)) == minhash.signature(minhash.strips(b))).mean())
        real = minhash.similarity(a, b)
    assert abs(np.mean(agree) - real) < 0.02


def test_near_vectors_against_all_pairs(spark):
    base = RNG.standard_normal((60, 24))
    near = base[:30] + RNG.standard_normal((30, 24)) * 0.04 * np.linalg.norm(base[:30], axis=1)[:, None] / np.sqrt(24) * RNG.uniform(1, 6, 30)[:, None]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(np.concatenate([base, near, base[:9], base[:9] * 2.5]))]
    rows += [(300 + i, (base[0] + 0.001 * i).tolist(), 0) for i in range(30)]
    odd = [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [1.0, None], 0), (904, base[0].tolist(), None), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    fine = [r for r in rows + odd if r[0] in (905, 906) or r[0] < 900]
    links = Counter()
    pairs = []
    for i, (a, x, p) in enumerate(fine):
        for b, y, q in fine[i + 1 :]:
            if p == q and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                pairs.append((a, b))
                links[a] += 1
                links[b] += 1
    want = groups_of(pairs, [r[0] for r in rows + odd])
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicates(table).collect()}
    assert len(got) == len(rows + odd) and len(pairs) > 400
    for v, top in want.items():
        assert (got[v]["n_links"], got[v]["component_id"], got[v]["kept"]) == (links[v], top, v == top), v
    assert neardup_vectors.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("piece", [4_000, 7])
def test_cut_cells_lose_no_pair(spark, piece, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "PIECE", piece)
    v = [(i, ((i % 5 == 0) + RNG.standard_normal(16) * 0.02).tolist(), 1) for i in range(60)]
    v = [(i, [x + 1.0 for x in e], t) for i, e, t in v]
    table = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")
    x = np.array([e for _, e, _ in v])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = ((x @ x.T >= 0.98).sum(1) - 1).tolist()
    got = {r["vec_id"]: r["n_links"] for r in neardup_vectors.near_duplicates(table).collect()}
    assert [got[i] for i in range(60)] == want


def test_suffix_arrays():
    for t in (b"banana", b"a" * 90, bytes(RNG.choice([97, 98], 400).tolist()), bytes(RNG.integers(97, 105, 900).tolist())):
        x = np.frombuffer(t, np.uint8)
        sa, rank = substrings.suffix_array(x)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        common = substrings.common_prefixes(x, sa, rank, 40)
        for i in range(1, len(t)):
            a, b, k = t[sa[i - 1] :], t[sa[i] :], 0
            while k < min(len(a), len(b), 40) and a[k] == b[k]:
                k += 1
            assert common[i] == k


def strings_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot, array_bytes", [(1_000, 2 << 20), (3, 2 << 20), (1_000, 3_000)])
def test_repeated_strings_against_brute_force(spark, hot, array_bytes, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_PIECES", hot)
    monkeypatch.setitem(substrings.repeated.__kwdefaults__ or {}, "array_bytes", array_bytes)
    monkeypatch.setattr(substrings.repeated, "__defaults__", (substrings.LENGTH, array_bytes))
    passage = " ".join(words(90))
    texts = ["".join(RNG.choice(LETTERS, RNG.integers(0, 300))) + passage + "".join(RNG.choice(LETTERS, 250)) for _ in range(25)]
    texts += [None, "", "ab" * 1500, "haha. " * 300, "q" * 399, "q" * 400, "r" * 401, *["é copy " * 100] * 3, passage[:450] + "ß" + passage[:430]]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, th string").repartition(3)
    got = {r["doc_id"]: r for r in substrings.removed(docs).collect()}
    for i, want in enumerate(strings_removed([(t or "").encode() for t in texts], 400)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) == want, i
    assert substrings.removed(docs.limit(0)).count() == 0


def test_suffix_arrays_take_bounded_memory():
    passage = RNG.integers(97, 123, 500).astype(np.uint8).tobytes()
    texts = [RNG.integers(97, 123, 700).astype(np.uint8).tobytes() + passage * (i % 3 == 0) for i in range(1_000)]
    tracemalloc.start()
    found = substrings.repeated(texts, np.ones(len(texts), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [bool(runs) for runs in found] == [len(t) > 700 for t in texts]
    assert peak < 70 * sum(map(len, texts))


def test_repeated_strings_query(spark):
    got = queries.op5_repeated_strings(spark, SMALL).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    for i, want in zip(docs["doc_id"], strings_removed([t.encode() for t in docs["text"]], 400)):
        assert tuple(got.loc[i]) == want


def test_least_moves():
    old, new = [120, 30, 50, 0], [50, 50, 50, 50]
    flow = reshard.least_moves(old, new)
    assert [sum(r) for r in flow] == old and [sum(c) for c in zip(*flow)] == new
    assert sum(flow[i][i] for i in range(4)) == sum(min(a, b) for a, b in zip(old, new))
    assert reshard.least_moves([0, 0], [0, 0, 0]) == [[0] * 3] * 2


def test_reshard_query(spark):
    got = queries.op6_reshard(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().merge(got, on="doc_id", validate="1:1")
    assert (docs["size"] == docs["text"].str.encode("utf-8").str.len() + 1).all()
    assert (docs["text_crc32"] == [zlib.crc32(t.encode()) for t in docs["text"]]).all()
    sums = docs.groupby("shard")["size"].sum().reindex(range(16), fill_value=0)
    assert sums.max() - sums.min() < 2_000
    for _, part in docs.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_reshard_keeps_what_need_not_move(spark, tmp_path):
    rows = [(i, f"text {i % 150} " * 20, i % 4, "own") for i in range(600)] + [(700, None, 0, "own"), (None, "", 1, "own")] + [(800, "hot " * 50, 2, "own")] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int, slot string")
    placed, flows = reshard.plan(docs, F.col("place"), 4, [1, 1, 1, 1])
    files = reshard.rewrite(placed, str(tmp_path / "out"), reshard.affected(flows))
    assert files.count() == len(rows)
    pdf = placed.withColumn("size", reshard.size_of("text")).toPandas()
    sums = pdf.groupby("shard")["size"].sum()
    assert sums.max() < 1.03 * sums.min()
    stay = pdf[pdf["shard"] == pdf["place"]]["size"].sum()
    before = pdf.groupby("place")["size"].sum()
    assert stay > 0.95 * np.minimum(before, before.sum() / 4).sum()
    empty, _ = reshard.plan(docs.limit(0), F.col("place"), 4, [1, 1])
    assert empty.count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("node", F.lit(1)).withColumn("gone", F.lit("x"))
    extra = spark.createDataFrame([(None, None, None, None, None, 1, "x"), (10**9, "", "en", None, 0, 1, "x"), (10**9 + 1, "12", None, "s", 2, 1, "x")], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(3))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "encoding"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "encoding":
            assert out.columns == docs.columns
            assert out.dtypes == docs.dtypes
        pdf = out.toPandas()
        assert 150 < len(pdf) <= docs.count(), name
        empty = stage(spark, docs.limit(0), SMALL)
        assert empty.count() == 0 and empty.columns == out.columns
        if name == "near_duplicates":
            assert pdf["doc_id"].dropna().is_unique
        if name != "encoding":
            docs = spark.createDataFrame(out.collect(), out.schema)


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert got["doc_id"].is_unique and 150 < len(got) < 200 and (got["n_tokens"] >= 0).all()
