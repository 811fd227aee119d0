"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricepanel.llm import bpe, decontaminate, divergence, langid, linededup, lm, minhash, neardup_vectors, periodic, pii, reshard, substrings, tokenfile
from pricepanel.llm.common import table
from pricepanel.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text", langid.held_out().alias("held_out")), dictionaries).drop("text")


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


@query
def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query
def op6_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The layout so far: 12 shards by the text's hash; 16 of equal bytes are wanted.
    old = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("layout")), F.lit(12))
    placed, _ = reshard.plan(docs, old, 12, [1.0] * 16)
    files = reshard.rewrite(placed, scratch(spark, "shards"))
    return files.select(
        "doc_id",
        reshard.size_of("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path, vocabulary())
    return tokenfile.read(spark, path)


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.dedup(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


@query
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip_digests(docs, vocabulary()).drop("text")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digests(periodic.planted(docs)).drop("text")


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.Audit(table(spark, sf_dir, "documents"), min_docs=10).report(most=10)


@query
def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    trained = lm.Trained(docs.filter(~F.col("held_out")), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return lm.score(docs, trained)


SQL["op8_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, n, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
gone AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE gone.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone USING (k) GROUP BY doc_id"""

# Windows of an item's length at every place of a document that shares a shingle with the item.
SQL["op2_decontaminate"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) - 4 AS m, i, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
bs AS (SELECT item_id, k, s, count(*) AS n FROM (
         SELECT item_id, len(w) - 4 AS k, array_to_string(w[i:i + 4], ' ') AS s
         FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)) GROUP BY 1, 2, 3),
hit AS (SELECT doc_id, item_id, m, k, n, s, unnest(generate_series(greatest(1, i - k + 1), least(i, greatest(m - k + 1, 1)))) AS a
        FROM ds JOIN bs USING (s)),
win AS (SELECT doc_id, item_id, m, k, a, s, least(count(*), any_value(n)) AS shared FROM hit GROUP BY 1, 2, 3, 4, 5, 6),
sim AS (SELECT doc_id, item_id, sum(shared) / (least(m, k) + k - sum(shared)) AS similarity FROM win GROUP BY doc_id, item_id, m, k, a)
SELECT doc_id, item_id, round(max(similarity)::DOUBLE, 6) AS similarity FROM sim WHERE similarity >= 0.8 GROUP BY 1, 2"""

SQL["op3_near_vectors"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
         AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id"""

SQL["op9_minhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, s, count(*) AS n FROM s GROUP BY 1, 2),
t AS (SELECT doc_id, count(*) AS t FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM pairs JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE shared / (x.t + y.t - shared) >= 0.8),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, near.b FROM reach JOIN near ON near.a = reach.r)
SELECT doc_id, min(r) AS component_id, doc_id = min(r) AS kept FROM reach GROUP BY doc_id"""

SQL["op12_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n_all FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (n + 2 * v) AS p,
             1 + (1000000000::HUGEINT * (total + 2)) // (n_all + 2 * v) AS q
      FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 10"""
