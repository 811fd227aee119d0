"""Benchmark decontamination (operator 2), by Spark SQL functions alone.

Texts become words (runs of letters and digits, lower-cased) and shingles of five
words. A window is as many shingles of a document as an item has. A window of
similarity 0.8 with an item holds so many shingles of items of its length that sets of
less overlap are out of question, in whatever order they stand. Windows are laid at
every place where that many are, and nowhere else. Every window and
every item gets a 64-bit SimHash; fingerprints are cut into ``BLOCKS`` blocks, and
items are indexed under all values of a block within ``NEAR`` bits of theirs. Two
fingerprints that differ in at most ``RADIUS`` bits differ in at most ``NEAR`` in one
block at least, so the join finds every pair within the radius. What it finds is held
against the exact weighted similarity: the shared shingles over all shingles, each
with its multiplicity.

Null and empty texts have no shingle and are clean. Items of fewer than five words
have none either and match nothing. A document shorter than an item is one window.
Rows are told apart by id and text, so rows that share an id, or have none, are
judged each by its own text. With an empty table on either side nothing is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricepanel.llm.common import OWN, stored

WORDS = 5
LEAST = 0.8
BLOCKS, NEAR = 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Item tables are broadcast up to so many rows of at most 40 bytes or so; beyond, they are shuffled.
SEND_ROWS = 500_000


def _simhash(hashes: str) -> str:
    """A bit is set where more shingles have it than not."""
    return f"""aggregate(transform(sequence(0, 63), b -> IF(
        aggregate({hashes}, 0, (s, h) -> s + CAST(shiftrightunsigned(h, b) & 1L AS INT) * 2 - 1) > 0,
        shiftleft(1L, b), 0L)), 0L, (x, y) -> x | y)"""


def _shared(a: str, b: str) -> str:
    """Shingles in common, each as often as in the side that has it less."""
    return f"""aggregate(array_distinct({b}), 0, (s, x) ->
        s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"""


def shingled(df: DataFrame, text: str, *keep) -> DataFrame:
    """``keep`` and ``hs``, the hashes of the shingles in order, empty for short texts."""
    # An outer explode below: a plain one would make Spark test the array first, by computing it twice.
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    parts = ", ".join(f"w[i + {k}]" if k else "w[i]" for k in range(WORDS))
    # The inner array binds the words, so that they are made once and not for every shingle.
    hs = f"""get(transform(array({OWN}words), w -> IF(size(w) < {WORDS}, CAST(array() AS array<bigint>),
        transform(sequence(0, size(w) - {WORDS}), i -> xxhash64({parts})))), 0)"""
    return df.select(*keep, words.alias(f"{OWN}words")).withColumn("hs", F.expr(hs)).drop(f"{OWN}words")


def _sent(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its size allows it."""
    return F.broadcast(df) if df.limit(SEND_ROWS + 1).count() <= SEND_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, n_windows) per document and item that is in it."""
    items = stored(
        shingled(benchmark, "text", F.col("item_id").cast("long").alias("item_id")).filter(F.size("hs") > 0).withColumn("print", F.expr(_simhash("hs"))),
        "items",
    )
    # What lays a window is the shingle and the item's length, not the item.
    places = _sent(stored(items.select(F.explode_outer("hs").alias("h"), F.size("hs").alias("k")).distinct(), "places"))
    key = [F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash")]
    hits = (
        shingled(docs, text, *key)
        .select("doc_id", "text_hash", F.size("hs").alias("m"), F.posexplode_outer("hs").alias("pos", "h"))
        .join(places, "h")
        .groupBy("doc_id", "text_hash", "m", "k")
        .agg(F.array_sort(F.collect_set("pos")).alias("p"))
        .withColumn("wide", F.expr("least(m, k)"))
        # Fewer shingles of items in a window leave it below LEAST; rounding never raises the bound.
        .withColumn("need", F.expr(f"CAST(greatest(1, ceil({LEAST / (1 + LEAST)!r} * (wide + k) - 1e-6)) AS INT)"))
    )
    # From p[i] to p[i + need - 1] there are enough; all windows that cover both are laid.
    starts = """array_distinct(flatten(transform(sequence(0, size(p) - need), i -> IF(p[i + need - 1] - p[i] < wide,
        sequence(greatest(0, p[i + need - 1] - wide + 1), least(p[i], m - wide)), CAST(array() AS array<int>)))))"""
    starts = hits.filter("size(p) >= need").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("th"), "k", F.expr(starts).alias("starts"))
    starts = stored(starts.filter("size(starts) > 0"), "starts")
    found = _sent(starts.groupBy("d", "th").agg(F.collect_list(F.struct("k", "starts")).alias("spans")))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(text) == F.col("th"))
    laid = (
        shingled(docs.select(doc_id, text).join(found, same), text, "d", "th", "spans")
        .select(F.col("d").alias("doc_id"), F.col("th").alias("text_hash"), "hs", F.expr("inline(spans)"))
        .select("doc_id", "text_hash", "hs", "k", F.explode("starts").alias("at"))
        .select("doc_id", "text_hash", "at", "k", F.expr("slice(hs, at + 1, k)").alias("window"))
    )
    windows = stored(
        laid.withColumn("w", F.xxhash64("window")).dropDuplicates(["doc_id", "text_hash", "at", "k", "w"]).drop("w")
        .withColumn("print", F.expr(_simhash("window"))),
        "windows",
    )
    bits = 64 // BLOCKS
    block = f"CAST(shiftrightunsigned(print, b * {bits}) & {(1 << bits) - 1}L AS INT)"
    masks = [m for m in range(1 << bits) if m.bit_count() <= NEAR]
    index = items.select(
        "item_id", F.size("hs").alias("k"), F.col("print").alias("item_print"), F.expr(f"explode(sequence(0, {BLOCKS - 1})) AS b"), "print"
    ).select("item_id", "k", "item_print", "b", F.expr(f"explode(transform(array({', '.join(map(str, masks))}), m -> {block} ^ m)) AS value"))
    index = _sent(stored(index, "index"))
    asked = windows.withColumn("b", F.expr(f"explode(sequence(0, {BLOCKS - 1}))")).withColumn("value", F.expr(block))
    # A pair may meet in several blocks; the first of those within NEAR bits counts it.
    first = " AND ".join(
        f"(b <= {i} OR bit_count(shiftrightunsigned(print ^ item_print, {i * bits}) & {(1 << bits) - 1}L) > {NEAR})" for i in range(BLOCKS - 1)
    )
    near = asked.join(index, ["k", "b", "value"]).filter(first).filter(f"bit_count(print ^ item_print) <= {RADIUS}")
    sets = items.select("item_id", F.col("hs").alias("item"))
    scored = (
        near.join(_sent(sets), "item_id")
        .withColumn("both", F.expr(_shared("window", "item")))
        .withColumn("similarity", F.expr("both / (size(window) + size(item) - both)"))
        .filter(F.col("similarity") >= LEAST)
    )
    return scored.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("similarity").alias("similarity"), F.count("*").alias("n_windows")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item."""
    named = docs.select(*[F.col(c).alias(f"{OWN}{i}") for i, c in enumerate(docs.columns)])
    i, t = (F.col(f"{OWN}{docs.columns.index(c)}") for c in (doc_id, text))
    found = leaks(docs, benchmark, doc_id, text).select("doc_id", "text_hash").distinct()
    same = i.cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(t) == found["text_hash"])
    kept = named.join(found, same, "left_anti")
    return kept.select(*[F.col(f"{OWN}{k}").alias(c) for k, c in enumerate(docs.columns)])
