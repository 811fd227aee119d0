"""Near-duplicate documents by DartMinHash (operator 9).

A document is the weighted set of its shingles of five words (lower-cased, between
white space), the weight being the number of times it occurs; a document of fewer
words is one shingle. Each shingle owns a strip of the plane per unit of weight, and
hashed darts fall on a strip as a Poisson process over time. Darts are thrown until
the expected number on the whole document covers all coordinates; each dart is
assigned to a coordinate by hash, the earliest per coordinate stays, and documents
with an empty coordinate are thrown at again for twice as long. Equal coordinates of
two documents are as likely as their weighted Jaccard similarity.

Signatures are cut into ``BANDS`` bands of ``ROWS`` coordinates. Within a band's
bucket every document is a candidate with the bucket's first document and with the
one before it, so candidates grow with the number of
documents and not with the square of a group; sorting is a range partition, which
splits a hot bucket. Candidates are then held against the exact weighted similarity,
and groups are the connected components of what holds.

Where a candidate fails, its bucket holds several groups, and a pair of two of them may
lie in it that was no candidate. All documents of such groups are joined by the prefix
rule, which is exact: of the shingles that several groups have, rarest first, two
similar documents share one among their first few. What it finds is verified too, and
the components are taken over both.

Documents of equal word lists meet as one candidate. Null and empty texts and texts
of white space have no shingle: they form no group, and each is its own class. So
are documents without an id. Rows that share an id are versions of one document: a
link of any of them is the document's, and one row of it stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pricepanel.llm.common import OWN, record, slices, stored
from pricepanel.llm.components import components
from pricepanel.session import width

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 24, 5
DARTS = BANDS * ROWS
CACHE = 500_000
#: Strips before a shared one that are looked at for an earlier meeting.
BEFORE = 8

U = np.uint64
_MULTIPLY = [U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values."""
    x = x + _MULTIPLY[0]
    x = (x ^ (x >> U(30))) * _MULTIPLY[1]
    x = (x ^ (x >> U(27))) * _MULTIPLY[2]
    return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingles(words: list[str], hashes: WordHashes) -> np.ndarray:
    """Hashes of all shingles, repeated ones too."""
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    n = len(h) - WORDS + 1
    if n < 1:
        h = np.concatenate([h, np.zeros(WORDS - len(h), U)]) if len(h) else h
        n = 1 if len(h) else 0
    out = np.zeros(n, U)
    for i in range(WORDS if n else 0):
        out = mix(out ^ h[i : i + n])
    return out


def strips(found: np.ndarray) -> np.ndarray:
    """One hash per shingle and unit of weight: the k-th occurrence is strip k."""
    found = np.sort(found)
    first = np.concatenate([[True], found[1:] != found[:-1]]) if len(found) else np.zeros(0, bool)
    run = np.arange(len(found)) - np.maximum.accumulate(np.where(first, np.arange(len(found)), 0))
    return mix(found + run.astype(U) * _MULTIPLY[1])


def signature(strip: np.ndarray) -> np.ndarray:
    """Earliest dart per coordinate, as its hash; ``strip`` isn't empty."""
    n = len(strip)
    until = (DARTS * np.log(DARTS) + 2 * DARTS) / n
    while True:
        best_time, best = np.full(DARTS, np.inf), np.zeros(DARTS, U)
        # The darts of a strip come one after the other, with exponential gaps.
        live, state, time = strip, strip, np.zeros(n)
        dart, times = [], []
        while len(live):
            state = mix(state)
            time = time - np.log(((state >> U(11)).astype(np.float64) + 0.5) / 2.0**53)
            go = time < until
            live, state, time = live[go], state[go], time[go]
            dart.append(state)
            times.append(time)
        dart, times = mix(np.concatenate(dart)), np.concatenate(times)
        at = (dart % U(DARTS)).astype(np.int64)
        order = np.lexsort((dart, times, at))
        at, dart, times = at[order], dart[order], times[order]
        lead = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
        best_time[at[lead]], best[at[lead]] = times[lead], dart[lead]
        if np.isfinite(best_time).all():
            return best
        until *= 2


def bands(sign: np.ndarray) -> np.ndarray:
    """A hash per band."""
    rows = sign.reshape(BANDS, ROWS)
    out = np.arange(BANDS).astype(U)
    for i in range(ROWS):
        out = mix(out ^ rows[:, i])
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle lists."""
    if not len(a) and not len(b):
        return 1.0
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(nx[i], ny[j]).sum()
    return float(both / (len(a) + len(b) - both))


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hi, lo, bands) per row with an id and a word: a digest of the words and
    the hash of each band."""
    out = pa.schema([("id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            ids, names, found = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                if words:
                    ids.append(i)
                    names.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest())
                    found.append(bands(signature(strips(shingles(words, hashes)))))
            if ids:
                two = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                flat = pa.array(np.concatenate(found))
                ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS)
                yield record(out, [ids, two[:, 0].copy(), two[:, 1].copy(), pa.ListArray.from_arrays(ends, flat)])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).filter("id IS NOT NULL AND t IS NOT NULL")
    return rows.mapInArrow(run, "id bigint, hi bigint, lo bigint, bands array<bigint>")


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, from each bucket: with its first document and with the
    neighbour. One pass over rows in order, cut into ranges whatever the buckets are."""
    schema = "part int, last boolean, band int, bucket bigint, a bigint, b bigint"
    out = pa.schema([("part", pa.int32()), ("last", pa.bool_()), ("band", pa.int32()), ("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, hub = TaskContext.get().partitionId(), None, None
        for batch in batches:
            band, bucket, node = (batch.column(i).to_numpy() for i in (0, 1, 2))
            n = len(node)
            if before is None:  # the first row of the part, to be tied to the last row of an earlier part
                yield record(out, [[part], [False], band[:1], bucket[:1], node[:1], node[:1]])
                before, hub = (band[0], bucket[0], node[0]), node[0]
            pb, pk, pn = (np.concatenate([[x], y[:-1]]) for x, y in zip(before, (band, bucket, node)))
            same = (pb == band) & (pk == bucket)
            start = np.where(~same, np.arange(n), -1)
            at = np.maximum.accumulate(start)
            hubs = np.where(at >= 0, node[np.maximum(at, 0)], hub)
            a = np.concatenate([pn[same], hubs[same]])
            b = np.concatenate([node[same], node[same]])
            two = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
            m = len(two)
            if m:
                yield record(out, [np.full(m, -1, np.int32), np.zeros(m, bool), np.zeros(m, np.int32), np.zeros(m, np.int64), two[:, 0].copy(), two[:, 1].copy()])
            before, hub = (band[-1], bucket[-1], node[-1]), hubs[-1]
        if before is not None:
            yield record(out, [[part], [True], [before[0]], [before[1]], [before[2]], [hub]])

    spark = rows.sparkSession
    keys = ["band", "bucket", "node"]
    found = stored(
        rows.select(*keys).repartitionByRange(width(spark), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema), "pairs"
    )
    pairs = found.filter("part < 0").select("a", "b")
    # A bucket over several parts: the first row of a part is tied to the last row and the hub of the part before.
    ends = found.filter("part >= 0")
    heads = ends.filter("not last").select("part", "band", "bucket", F.col("a").alias("head"))
    tails = ends.filter("last").select((F.col("part") + 1).alias("part"), "band", "bucket", F.col("a").alias("tail"), F.col("b").alias("hub"))
    tied = heads.join(tails, ["part", "band", "bucket"]).select("head", F.explode(F.array("tail", "hub")).alias("o")).filter("head <> o")
    pairs = pairs.unionByName(tied.select(F.least("head", "o").alias("a"), F.greatest("head", "o").alias("b")))
    return pairs.distinct()


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs whose exact similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, sets = WordHashes(), None, None
        for batch in slices(batches, 64):
            keep = []
            for a, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if a != held:  # rows of one text tend to follow each other
                    held, sets = a, shingles(words_of(x), hashes)
                keep.append(similarity(sets, shingles(words_of(y), hashes)) >= least)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a bigint, b bigint")


def _needed(share: float, n: str) -> str:
    """The least whole number that is ``share`` of ``n``; rounding never raises it."""
    return f"CAST(ceil({share!r} * {n} - 1e-6) AS INT)"


def unlinked(pairs: DataFrame, parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, c) of all documents of the groups ``c`` that failed candidates touch.

    Of two documents of a bucket that are in different groups one isn't in the group of
    the bucket's first document, with which both were candidates. So both their groups
    are among these.
    """
    a, b = (parts.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    named = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    mixed = named.filter("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("c")).distinct()
    groups = nodes.distinct().join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("c"))
    return groups.join(mixed, "c", "left_semi").select("node", "c")


def prefix_pairs(rest: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b), a < b, of different groups: all of similarity ``least`` or more, and some others.

    Similar documents share ``least`` of the larger one's strips and 2 least / (1 + least)
    of the smaller one's. Strips of a single group are shared with no other, so they are
    put first and only counted.
    """
    out = pa.schema([("node", pa.int64()), ("c", pa.int64()), ("v", pa.int64()), ("n", pa.int32()), ("hs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            found = [strips(shingles(words_of(t), hashes)).view(np.int64) for t in batch.column(3).to_pylist()]
            sizes = np.array([len(x) for x in found], np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
            yield record(out, [batch.column(0), batch.column(1), batch.column(2), sizes, lists])

    rows = rest.join(texts, "node").filter("t IS NOT NULL").select("node", "c", F.xxhash64("t").alias("v"), "t")
    held = stored(rows.mapInArrow(run, "node bigint, c bigint, v bigint, n int, hs array<bigint>"), "strips")
    each = held.select("node", "c", "v", "n", F.explode("hs").alias("h"))
    among = each.groupBy("h").agg(F.count("*").alias("often"), F.min("c").alias("low"), F.max("c").alias("high"))
    several = stored(among.filter("low <> high").select("h", "often"), "several")
    ranked = each.join(several, "h").groupBy("node", "c", "v", "n").agg(F.array_sort(F.collect_set(F.struct("often", "h"))).alias("s"))
    # With each strip the few before it: where two documents share one of those, they have met already.
    cut = lambda share: F.expr(
        f"""inline(transform(slice(s.h, 1, greatest(0, size(s) - {_needed(share, 'n')} + 1)),
            (h, i) -> struct(i, h, slice(s.h, greatest(1, i - {BEFORE - 1}), least(i, {BEFORE})) AS before)))"""
    )
    ranked = stored(ranked.filter(f"size(s) >= {_needed(least, 'n')}"), "ranked")
    large = ranked.select(F.col("node").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.size("s").alias("ka"), cut(least).alias("i", "h", "a_before"))
    small = ranked.select(F.col("node").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.size("s").alias("kb"), cut(2 * least / (1 + least)).alias("j", "h", "b_before"))
    # From the first shared strip on, the rest of the shorter list bounds what is shared.
    enough = f"least(ka - i, kb - j) >= {_needed(least / (1 + least), '(na + nb)')} AND NOT arrays_overlap(a_before, b_before)"
    met = large.join(small, "h").filter(f"ca <> cb AND nb <= na AND nb >= {_needed(least, 'na')} AND {enough}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component) per distinct id of a document with a word; the component is the
    smallest id of its group."""
    signed = stored(signatures(docs, doc_id, text), "signatures")
    # Copies meet in one row, named by their smallest id.
    texts = stored(signed.groupBy("hi", "lo").agg(F.min("id").alias("node"), F.first("bands").alias("bands")), "texts")
    rows = texts.select("node", F.posexplode("bands").alias("band", "bucket"))
    own = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("t"))
    pairs = stored(candidates(rows), "candidates")
    edges = stored(verified(pairs, own), "near")
    parts = components(edges)
    rest = stored(unlinked(pairs, parts, texts.select("node")), "unlinked")
    if rest.limit(1).count():
        more = stored(verified(prefix_pairs(rest, own), own), "more")
        if more.limit(1).count():
            parts = components(edges.unionByName(more))
    # Versions of a repeated id are tied through the node of each version's copies.
    tied = signed.join(texts.select("hi", "lo", "node"), ["hi", "lo"]).select("id", "node")
    return (
        tied.join(parts, "node", "left")
        .groupBy("id")
        .agg(F.min(F.coalesce("component", "node")).alias("component"))
    )


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, component_id (its own id where it has no group) and kept."""
    found = classes(docs, doc_id, text)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    return ids.join(found, ids["doc_id"] == found["id"], "left").select(
        "doc_id",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest id."""
    named = docs.select(*[F.col(c).alias(f"{OWN}{i}") for i, c in enumerate(docs.columns)])
    i, t = (F.col(f"{OWN}{docs.columns.index(c)}") for c in (doc_id, text))
    found = classes(docs, doc_id, text)
    joined = named.withColumn(f"{OWN}key", i.cast("long")).join(found, F.col(f"{OWN}key") == F.col("id"), "left")
    # Rows that share an id lie together after the join; one of them stays.
    turn = F.row_number().over(Window.partitionBy(f"{OWN}key").orderBy(F.xxhash64(t)))
    first = joined.filter(F.col("component") == F.col(f"{OWN}key")).withColumn(f"{OWN}turn", turn).filter(F.col(f"{OWN}turn") == 1)
    kept = joined.filter(F.col("component").isNull()).unionByName(first.drop(f"{OWN}turn"))
    return kept.select(*[F.col(f"{OWN}{k}").alias(c) for k, c in enumerate(docs.columns)])
