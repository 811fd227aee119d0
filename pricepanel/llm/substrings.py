"""Removal of long repeated byte strings by suffix arrays (operator 5).

Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere else
in the corpus goes. Texts are UTF-8; strings never cross documents; all are judged on
the input.

1. Sharding. Each string (window) of ``LENGTH`` bytes is assigned to the gram of
   ``GRAM`` bytes in it that has the least hash, the leftmost of equals. Equal windows
   have equal grams, so they meet under the gram's hash. Consecutive windows with one
   gram form a piece. Pieces whose gram occurs once in the corpus hold no repeated
   window and are done; equal pieces are one from here on, with their number.
2. Suffix arrays. The pieces of a shard of grams are laid out and their suffixes are
   sorted by Larsson-Sadakane refinement in numpy: ranks by the first 8 bytes, then
   groups that are still tied are refined by the rank 8, 16, 32, ... bytes further on.
   Common prefixes of neighbours follow by Kasai's rule (one byte further on in the
   text at most one byte is lost), with strides halved instead of one step at a time.
   Windows with a common prefix of ``LENGTH`` are one class; a class of two or more
   occurrences is repeated.
3. Merging. A shard beyond ``ARRAY_BYTES`` has several suffix arrays; the classes of
   one are looked up in the others by binary search and their numbers are added.
   Places are numbers of 4 bytes, so an array takes some 60 bytes a byte while it is
   made, and 17 afterwards.
4. Grams with very many different pieces, which would not fit into a shard, have
   their pieces cut to fewer windows, which meet under the bytes that all windows of
   a cut share, and again where those are still too many, down to single windows.

Null and empty texts have no bytes. Rows are told apart by id and text; rows equal in
both are copies of each other, and both go. Nothing depends on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pricepanel.llm.common import OWN, record, slices, stored
from pricepanel.session import width

LENGTH = 400
GRAM = 32
ARRAY_BYTES = 1 << 20
SHARD_BYTES = 1 << 19
TOGETHER = 1 << 16  # neighbours compared at a time
HOT_PIECES = 1_000
CUTS = (32, 4, 1)

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at every byte that has one, by doubling."""
    h, base, size = data.astype(U) + U(1), U(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * base + h[size:] if len(h) > size else h[:0]
            base, size = base * base, 2 * size
        return _mix(h)


def pieces(data: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """(first window, number of windows, gram hash) of the pieces of texts that lie
    one after the other in ``data`` and end at ``ends``."""
    span = length - GRAM + 1
    h = gram_hashes(data)
    n = len(data) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    # The least of span values: 32 bits of hash above the place, so the leftmost wins a tie.
    low, size = h & U(0xFFFFFFFF00000000) | np.arange(len(h), dtype=U), 1
    while 2 * size <= span:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[:n], low[span - size : span - size + n])
    at = (low & U(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n, bool)
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        inside[a : max(a, b - length + 1)] = True
    starts = np.flatnonzero(inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]]))
    stops = np.flatnonzero(inside & np.concatenate([(at[1:] != at[:-1]) | ~inside[1:], [True]])) + 1
    return starts, stops - starts, h[at[starts]]


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number, zeros behind the end: a view
    that holds each byte once."""
    return np.ndarray(len(text), ">u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks, by refinement of tied groups."""
    n = len(text)
    key = words(text).astype(U)
    sa = np.argsort(key, kind="stable").astype(np.int32)
    key = key[sa]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    place = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    group = np.maximum.accumulate(np.where(head, place, 0))
    rank[sa] = group + 1  # 0 stands for what is behind the end
    step = 8
    while True:
        tail = np.concatenate([head[1:], [True]])
        tied = place[~(head & tail)]
        if not len(tied):
            return sa, rank - 1
        at = sa[tied]
        ahead = np.minimum(at.astype(np.int64) + step, n)
        key = group[tied] * np.int64(n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)], 0)
        del ahead
        order = np.argsort(key, kind="stable")
        sa[tied], key = at[order], key[order]
        head[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        del order, key
        group = np.maximum.accumulate(np.where(head, place, 0))
        rank[sa[tied]] = group[tied] + 1
        step *= 2


def _extend(word: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, from a known part on, up to ``most``."""
    out = np.minimum(known, most)
    live = np.flatnonzero(out < most)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        fits = np.maximum(x, y) < n
        live, x, y = live[fits], x[fits], y[fits]
        apart = word[x] ^ word[y]
        room = np.minimum(n - np.maximum(x, y), 8)
        # Equal leading bytes of the two words.
        same = np.zeros(len(live), np.int64)
        go = np.ones(len(live), bool)
        for i in range(8):
            go &= (apart >> U(56 - 8 * i)) & U(255) == 0
            same += go
        same = np.minimum(same, room)
        out[live] = np.minimum(out[live] + same, most)
        live = live[(same == 8) & (out[live] < most)]
    return out


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, up to ``most``."""
    n = len(text)
    word = words(text)
    before = np.concatenate([np.array([-1], np.int32), sa[:-1]])[rank]  # by place in the text
    out = np.full(n, -1, np.int32)
    stride = 64
    for first, gap in [(0, stride)] + [(s, 2 * s) for s in (32, 16, 8, 4, 2, 1)]:
        at = np.arange(first, n, gap)
        at = at[before[at] >= 0]
        left = at - first if first else at
        known = np.maximum(out[left] - (at - left), 0) if first else np.zeros(len(at), np.int64)
        for a in range(0, len(at), TOGETHER):
            some = at[a : a + TOGETHER]
            out[some] = _extend(word, n, some, before[some], known[a : a + TOGETHER], most)
    return np.maximum(out, 0)[sa]


class Block:
    """Suffix array over some pieces: its classes of windows in sorted order."""

    def __init__(self, texts: list[bytes], copies: np.ndarray, length: int):
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = (np.cumsum(sizes) - sizes).astype(np.int32)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        inside = np.concatenate([np.arange(s) <= s - length for s in sizes.tolist()]) if texts else np.zeros(0, bool)
        sa, rank = suffix_array(self.text)
        name = np.cumsum(common_prefixes(self.text, sa, rank, length) < length, dtype=np.int32)
        del rank
        valid = inside[sa]
        self.place, name = sa[valid], name[valid]
        del sa, valid, inside
        new = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.owner = owner[self.place]
        self.offset = self.place - begin[self.owner]
        self.name = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.count = np.bincount(self.name, copies[self.owner], len(self.first)).astype(np.int64)
        self.least = self.place[self.first]  # a place of each class, in sorted order
        self.word = words(self.text)

    def merge(self, other: Block, length: int) -> None:
        """Adds the counts of classes that both have: each of this array's classes is
        looked up in the other by binary search."""
        if not len(self.least) or not len(other.least):
            return
        low, high = np.zeros(len(self.least), np.int64), np.full(len(self.least), len(other.least), np.int64)
        while (low < high).any():
            live = np.flatnonzero(low < high)
            mid = (low[live] + high[live]) // 2
            less = self._less(other, other.least[mid], self.least[live], length)
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
        at = np.minimum(low, len(other.least) - 1)
        same = (low < len(other.least)) & ~self._less(other, other.least[at], self.least, length, or_equal=False, differs=True)
        mine, theirs = np.flatnonzero(same), at[same]
        add, back = other.count[theirs].copy(), self.count[mine].copy()
        self.count[mine] += add
        other.count[theirs] += back

    def _less(self, other: Block, theirs: np.ndarray, mine: np.ndarray, length: int, or_equal: bool = False, differs: bool = False) -> np.ndarray:
        """Is the other's window less than this one's (or, does it differ)?"""
        out = np.full(len(mine), or_equal)
        live = np.arange(len(mine))
        for step in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            x, y = other.word[theirs[live] + step], self.word[mine[live] + step]
            apart = x != y
            out[live[apart]] = True if differs else x[apart] < y[apart]
            live = live[~apart]
            if not len(live):
                break
        return out


def repeated(texts: list[bytes], copies: np.ndarray, length: int = LENGTH, array_bytes: int = ARRAY_BYTES) -> list[list[tuple[int, int]]]:
    """Runs [from, to) of repeated windows of each piece; pieces are distinct and
    stand for ``copies`` occurrences."""
    cuts, size = [0], 0
    for i, t in enumerate(texts):
        if size and size + len(t) > array_bytes:
            cuts.append(i)
            size = 0
        size += len(t)
    blocks = [(a, Block(texts[a:b], copies[a:b], length)) for a, b in zip(cuts, [*cuts[1:], len(texts)])]
    own = [b.count.copy() for _, b in blocks]
    total = [c.copy() for c in own]
    for i in range(len(blocks)):
        for j in range(i + 1, len(blocks)):
            x, y = blocks[i][1], blocks[j][1]
            x.count, y.count = own[i].copy(), own[j].copy()
            x.merge(y, length)
            total[i] += x.count - own[i]
            total[j] += y.count - own[j]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for (start, b), count in zip(blocks, total):
        hit = count[b.name] >= 2 if len(b.name) else np.zeros(0, bool)
        owner, offset = b.owner[hit] + start, b.offset[hit]
        order = np.lexsort((offset, owner))
        owner, offset = owner[order], offset[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(owner) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(owner)]]) - 1 if len(first) else first
        for o, a, z in zip(owner[first].tolist(), offset[first].tolist(), offset[last].tolist()):
            out[o].append((a, z + 1))
    return out


_NAME = ["gram", "hi", "lo"]


def _occurrences(rows: DataFrame, length: int) -> DataFrame:
    """(id, th, at, n, gram, hi, lo): the pieces of every document."""
    schema = "id bigint, th bigint, at int, n int, gram bigint, hi bigint, lo bigint"
    out = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("gram", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = [t if len(t) >= length else b"" for t in batch.column(2).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            raw = b"".join(texts)
            start, n, gram = pieces(np.frombuffer(raw, np.uint8), ends, length)
            if not len(start):
                continue
            owner = np.searchsorted(ends, start, "right")
            names = [hashlib.blake2b(raw[a : a + k + length - 1], digest_size=16).digest() for a, k in zip(start.tolist(), n.tolist())]
            two = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            take = pa.array(owner)
            yield record(
                out,
                [batch.column(0).take(take), batch.column(1).take(take), (start - (ends - sizes)[owner]).astype(np.int32), n.astype(np.int32),
                 gram.view(np.int64), two[:, 0].copy(), two[:, 1].copy()],
            )

    return rows.mapInArrow(run, schema)


def _piece_texts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, hi, lo, copies, hot, text) of the pieces ``wanted`` (id, th, at, n, ...)."""
    per_doc = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("at", "n", *_NAME, "copies", "hot")).alias("want"))
    joined = rows.join(per_doc.withColumnsRenamed({"id": "i", "th": "h"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")))
    out = pa.schema([("gram", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("copies", pa.int64()), ("hot", pa.bool_()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [
                (w["gram"], w["hi"], w["lo"], w["copies"], w["hot"], t[w["at"] : w["at"] + w["n"] + length - 1])
                for t, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for w in want
            ]
            if made:
                yield record(out, [list(x) for x in zip(*made)])

    return joined.select("b", "want").mapInArrow(run, "gram bigint, hi bigint, lo bigint, copies bigint, hot boolean, text binary")


_RUNS = "gram bigint, hi bigint, lo bigint, first int, past int"


def _by_shards(texts: DataFrame, shards: int, length: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(_NAME).sort_values(_NAME)
        found = repeated(pdf["text"].tolist(), pdf["copies"].to_numpy(), length)
        made = [(g, h, o, a, b) for g, h, o, runs in zip(pdf["gram"], pdf["hi"], pdf["lo"], found) for a, b in runs]
        return pd.DataFrame(made, columns=[*_NAME, "first", "past"])

    shard = F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard")
    return texts.withColumn("shard", shard).repartition(width(texts.sparkSession), "shard").groupBy("shard").applyInPandas(run, _RUNS)


_SUB = "gram bigint, hi bigint, lo bigint, copies bigint, start int, key bigint, khi bigint, klo bigint, spot int, body binary"
_SUB_SCHEMA = pa.schema(
    [("gram", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("copies", pa.int64()), ("start", pa.int32()), ("key", pa.int64()),
     ("khi", pa.int64()), ("klo", pa.int64()), ("spot", pa.int32()), ("body", pa.binary())]
)


def _split(texts: DataFrame, step: int, length: int) -> DataFrame:
    """Cuts pieces to ``step`` windows each. A window's distance to its gram depends
    on its bytes alone, so equal windows fall into equal cuts; all windows of a cut
    share the bytes in its middle, whose digest is the key they meet under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = []
            for r in batch.to_pylist():
                t, spot = r["text"], r["spot"]
                if spot is None:
                    h = gram_hashes(np.frombuffer(t, np.uint8)).view(np.int64)
                    spot = int(np.argmax(h == r["gram"]))
                o, n = 0, len(t) - length + 1
                while o < n:
                    cut = (spot - o) // step
                    past = min(n, spot - cut * step + 1)
                    body = t[o : past - 1 + length]
                    last = spot - cut * step  # where the cut's last window would start
                    core = t[last : last - step + 1 + length]
                    key = np.frombuffer(hashlib.blake2b(core, digest_size=8).digest(), "<i8")[0]
                    two = np.frombuffer(hashlib.blake2b(body, digest_size=16).digest(), "<i8")
                    made.append((r["gram"], r["hi"], r["lo"], r["copies"], o, int(key), int(two[0]), int(two[1]), spot - o, body))
                    o = past
            if made:
                yield record(_SUB_SCHEMA, [list(x) for x in zip(*made)])

    return texts.select(*_NAME, "copies", "spot", "text").mapInArrow(run, _SUB)


def _by_cuts(texts: DataFrame, steps: tuple[int, ...], shards: int, length: int) -> DataFrame:
    """Runs of pieces whose gram has very many of them: the pieces are cut finer, and
    what still has too many under a key is cut again, down to single windows, which
    are equal or not."""
    sub = stored(_split(texts, steps[0], length), "cuts")
    name = ["key", "khi", "klo"]
    one = stored(
        sub.groupBy(*name).agg(F.sum("copies").alias("copies"), F.first("spot").alias("spot"), F.first("body").alias("text")), "cut-texts"
    )
    kinds = one.groupBy("key").agg(F.count("*").alias("kinds"))
    known = one.join(kinds, "key").withColumnsRenamed({"key": "gram", "khi": "hi", "klo": "lo"})
    same = known.filter("copies > 1").select(*_NAME, F.lit(0).alias("first"), (F.length("text") - length + 1).alias("past"))
    few = known.filter((F.col("kinds") > 1) & (F.col("kinds") <= HOT_PIECES))
    runs = same.unionByName(_by_shards(few, shards, length))
    if len(steps) > 1:
        runs = runs.unionByName(_by_cuts(known.filter(F.col("kinds") > HOT_PIECES), steps[1:], shards, length))
    runs = runs.withColumnsRenamed({"gram": "key", "hi": "khi", "lo": "klo"})
    return sub.join(runs, name).select(
        *_NAME, (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("past")).alias("past")
    )


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept_bytes (binary)."""
    named = docs.drop(*[c for c in docs.columns if c.lower() in ("n_bytes", "n_removed", "n_spans", "kept_bytes")])
    rows = named.select(
        F.col(doc_id).cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("b"),
    )
    every = stored(_occurrences(rows, length), "pieces")
    twice = every.groupBy("gram").count().filter("count > 1").select("gram")
    found = stored(every.join(twice, "gram", "left_semi"), "repeated-grams")
    one = stored(
        found.groupBy(*_NAME).agg(F.count("*").alias("copies"), F.min(F.struct("id", "th", "at", "n")).alias("spot")), "distinct-pieces"
    )
    grams = one.groupBy("gram").agg(F.count("*").alias("kinds"))
    known = one.join(grams, "gram").select(*_NAME, "copies", "kinds", "spot.*")
    same = known.filter("copies > 1").select(*_NAME, F.lit(0).alias("first"), F.col("n").alias("past"))
    several = known.filter("kinds > 1").withColumn("hot", F.col("kinds") > HOT_PIECES)
    volume = several.agg(F.sum(F.col("n") + length - 1)).head()[0] or 0
    texts = _piece_texts(rows, several.select("id", "th", "at", "n", *_NAME, "copies", "hot"), length)
    texts = stored(texts, "piece-texts")
    shards = max(1, -(-volume // SHARD_BYTES))
    runs = same.unionByName(_by_shards(texts.filter("not hot"), shards, length))
    hot = texts.filter("hot").dropDuplicates(_NAME).withColumn("spot", F.lit(None).cast("int"))
    if several.filter("hot").limit(1).count():
        runs = runs.unionByName(_by_cuts(hot, CUTS, shards, length))
    runs = stored(runs, "runs")
    spans = found.join(runs, _NAME).groupBy("id", "th").agg(
        F.collect_list(F.struct((F.col("at") + F.col("first")).alias("a"), (F.col("at") + F.col("past") - 1 + length).alias("z"))).alias("spans")
    )
    return _cut(named, spans, doc_id, text)


def _cut(docs: DataFrame, spans: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = docs.select(*[F.col(c).alias(f"{OWN}{i}") for i, c in enumerate(docs.columns)])
    i, t = (F.col(f"{OWN}{docs.columns.index(c)}") for c in (doc_id, text))
    body = F.coalesce(t, F.lit(""))
    joined = own.join(spans, i.cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(body) == F.col("th")), "left")
    feed = joined.select(*own.columns, body.cast("binary").alias("b"), "spans")
    extra = [T.StructField(n, k) for n, k in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_bytes", T.BinaryType()))]
    schema = T.StructType([*own.schema.fields, *extra])
    width_ = len(own.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, gone, count, kept = [], [], [], []
            for raw, cuts in zip(batch.column(width_).to_pylist(), batch.column(width_ + 1).to_pylist()):
                left, at, n = [], 0, 0
                end = None  # of the run that is being removed
                for a, z in sorted((c["a"], c["z"]) for c in cuts or []):
                    if end is None or a > end:
                        left.append(raw[at:a])
                        n += 1
                        end = z
                    else:
                        end = max(end, z)
                    at = end
                left.append(raw[at:])
                rest = b"".join(left)
                total.append(len(raw))
                gone.append(len(raw) - len(rest))
                count.append(n)
                kept.append(rest)
            made = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width_], *made], names=schema.names)

    out = feed.mapInArrow(run, schema)
    return out.select(*[F.col(f"{OWN}{k}").alias(c) for k, c in enumerate(docs.columns)], *[f.name for f in extra])
