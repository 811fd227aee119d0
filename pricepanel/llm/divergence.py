"""Divergence of the word use of sources, within each language (operator 12).

Terms are runs of ASCII letters and of anything outside ASCII, with A to Z lowered. A
language keeps the terms that ``min_docs`` of its documents hold. Every group, that is
a language and source, and every language as a whole gives a kept term with ``count``
occurrences there the scaled smoothed share

    p = 1 + floor(10^9 (count + 2) / (N + 2 V))

with V the kept terms of the language and N the sum of ``count`` over them. Two shares
differ by f = floor((p - q)^2 / (p + q)); all arithmetic is on integers.

Method, single-pass in-memory indexing. A task reads its documents once and counts in
memory; when ``BLOCK`` postings are held, they are written out as a run: sorted by
term, dealt over hash shards and cut to short segments. A shard's segments come
ordered by their first term, and one pass with a heap, which holds the segments that
reach the current term, merges them to total frequencies. The sum of f over all kept
terms starts from f of two absent terms, V times; terms that only one source has
correct it by source and count (few different counts, whatever the number of terms),
and the terms that two sources share are streamed by and correct it for the pair. A
task adds corrections up in memory and hands sums on; no row per term and pair exists.

Null text, language or source is ''. A group without kept terms is listed too. Rows
are documents, repeated ids or not. Equal values are ranked by item in UTF-8 order. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pricepanel.llm.common import OWN, record, slices, stored
from pricepanel.session import width

BLOCK = 2_000_000  # occurrences of terms held in memory
SEGMENT = 1_000  # terms of a row of a run
TOGETHER = 200_000  # postings merged in one step
SUMS = 1_000_000  # corrections held in memory
UNIT = 1_000_000_000

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)
)  # letters of UTF-8 text, lowered; spaces for the rest


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    changed = np.zeros(len(keys[0]), bool)
    changed[:1] = True
    for k in keys:
        changed[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(changed)


_RUNS = pa.schema(
    [("lang", pa.string()), ("shard", pa.int32()), ("first", pa.binary()), ("terms", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64())),
     ("fan", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
)
RUNS = (
    "lang string, shard int, first binary, terms array<binary>, docs array<bigint>, fan array<bigint>, "
    "sources array<string>, counts array<bigint>"
)


class _Block:
    """Documents in memory, as numbers of groups and arrays of terms."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.owner: list[int] = []
        self.sizes: list[int] = []
        self.words: list[pa.Array] = []
        self.held = 0

    def add(self, langs: list[str], sources: list[str], texts: list) -> None:
        found = [terms(t) for t in texts]
        self.owner += [self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)]
        self.sizes += map(len, found)
        self.words.append(pa.array([w for f in found for w in f], pa.binary()))
        self.held += len(self.words[-1])

    def run(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The postings, dealt by language and shard, sorted by term and source."""
        if not self.held:
            return
        coded = pa.chunked_array(self.words).dictionary_encode().combine_chunks()
        order = pc.sort_indices(coded.dictionary)
        names = coded.dictionary.take(order)
        rank = np.empty(len(names), np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        term = rank[coded.indices.to_numpy()]
        shard_of = np.fromiter((zlib.crc32(t) % shards for t in names.to_pylist()), np.int64, len(names))
        of_lang: dict[str, int] = {}
        lang_of = np.array([of_lang.setdefault(lang, len(of_lang)) for lang, _ in self.groups])
        langs, sources = pa.array(list(of_lang)), pa.array([s for _, s in self.groups], pa.string())
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        owner = np.array(self.owner)

        posting, count = np.unique(owner[doc] * len(names) + term, return_counts=True)
        group, term_of = np.divmod(posting, len(names))
        once = np.unique(doc * len(names) + term)
        holder, docs = np.unique(lang_of[owner[once // len(names)]] * len(names) + once % len(names), return_counts=True)

        lang, shard = lang_of[group], shard_of[term_of]
        at = np.lexsort((group, term_of, shard, lang))
        group, term_of, lang, shard, count = group[at], term_of[at], lang[at], shard[at], count[at]
        first = _starts(lang, term_of)  # of each term's postings
        bounds = np.append(first, len(term_of))
        place = _starts(lang[first], shard[first])
        sizes = np.diff(np.append(place, len(first)))
        # Rows begin with each shard, and after every SEGMENT terms of it.
        rows = np.concatenate([np.arange(a, a + n, SEGMENT) for a, n in zip(place.tolist(), sizes.tolist())])
        ends = np.append(rows, len(first))
        whole = pa.RecordBatch.from_arrays(
            [
                langs.take(pa.array(lang[first[rows]])),
                pa.array(shard[first[rows]], pa.int32()),
                names.take(pa.array(term_of[first[rows]])),
                _lists(names.take(pa.array(term_of[first])), ends),
                _lists(pa.array(docs[np.searchsorted(holder, lang[first] * len(names) + term_of[first])], pa.int64()), ends),
                _lists(pa.array(np.diff(bounds), pa.int64()), ends),
                _lists(sources.take(pa.array(group)), bounds[ends]),
                _lists(pa.array(count, pa.int64()), bounds[ends]),
            ],
            schema=_RUNS,
        )
        yield from slices([whole], 64)


def _index(docs: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in slices(batches):
            block.add(*(c.to_pylist() for c in batch.columns))
            if block.held > BLOCK:
                yield from block.run(shards)
                block = _Block()
        yield from block.run(shards)

    return docs.mapInArrow(run, RUNS)


_MERGED = pa.schema(
    [("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
)


class _Shard:
    """A heap of run segments, by the first term that is not merged yet."""

    def __init__(self, min_docs: int):
        self.min_docs, self.heap, self.held, self.seen = min_docs, [], 0, 0

    def push(self, names: list[bytes], docs: np.ndarray, fan: np.ndarray, sources: pa.Array, counts: np.ndarray) -> None:
        segment = (names, docs, np.concatenate([[0], np.cumsum(fan)]), sources, counts)
        self.seen += 1
        heapq.heappush(self.heap, (names[0], self.seen, 0, segment))
        self.held += len(counts)

    def merge(self, lang: str, before: bytes | None) -> Iterator[pa.RecordBatch]:
        """The kept terms ahead of ``before``, which no later segment holds."""
        names, docs, fans, sources, counts = [], [], [], [], []
        while self.heap and (before is None or self.heap[0][0] < before):
            _, seen, a, segment = heapq.heappop(self.heap)
            b = len(segment[0]) if before is None else bisect_left(segment[0], before, a)
            if b < len(segment[0]):
                heapq.heappush(self.heap, (segment[0][b], seen, b, segment))
            x, y = segment[2][a], segment[2][b]
            names += segment[0][a:b]
            docs.append(segment[1][a:b])
            fans.append(np.diff(segment[2][a : b + 1]))
            sources.append(segment[3].slice(x, y - x))
            counts.append(segment[4][x:y])
            self.held -= int(y - x)
        if not names:
            return
        coded = pa.array(names, pa.binary()).dictionary_encode()
        code = coded.indices.to_numpy()
        held = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(held, code, np.concatenate(docs))
        kept = held >= self.min_docs
        if not kept.any():
            return
        term = np.repeat(code, np.concatenate(fans))
        use = kept[term]
        source = pa.concat_arrays(sources).dictionary_encode()
        key = term[use].astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()[use]
        order = np.argsort(key, kind="stable")
        key, count = key[order], np.concatenate(counts)[use][order]
        first = _starts(key)
        total, key = np.add.reduceat(count, first), key[first]
        term, which = np.divmod(key, len(source.dictionary))
        begin = _starts(term)
        ends = np.append(begin, len(term))
        words = coded.dictionary.take(pa.array(term[begin])).cast(pa.string())
        spread = _lists(source.dictionary.take(pa.array(which)), ends)
        whole = pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(words), pa.string()), words, spread, _lists(pa.array(total, pa.int64()), ends)], schema=_MERGED
        )
        yield from slices([whole], 5_000)


def _merge(runs: DataFrame, min_docs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = _Shard(min_docs), (None, None)
        for batch in slices(batches, 16):
            langs, shards, firsts, *lists = batch.columns
            for i, at in enumerate(zip(langs.to_pylist(), shards.to_pylist())):
                if at != now:
                    yield from shard.merge(now[0], None)
                    now = at
                elif shard.held > TOGETHER:
                    yield from shard.merge(now[0], firsts[i].as_py())
                names, docs, fan, sources, counts = (c[i].values for c in lists)
                shard.push(names.to_pylist(), docs.to_numpy(), fan.to_numpy(), sources, counts.to_numpy())
        yield from shard.merge(now[0], None)

    dealt = runs.repartition(width(runs.sparkSession), "lang", "shard").sortWithinPartitions("lang", "shard", "first")
    return dealt.mapInArrow(run, "lang string, term string, sources array<string>, counts array<bigint>")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (N + 2 V)), in 38 digits."""
    over = ((count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")).cast("decimal(30,0)")
    return 1 + F.call_function("div", over, (total + 2 * kept).cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Audit:
    """The index of a corpus: kept terms, groups and totals, in the shared folder."""

    def __init__(self, docs: DataFrame, min_docs: int = 10, lang: str = "lang", source: str = "source", text: str = "text"):
        spark = docs.sparkSession
        empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
        plain = docs.select(empty(lang, "lang"), empty(source, "source"), F.col(text).alias("text"))
        #: lang, term, sources, counts; one row per kept term.
        self.kept = stored(_merge(_index(plain, width(spark)), min_docs), "kept")
        by_lang = self.kept.groupBy("lang").agg(F.count("*").alias("v"))
        counted = (
            self.kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
            .groupBy("lang", F.col("x.sources").alias("source"))
            .agg(F.sum("x.counts").alias("n"))
        )
        groups = plain.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(by_lang, "lang", "left")
        #: lang, source, n, v; one row per occurring group.
        self.groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v")]), "groups")
        #: lang, n, v
        self.langs = stored(self.groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v")), "langs")

    def shares(self) -> DataFrame:
        """lang, term, total, source, count, p, none (p of an absent term): kept terms
        of each group that has them."""
        each = self.kept.select(
            "lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
            F.explode(F.arrays_zip("sources", "counts")).alias("x"),
        ).select("lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
        n, v = F.col("n"), F.col("v")
        return (
            each.join(self.groups, ["lang", "source"])
            .withColumn("p", _share(F.col("count"), n, v))
            .withColumn("none", _share(F.lit(0), n, v))
            .drop("n", "v")
        )

    def top_terms(self, most: int = 10) -> DataFrame:
        """lang, source, item, value, rank: terms that a group uses more than its language."""
        own = self.langs.withColumnsRenamed({"n": "n_all", "v": "v_all"})
        found = self.shares().join(own, "lang").withColumn("q", _share(F.col("total"), F.col("n_all"), F.col("v_all")))
        found = found.filter("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
        return _ranked(found).filter(F.col("rank") <= most)

    def pairs(self) -> DataFrame:
        """lang, source, item (another source), value, rank: all pairs of a language."""
        none = _share(F.lit(0), F.col("n"), F.col("v"))
        groups = self.groups.withColumn("none", F.when(F.col("v") > 0, none)).drop("n")
        other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
        both = groups.join(other, "lang").filter(F.col("source") != F.col("item"))
        base = both.select("lang", "source", "item", F.coalesce(F.col("v") * _apart(F.col("none"), F.col("other")), F.lit(0)).alias("value"))
        # Terms of one source, as if the other lacked them: they differ by their count alone.
        alike = self.shares().groupBy("lang", "source", "p", "none").agg(F.count("*").alias("many"))
        single = alike.join(other, "lang").filter(F.col("source") != F.col("item"))
        value = F.col("many") * (_apart(F.col("p"), F.col("other")) - _apart(F.col("none"), F.col("other")))
        single = single.groupBy("lang", "source", "item").agg(F.sum(value).alias("value"))
        parts = [base, single, _turned(single), *(turn(self._common()) for turn in (lambda d: d, _turned))]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return _ranked(every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))

    def _common(self) -> DataFrame:
        """lang, source, item, value: corrections of terms that both sources have, for
        source before item, added up within tasks."""
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

        def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (p - q) ** 2 // (p + q)

        def corrections(starts: np.ndarray, group: np.ndarray, p: np.ndarray, z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Of all pairs of rows of one term: rows 1, 2, ... places apart."""
            ends = np.repeat(np.append(starts[1:], len(group)), np.diff(np.append(starts, len(group))))
            i, ahead = np.arange(len(group)), 0
            while True:
                ahead += 1
                i = i[i + ahead < ends[i]]
                if not len(i):
                    return
                j = i + ahead
                value = apart(p[i], p[j]) - apart(p[i], z[j]) - apart(z[i], p[j]) + apart(z[i], z[j])
                low, high = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
                yield low << 32 | high, value  # a pair has one code, the smaller number first

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names: dict[tuple[str, str], int] = {}
            codes: list[np.ndarray] = []
            sums: list[np.ndarray] = []
            size, left = 0, None

            def added() -> tuple[np.ndarray, np.ndarray]:
                code, value = np.concatenate(codes), np.concatenate(sums)
                order = np.argsort(code, kind="stable")
                code = code[order]
                first = _starts(code)
                return code[first], np.add.reduceat(value[order], first)

            def written(code: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
                known = list(names)
                for a in range(0, len(code), 20_000):
                    pairs = [(known[c >> 32], known[c & 0xFFFFFFFF]) for c in code[a : a + 20_000].tolist()]
                    pairs = [(x, y) if x[1].encode() < y[1].encode() else (y, x) for x, y in pairs]
                    yield record(schema, [[x[0] for x, _ in pairs], [x[1] for x, _ in pairs], [y[1] for _, y in pairs], value[a : a + 20_000]])

            def numbered(table: pa.Table) -> np.ndarray:
                """A number per language and source."""
                lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
                both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                some, place = np.unique(both, return_inverse=True)
                x, y = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
                ids = [names.setdefault((x[k // len(y)], y[k % len(y)]), len(names)) for k in some.tolist()]
                return np.array(ids, np.int64)[place]

            def terms_of(table: pa.Table) -> np.ndarray:
                lang, term = (table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term"))
                return _starts(lang, term)

            for batch in chain(batches, [None]):
                parts = [x for x in (left, batch and pa.Table.from_batches([batch])) if x is not None]
                table = pa.concat_tables(parts) if parts else None
                if table is None or not table.num_rows:
                    continue
                starts = terms_of(table)
                cut = table.num_rows if batch is None else int(starts[-1])  # the last term may go on
                left, table = table.slice(cut), table.slice(0, cut)
                if not table.num_rows:
                    continue
                p, z = (table.column(c).to_numpy() for c in ("p", "none"))
                for code, value in corrections(starts[starts < cut], numbered(table), p, z):
                    codes.append(code)
                    sums.append(value)
                    size += len(code)
                    if size > SUMS:
                        code, value = added()
                        codes, sums, size = [code], [value], len(code)
                        if size > SUMS // 2:
                            yield from written(code, value)
                            codes, sums, size = [], [], 0
                if not codes:
                    names = {}
            if codes:
                yield from written(*added())

        shares = self.shares().select("lang", "term", "source", "p", "none")
        dealt = shares.repartition(width(shares.sparkSession), "lang", "term").sortWithinPartitions("lang", "term", "source")
        return dealt.mapInArrow(run, "lang string, source string, item string, value bigint")

    def report(self, most: int = 10) -> DataFrame:
        """lang, source, part ('pair' or 'term'), item, value, rank."""
        pair, term = (d.withColumn("part", F.lit(n)) for d, n in ((self.pairs(), "pair"), (self.top_terms(most), "term")))
        return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")


def _turned(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"source": f"{OWN}s", "item": "source"}).withColumnRenamed(f"{OWN}s", "item")


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(order))
