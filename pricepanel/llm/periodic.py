"""Runs of periodic words, and texts with them collapsed (operator 11).

A run is a stretch of consecutive words with smallest period q that no neighbouring
word extends, of at least 3 q words and of at least ``least`` words.

Method, string synchronising sets. At the scales t = 4, 8, 16, ... a position is
selected if, among the t + 1 stretches of t words that start from it on, the
smallest hash is that of the first or of the last one; stretches with a period of
t / 3 or less take no part. Selection depends on the next 2 t words alone, so equal
contexts are selected alike, and any 2 t words in a row without a selected position
are highly periodic themselves. A run of period q in [2 t, 4 t] therefore holds a
selected position whose context recurs q words later: selected positions of equal
context at such a distance propose q, and comparing words around them gives the
run's exact ends. Equal contexts of selected positions are over t / 3 apart, so a
position has less than a dozen partners. The highly periodic stretches that a scale
leaves out are runs of the scales before it; the periods below 8, which no scale
covers, are found by comparing words directly. Hashes only select and propose:
words are compared for every run, and no run is missed when hashes collide.

Words are what ASCII white space (U+0020, U+0009 to U+000D) parts. Many texts are
searched in one array, with a word of its own kind between two of them. Null and
empty texts have no words and no runs, and collapse to ''. Rows are kept as they
are, repeated ones too; columns that the results are named after are replaced. A
text is one row, so its words are the largest thing that a task holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pricepanel.llm.common import OWN

LEAST = 24  # words of a run
FIRST = 4  # the smallest scale; periods below 2 * FIRST are compared directly
TOGETHER = 1 << 20  # bytes of text that are searched in one array
CELLS = 1 << 20  # words compared in one step

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, ends, periods


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads equal inputs alike over all values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _doubled(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of stretches twice as wide."""
    return _mix(ids + np.uint64(0x632BE59BD9B4E019) + np.roll(ids, -width) * np.uint64(3))


def _direct(words: np.ndarray, period: int) -> Runs:
    """All stretches of at least three periods, by comparing words ``period`` apart."""
    same = np.zeros(len(words) - period + 2, np.int8)
    same[1:-1] = words[:-period] == words[period:]
    change = np.diff(same)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1) + period
    long = end - start >= 3 * period
    return start[long], end[long], np.full(long.sum(), period)


def _selected(ids: np.ndarray, scale: int) -> np.ndarray:
    """Positions whose hash, or the one ``scale`` later, is the least of that stretch."""
    least, step = ids, 1
    while step < scale:  # least hash of 2, 4, ... stretches in a row
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    n = len(ids) - scale
    low = np.minimum(least[:n], ids[scale:])
    return np.flatnonzero(((low == ids[:n]) | (low == ids[scale:])) & (low != _OUT))


_OUT = np.uint64(2**64 - 1)


def _proposals(at: np.ndarray, context: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position, distance) of equal contexts 2 to 4 scales apart."""
    order = np.argsort(context, kind="stable")  # positions ascend within a context
    at, context = at[order], context[order]
    starts, gaps = [], []
    for ahead in range(1, len(at)):
        gap = at[ahead:] - at[:-ahead]
        near = (context[ahead:] == context[:-ahead]) & (gap <= 4 * scale)
        if not near.any():
            break
        near &= gap >= 2 * scale
        starts.append(at[:-ahead][near])
        gaps.append(gap[near])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(gaps)


def _reach(words: np.ndarray, start: np.ndarray, gap: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words from ``start`` on, in direction ``step``, equal those ``gap`` later."""
    out = np.empty(len(start), np.int64)
    ahead = np.arange(most) * step
    for a in range(0, len(start), max(1, CELLS // most)):
        part = slice(a, a + max(1, CELLS // most))
        x = start[part, None] + ahead
        y = x + gap[part, None]
        fits = (x >= 0) & (y < len(words))
        differs = ~(fits & (words[np.where(fits, x, 0)] == words[np.where(fits, y, 0)]))
        out[part] = np.where(differs.any(axis=1), differs.argmax(axis=1), most)
    return out


def _extended(words: np.ndarray, start: np.ndarray, gap: np.ndarray, scale: int) -> Runs:
    """The maximal stretches of period ``gap`` around the proposals."""
    # Proposals of one distance that follow each other closely are one stretch, if
    # the words between them agree as well.
    order = np.lexsort((start, gap))
    start, gap = start[order], gap[order]
    ahead = _reach(words, start, gap, 1, 7 * scale)  # over 2 scales of context and a period
    if len(start) > 1:
        joined = (gap[1:] == gap[:-1]) & (start[:-1] + ahead[:-1] >= start[1:])
        first = np.flatnonzero(np.append(True, ~joined))
        last = np.append(first[1:] - 1, len(start) - 1)
    else:
        first = last = np.zeros(len(start), np.int64)
    begin, period, end = start[first], gap[first], start[last] + ahead[last]
    begin = begin - _reach(words, begin - 1, period, -1, 5 * scale)
    # Hashes may collide, and a stretch may go on beyond what was compared: both are
    # seen by looking at the words themselves.
    open_end = np.flatnonzero(ahead[last] == 7 * scale)
    open_start = np.flatnonzero(start[first] - begin == 5 * scale)
    for i in open_end.tolist():
        while (more := _reach(words, end[i : i + 1], period[i : i + 1], 1, 7 * scale)[0]) > 0:
            end[i] += more
    for i in open_start.tolist():
        while (more := _reach(words, begin[i : i + 1] - 1, period[i : i + 1], -1, 7 * scale)[0]) > 0:
            begin[i] -= more
    end = end + period
    long = end - begin >= 3 * period
    return begin[long], end[long], period[long]


def find(words: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> Runs:
    """All runs in ``words`` (numbers of words; text i is ``bounds[i]:bounds[i+1]`` and
    ends with a number that occurs nowhere else)."""
    found = [_direct(words, q) for q in range(1, 2 * FIRST) if len(words) > q]
    sizes = np.diff(bounds)
    scale = FIRST
    # Places of the words of texts that can hold a run of this scale, and their hashes.
    place = np.arange(len(words))
    ids = _mix(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    width = 1
    while True:
        enough = sizes >= 6 * scale
        if not enough.any():
            break
        take = np.repeat(enough, sizes)
        if not take.all():
            place, ids, sizes = place[take], ids[take], sizes[enough]
        while width < scale:
            ids, width = _doubled(ids, width), 2 * width
        text = words[place]
        starts, ends, periods = map(np.concatenate, zip(*found))
        dull = np.zeros(len(words) + 1, np.int64)  # places of highly periodic stretches
        short = (3 * periods <= scale) & (ends - starts >= scale)
        np.add.at(dull, starts[short], 1)
        np.add.at(dull, ends[short] - scale + 1, -1)
        marked = np.where(np.cumsum(dull)[place] > 0, _OUT, np.minimum(ids, _OUT - np.uint64(1)))
        at = _selected(marked, scale)
        ids, width = _doubled(ids, scale), 2 * scale  # of contexts, and of the next scale's stretches
        start, gap = _proposals(at, ids[at], scale)
        if len(start):
            a, b, q = _extended(text, start, gap, scale)
            shift = place[a] - a
            found.append((a + shift, b + shift, q))
        scale *= 2
    starts, ends, periods = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.int64),) * 3
    # A stretch found with several periods has the smallest of them.
    order = np.lexsort((periods, ends, starts))
    starts, ends, periods = starts[order], ends[order], periods[order]
    first = np.ones(len(starts), bool)
    first[1:] = (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])
    first &= ends - starts >= least
    return starts[first], ends[first], periods[first]


def search(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text, given as its words, the (start, length, period) of its runs by
    start, then period."""
    flat = [w for t in texts for w in t]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.empty(bounds[-1], np.int64)
    ends = bounds[1:] - 1
    words[ends] = len(number) + np.arange(len(texts))
    inner = np.ones(len(words), bool)
    inner[ends] = False
    words[inner] = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts, stops, periods = find(words, bounds, least)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    for i in np.lexsort((periods, starts)).tolist():
        t = owner[i]
        out[t].append((int(starts[i] - bounds[t]), int(stops[i] - starts[i]), int(periods[i])))
    return out


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words are in a run after its first period."""
    gone = np.zeros(n, bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return gone


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        words = [w for w, g in zip(words, dropped(len(words), runs).tolist()) if not g]
    return b" ".join(words)


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length per period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``TOGETHER`` bytes."""
    sizes = texts.cast(pa.binary()) if False else texts
    lengths = np.asarray(pc.binary_length(texts).fill_null(0))
    group = np.cumsum(lengths) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def _mapped(docs: DataFrame, text: str, fields: list[tuple[str, str]], make) -> DataFrame:
    """Appends ``fields``, made by ``make(words of the texts, their runs)``, in place of
    columns so named."""
    names = {name.lower() for name, _ in fields}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names and c != text])
    work = docs.withColumn(f"{OWN}text", F.col(text))
    at = len(work.columns) - 1
    out = docs.drop(text) if text.lower() in names else docs
    keep = [i for i, c in enumerate(work.columns) if c in out.columns]
    schema = out.limit(0).selectExpr("*", *[f"CAST(NULL AS {kind}) AS {name}" for name, kind in fields]).schema
    labels = [*out.columns, *[name for name, _ in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _pieces(batch.column(at)):
                part = batch.slice(a, b - a)
                words = [(t or "").encode().split() for t in part.column(at).to_pylist()]
                made = make(words, search(words))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *made], names=labels)

    return work.mapInArrow(run, schema)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs array<struct<start, length, period>>``, in words."""

    def make(words: list, found: list) -> list:
        return [pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], RUNS)]

    return _mapped(docs, text, [("runs", "array<struct<start:bigint,length:bigint,period:bigint>>")], make)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``collapsed string``: the words that no run repeats, one space apart."""

    def make(words: list, found: list) -> list:
        return [pa.array([kept_words(w, f).decode() for w, f in zip(words, found)], pa.string())]

    return _mapped(docs, text, [("collapsed", "string")], make)


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the number of runs, the run of greatest exponent, and SHA-256 of
    the list of runs and of the collapsed text, which need not leave the worker for it."""

    def make(words: list, found: list) -> list:
        top = [best(f) for f in found]
        written = ["".join(f"{s},{n},{q}\n" for s, n, q in f).encode() for f in found]
        of = lambda i: pa.array([t and t[i] for t in top], pa.int64())
        return [
            pa.array(map(len, found), pa.int64()),
            of(0),
            of(1),
            of(2),
            pa.array([t and 1000 * t[1] // t[2] for t in top], pa.int64()),
            pa.array([hashlib.sha256(w).hexdigest() for w in written], pa.string()),
            pa.array([hashlib.sha256(kept_words(w, f)).hexdigest() for w, f in zip(words, found)], pa.string()),
        ]

    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    return _mapped(docs, text, [*((n, "bigint") for n in numbers), ("runs_sha256", "string"), ("collapsed_sha256", "string")], make)


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repetition in a tenth of the texts, by crc32 of the id: from a
    word on, the next few words recur to the end. Null ids are left as they are."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col(text), "[ \t-\r]+"), lambda w: w != "")
    work = docs.withColumn(f"{OWN}g", F.when(h % 10 == 0, g)).withColumn(
        f"{OWN}words", F.when(F.col(f"{OWN}g").isNotNull(), words)
    )
    w, g = F.col(f"{OWN}words"), F.col(f"{OWN}g")
    n = F.nullif(F.size(w), F.lit(0))
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = _cycled(w, a, p, n)
    changed = F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")
    return work.withColumn(text, F.when(n > 0, changed).otherwise(F.col(text))).drop(f"{OWN}g", f"{OWN}words")


def _cycled(words: Column, a: Column, p: Column, n: Column) -> Column:
    """The words from ``a`` on, ``p`` of them over and over, to ``n`` words in all."""
    cycle = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    return F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
