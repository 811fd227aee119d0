"""Reversible line dedup (operator 8): cuckoo filters over exact reference counts.

A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at its ends and
with A-Z lower-cased. A document refers to a key once, however often it repeats the
line. Keys of ``min_chars`` code points or more with ``min_docs`` references or more
lose all their lines in every document.

State is two tables. ``refs`` (shard, hi, lo, refs) holds the exact number of
documents per 128-bit key. ``filters`` (shard, level, slots, bits) holds, for every
shard, a cuckoo filter of the keys that are over the threshold. Inserting or deleting
documents adds or subtracts references; the filter of a touched shard gains the keys
that rise over the threshold and loses those that fall below it, so taking documents
out again leads back to the state before. Filters have no false negatives and screen
the lines of a document before any shuffle; the exact table decides.

Documents are told apart by doc_id: rows that share an id (a null id too) refer to a
key once. A null or empty text is one empty line, whose key is never dropped. Lines
end at \\n alone. Empty tables give empty states and results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pricepanel.llm.common import OWN, slices, stored
from pricepanel.session import width

_BLANK = b" \t\n\x0b\x0c\r"
#: Filters are sent to the tasks up to this size; beyond it lines go to the exact join unscreened.
SEND_BYTES = 32 << 20
SHARD_KEYS = 100_000
SLOTS = 4


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The 16-byte key of each line, None for lines that are never dropped."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # bytes.lower() changes A-Z alone
        key = line.strip(_BLANK)
        short = not key or min_chars > 1 and len(key.decode()) < min_chars
        out.append(None if short else hashlib.blake2b(key, digest_size=16).digest())
    return out


def _longs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)


class CuckooFilter:
    """A cuckoo filter over 64-bit hashes: 16-bit fingerprints, ``SLOTS`` to a bucket."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots  # (buckets, SLOTS), uint16, 0: free
        self.mask = np.uint64(len(slots) - 1)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of these keys, at most 80 % full; larger if they don't find room."""
        buckets = 1 << int(np.ceil(np.log2(max(2, len(keys) / (0.8 * SLOTS)))))
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            if all(made.insert(k) for k in keys.tolist()):
                return made
            buckets *= 2

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        u = np.asarray(keys, np.int64).astype(np.uint64)
        mark = (u >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        first = (u & self.mask).astype(np.int64)
        return mark, first, first ^ self.other(mark)

    def other(self, mark: np.ndarray) -> np.ndarray:
        """What leads from a bucket of a fingerprint to its other one."""
        return (mark.astype(np.uint64) * np.uint64(0x5BD1E995) & self.mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(keys)
        return (self.slots[a] == mark[:, None]).any(1) | (self.slots[b] == mark[:, None]).any(1)

    def insert(self, key: int, kicks: int = 500) -> bool:
        mark, a, b = (x[0] for x in self.places(np.array([key], np.int64)))
        for at in (a, b):
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
        at = a
        for i in range(kicks):
            slot = (int(mark) + i) % SLOTS
            self.slots[at, slot], mark = mark, self.slots[at, slot]
            at = at ^ self.other(np.array([mark]))[0]
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
        return False

    def delete(self, key: int) -> bool:
        """Takes out one fingerprint of a key that is in."""
        mark, a, b = (x[0] for x in self.places(np.array([key], np.int64)))
        for at in (a, b):
            held = np.flatnonzero(self.slots[at] == mark)
            if len(held):
                self.slots[at, held[0]] = 0
                return True
        return False


_REFS = "hi bigint, lo bigint, refs bigint"
_FILTERS = "shard int, buckets int, bits binary"


def references(docs: DataFrame, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exact number of documents per key (hi, lo, refs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2_000):
            keys, owner = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = {k for k in line_keys(t, min_chars) if k is not None}
                keys += own
                owner += [i] * len(own)
            two = _longs(keys)
            ids = batch.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], names=["id", "hi", "lo"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    pairs = rows.mapInArrow(run, "id bigint, hi bigint, lo bigint")
    # Ids that repeat count once; both steps combine before their shuffle.
    return pairs.distinct().groupBy("hi", "lo").agg(F.count("*").alias("refs"))


def shard_count(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def _shard(shards: int):
    return F.pmod("lo", F.lit(shards)).cast("int").alias("shard")


def filters_of(refs: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """One cuckoo filter per shard, of the keys over the threshold. Shards are
    hash-dealt and hold about ``SHARD_KEYS`` keys each."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.of(np.sort(pdf["hi"].to_numpy()))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "buckets": [len(made.slots)], "bits": [made.slots.tobytes()]})

    hot = refs.filter(F.col("refs") >= min_docs).select("hi", _shard(shards))
    return hot.groupBy("shard").applyInPandas(build, _FILTERS)


def _load(row) -> CuckooFilter:
    return CuckooFilter(np.frombuffer(row["bits"], np.uint16).reshape(row["buckets"], SLOTS).copy())


def change(refs: DataFrame, filters: DataFrame, docs: DataFrame, sign: int, min_docs: int, shards: int, min_chars: int = 1):
    """References and filters after inserting (``sign`` 1) or deleting (-1)
    ``docs``. Deleted documents must have been inserted before. Both results are
    lazy; write them before the old state goes."""
    delta = references(docs, min_chars).select("hi", "lo", (F.col("refs") * sign).alias("delta"), F.lit(0).alias("was"))
    old = refs.select("hi", "lo", F.lit(0).cast("long").alias("delta"), F.col("refs").alias("was"))
    both = old.unionByName(delta).groupBy("hi", "lo").agg(F.sum("was").alias("was"), F.sum("delta").alias("delta"))
    after = both.select("hi", "lo", "was", (F.col("was") + F.col("delta")).alias("refs"))
    over, under = F.col("refs") >= min_docs, F.col("was") >= min_docs
    moved = after.filter(over != under).select("hi", over.alias("rises"), _shard(shards))

    def touch(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        rises, falls = new.loc[new["rises"], "hi"], new.loc[~new["rises"], "hi"]
        shard = int((new if len(new) else old)["shard"].iloc[0])
        f = _load(old.iloc[0]) if len(old) else CuckooFilter.of(np.array([], np.int64))
        for k in falls.tolist():
            f.delete(k)
        for k in rises.tolist():
            if not f.insert(k):
                # No room: a filter over all keys of the shard is made anew from the exact table.
                return pd.DataFrame({"shard": [shard], "buckets": [0], "bits": [b""]})
        return pd.DataFrame({"shard": [shard], "buckets": [len(f.slots)], "bits": [f.slots.tobytes()]})

    touched = filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(touch, _FILTERS)
    kept = after.filter(F.col("refs") > 0).select("hi", "lo", "refs")
    full = touched.filter(F.col("buckets") == 0).select("shard")
    again = filters_of(kept.withColumn("s", _shard(shards)).join(full.withColumnRenamed("shard", "s"), "s", "left_semi"), min_docs, shards)
    return kept, touched.filter(F.col("buckets") > 0).unionByName(again)


def prune(
    docs: DataFrame, refs: DataFrame, filters: DataFrame, min_docs: int, shards: int, min_chars: int = 1,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, the lines that stay."""
    spark = docs.sparkSession
    size = filters.agg(F.sum(F.length("bits"))).head()[0] or 0
    sent = None
    if size <= SEND_BYTES:
        sent = spark.sparkContext.broadcast([(r["shard"], r["buckets"], bytes(r["bits"])) for r in filters.collect()])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        if sent is not None:
            held = {at: CuckooFilter(np.frombuffer(bits, np.uint16).reshape(n, SLOTS)) for at, n, bits in sent.value}
        for batch in slices(batches, 2_000):
            keys, owner = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = {k for k in line_keys(t, min_chars) if k is not None}
                keys += own
                owner += [i] * len(own)
            two = _longs(keys)
            if held is not None:
                through, shard = np.zeros(len(two), bool), two[:, 1] % shards
                for at in np.unique(shard).tolist():
                    if at in held:
                        here = np.flatnonzero(shard == at)
                        through[here] = held[at].contains(two[here, 0])
                two, owner = two[through], np.array(owner, np.int64)[through].tolist()
            ids = batch.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], names=["id", "hi", "lo"]
            )

    named = docs.select(*[F.col(c).alias(f"{OWN}{i}") for i, c in enumerate(docs.columns)])
    own_id, own_text = (F.col(f"{OWN}{docs.columns.index(c)}") for c in (doc_id, text))
    rows = named.select(own_id.cast("long").alias("id"), F.coalesce(own_text, F.lit("")).cast("binary").alias("t"))
    hot = refs.filter(F.col("refs") >= min_docs).select("hi", "lo")
    # The lines of a document that go, at most as many as it has.
    gone = (
        rows.mapInArrow(lines, "id bigint, hi bigint, lo bigint")
        .join(hot, ["hi", "lo"], "left_semi")
        .groupBy("id")
        .agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))
    )
    joined = named.withColumn(f"{OWN}id", own_id.cast("long")).join(
        gone, F.col(f"{OWN}id").eqNullSafe(F.col("id")), "left"
    )
    passed = [f"{OWN}{i}" for i in range(len(docs.columns)) if docs.columns[i] not in ("n_lines", "n_dropped", "kept_text")]
    feed = joined.select(*passed, F.coalesce(own_text, F.lit("")).cast("binary").alias(f"{OWN}t"), "gone")
    made_types = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]
    schema = T.StructType([*feed.schema.fields[: len(passed)], *made_types])
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            total, dropped, kept = [], [], []
            goners = batch.column(len(passed) + 1).to_pylist()
            for t, go in zip(batch.column(len(passed)).to_pylist(), goners):
                split = t.split(b"\n")
                left = split
                if go:
                    low = _keys_of(go)
                    left = [x for x, k in zip(split, line_keys(t, min_chars)) if k not in low]
                total.append(len(split))
                dropped.append(len(split) - len(left))
                kept.append(b"\n".join(left).decode())
            made = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *made], names=names)

    out = feed.mapInArrow(cut, schema)
    back = {f"{OWN}{i}": c for i, c in enumerate(docs.columns)}
    return out.select(*[F.col(c).alias(back.get(c, c)) for c in names])


def _keys_of(rows: list[dict]) -> set[bytes]:
    return {np.array([r["hi"], r["lo"]], "<i8").tobytes() for r in rows}


def dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One run over a whole table: references and filters, both written, then the lines that stay."""
    refs = stored(references(docs, min_chars, doc_id, text), "line-refs")
    shards = shard_count(refs.filter(F.col("refs") >= min_docs).count())
    filters = stored(filters_of(refs, min_docs, shards), "line-filters")
    return prune(docs, refs, filters, min_docs, shards, min_chars, doc_id, text)


def rewrite(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the frequent lines taken out of the texts; a text that loses none
    stays as it is (a null one null), and n_chars, where present, follows the text."""
    named = docs.select(*[F.col(c).alias(f"{OWN}c{i}") for i, c in enumerate(docs.columns)])
    i, t = (f"{OWN}c{docs.columns.index(c)}" for c in (doc_id, text))
    kept = dedup(named, min_docs, min_chars, i, t)
    changed = F.col("n_dropped") > 0
    new = {text: F.when(changed, F.col("kept_text")).otherwise(F.col(t))}
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        new["n_chars"] = F.when(changed, F.char_length("kept_text").cast(docs.schema[at].dataType)).otherwise(F.col(f"{OWN}c{at}"))
    return kept.select(*[new.get(c, F.col(f"{OWN}c{k}")).alias(c) for k, c in enumerate(docs.columns)])
