"""Token ids in flat binary files (operator 7).

Format, one triple of files per part, all little-endian:

``.tok``  the ids of all documents one after the other, as unsigned integers of 2
          bytes where every id of the vocabulary fits, else of 4
``.off``  n + 1 unsigned 64-bit offsets: document i has ids [off[i], off[i + 1])
``.doc``  n signed 64-bit document ids, then n bytes that are 1 where the id is null

``index`` beside them is a table with one row per part: its number, files, counts
and width. Parts ascend by document id; a part's base, the ids in all parts before,
is a prefix sum over the index. Files are memory-mapped when read. A task writes
names of its own and the index holds those of the attempts that Spark committed, so
lost executors leave at most files that no row names.

Ids come from the tokenizers library; words between white space, which no token
crosses, are encoded once per worker and strung together as arrays. Null texts are empty:
they hold the end id alone. Null document ids come first. Rows that share an id are
separate documents, by text. An empty table gives an index without rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pricepanel.llm.bpe import chunks, of_worker, shared
from pricepanel.llm.common import joined, record, slices, split_words
from pricepanel.session import width

CACHE = 1_000_000
TOGETHER = 32
ROWS = 512  # texts whose different words are looked up together


class Library:
    """The library's encoder with a bounded cache of words."""

    def __init__(self, content: str):
        import os

        # Threads within a task would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {a["content"]: a["id"] for a in json.loads(content)["added_tokens"] if not a["normalized"]}
        self.known: dict[bytes, bytes] = {}

    def kind(self, end: int) -> str:
        return "<u2" if max(self.tokenizer.get_vocab_size(True), end + 1) <= 1 << 16 else "<u4"

    def learn(self, new: list[bytes], kind: str) -> None:
        """Encodes words, many in one call: an added token between two of them keeps
        them apart and shows where each ends."""
        mark, number = next(iter(self.added.items()), (None, None))
        texts = [w.decode() for w in new]
        alone = [mark is None or len(chunks(t)) != 1 or any(a in t for a in self.added) for t in texts]
        for w, t in ((w, t) for w, t, single in zip(new, texts, alone) if single):
            ids = [i for c in chunks(t) for i in self.tokenizer.encode(c, add_special_tokens=False).ids]
            self.known[w] = np.array(ids, kind).tobytes()
        rest = [(w, t) for w, t, single in zip(new, texts, alone) if not single]
        for a in range(0, len(rest), TOGETHER):
            group = rest[a : a + TOGETHER]
            ids = np.array(self.tokenizer.encode(mark.join([t for _, t in group]), add_special_tokens=False).ids, kind)
            ends = np.flatnonzero(ids == number).tolist()
            raw, size = ids.tobytes(), ids.itemsize
            for (w, _), x, y in zip(group, [0, *[e + 1 for e in ends]], [*ends, len(ids)], strict=True):
                self.known[w] = raw[x * size : y * size]

    def encode(self, texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each ends, 0 in front.
        Words between ASCII white space, which no token crosses, are dealt with once
        per batch; what other white space they hold is cut when they are encoded."""
        different, which, sizes = split_words(texts)
        new = [w for w in different if w not in self.known]
        if len(self.known) > CACHE:
            self.known.clear()
            new = different
        self.learn(new, kind)
        return joined(list(map(self.known.__getitem__, different)), which, sizes, kind)


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


INDEX = "part bigint, tok string, off string, doc string, kind string, n_docs bigint, n_tokens bigint"
_INDEX = pa.schema(
    [("part", pa.int64()), ("tok", pa.string()), ("off", pa.string()), ("doc", pa.string()), ("kind", pa.string()),
     ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
)


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes ``docs`` in ascending order of id into files below ``path``, a
    folder that all executors share."""
    spark = docs.sparkSession
    library = shared(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        stem = f"{path}/part-{part:08d}-{uuid.uuid4().hex}"
        store, place = _at(stem)
        codec, tok, off, ids, nulls, n, at = of_worker(library, Library), None, None, [], [], 0, 0
        kind = codec.kind(end)
        for batch in slices(batches, ROWS):
            if tok is None:
                store.create_dir(place.rpartition("/")[0], recursive=True)
                tok, off = (store.open_output_stream(f"{place}.{x}") for x in ("tok", "off"))
                off.write(np.zeros(1, "<u8").tobytes())
            found, ends = codec.encode(batch.column(1), kind)
            tok.write(np.insert(found, ends[1:], end).tobytes())  # the end id after each text
            ends = ends[1:] + np.arange(1, len(ends)) + at
            off.write(ends.astype("<u8").tobytes())
            n, at = n + len(ends), int(ends[-1])
            col = batch.column(0)
            nulls.append(col.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
            ids.append(col.fill_null(0).to_numpy().astype("<i8"))
        if tok is None:
            return
        tok.close()
        off.close()
        with store.open_output_stream(f"{place}.doc") as f:
            f.write(np.concatenate(ids).tobytes() + np.concatenate(nulls).tobytes())
        yield record(_INDEX, [[part], [f"{stem}.tok"], [f"{stem}.off"], [f"{stem}.doc"], [kind], [n], [at]])

    key = F.col(doc_id).cast("long").alias("id")
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Repeated ids are told apart by their texts, so that even they spread over parts.
    dealt = rows.repartitionByRange(width(spark), "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    dealt.mapInArrow(run, INDEX).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str, per_batch: int = 20_000) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents
    before it), n_tokens and ids_crc32, over the ids as 4-byte integers."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    # One row per file: the only ordering over all of them is of this list.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def mapped(uri: str, kind: str) -> np.ndarray:
        store, place = _at(uri)
        if store.type_name == "local":
            buffer = pa.memory_map(place).read_buffer()
        else:
            with store.open_input_file(place) as f:
                buffer = f.read_buffer()
        return np.frombuffer(buffer, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n_docs"]
                tok, off, doc = mapped(r["tok"], r["kind"]), mapped(r["off"], "<u8"), mapped(r["doc"], "u1")
                ids, null = doc[: 8 * n].view("<i8"), doc[8 * n :].astype(bool)
                for a in range(0, n, per_batch):
                    b = min(n, a + per_batch)
                    bounds = off[a : b + 1].tolist()
                    crc = [zlib.crc32(tok[x:y].astype("<u4")) for x, y in zip(bounds, bounds[1:])]
                    start = off[a:b].astype(np.int64) + r["base"]
                    yield record(out, [pa.array(ids[a:b], mask=null[a:b]), start, np.diff(off[a : b + 1]).astype(np.int64), crc])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return parts.repartition(max(1, index.count())).mapInArrow(run, schema)
