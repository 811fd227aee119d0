"""BPE encoding and decoding with a public vocabulary (operator 10), and the
word-wise front of the library encoder (operator 7).

Method of operator 10, the contiguous rank array: a short word is an array of
parts beside an array of the merge ranks of adjacent parts. The minimum rank is
looked up by scanning, its right part is deleted, and the two ranks next to the
merged part are refreshed, until no rank is left. Many words are handled at a
time as rows of a matrix. Words of more than ``SHORT`` bytes, for which repeated
scanning would be quadratic, use a heap over the same ranks.

A text is cut at white space first: no token of these vocabularies crosses it, so
each chunk is encoded once per worker and looked up afterwards. Chunks are held in
a bounded cache that is emptied when full; results don't depend on it.

Nulls count as empty texts; an empty text has no ids and decodes to ''. Strings of
added tokens in a text get their ids, as the library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pricepanel.llm.common import record, slices

SHORT = 64
CACHE = 300_000
NONE = np.int32(2**31 - 1)

# What separates chunks: the white space of the tokenizers library. str.split()
# agrees with it except for the four separators U+001C to U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
# Beyond this the Unicode tables of Python and of the library may differ in age.
_RECENT = re.compile("[^\x00-ɏ]")


def chunks(text: str) -> list[str]:
    """The parts of ``text`` between white space."""
    if _ODD.search(text) is None:
        return text.split()
    return [x for x in _SPACE.split(text) if x]


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class RankArrays:
    """Vocabulary and merges of a tokenizers file, as arrays."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.tokens = [""] * (1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.added.items():
            self.tokens[i] = token
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        key = left << np.uint64(32) | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, ``NONE`` where there is no merge."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (UTF-8, not empty)."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for high in (8, 16, 32, SHORT):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(at, max(1, len(at) * high // 65_536)):
                if len(part):
                    rows, counts = self._scan([words[i] for i in part], sizes[part], high)
                    for i, row, n in zip(part.tolist(), rows.tolist(), counts.tolist()):
                        out[i] = row[:n]
            low = high
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = self._heap(words[i])
        return out

    def _parts(self, word: np.ndarray) -> np.ndarray:
        parts = self.inner[word]
        parts[-1] = self.last[word[-1]]
        return parts

    def _scan(self, words: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges all words at once; a row has ``width`` parts at most."""
        n = len(words)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), sizes)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        final = col == np.repeat(sizes, sizes) - 1
        parts = np.zeros((n, width), np.int32)
        parts[row, col] = np.where(final, self.last[flat], self.inner[flat])
        ranks = np.full((n, width), NONE, np.int32)  # of the pair of a part and the next one
        r, c = row[~final], col[~final]
        ranks[r, c] = self.ranks(parts[r, c], parts[r, c + 1])
        done, counts = np.zeros_like(parts), sizes.copy()
        live = np.arange(n)
        ahead = np.arange(width)
        while len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            ended = best == NONE
            if ended.any():
                done[live[ended]] = parts[ended]
                go = ~ended
                live, parts, ranks, at, best = live[go], parts[go], ranks[go], at[go], best[go]
                if not len(live):
                    break
            every = np.arange(len(live))
            parts[every, at] = self.made[best]
            # Delete the boundary behind the merged part: what follows moves left.
            parts = np.take_along_axis(parts, np.minimum(ahead + (ahead > at[:, None]), width - 1), 1)
            ranks = np.take_along_axis(ranks, np.minimum(ahead + (ahead >= at[:, None]), width - 1), 1)
            counts[live] -= 1
            size = counts[live]
            ranks[every, size - 1] = NONE
            has = at < size - 1
            e, a = every[has], at[has]
            ranks[e, a] = self.ranks(parts[e, a], parts[e, a + 1])
            has = at > 0
            e, a = every[has], at[has]
            ranks[e, a - 1] = self.ranks(parts[e, a - 1], parts[e, a])
        return done, counts

    def _heap(self, word: bytes) -> list[int]:
        """The same merges for a long word: lowest rank first, leftmost among equals."""
        part = self._parts(np.frombuffer(word, np.uint8)).tolist()
        n = len(part)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank = self.ranks(np.array(part[:-1], np.int32), np.array(part[1:], np.int32)).tolist()
        queue = [(r, i, part[i], part[i + 1]) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(queue)
        table = dict(zip(self.keys.tolist(), self.rank_of.tolist()))
        made = self.made.tolist()

        def push(i: int, j: int) -> None:
            if (r := table.get(part[i] << 32 | part[j])) is not None:
                heapq.heappush(queue, (r, i, part[i], part[j]))

        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue  # one of the two has been merged meanwhile
            part[i], part[j] = made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in part if x >= 0]


class Codec:
    """Encodes and decodes texts; made from the content of a tokenizers file."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.arrays = RankArrays(spec)
        # The library's own normalizing and cutting, for letters outside the Latin blocks.
        self.library = Tokenizer.from_str(content)
        cut = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(cut)
        self.letters = _byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        self.special = re.compile("|".join(f"({re.escape(x)})" for x in self.arrays.added)) if self.arrays.added else None
        self.known: dict[str, list[int]] = {}
        self.shown: dict[str, str] = {}

    def pieces(self, chunk: str) -> list[bytes]:
        """The words that merging treats separately."""
        if _RECENT.search(chunk) is None:
            chunk = unicodedata.normalize("NFC", chunk).lower()
            return [w.encode() for w in self.words.findall(chunk)]
        plain = self.library.normalizer.normalize_str(chunk)
        return [bytes(map(self.bytes_of.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def encode_chunks(self, wanted: list[str]) -> list[list[int]]:
        """Ids of each chunk. All their distinct words are merged together."""
        plans: list[list] = []
        words: dict[bytes, int] = {}
        for chunk in wanted:
            if self.special is not None and "<" in chunk and self.special.search(chunk):
                plan: list = []
                for x in self.special.split(chunk):
                    if x in self.arrays.added:
                        plan.append([self.arrays.added[x]])
                    elif x:
                        plan += [words.setdefault(w, len(words)) for w in self.pieces(x)]
            else:
                plan = [words.setdefault(w, len(words)) for w in self.pieces(chunk)]
            plans.append(plan)
        ids = self.arrays.encode_words(list(words))
        return [
            ids[p[0]] if len(p) == 1 and isinstance(p[0], int) else [i for x in p for i in (x if isinstance(x, list) else ids[x])]
            for p in plans
        ]

    def learn(self, cut: list[list[str]]) -> None:
        """Makes every chunk of these texts known."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = list({c for row in cut for c in row if c not in known})
        known.update(zip(new, self.encode_chunks(new)))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [chunks(t or "") for t in texts]
        self.learn(cut)
        return [[i for c in row for i in self.known[c]] for row in cut]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: what the library does for a file without a decoder."""
        return " ".join(map(self.arrays.tokens.__getitem__, ids))

    def digests(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, and SHA-256 of the ids and of the decoded text, for each
        text. A chunk's ids are written and decoded once; joining those equals
        writing and decoding the whole text."""
        shown = self.shown
        if len(shown) > CACHE:
            shown.clear()
        cut = [chunks(t or "") for t in texts]
        found = [list(map(shown.get, row)) for row in cut]
        if any(None in row for row in found):
            new = list({c for row, got in zip(cut, found) if None in got for c, x in zip(row, got) if x is None})
            for chunk, ids in zip(new, self.encode_chunks(new)):
                shown[chunk] = f"{' '.join(map(str, ids))}\n{self.decode(ids)}"
            found = [list(map(shown.__getitem__, row)) if None in got else got for row, got in zip(cut, found)]
        counts, written, decoded = [], [], []
        for got in found:
            both = "\n".join(got).split("\n") if got else []
            if "" in both:  # chunks without ids
                both = [x for x in both if x]
            ids = " ".join(both[::2]).encode()
            counts.append(ids.count(b" ") + 1 if ids else 0)
            written.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(" ".join(both[1::2]).encode()).hexdigest())
        return counts, written, decoded


def shared(spark: SparkSession, path: str):
    """The vocabulary file (a few MB whatever the input) as a broadcast. Plain data
    travels, so executors don't need this package."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast({"content": f.read()})


def of_worker(sent, make):
    """``make(content)``, made once per worker process: the broadcast's value lives
    as long as the worker does, and with it the caches of what was made."""
    state = sent.value
    if "made" not in state:
        state["made"] = make(state["content"])
    return state["made"]


def _map(docs: DataFrame, text: str, fields: str, make) -> DataFrame:
    """Appends the columns ``fields``, made from slices of texts."""
    names = [f.split()[0] for f in fields.split(", ")]
    clash = [c for c in docs.columns if c.lower() in {n.lower() for n in names}]
    docs = docs.drop(*clash)
    out = docs.limit(0).selectExpr("*", *[f"CAST(NULL AS {f.split(' ', 1)[1]}) AS {f.split()[0]}" for f in fields.split(", ")])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = make(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, out.schema)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>``. A column of that name is replaced."""
    codec = shared(docs.sparkSession, path)
    return _map(docs, text, "ids array<int>", lambda t: [pa.array(of_worker(codec, Codec).encode(t), pa.list_(pa.int32()))])


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded string``; null ids decode to ''."""
    codec = shared(encoded.sparkSession, path)
    return _map(
        encoded, ids, "decoded string", lambda rows: [pa.array([of_worker(codec, Codec).decode(r or []) for r in rows], pa.string())]
    )


def round_trip_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 in place of the ids
    and the decoded text, which need not leave the worker for it."""
    codec = shared(docs.sparkSession, path)

    def made(texts: list) -> list:
        counts, ids, decoded = of_worker(codec, Codec).digests(texts)
        return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    return _map(docs, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", made)
