"""Language identification by compression (operator 1).

One raw-content zstandard dictionary is made per language from sample texts. A text
is compressed with each of them, in blocks, and the dictionary that leaves the
fewest bytes names the language; both are lower-cased, for texts in capitals. The score is the margin, (second - first) / second
of the sizes; where it is narrow the text counts as rejected.

Fitting reads a bounded sample of every language: ``PER_LANG`` different texts, which
share ``DICT_BYTES`` evenly, ``CHARS`` characters of a text at most. All dictionaries
together have ``ALL_BYTES``, which many languages share evenly too. Predictions read
whole texts, and nothing but the text.

Null texts and texts without a letter are ``und`` with score 0. With one language
known every other text belongs to it with score 1; with none all are ``und``. Ties
go to the language that sorts first. Rows are never dropped or merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pricepanel.llm.common import OWN, slices

PER_LANG = 200
CHARS = 2_000
DICT_BYTES = 112_640
ALL_BYTES = 32 << 20
BLOCK = 4_096
LEVEL = 6
#: Texts of so few bytes are compressed at a slower level, which finds shorter matches and leaves fewer ties.
FINE_BYTES, FINE_LEVEL = 512, 12
#: Below this margin a text is rejected: about a byte in 500 between two languages.
NARROW = 0.002


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language, from a sample bounded as stated above."""
    known = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    # Copies are drawn as one.
    texts = known.groupBy("lang", F.xxhash64("text").alias("h")).count()
    counts = texts.groupBy("lang").agg(F.count("*").alias("texts")).collect()
    if not counts:
        return {}
    size = min(DICT_BYTES, ALL_BYTES // len(counts))
    each = {r["lang"]: max(1, min(CHARS, size // min(PER_LANG, r["texts"]))) for r in counts}
    chars = F.create_map(*[F.lit(x) for pair in each.items() for x in pair])
    # A share of each language's texts by their hash, some three times the wanted number; the lowest hashes stay.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 3.0 * PER_LANG / r["texts"]))])
    spot = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    first = Window.partitionBy("lang").orderBy("spot", "text")
    rows = (
        known.withColumn("spot", spot)
        .filter(F.col("spot") < share[F.col("lang")])
        .select("lang", "spot", F.col("text").substr(F.lit(1), chars[F.col("lang")]).alias("text"))
        .distinct()
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= PER_LANG)
        .select("lang", "n", "text")
        .collect()
    )
    parts: dict[str, list[bytes]] = {r["lang"]: [] for r in counts}
    for r in sorted(rows, key=lambda r: (r["lang"], r["n"])):
        parts[r["lang"]].append(r["text"].lower().encode())
    return {k: b"\n".join(v)[:size] for k, v in sorted(parts.items()) if v}


class Sizes:
    """Compressed sizes of a text under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as zstd

        self.langs = sorted(dictionaries)
        self.coders, self.fine = ([self._coder(zstd, dictionaries[k], n) for k in self.langs] for n in (LEVEL, FINE_LEVEL))

    @staticmethod
    def _coder(zstd, content: bytes, level: int):
        made = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=level)
        return zstd.ZstdCompressor(dict_data=made, level=level, write_content_size=False, write_dict_id=False)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        coders = self.fine if len(data) <= FINE_BYTES else self.coders
        sizes = [(sum(len(c.compress(b)) for b in blocks), k) for c, k in zip(coders, self.langs)]
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        (best, lang), (second, _) = sorted(sizes)[:2]
        return lang, (second - best) / second


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of those names are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "rejected")])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # ALL_BYTES at most
    schema = docs.limit(0).selectExpr(
        "*", "CAST(NULL AS string) AS lang_pred", "CAST(NULL AS double) AS score", "CAST(NULL AS boolean) AS rejected"
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(shared.value)
        for batch in slices(batches):
            got = [sizes.predict(t) for t in batch.column(at).to_pylist()]
            made = [
                pa.array([x[0] for x in got], pa.string()),
                pa.array([x[1] for x in got], pa.float64()),
                pa.array([x[0] == "und" or x[1] < NARROW for x in got], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """A third of the documents, never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents with a language, by dictionaries of the table's own labels."""
    dictionaries = fit(docs.filter(~held_out()))
    named = docs.select(*[F.col(c).alias(f"{OWN}{i}") for i, c in enumerate(docs.columns)])
    text = f"{OWN}{docs.columns.index('text')}"
    return predict(named, dictionaries, text).filter(~F.col("rejected")).select(
        *[F.col(f"{OWN}{i}").alias(c) for i, c in enumerate(docs.columns)]
    )
