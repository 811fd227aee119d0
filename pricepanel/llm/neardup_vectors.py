"""Near-duplicate vectors by a subspace pigeonhole join (operator 3).

Vectors are scaled to length one and turned by a fixed rotation, which spreads their
variance evenly. Cosine >= c means a squared distance of 2 - 2c at most, and so in
one of the blocks of coordinates at least a squared distance within the block's
share of it, in proportion to its width. Each block is joined within its share: its
leading coordinates are cut into cells of ``CELL`` radii, a vector is also sent to
the cells its radius reaches into, and every vector is compared with what is in its
own cell. Candidates of all blocks are then held against the cosine of the original
vectors in double precision.

Only vectors of one label and one length are compared. Null labels, and vectors that
are null, empty, zero or hold a null or non-finite component link with nothing.
Equal vectors are joined as one with its number of copies, so copies never form
pairs. Cells with very many vectors are cut into ``PIECE`` x ``PIECE`` tasks. Rows that repeat a
vec_id are separate vectors with one id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricepanel.llm.common import stored
from pricepanel.llm.components import components
from pricepanel.session import width

BLOCK = 8
GRID = 4
CELL = 4.0
PIECE = 4_000
SEED = 12


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _cells(turned: np.ndarray, budget: float) -> Iterator[tuple[int, float, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: its number, rows, cell coordinates and whether the cell is the row's own."""
    n, d = turned.shape
    for block, at in enumerate(range(0, d, BLOCK)):
        part = turned[:, at : at + BLOCK]
        radius = np.sqrt(budget * part.shape[1] / d)
        grid = part[:, :GRID] / (CELL * radius)
        own = np.floor(grid).astype(np.int64)
        inside = grid - own
        low, high = inside <= 1 / CELL, inside >= 1 - 1 / CELL
        for step in product((-1, 0, 1), repeat=grid.shape[1]):
            step = np.array(step)
            there = np.where(step == -1, low, np.where(step == 1, high, True)).all(1)
            rows = np.flatnonzero(there)
            if len(rows):
                yield block, radius, rows, own[rows] + step, np.full(len(rows), not step.any())


def _matrix(col: pa.ListArray) -> np.ndarray:
    return np.stack(col.to_numpy(zero_copy_only=False)).astype(np.float64)


_ROWS = "label bigint, dims int, block int, cell binary, home boolean, id bigint, part binary"
_ROW_SCHEMA = pa.schema(
    [("label", pa.int64()), ("dims", pa.int32()), ("block", pa.int32()), ("cell", pa.binary()), ("home", pa.bool_()),
     ("id", pa.int64()), ("part", pa.binary())]
)


def _spread(vectors: DataFrame, budget: float) -> DataFrame:
    """A row for each block and cell a vector reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1_000):
                batch = whole.slice(begin, 1_000)
                dims = np.array([len(v) for v in batch.column(2)])
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d)
                    some = batch.take(pa.array(at))
                    x = _matrix(some.column(2))
                    turned = (x / np.linalg.norm(x, axis=1)[:, None]) @ rotation(d)
                    ids, labels = some.column(0).to_numpy(), some.column(1).to_numpy()
                    for block, _, rows, cells, home in _cells(turned, budget):
                        part = turned[rows, block * BLOCK : block * BLOCK + BLOCK]
                        columns = [
                            pa.array(labels[rows]), pa.array(np.full(len(rows), d, np.int32)),
                            pa.array(np.full(len(rows), block, np.int32)), pa.array([c.tobytes() for c in cells], pa.binary()),
                            pa.array(home), pa.array(ids[rows]), pa.array([p.tobytes() for p in part], pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, schema=_ROW_SCHEMA)

    return vectors.mapInArrow(run, _ROWS)


def _candidates(rows: DataFrame, budget: float) -> DataFrame:
    """Pairs (a < b) that are within a block's share in some cell."""
    key = ["label", "dims", "block", "cell"]
    spark = rows.sparkSession
    full = rows.groupBy(*key).count().filter(F.col("count") > PIECE)
    # One row per PIECE rows at most: it may be joined either way.
    cut = full.select(*key, F.ceil(F.col("count") / PIECE).cast("int").alias("cuts"))
    n = F.coalesce("cuts", F.lit(1))
    spot = F.pmod(F.xxhash64("id"), n).cast("int")
    every = F.sequence(F.lit(0), n - 1)
    both = rows.join(cut, key, "left").select(*key, "home", "id", "part", spot.alias("spot"), every.alias("every"))
    asks = both.filter("home").select(*key, "id", "part", F.lit(True).alias("asks"), F.col("spot").alias("i"), F.explode("every").alias("j"))
    told = both.select(*key, "id", "part", F.lit(False).alias("asks"), F.explode("every").alias("i"), F.col("spot").alias("j"))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        x = np.frombuffer(b"".join(pdf["part"]), np.float64).reshape(len(pdf), -1)
        ids = pdf["id"].to_numpy()
        mine, theirs, my_ids, their_ids = x[asks], x[~asks], ids[asks], ids[~asks]
        share = budget * x.shape[1] / int(pdf["dims"].iloc[0]) + 1e-9
        squares, a, b = (theirs**2).sum(1), [], []
        for at in range(0, len(mine), 256):
            some = mine[at : at + 256]
            apart = (some**2).sum(1)[:, None] + squares - 2 * some @ theirs.T
            i, j = np.nonzero(apart <= share)
            p, q = my_ids[at + i], their_ids[j]
            a.append(p[p < q])
            b.append(q[p < q])
        return pd.DataFrame({"a": np.concatenate([*a, np.array([], np.int64)]), "b": np.concatenate([*b, np.array([], np.int64)])})

    dealt = asks.unionByName(told).repartition(width(spark), *key, "i", "j")
    return dealt.groupBy(*key, "i", "j").applyInPandas(pairs, "a bigint, b bigint").distinct()


def links(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b) of the rows (id, label, v) with cosine >= ``least``, a < b; ids are unique."""
    budget = max(0.0, 2 - 2 * least)
    pairs = _candidates(stored(_spread(vectors, budget), "cells"), budget)
    v = vectors.select("id", "v")
    both = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(
        v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b"
    )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column(2)), _matrix(batch.column(3))
            cosine = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield batch.select([0, 1]).filter(pa.array(cosine >= least))

    # A pair's vectors have one length, batches may not.
    by_length = both.select("a", "b", "va", "vb", F.size("va").alias("d"))
    lengths = [r[0] for r in vectors.select(F.size("v")).distinct().limit(100).collect()]
    if len(lengths) <= 1:
        return by_length.select("a", "b", "va", "vb").mapInArrow(near, "a bigint, b bigint")
    return by_length.groupBy("d", F.pmod(F.xxhash64("a", "b"), F.lit(4 * width(pairs.sparkSession))).alias("s")).applyInPandas(
        lambda pdf: pdf[_cosines(pdf) >= least][["a", "b"]], "a bigint, b bigint"
    )


def _cosines(pdf: pd.DataFrame) -> np.ndarray:
    x, y = np.stack(pdf["va"]).astype(np.float64), np.stack(pdf["vb"]).astype(np.float64)
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def near_duplicates(
    table: DataFrame, least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    rows = table.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    fine = (
        F.col("label").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    groups = stored(
        rows.filter("fine").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("id", F.xxhash64("label", "v")),
        "vectors",
    )
    edges = stored(links(groups.select("id", "label", "v"), least), "links")
    copies = groups.select(F.col("id").alias("b"), "copies")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(copies, "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("others"))
    parts = components(edges).withColumnRenamed("node", "id")
    known = groups.join(linked, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least_id = known.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = known.join(least_id, "component").select(
        "label", "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"
    )
    out = rows.filter("fine").join(facts, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
