"""Resharding by minimum-cost flow (operator 6).

The old shards' bytes are supplies, the new shards' capacities are demands, and a
byte that changes its shard costs 1. The flow of least cost says how many bytes go
from which old shard to which new one; it is solved on shard totals alone. Bytes
move in blocks: the documents of an old shard whose texts share a hash bucket, so
that equal texts stay together. A block over ``SPLIT`` of a capacity (one text with
very many copies, say) is cut by document id. Blocks are dealt, largest first, to
the flow of their shard with most bytes open. Documents then get gapless slots in
their new shard and the affected shards are written, one folder each.

The tables of blocks on the driver have at most ``n_old * BLOCKS`` rows plus
``n_new / SPLIT`` for cut ones, whatever the input. A document's size is its text's UTF-8 bytes plus one;
null texts count as empty. Rows that repeat are separate documents. An empty table
gives empty shards; with no bytes at all nothing moves.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pricepanel.llm.common import OWN
from pricepanel.session import width

BLOCKS = 512
SPLIT = 1 / 4


def size_of(text: str | Column) -> Column:
    return F.octet_length(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))).cast("long") + 1


def least_moves(old: Sequence[int], capacity: Sequence[int]) -> list[list[int]]:
    """Bytes from each old to each new shard, by successive shortest paths. The sums
    of both sides are equal; shard i of both sides is the same place."""
    n, m = len(old), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]  # to, room, cost, index of the way back

    def way(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, s in enumerate(old):
        way(source, i, s, 0)
        for j in range(m):
            way(i, n + j, s, int(i != j))
    for j, c in enumerate(capacity):
        way(n + j, sink, c, 0)
    height = [0] * len(graph)
    while True:
        far = [float("inf")] * len(graph)
        came: list[tuple[int, int] | None] = [None] * len(graph)
        far[source], queue = 0, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and (e := d + cost + height[a] - height[b]) < far[b]:
                    far[b], came[b] = e, (a, k)
                    heapq.heappush(queue, (e, b))
        if came[sink] is None:
            break
        height = [h + d if d < float("inf") else h for h, d in zip(height, far)]
        path, at = [], sink
        while at != source:
            a, k = came[at]
            path.append(graph[a][k])
            at = a
        room = min(w[1] for w in path)
        for w in path:
            w[1] -= room
            graph[w[0]][w[3]][1] += room
    return [[graph[n + j][next(w[3] for w in graph[i] if w[0] == n + j)][1] for j in range(m)] for i in range(n)]


def deal(blocks: list[tuple], flows: list[list[int]]) -> list[int]:
    """New shard of each block (old, ..., bytes last): largest first, to the flow of
    its old shard with most bytes open; at a tie it stays where it is."""
    left = [list(f) for f in flows]
    out = [0] * len(blocks)
    for at in sorted(range(len(blocks)), key=lambda i: (-blocks[i][-1], blocks[i])):
        i, size = blocks[at][0], blocks[at][-1]
        j = max(range(len(left[i])), key=lambda j: (left[i][j], j == i, -j))
        left[i][j] -= size
        out[at] = j
    return out


def plan(docs: DataFrame, old: Column, n_old: int, capacities: Sequence[float], doc_id: str = "doc_id", text: str = "text"):
    """``docs`` with ``shard`` and ``slot``, and the flows. ``old`` gives a row's
    old shard, 0 to n_old - 1; capacities are shares, made to fit the total."""
    spark = docs.sparkSession
    block = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(BLOCKS)).cast("int")
    small = docs.select(old.cast("int").alias("old"), block.alias("block"), F.xxhash64(F.col(doc_id)).alias("h"), size_of(text).alias("bytes"))
    sizes = small.groupBy("old", "block").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).collect()
    total = sum(r["bytes"] for r in sizes)
    weight = sum(capacities)
    bounds = [round(total * sum(capacities[:j]) / weight) for j in range(len(capacities) + 1)]
    capacity = [b - a for a, b in zip(bounds, bounds[1:])]
    most = max(1.0, SPLIT * max(capacity))
    cuts = [(r["old"], r["block"], -int(-r["bytes"] // most)) for r in sizes if r["bytes"] > most and r["rows"] > 1]
    # At most total / most rows, that is the number of new shards over SPLIT.
    cut = F.broadcast(spark.createDataFrame(cuts, "old int, block int, cuts int"))
    part = F.pmod("h", F.coalesce("cuts", F.lit(1))).cast("int").alias("part")
    whole = {(o, b) for o, b, _ in cuts}
    units = [(r["old"], r["block"], 0, r["rows"], r["bytes"]) for r in sizes if (r["old"], r["block"]) not in whole]
    if cuts:
        pieces = small.join(cut, ["old", "block"]).groupBy("old", "block", part)
        units += [tuple(r) for r in pieces.agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).collect()]
    units.sort()
    supply = [sum(u[-1] for u in units if u[0] == i) for i in range(n_old)]
    flows = least_moves(supply, capacity)
    shard_of, filled, rows = deal(units, flows), [0] * len(capacities), []
    for (o, b, p, n, _), j in zip(units, shard_of):
        rows.append((o, b, p, j, filled[j]))
        filled[j] += n
    placed = F.broadcast(spark.createDataFrame(rows, f"{OWN}old int, {OWN}block int, {OWN}part int, shard int, {OWN}base long"))
    keyed = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")]).select(
        "*", old.cast("int").alias(f"{OWN}old"), block.alias(f"{OWN}block"), F.xxhash64(F.col(doc_id)).alias(f"{OWN}h")
    )
    marked = keyed.join(
        cut.select(F.col("old").alias(f"{OWN}old"), F.col("block").alias(f"{OWN}block"), F.col("cuts").alias(f"{OWN}cuts")),
        [f"{OWN}old", f"{OWN}block"],
        "left",
    ).withColumn(f"{OWN}part", F.pmod(f"{OWN}h", F.coalesce(F.col(f"{OWN}cuts"), F.lit(1))).cast("int"))
    unit = [f"{OWN}old", f"{OWN}block", f"{OWN}part"]
    dealt = marked.join(placed, unit).repartition(width(spark), *unit)
    order = Window.partitionBy(*unit).orderBy(F.xxhash64(F.col(text)), doc_id, text)
    out = dealt.withColumn("slot", F.col(f"{OWN}base") + F.row_number().over(order) - 1)
    return out.drop(*[c for c in out.columns if c.startswith(OWN)]), flows


def affected(flows: list[list[int]]) -> set[int]:
    """Shards that lose or gain bytes; the files of the others may stay as they are."""
    pairs = [(i, j) for i, row in enumerate(flows) for j, moved in enumerate(row) if moved and i != j]
    return {x for pair in pairs for x in pair}


def rewrite(placed: DataFrame, path: str, shards: set[int] | None = None) -> DataFrame:
    """Writes the given shards (all by default) as one folder each and returns what
    is in them."""
    chosen = placed if shards is None else placed.filter(F.col("shard").isin(*shards))
    chosen.write.partitionBy("shard").parquet(path)
    return reread(placed.sparkSession, path, chosen)


def reread(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)
