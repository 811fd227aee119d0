"""Order-dependent building blocks that never pull one node into one task.

A plain ``PARTITION BY node`` window sends all rows of a node to a single task.
Here the order is cut at time boundaries instead: per-bucket totals are reduced
first (with map-side combine), the short per-node list of buckets is scanned to
get offsets, and the detail rows are handled per ``(node, bucket)``. A node that
holds a third of the data is then spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from pricepanel.session import scratch, width

NODE = ("node",)


def _by(keys: Sequence[str], *more: str) -> list[str]:
    return [*keys, *more]


def day_groups(
    df: DataFrame, keys: Sequence[str] = NODE, ts: str = "timestamp"
) -> DataFrame:
    """One row per (keys, day) with the day's rows as a sorted array.

    For panels: timestamps are unique per node there, so a group holds at most one
    row per slot of a day. Callers derive both a per-day summary and the detail
    from this frame; the two plans share one exchange, so the input is read once.
    The explicit null filters keep both plans identical, which joins would
    otherwise add on one side only.
    """
    day = F.to_date(ts)
    known = df.filter(day.isNotNull())
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    rest = [c for c in df.columns if c not in keys and c != ts]
    return known.groupBy(*keys, day.alias("_day")).agg(
        F.sort_array(F.collect_list(F.struct(ts, *rest))).alias("_rows")
    )


def number_rows(
    df: DataFrame, keys: Sequence[str] = NODE, ts: str = "timestamp"
) -> DataFrame:
    """Add ``rn`` (1-based position in time order) and ``n`` (rows of the group)."""
    days = day_groups(df, keys, ts)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    count = F.size("_rows").cast("bigint")
    offsets = days.select(
        *_by(keys, "_day"),
        F.coalesce(F.sum(count).over(before), F.lit(0)).alias("_off"),
        F.sum(count).over(whole).alias("n"),
    )
    rest = [c for c in df.columns if c not in keys]
    return (
        days.join(offsets, _by(keys, "_day"))
        .select(*keys, "_off", "n", F.posexplode("_rows").alias("_pos", "_row"))
        .select(
            *[F.col(k) for k in keys],
            *[F.col("_row")[c].alias(c) for c in rest],
            (F.col("_off") + F.col("_pos") + 1).alias("rn"),
            "n",
        )
        .select(*df.columns, "rn", "n")
    )


def in_chunks(
    numbered: DataFrame, size: int, lookback: int = 0, lookahead: int = 0
) -> DataFrame:
    """Cut each group into runs of ``size`` rows plus the neighbours a bounded
    frame needs. Adds ``_chunk`` and ``_own`` (true on the rows to keep)."""
    own = F.floor((F.col("rn") - 1) / size)
    last = F.floor((F.col("n") - 1) / size)
    first_needed = F.floor(F.greatest(F.col("rn") - 1 - lookahead, F.lit(0)) / size)
    last_needed = F.least(F.floor((F.col("rn") - 1 + lookback) / size), last)
    return (
        numbered.withColumn("_chunk", F.explode(F.sequence(first_needed, last_needed)))
        .withColumn("_own", F.col("_chunk") == own)
    )


def lagged(
    numbered: DataFrame,
    lags: Sequence[int],
    value: str = "price",
    keys: Sequence[str] = NODE,
    prefix: str = "lag_",
    size: int = 4096,
) -> DataFrame:
    """Previous values at the given row distances, null before the start."""
    parts = in_chunks(numbered, size, lookback=max(lags))
    w = Window.partitionBy(*_by(keys, "_chunk")).orderBy("rn")
    return (
        parts.select("*", *[F.lag(value, k).over(w).alias(f"{prefix}{k}") for k in lags])
        .filter("_own")
        .drop("_chunk", "_own")
    )


def previous(
    df: DataFrame,
    value: Column,
    alias: str,
    keys: Sequence[str] = NODE,
    ts: str = "timestamp",
) -> DataFrame:
    """Last known value of earlier rows, without numbering the rows.

    Works on raw ticks: rows are range-partitioned by key and time (rows of one moment
    by their content, in an order that no run changes), so any number of ticks of a
    node, even of one second, is spread. A task fills forward as rows stream by; what
    comes before its part is carried over by a scan of one row per part and key. The
    filled parts are written to the shared folder first, so that parts stay as they
    are for both steps.
    """
    spark = df.sparkSession
    tagged = df.withColumn("_v", value).withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    dealt = tagged.repartitionByRange(width(spark), *keys, ts, "_tie").sortWithinPartitions(*keys, ts, "_tie")
    at = [dealt.columns.index(k) for k in keys]
    v = dealt.columns.index("_v")
    schema = dealt.withColumn("_before", F.col("_v")).withColumn("_part", F.lit(0)).limit(0).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, carried = TaskContext.get().partitionId(), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            changes = np.zeros(n, bool)
            for k in at:
                codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy()
                changes[1:] |= codes[1:] != codes[:-1]
            changes[0] = [batch.column(k)[0].as_py() for k in at] != now
            column = batch.column(v)
            # Value 0 is what was carried here, value i + 1 that of row i.
            values = pa.concat_arrays([pa.array([None if changes[0] else carried], column.type), column])
            known = values.is_valid().to_numpy(zero_copy_only=False)
            last = np.maximum.accumulate(np.where(known, np.arange(n + 1), 0))[:-1]
            begin = np.maximum.accumulate(np.where(changes, np.arange(n), 0))
            # Nothing from before the key's first row, unless it goes on from the last batch.
            open_ = last < np.where((begin == 0) & ~changes[0], 0, begin + 1)
            before = values.take(pa.array(last, mask=open_))
            now = [batch.column(k)[n - 1].as_py() for k in at]
            end = column[n - 1] if column[n - 1].is_valid else before[n - 1]
            carried = end.as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, before, pa.array(np.full(n, part, np.int32))], names=names)

    path = scratch(spark, "parts")
    dealt.mapInArrow(run, schema).write.parquet(path)
    filled = spark.read.schema(schema).parquet(path)
    known_at = F.when(F.col("_v").isNotNull(), F.struct(ts, "_tie"))
    ends = filled.groupBy("_part", *keys).agg(F.max_by("_v", known_at).alias("_last"))
    scan = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    carried = ends.select(F.col("_part").alias("_p"), *own, F.last("_last", ignorenulls=True).over(scan).alias("_carried"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return filled.join(carried, same).select(*df.columns, F.coalesce("_before", "_carried").alias(alias))


def last_known(
    df: DataFrame,
    k: int,
    value: str = "price",
    keys: Sequence[str] = NODE,
    ts: str = "timestamp",
) -> DataFrame:
    """The ``k`` latest known values at or before each row, gaps skipped.

    Adds ``_last`` (newest first, shorter where history is), ``_last_ts`` (time of
    the newest one) and ``_left`` (rows of the day from this one on). Within a day a
    window skips nulls and NaN; what is still missing comes from the state that a
    scan of days carries over: each day's last ``k`` values, completed by those of
    the ``k`` days with values before it.
    """
    spec = f"PARTITION BY {', '.join(f'`{c}`' for c in _by(keys, '_day'))} ORDER BY `{ts}`"
    tagged = df.withColumn("_v", F.when(~F.isnan(value), F.col(value).cast("double"))).withColumn("_day", F.to_date(ts))
    newest = F.sort_array(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct(F.col(ts).alias("t"), F.col("_v").alias("v")))), asc=False)
    tails = tagged.groupBy(*_by(keys, "_day")).agg(F.slice(newest, 1, k).alias("_tail"))
    known_days = Window.partitionBy(*keys, F.size("_tail") > 0).orderBy("_day").rowsBetween(1 - k, 0)
    after = F.slice(F.flatten(F.reverse(F.collect_list("_tail").over(known_days))), 1, k)
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tails.withColumn("_after", F.when(F.size("_tail") > 0, after))
        .select(*_by(keys, "_day"), F.coalesce(F.last("_after", ignorenulls=True).over(earlier), F.slice("_tail", 1, 0)).alias("_before"))
    )
    steps = [F.col("_v"), *[F.expr(f"lag(_v, {j}) IGNORE NULLS OVER ({spec})") for j in range(1, k + 1)]]
    inside = Window.partitionBy(*_by(keys, "_day")).orderBy(ts)
    seen = F.last(F.when(F.col("_v").isNotNull(), F.col(ts)), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        tagged.join(carried, _by(keys, "_day"))
        .withColumn("_in", F.array_compact(F.array(*steps)))
        .withColumn("_seen", seen)
        .withColumn("_left", F.count(F.lit(1)).over(inside.rowsBetween(0, Window.unboundedFollowing)))
        .select(
            *df.columns,
            F.slice(F.concat("_in", F.col("_before.v")), 1, k).alias("_last"),
            F.coalesce("_seen", F.try_element_at(F.col("_before.t"), F.lit(1))).alias("_last_ts"),
            "_left",
        )
    )


def expanding_moments(
    df: DataFrame,
    value: str = "price",
    keys: Sequence[str] = NODE,
    ts: str = "timestamp",
) -> DataFrame:
    """Count, mean and population variance of all strictly earlier rows.

    Day totals are merged with the running moments inside the day; deviations are
    taken around the node's own mean so the merge does not cancel.
    """
    days = day_groups(df, keys, ts)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    # A day is reduced to three numbers before the node's days are scanned.
    known = F.filter(F.col(f"_rows.{value}"), lambda x: x.isNotNull())
    total = F.aggregate("_x", F.lit(0.0), lambda a, x: a + x)
    apart = F.aggregate("_x", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m")))
    per_day = (
        days.select(*_by(keys, "_day"), known.alias("_x"))
        .select("*", F.size("_x").alias("_c"), F.when(F.size("_x") > 0, total / F.size("_x")).otherwise(0.0).alias("_m"))
        .select(*_by(keys, "_day", "_c", "_m"), apart.alias("_q"))
        .withColumn("_ctr", F.coalesce(F.sum(F.col("_c") * F.col("_m")).over(whole) / F.nullif(F.sum("_c").over(whole), F.lit(0)), F.lit(0.0)))
    )
    off = F.col("_m") - F.col("_ctr")
    squares = F.col("_q") + F.col("_c") * off * off
    prefix = per_day.withColumn("_sq", squares).select(
        *_by(keys, "_day", "_ctr"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(
            F.sum(F.col("_c") * (F.col("_m") - F.col("_ctr"))).over(before), F.lit(0.0)
        ).alias("_s0"),
        F.coalesce(F.sum("_sq").over(before), F.lit(0.0)).alias("_t0"),
    )
    inside = (
        Window.partitionBy(*_by(keys, "_day"))
        .orderBy(ts)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rest = [c for c in df.columns if c not in keys]
    detail = days.join(prefix, _by(keys, "_day")).select(
        *_by(keys, "_day", "_ctr", "_n0", "_s0", "_t0"),
        F.explode("_rows").alias("_row"),
    )
    joined = detail.select(
        *_by(keys, "_day", "_ctr", "_n0", "_s0", "_t0"),
        *[F.col("_row")[c].alias(c) for c in rest],
    ).select(
        "*",
        F.count(value).over(inside).alias("_n1"),
        F.coalesce(F.avg(value).over(inside), F.lit(0.0)).alias("_m1"),
        F.coalesce(F.var_pop(value).over(inside), F.lit(0.0)).alias("_v1"),
    )
    d1 = F.col("_m1") - F.col("_ctr")
    n = F.col("_n0") + F.col("_n1")
    shift = (F.col("_s0") + F.col("_n1") * d1) / F.nullif(n, F.lit(0))
    spread = F.col("_t0") + F.col("_n1") * (F.col("_v1") + d1 * d1)
    # One block only: take its moments as they are, with no detour over the centre.
    mean = F.when(F.col("_n0") == 0, F.col("_m1")).otherwise(F.col("_ctr") + shift)
    var = F.when(F.col("_n0") == 0, F.col("_v1")).otherwise(
        spread / F.nullif(n, F.lit(0)) - shift * shift
    )
    tiny = F.lit(1e-10)  # below this the spread is rounding noise of equal values
    return joined.select(
        *df.columns,
        n.alias("n_before"),
        F.when(n > 0, mean).alias("mean_before"),
        F.when(n > 0, F.when(var < tiny, F.lit(0.0)).otherwise(var)).alias("var_before"),
    )
