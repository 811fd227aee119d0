"""Layouts, filters, duplicates, reshaping and the time grid of a price panel."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricepanel.functions.scalars import clean_number
from pricepanel.functions.timegrid import (
    delivery_to_ts,
    floor_to,
    plus_minutes,
    seconds_between,
)
from pricepanel.operators.ordering import NODE, number_rows, previous

# Column headings of the published report layouts, lower case.
COLUMN_ALIASES = {
    "time stamp": "timestamp",
    "zone": "node",
    "name": "node",
    "settlementpoint": "node",
    "lbmp ($/mwhr)": "price",
    "settlementpointprice": "price",
}
TIME_HEADINGS = ("timestamp", "index", "date", "time", "datetime")


# --- columns and layouts -------------------------------------------------------


def standardise_columns(df: DataFrame) -> DataFrame:
    """Rename known headings, whatever their case, to timestamp, node, price."""
    taken = {c.lower() for c in df.columns}
    renames = {}
    for c in df.columns:
        target = COLUMN_ALIASES.get(c.lower(), c.lower() if c.lower() in ("timestamp", "node", "price") else None)
        if target and target != c and (target == c.lower() or target not in taken):
            renames[c] = target
            taken.add(target)
    return df.withColumnsRenamed(renames)


def as_timestamp(c: Column) -> Column:
    """ISO or month/day/year text, or any time type, as naive time; else null."""
    text = c.cast("string")
    us = F.regexp_replace(
        text, r"^(\d{1,2})/(\d{1,2})/(\d{4})\s*(.*)$", "$3-$1-$2 $4"
    )
    padded = F.regexp_replace(us, r"^(\d{4})-(\d)-", "$1-0$2-")
    padded = F.regexp_replace(padded, r"^(\d{4}-\d{2})-(\d)( |$)", "$1-0$2$3")
    return F.trim(padded).try_cast("timestamp_ntz")


def tidy(df: DataFrame) -> DataFrame:
    """Typed (timestamp, node, price) out of standardised columns."""
    dtype = dict(df.dtypes)
    ts = F.col("timestamp")
    price = F.col("price")
    return df.select(
        (ts if dtype["timestamp"] == "timestamp_ntz" else as_timestamp(ts)).alias("timestamp"),
        F.col("node").cast("string").alias("node"),
        (price if dtype["price"] == "double" else clean_number(price)).alias("price"),
    )


def wide_to_tidy(df: DataFrame) -> DataFrame:
    """One row per (timestamp, node) from one column per node, nulls kept."""
    heads = {c.lower(): c for c in df.columns}
    time = next((heads[h] for h in TIME_HEADINGS if h in heads), None)
    if time is None:
        raise ValueError(f"no time column among {df.columns}")
    nodes = [c for c in df.columns if c != time]
    cast = df.select(
        F.col(f"`{time}`").alias("timestamp"),
        *[clean_number(F.col(f"`{c}`")).alias(c) for c in nodes],
    )
    return tidy(
        cast.unpivot("timestamp", [F.col(f"`{c}`") for c in nodes], "node", "price")
    )


def normalise_panel(df: DataFrame) -> DataFrame:
    """Detect the layout by its headings and return the tidy panel."""
    heads = {c.lower(): c for c in df.columns}
    long_form = {"deliverydate", "deliveryhour", "settlementpoint", "settlementpointprice"}
    if long_form <= heads.keys():
        # Reports without an interval column are hourly: their rows start the hour.
        quarter = F.col(heads["deliveryinterval"]) if "deliveryinterval" in heads else F.lit(1)
        return df.select(
            delivery_to_ts(
                F.col(heads["deliverydate"]), F.col(heads["deliveryhour"]), quarter
            ).alias("timestamp"),
            F.col(heads["settlementpoint"]).cast("string").alias("node"),
            clean_number(F.col(heads["settlementpointprice"])).alias("price"),
        )
    std = standardise_columns(df)
    if {"timestamp", "node", "price"} <= set(std.columns):
        return tidy(std)
    return wide_to_tidy(df)


# --- filters -------------------------------------------------------------------


def filter_nodes(df: DataFrame, nodes: Sequence[str] | None) -> DataFrame:
    return df.filter(F.col("node").isin(list(nodes))) if nodes else df


def with_node_list(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows whose node is listed. The list's size decides the join strategy."""
    return df.join(nodes.select("node"), "node", "left_semi")


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Closed range."""
    return df.filter(
        F.col("timestamp").between(_literal_time(start), _literal_time(end))
    )


def _literal_time(text: str | dt.datetime) -> Column:
    return F.lit(str(text)).cast("timestamp_ntz")


def month_bounds(start: str | None, end: str | None) -> tuple[str | None, str | None]:
    """``YYYY-MM`` start means its first day, ``YYYY-MM`` end the day after it."""
    if start and len(start.split("-")) == 2:
        start = f"{start}-01"
    if end and len(end.split("-")) == 2:
        y, m = (int(p) for p in end.split("-"))
        end = f"{y + m // 12}-{m % 12 + 1:02d}-01"
    return start, end


def filter_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Half-open range ``[start, end)``; a side that is not given stays open."""
    start, end = month_bounds(start, end)
    if start:
        df = df.filter(F.col("timestamp") >= _literal_time(start))
    if end:
        df = df.filter(F.col("timestamp") < _literal_time(end))
    return df


def filter_week(df: DataFrame, start: str | None = None) -> DataFrame:
    """Seven days from the given or the first date of the data."""
    day = F.to_date("timestamp")
    if start:
        first = F.lit(start).cast("date")
        return df.filter((day >= first) & (day < F.date_add(first, 7)))
    first_day = df.agg(F.min(day).alias("_first"))  # one row
    return (
        df.crossJoin(F.broadcast(first_day))
        .filter((day >= F.col("_first")) & (day < F.date_add("_first", 7)))
        .drop("_first")
    )


def clean_price(df: DataFrame, raw: str = "price") -> DataFrame:
    """Numeric prices only; rows that do not parse are dropped."""
    return df.withColumn("price", clean_number(F.col(raw))).filter("price is not null")


def count_bad_prices(df: DataFrame, raw: str = "price") -> DataFrame:
    value = clean_number(F.col(raw))
    return df.groupBy("node").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(value.isNull()).alias("bad_rows"),
    )


def first_nodes(df: DataFrame, n: int, seq: str) -> DataFrame:
    """Rows of the first ``n`` nodes in order of first appearance."""
    chosen = (
        df.groupBy("node").agg(F.min(seq).alias("_first")).orderBy("_first", "node").limit(n)
    )
    return with_node_list(df, chosen)


def node_series(df: DataFrame, node: str, fallback: bool = False, seq: str | None = None) -> DataFrame:
    """Rows of one node. An unknown node is an error, or with ``fallback`` the
    node that appears first is taken instead."""
    hit = df.filter(F.col("node") == node)
    if not hit.limit(1).isEmpty():
        return hit
    if not fallback:
        raise ValueError(f"node {node!r} not in the panel")
    return first_nodes(df, 1, seq or "timestamp")


# --- duplicates and unions -----------------------------------------------------


def dedup(
    df: DataFrame,
    seq: str | Column,
    keep: str = "last",
    keys: Sequence[str] = ("timestamp", "node"),
) -> DataFrame:
    """One row per key, the first or last by ``seq``, which must be unique.

    An aggregate rather than a ranking window: duplicates are reduced before the
    shuffle, so a key that repeats without bound never reaches one task in full.
    """
    order = F.col(seq) if isinstance(seq, str) else seq
    pick = {"last": F.max_by, "first": F.min_by}[keep]
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[pick(F.col(c), order).alias(c) for c in rest])


def dedup_mean(df: DataFrame) -> DataFrame:
    return df.groupBy("timestamp", "node").agg(F.avg("price").alias("price"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Surplus rows and repeated keys over ``(timestamp, node)``, per node."""
    per_key = df.groupBy("timestamp", "node").agg(F.count(F.lit(1)).alias("_c"))
    return per_key.groupBy("node").agg(
        F.sum(F.col("_c") - 1).alias("duplicates"),
        F.count_if(F.col("_c") > 1).alias("repeated_keys"),
    )


def concat(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name; columns missing in a part are null."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def sorted_panel(df: DataFrame) -> DataFrame:
    return df.orderBy("timestamp", "node")


# --- reshaping -----------------------------------------------------------------


def node_names(df: DataFrame) -> list[str]:
    """Column names for a wide table. A wide table is only for panels with few
    nodes, so the pivot limit of the session bounds this list."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    rows = df.select("node").distinct().orderBy("node").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} nodes; keep the panel tidy")
    return [r[0] for r in rows]


def to_wide(df: DataFrame, nodes: Sequence[str] | None = None) -> DataFrame:
    """One column per node, mean of duplicates."""
    values = list(nodes) if nodes is not None else node_names(df)
    return df.groupBy("timestamp").pivot("node", values).agg(F.avg("price"))


def to_wide_strict(df: DataFrame, nodes: Sequence[str] | None = None) -> DataFrame:
    """As :func:`to_wide`, but a repeated ``(timestamp, node)`` fails the job."""
    one = (
        df.groupBy("timestamp", "node")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("price").alias("price"))
        .withColumn(
            "price",
            F.when(F.col("_c") == 1, F.col("price")).otherwise(
                F.raise_error(F.lit("duplicate timestamp-node entries"))
            ),
        )
    )
    values = list(nodes) if nodes is not None else node_names(df)
    return one.groupBy("timestamp").pivot("node", values).agg(F.first("price"))


def daily_mean_wide(df: DataFrame, nodes: Sequence[str] | None = None) -> DataFrame:
    """Mean price per day, one column per node, over all input at once."""
    values = list(nodes) if nodes is not None else node_names(df)
    return (
        df.groupBy(F.to_date("timestamp").alias("date"))
        .pivot("node", values)
        .agg(F.avg("price"))
    )


# --- time grid -----------------------------------------------------------------

# Labels of the common steps, in seconds.
STEP_LABELS = {60: "1min", 300: "5min", 900: "15T", 3600: "1H", 86400: "1D"}


def infer_step(df: DataFrame) -> DataFrame:
    """Most frequent step per node with its label; ties take the smaller step and
    a node with one row counts as daily."""
    gaps = previous(df.select("node", "timestamp"), F.col("timestamp"), "_prev").select(
        "node", seconds_between("timestamp", "_prev").alias("_s")
    )
    counted = gaps.groupBy("node", "_s").agg(F.count(F.lit(1)).alias("_c"))
    best = counted.groupBy("node").agg(
        F.max(
            F.struct(F.col("_s").isNotNull().alias("known"), "_c", (-F.col("_s")).alias("neg"))
        ).alias("b")
    )
    seconds = -F.col("b.neg")
    label = F.when(seconds.isNull(), F.lit("1D"))
    for s, text in STEP_LABELS.items():
        label = label.when(seconds == s, F.lit(text))
    label = label.otherwise(F.concat(seconds.cast("bigint").cast("string"), F.lit("S")))
    return best.select(
        "node",
        F.when(seconds.isNotNull(), F.col("b._c")).otherwise(F.lit(0)).alias("times"),
        label.alias("step"),
    )


def bucket_mean(df: DataFrame, freq: str) -> DataFrame:
    """Mean price per node and tumbling window. On a stream the event time is an
    instant, so there it runs on what :func:`to_instant` gives."""
    return (
        df.groupBy("node", F.window("timestamp", freq).alias("_w"))
        .agg(F.avg("price").alias("price"))
        .select("node", F.col("_w.start").alias("timestamp"), "price")
    )


def regular_grid(df: DataFrame, minutes: int = 15) -> DataFrame:
    """Every slot between a node's first and last row; missing prices are null.

    The grid starts at the node's first row; rows off the grid are dropped. Slots
    are generated day by day and joined on (node, slot), which a bucketed panel is
    already partitioned by, so one node's grid is spread over all tasks.
    """
    span = df.groupBy("node").agg(
        F.min("timestamp").alias("_a"), F.max("timestamp").alias("_z")
    )
    midnight = F.to_timestamp_ntz(F.col("_day").cast("string"))
    slots = (
        span.withColumn("_phase", F.col("_a") - floor_to("_a", minutes))
        .withColumn("_day", F.explode(F.sequence(F.to_date("_a"), F.to_date("_z"))))
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(1440 // minutes - 1))))
        .withColumn(
            "timestamp", plus_minutes(midnight, F.col("_k") * minutes) + F.col("_phase")
        )
        .filter("timestamp between _a and _z")
        .select("node", "timestamp")
    )
    return slots.join(df, ["node", "timestamp"], "left")


def resample(df: DataFrame, minutes: int) -> DataFrame:
    """Mean per bucket of ``minutes`` and node; empty buckets are null rows."""
    return regular_grid(bucket_mean(df, f"{minutes} minutes"), minutes)


def completeness(df: DataFrame, per_day: int = 96) -> DataFrame:
    """Distinct intervals per calendar year against the number expected."""
    year = F.year("timestamp").alias("year")
    expected = (
        F.datediff(
            F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)),
            F.make_date(F.col("year"), F.lit(1), F.lit(1)),
        )
        * per_day
    )
    distinct = df.select(year, "timestamp").distinct()
    return (
        distinct.groupBy("year")
        .agg(F.count(F.lit(1)).alias("intervals"))
        .withColumn("expected", expected.cast("bigint"))
        .withColumn("ratio", F.col("intervals") / F.col("expected"))
    )


def profile(df: DataFrame) -> DataFrame:
    """Rows, nodes, intervals and time span of the panel, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("node").alias("nodes"),
        F.countDistinct("timestamp").alias("intervals"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct nodes and intervals; the approximate form keeps one small sketch
    per task instead of shuffling the values."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(count("node").alias("nodes"), count("timestamp").alias("intervals"))


def day_sketches(df: DataFrame, lg_k: int = 12) -> DataFrame:
    """One sketch of the distinct intervals per (node, day), of a few kB at most.

    Sketches are stored and merged instead of the rows: a new day adds its own, and
    as a union ignores what it already holds, a day that is added again, late rows
    included, is not counted twice.
    """
    return df.groupBy("node", F.to_date("timestamp").alias("day")).agg(
        F.hll_sketch_agg(F.col("timestamp").cast("string"), lg_k).alias("intervals")
    )


def merged_counts(sketches: DataFrame, *keys: str) -> DataFrame:
    """Distinct intervals per ``keys`` (all together without), from stored sketches.
    The standard error is about 1.04 / sqrt(2 ** lg_k)."""
    union = F.hll_sketch_estimate(F.hll_union_agg("intervals")).alias("intervals")
    return sketches.groupBy(*keys).agg(union)


def walk_forward_folds(
    df: DataFrame,
    n_splits: int = 3,
    test_size: int | float = 0.2,
    gap: int = 0,
    keys: Sequence[str] = NODE,
) -> DataFrame:
    """Rows tagged ``(fold, split)`` for expanding-window evaluation.

    Folds are numbered from 1, oldest first. Each row is repeated only for the
    folds that use it; bounds are arithmetic on the row number.
    """
    if isinstance(test_size, float) and not 0 < test_size < 1:
        raise ValueError("test_size as a share must lie between 0 and 1")
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    whole = F.col("n")
    held = (F.floor(whole * F.lit(test_size)) if isinstance(test_size, float) else F.lit(test_size)).cast("bigint")
    # Folds end equally far apart; between two ends lie a test part, a gap and what is left over.
    moves = n_splits - 1
    spare = F.floor((whole - held - moves * (held + gap)) / moves)
    stride = F.when(spare > 0, spare + held + gap).otherwise(F.raise_error(F.lit(f"too few rows for {n_splits} folds")))
    rows = number_rows(df, keys).withColumn("_held", held).withColumn("_stride", stride)
    folds = F.least(F.lit(n_splits), F.ceil((whole - F.col("_held") - gap) / F.col("_stride")))
    back = F.sequence(F.lit(0).cast("bigint"), folds - 1)
    spans = F.transform(
        back,
        lambda i: F.struct(
            (folds - i).cast("int").alias("fold"),
            (whole - i * F.col("_stride") - F.col("_held") - gap).alias("learn"),
            (whole - i * F.col("_stride") - F.col("_held")).alias("after"),
            (whole - i * F.col("_stride")).alias("last"),
        ),
    )
    rn, span = F.col("rn"), F.col("_span")
    part = F.when(rn <= span["learn"], "train").when((rn > span["after"]) & (rn <= span["last"]), "test")
    return (
        rows.withColumn("_span", F.explode(spans))
        .withColumn("split", part)
        .filter("split is not null")
        .select(*df.columns, "rn", "_span.fold", "split")
    )
