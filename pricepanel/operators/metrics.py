"""Comparison of results across models, nodes and markets.

Input is a results table ``(iso, node, model, revenue, runtime_seconds)``; ``iso``
is optional where stated. Aggregates come first, so joins and pivots only see one
row per node and model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pricepanel.functions.scalars import percent_of

# Spellings of model names in result files.
MODEL_NAMES = {"oracle_LP": "oracle_lp"}
MODELS = (
    "oracle_lp",
    "online_mpc_ridge",
    "online_mpc_naive",
    "online_quartile_p10",
    "online_quartile_p25",
    "online_quartile_p45",
)
ORACLE, RIDGE, NAIVE = MODELS[:3]


def _keys(df: DataFrame) -> list[str]:
    return [k for k in ("iso", "node") if k in df.columns]


def normalise_models(df: DataFrame, names: dict[str, str] = MODEL_NAMES) -> DataFrame:
    """Uniform model names; unknown ones pass through."""
    model = F.col("model")
    for found, wanted in names.items():
        model = F.when(F.col("model") == found, F.lit(wanted)).otherwise(model)
    return df.withColumn("model", model)


def mean_results(df: DataFrame) -> DataFrame:
    """Mean revenue and runtime per (iso, node, model)."""
    return df.groupBy(*_keys(df), "model").agg(
        F.avg("revenue").alias("revenue"), F.avg("runtime_seconds").alias("runtime_seconds")
    )


def mean_runtime(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("model")
        .agg(F.avg("runtime_seconds").alias("runtime_seconds"))
        .orderBy("runtime_seconds")
    )


def names_in(df: DataFrame, column: str) -> list[str]:
    """The names a column holds, for a pivot; the session's pivot limit bounds them."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} values of {column}")
    return [r[0] for r in rows]


def pivot_models(detailed: DataFrame, value: str = "revenue", models: Sequence[str] | None = MODELS) -> DataFrame:
    """One row per node, one column per model; those of the data where none are named."""
    models = names_in(detailed, "model") if models is None else list(models)
    return detailed.groupBy(*_keys(detailed)).pivot("model", models).agg(F.avg(value))


def pivot_nodes(df: DataFrame, nodes: Sequence[str] | None = None, value: str = "revenue") -> DataFrame:
    """One row per model, one column per node; those of the data where none are named."""
    nodes = names_in(df, "node") if nodes is None else list(nodes)
    return df.groupBy("model").pivot("node", nodes).agg(F.avg(value))


def vs_oracle(detailed: DataFrame, oracle: str = ORACLE) -> DataFrame:
    """Each result next to its node's oracle revenue (inner join).

    Expects one row per node and model, as :func:`mean_results` gives.
    """
    keys = _keys(detailed)
    best = detailed.filter(F.col("model") == oracle).select(
        *keys, F.col("revenue").alias("oracle_revenue")
    )
    return detailed.join(best, keys).withColumn(
        "pct_of_oracle", percent_of(F.col("revenue"), F.col("oracle_revenue"))
    )


def relative(
    detailed: DataFrame,
    models: Sequence[str] | None = MODELS,
    oracle: str = ORACLE,
    ridge: str = RIDGE,
    naive: str = NAIVE,
) -> DataFrame:
    """Percent of oracle per model and ridge over naive, one row per node."""
    models = names_in(detailed, "model") if models is None else models
    wide = pivot_models(detailed, "revenue", models)
    out = [
        percent_of(F.col(f"`{m}`"), F.col(f"`{oracle}`")).alias(f"{m}_vs_oracle")
        for m in models
        if m != oracle
    ]
    if ridge in models and naive in models:
        out.append(improvement(F.col(f"`{ridge}`"), F.col(f"`{naive}`")).alias("ridge_vs_naive"))
    return wide.select(*_keys(detailed), *out)


def improvement(new: Column, base: Column) -> Column:
    """Percent gain over ``base``; the sign of ``base`` is kept."""
    return (new - base) / F.nullif(base, F.lit(0.0)) * 100


def improvement_abs(new: Column, base: Column) -> Column:
    """Percent gain over the size of ``base``."""
    return (new - base) / F.nullif(F.abs(base), F.lit(0.0)) * 100


def _per_iso_and_overall(df: DataFrame, *extra: str) -> list:
    sets = [[F.col("iso"), *[F.col(e) for e in extra]], [F.col(e) for e in extra]]
    return df.groupingSets(sets, F.col("iso"), *[F.col(e) for e in extra])


def _iso_label() -> Column:
    return F.when(F.grouping("iso") == 1, F.lit("OVERALL")).otherwise(F.col("iso"))


def model_summary(detailed: DataFrame) -> DataFrame:
    """Mean and sample deviation per model, for each market and overall."""
    return (
        _per_iso_and_overall(detailed, "model")
        .agg(
            _iso_label().alias("market"),
            F.avg("revenue").alias("revenue_mean"),
            F.stddev_samp("revenue").alias("revenue_std"),
            F.avg("runtime_seconds").alias("runtime_mean"),
            F.count(F.lit(1)).alias("nodes"),
        )
        .drop("iso")
        .withColumnRenamed("market", "iso")
    )


def relative_summary(detailed: DataFrame, oracle: str = ORACLE) -> DataFrame:
    """Mean and sample deviation of the per-node percentages (mean of ratios)."""
    rows = vs_oracle(detailed, oracle).filter(F.col("model") != oracle)
    return (
        _per_iso_and_overall(rows, "model")
        .agg(
            _iso_label().alias("market"),
            F.avg("pct_of_oracle").alias("pct_mean"),
            F.stddev_samp("pct_of_oracle").alias("pct_std"),
        )
        .drop("iso")
        .withColumnRenamed("market", "iso")
    )


def two_models(detailed: DataFrame, **names: str) -> DataFrame:
    """One row per node with the revenue of each named model as a column."""
    return detailed.groupBy(*_keys(detailed)).agg(
        *[
            F.max(F.when(F.col("model") == m, F.col("revenue"))).alias(f"{label}_revenue")
            for label, m in names.items()
        ]
    )


def win_counts(detailed: DataFrame, ridge: str = RIDGE, naive: str = NAIVE) -> DataFrame:
    """Nodes where ridge beats naive, and their share, per market and overall."""
    gain = improvement(F.col("ridge_revenue"), F.col("naive_revenue"))
    rows = two_models(detailed, ridge=ridge, naive=naive)
    return (
        _per_iso_and_overall(rows)
        .agg(
            _iso_label().alias("market"),
            F.count_if(gain > 0).alias("ridge_wins"),
            F.count(F.lit(1)).alias("nodes"),
        )
        .select(
            F.col("market").alias("iso"),
            "ridge_wins",
            "nodes",
            (F.col("ridge_wins") / F.col("nodes") * 100).alias("share"),
        )
    )


def compare_markets(
    detailed: DataFrame,
    first: str,
    second: str,
    oracle: str = ORACLE,
    ridge: str = RIDGE,
    naive: str = NAIVE,
) -> DataFrame:
    """Two markets side by side: oracle ratio, ridge percentage, improvement."""
    rows = two_models(detailed, oracle=oracle, ridge=ridge, naive=naive)
    values = {
        "oracle": F.col("oracle_revenue"),
        "ridge_pct": percent_of(F.col("ridge_revenue"), F.col("oracle_revenue")),
        "improvement": improvement(F.col("ridge_revenue"), F.col("naive_revenue")),
    }
    out = rows.agg(
        *[
            F.avg(F.when(F.col("iso") == iso, v)).alias(f"{name}_{tag}")
            for name, v in values.items()
            for tag, iso in (("first", first), ("second", second))
        ]
    )
    return out.withColumn(
        "oracle_ratio", F.col("oracle_second") / F.nullif(F.col("oracle_first"), F.lit(0.0))
    )


def naive_comparison(
    detailed: DataFrame, oracle: str = ORACLE, ridge: str = RIDGE, naive: str = NAIVE
) -> DataFrame:
    """Gap to the oracle and ridge against naive per node that has all three."""
    o, r, n = (F.col(f"{x}_revenue") for x in ("oracle", "ridge", "naive"))
    pct = improvement_abs(r, n)
    return (
        two_models(detailed, oracle=oracle, ridge=ridge, naive=naive)
        .filter(o.isNotNull() & r.isNotNull() & n.isNotNull())
        .withColumn("naive_vs_ridge", pct)
        .withColumn("naive_vs_oracle", percent_of(o - n, o))
        .withColumn("ridge_vs_oracle", percent_of(o - r, o))
        .withColumn(
            "better_forecaster",
            F.when(pct.isNull(), F.lit(None)).when(pct > 0, F.lit("ridge")).otherwise(F.lit("naive")),
        )
        .withColumn("improvement", F.abs(pct))
    )


def naive_summary(comparison: DataFrame) -> DataFrame:
    """Counts and average gaps over the nodes of :func:`naive_comparison`."""
    worse = F.count_if(F.col("naive_vs_ridge") < 0)
    return comparison.agg(
        F.count(F.lit(1)).alias("nodes"),
        worse.alias("naive_better"),
        (worse / F.count(F.lit(1)) * 100).alias("naive_better_pct"),
        F.avg("naive_vs_ridge").alias("avg_ridge_gain"),
        F.avg("naive_vs_oracle").alias("avg_naive_gap"),
        F.avg("ridge_vs_oracle").alias("avg_ridge_gap"),
    )


def better_forecasters(comparison: DataFrame) -> DataFrame:
    """Nodes won and mean improvement per forecaster."""
    return comparison.groupBy("better_forecaster").agg(
        F.count(F.lit(1)).alias("nodes"), F.avg("improvement").alias("improvement")
    )


def summary_table(df: DataFrame, oracle: str = ORACLE) -> DataFrame:
    """Mean, deviation and range per model; percent of oracle as ratio of means."""
    stats = [
        f(c).alias(f"{c}_{name}")
        for c in ("revenue", "runtime_seconds")
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ]
    per_model = df.groupBy("model").agg(*stats)
    best = per_model.filter(F.col("model") == oracle).select(
        F.col("revenue_mean").alias("_oracle")
    )  # one row
    joined = per_model.crossJoin(F.broadcast(best))
    return joined.select(
        "model",
        *[F.round(c, 2).alias(c) for c in per_model.columns if c != "model"],
        F.round(percent_of(F.col("revenue_mean"), F.col("_oracle")), 1).alias("pct_of_oracle"),
    )


def oracle_histogram(detailed: DataFrame, bins: int = 15, oracle: str = ORACLE) -> DataFrame:
    """Equal-width histogram of the percent of oracle per model, with its mean."""
    rows = vs_oracle(detailed, oracle).filter(F.col("model") != oracle).select(
        "model", F.col("pct_of_oracle").alias("x")
    ).filter("x is not null")
    span = rows.groupBy("model").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean")
    )
    # All spans as one row: the rows need not be shuffled on the few model names.
    spans = span.agg(
        F.map_from_entries(
            F.collect_list(F.struct("model", F.struct("lo", "hi", "mean")))
        ).alias("_spans")
    )
    s = F.col("_spans")[F.col("model")]
    pos = F.floor((F.col("x") - s["lo"]) / F.nullif(s["hi"] - s["lo"], F.lit(0.0)) * bins)
    bin_no = F.coalesce(F.least(pos, F.lit(bins - 1)), F.lit(0))
    return (
        rows.crossJoin(F.broadcast(spans))
        .select("model", s["lo"].alias("lo"), s["hi"].alias("hi"), s["mean"].alias("mean"), bin_no.alias("bin"))
        .groupBy("model", "lo", "hi", "mean", "bin")
        .agg(F.count(F.lit(1)).alias("nodes"))
    )


def forecaster_table(schedules: DataFrame, runtimes: DataFrame | None = None) -> DataFrame:
    """Revenue and delivered energy per model over its schedule rows, with given
    runtimes when there are any."""
    out = schedules.groupBy("model").agg(
        F.sum("revenue").alias("revenue"), F.sum("mwh").alias("deployed_mwh")
    )
    return out if runtimes is None else out.join(runtimes, "model", "left")


def flatten_results(results: DataFrame) -> DataFrame:
    """One flat row per result out of ``(node, results ARRAY<STRUCT>)``; parameters
    a model does not have are null."""
    r = results.select("node", F.explode("results").alias("r"))
    fields = r.schema["r"].dataType.names
    wanted = [
        ("model", "string"), ("revenue", "double"), ("runtime_seconds", "double"),
        ("forecast_model", "string"), ("horizon", "int"), ("percentile", "double"),
        ("window_size", "int"),
    ]
    return r.select(
        "node",
        *[
            (F.col("r")[c] if c in fields else F.lit(None)).cast(t).alias(c) for c, t in wanted
        ],
    )
