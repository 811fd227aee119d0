"""The partitioned panel table, wide exports, and loading of a date range."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricepanel.operators import panel as op
from pricepanel.session import width
from pricepanel.sources import reports

# Names of the two market segments.
REAL_TIME, DAY_AHEAD = "RealTime", "DayAhead"


def freq_minutes(freq: str) -> int:
    """Minutes of a step such as ``15T``, ``5min``, ``1H`` or ``1D``."""
    m = re.fullmatch(r"(\d*)(T|min|H|h|D)", freq)
    if not m:
        raise ValueError(f"unknown frequency {freq!r}")
    unit = {"T": 1, "min": 1, "H": 60, "h": 60, "D": 1440}[m.group(2)]
    return int(m.group(1) or 1) * unit


def market_for(iso: str, freq: str) -> str:
    """Market segment a frequency belongs to. In one market hourly prices are
    day-ahead, in the other only daily ones are."""
    minutes = freq_minutes(freq)
    limit = 1440 if iso.upper() == "NYISO" else 60
    return REAL_TIME if minutes < limit else DAY_AHEAD


def write_tidy(
    df: DataFrame, root: str, iso: str, market: str, mode: str = "overwrite"
) -> None:
    """Store a panel by (iso, market, year), sorted by time and node.

    Rows are range-partitioned on time, so a year is several sorted files with
    narrow timestamp statistics and no task has to hold a whole year. By default the
    years that ``df`` has are replaced and others stay, so a rerun changes nothing;
    ``append`` adds to them.
    """
    out = df.select(
        "timestamp", "node", "price",
        F.lit(iso).alias("iso"),
        F.lit(market).alias("market"),
        F.year("timestamp").alias("year"),
    )
    (
        out.repartitionByRange(width(df.sparkSession), "year", "timestamp", "node")
        .sortWithinPartitions("year", "timestamp", "node")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("iso", "market", "year")
        .parquet(f"{root}/tidy")
    )


def write_wide(
    df: DataFrame, path: str, nodes: Sequence[str] | None = None, mode: str = "overwrite"
) -> None:
    """One column per node as CSV, in time order."""
    op.to_wide(df, nodes).orderBy("timestamp").write.mode(mode).option("header", True).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def wide_path(root: str, iso: str, market: str, year: int) -> str:
    return f"{root}/wide/{iso}/{market}/{year}"


def raw_path(root: str, iso: str, market: str, year: int) -> str:
    return f"{root}/raw/{iso}/{market}/{year}"


def load_prices(
    spark: SparkSession,
    root: str,
    iso: str,
    start: str,
    end: str,
    nodes: Sequence[str] | None = None,
    freq: str = "15T",
    native: str | None = None,
    missing: str = "error",
    one_per_file: bool = False,
) -> DataFrame:
    """Tidy prices in the closed range ``[start, end]`` at frequency ``freq``.

    Per year the tidy table is used if it has the year, else a wide export, else
    raw reports. All tidy years are one scan: the year filter prunes partitions and
    the timestamp filter reaches the Parquet statistics. ``native`` names the step
    of the stored data; without it the step is inferred. Years of the range without
    any data raise an error, or are left out if ``missing`` is ``ignore``. Raw reports
    are one document per line, or one per file (in any layout) with ``one_per_file``.
    """
    market = market_for(iso, freq)
    first, last = (dt.datetime.fromisoformat(str(t)) for t in (start, end))
    tidy_years, parts, absent = [], [], []
    for year in range(first.year, last.year + 1):
        wide, raw = wide_path(root, iso, market, year), raw_path(root, iso, market, year)
        if _exists(spark, f"{root}/tidy/iso={iso}/market={market}/year={year}"):
            tidy_years.append(year)
        elif _exists(spark, wide):
            parts.append(reports.read_wide(spark, wide))
        elif _exists(spark, f"{raw}/json"):
            parts.append(reports.read_report_json(spark, f"{raw}/json", nodes, one_per_file=one_per_file))
        elif _exists(spark, f"{raw}/csv"):
            parts.append(reports.read_zone_csv(spark, f"{raw}/csv"))
        else:
            absent.append(year)
    if absent and missing != "ignore":
        raise FileNotFoundError(f"no {iso} {market} prices for {absent} below {root}")
    if tidy_years:
        stored = spark.read.parquet(f"{root}/tidy").filter(
            (F.col("iso") == iso) & (F.col("market") == market) & F.col("year").isin(tidy_years)
        )
        parts.insert(0, stored.select("timestamp", "node", "price"))
    if not parts:
        return spark.createDataFrame([], "timestamp timestamp_ntz, node string, price double")
    out = op.filter_nodes(op.between(op.concat(parts), str(first), str(last)), nodes)
    out = out.select("timestamp", "node", "price")
    minutes = freq_minutes(freq)
    if native is not None:
        same = freq_minutes(native) == minutes
    else:
        label = op.STEP_LABELS.get(minutes * 60, f"{minutes * 60}S")
        steps = op.infer_step(out).select("step").distinct().limit(2).collect()
        same = [r["step"] for r in steps] in ([], [label])
    return out if same else op.resample(out, minutes).select("timestamp", "node", "price")
