"""Market report files: nested report documents, zone CSVs, archives, node lists."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricepanel.functions.scalars import clean_number
from pricepanel.functions.timegrid import delivery_to_ts
from pricepanel.operators.panel import (
    COLUMN_ALIASES,
    as_timestamp,
    filter_nodes,
    normalise_panel,
    standardise_columns,
    tidy,
)

REPORT_SCHEMA = (
    "fields array<struct<name:string,cardinality:int>>, data array<array<string>>"
)


def _documents(spark: SparkSession, paths: str | Sequence[str], one_per_file: bool) -> DataFrame:
    """Report documents, one per file or one per line, with their origin."""
    return (
        spark.read.schema(REPORT_SCHEMA)
        .option("multiLine", one_per_file)
        .json(paths)
        .select("fields", "data", F.col("_metadata.file_path").alias("file"))
    )


def _rows(docs: DataFrame) -> DataFrame:
    names = F.transform(
        "fields",
        lambda f, i: F.lower(F.coalesce(f["name"], F.concat(F.lit("field_"), i.cast("string")))),
    )
    return docs.select("file", names.alias("names"), F.posexplode("data").alias("pos", "row"))


def _field(name: str) -> Column:
    """Value of a named field in a positional row; null when the field is absent."""
    at = F.array_position("names", F.lit(name))
    return F.when(at > 0, F.get("row", (at - 1).cast("int")))


def read_report_json(
    spark: SparkSession,
    paths: str | Sequence[str],
    nodes: Sequence[str] | None = None,
    one_per_file: bool = True,
    with_order: bool = False,
) -> DataFrame:
    """Tidy panel of report documents.

    Rows are positional and named by the document's fields, in any case. Documents
    without an interval field are hourly. ``with_order`` keeps the file and the
    position of each row, which deduplication by source order needs.
    """
    rows = _rows(_documents(spark, paths, one_per_file))
    out = rows.select(
        delivery_to_ts(
            _field("deliverydate"),
            _field("deliveryhour"),
            F.coalesce(_field("deliveryinterval"), F.lit("1")),
        ).alias("timestamp"),
        _field("settlementpoint").alias("node"),
        clean_number(_field("settlementpointprice")).alias("price"),
        "file",
        "pos",
    )
    out = filter_nodes(out, nodes)
    return out if with_order else out.drop("file", "pos")


def concat_reports(
    spark: SparkSession, paths: str | Sequence[str], one_per_file: bool = True
) -> DataFrame:
    """All fields of all documents as text columns.

    Columns are the fields of the first document ordered by ``cardinality``; rows of
    another length are skipped.
    """
    docs = _documents(spark, paths, one_per_file)
    # Only the first file is opened for its fields; the listing is metadata.
    files = sorted(docs.inputFiles())
    first = _documents(spark, files[0], one_per_file).first() if files else None
    if first is None or first["fields"] is None:
        raise ValueError("no report document with fields")
    names = [f["name"] for f in sorted(first["fields"], key=lambda f: f["cardinality"])]
    return (
        docs.select(F.explode("data").alias("row"))
        .filter(F.size("row") == len(names))
        .select(*[F.col("row")[i].alias(n) for i, n in enumerate(names)])
    )


def _csv_groups(spark: SparkSession, paths: str | Sequence[str]) -> list[DataFrame]:
    """One scan per distinct header, so that columns are taken by name in every file,
    whatever their order. A pass over the lines finds each file's first one; the driver
    gets the file names by header, as it has them from listing the folder."""
    lines = spark.read.text(paths)
    first = lines.select(
        F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value"
    ).filter("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("header"))
    groups = first.groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    if len(groups) <= 1:
        return [spark.read.option("header", True).csv(paths)]
    # enforceSchema off: Spark itself fails on a file whose header is not the group's.
    return [
        spark.read.option("header", True).option("enforceSchema", False).csv(sorted(map(_as_path, g["files"])))
        for g in sorted(groups, key=lambda g: g["header"] or "")
    ]


def _as_path(uri: str) -> str:
    """A file's own path from its URI: names with blanks, signs or glob letters."""
    return re.sub(r"([\\\[\]{}*?^])", r"\\\1", unquote(uri))


def read_zone_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Tidy panel of zone price CSVs, by column names. Values are typed by casts, so
    no inference pass reads the data."""
    parts = [tidy(standardise_columns(raw)) for raw in _csv_groups(spark, paths)]
    return reduce(DataFrame.unionByName, parts)


_MEMBER_SCHEMA = "file string, member string, header string, line string, reason string"


def _member_lines(files: DataFrame) -> DataFrame:
    """Lines of every CSV member of archives given as ``(path, content)``, each with
    its member's header. What can't be read gives one row with a ``reason``: damaged
    archives and members, and members without lines. Members of other kinds are no data."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "member", "header", "line", "reason"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(path, None, None, None, "damaged archive")], columns=columns)
                    continue
                for member in archive.namelist():
                    if not member.lower().endswith(".csv"):
                        continue
                    try:
                        with archive.open(member) as raw:
                            text = io.TextIOWrapper(raw, "utf-8-sig", newline="")
                            header = text.readline().rstrip("\r\n")
                            if not header:
                                yield pd.DataFrame([(path, member, None, None, "empty member")], columns=columns)
                            while part := text.readlines(4 << 20):
                                yield pd.DataFrame({"file": path, "member": member, "header": header, "line": [x.rstrip("\r\n") for x in part], "reason": None})
                    except (zipfile.BadZipFile, zlib.error, EOFError, UnicodeDecodeError) as e:
                        yield pd.DataFrame([(path, member, None, None, f"damaged member: {type(e).__name__}")], columns=columns)

    return files.select("path", "content").mapInPandas(lines, _MEMBER_SCHEMA)


def _headings() -> list[str]:
    return ["timestamp", "node", "price"]


def _fields(line: str) -> Column:
    """The fields of a CSV line, however many; quoted ones still in quotes. A comma in
    front of the line lets every field start with one."""
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(',("(?:[^"]|"")*"|[^,]*)'), 1)


def _field_at(wanted: str) -> Column:
    """Place of the first heading that means ``wanted``, from 0; -1 without one."""
    names = [k for k, v in COLUMN_ALIASES.items() if v == wanted] + [wanted]
    heads = F.transform(_fields("header"), lambda h: F.lower(F.trim(F.regexp_replace(h, '"', ""))))
    return F.array_position(F.transform(heads, lambda h: h.isin(*names)), F.lit(True)).cast("int") - 1


def unzip_csv(files: DataFrame) -> DataFrame:
    """Rows of every ``.csv`` member of archives given as ``(path, content)``.

    Python only unpacks; lines are parsed by Spark. Archives are spread over tasks
    and lines leave in slices, so one archive's text never exists as a whole table.
    Archives and members that hold no prices are listed by :func:`rejected_members`.
    """
    rows = _member_lines(files).filter("reason IS NULL AND line <> ''")
    for name in _headings():
        rows = rows.withColumn(f"_{name}", _field_at(name))
    rows = rows.filter("_timestamp >= 0 AND _node >= 0 AND _price >= 0").withColumn("_v", _fields("line"))

    def value(name: str) -> Column:
        raw = F.get("_v", F.col(f"_{name}"))
        bare = F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw) - 2), '""', '"')
        return F.nullif(F.when(raw.startswith('"'), bare).otherwise(raw), F.lit(""))

    return rows.select(
        as_timestamp(value("timestamp")).alias("timestamp"),
        value("node").alias("node"),
        clean_number(value("price")).alias("price"),
        "file",
        "member",
    )


def rejected_members(files: DataFrame) -> DataFrame:
    """(file, member, reason, lines) of archives and members that :func:`unzip_csv` gives no rows of."""
    rows = _member_lines(files)
    missing = F.lit(False)
    for name in _headings():
        missing = missing | (_field_at(name) < 0)
    why = F.coalesce("reason", F.when(missing, "no column for timestamp, node or price"))
    return (
        rows.withColumn("reason", why)
        .filter("reason IS NOT NULL")
        .groupBy("file", "member", "reason")
        .agg(F.count("line").alias("lines"))
    )


def read_zipped_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Tidy panel of all CSV members of many zip archives."""
    return unzip_csv(spark.read.format("binaryFile").load(paths)).drop("file", "member")


def read_tidy(spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv") -> DataFrame:
    """Tidy files under any of the known headings, by name in every file."""
    if fmt == "csv":
        return read_zone_csv(spark, paths)
    return tidy(standardise_columns(spark.read.format(fmt).load(paths)))


def read_wide(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Wide CSV (one column per node) as a tidy panel, by name in every file."""
    return reduce(DataFrame.unionByName, [normalise_panel(raw) for raw in _csv_groups(spark, paths)])


def read_node_list(spark: SparkSession, path: str) -> DataFrame:
    """Nodes from a YAML ``nodes:`` list, one per line, or comma separated."""
    line = F.trim(F.regexp_replace("value", r"#.*$", ""))
    item = F.regexp_replace(F.regexp_replace(line, r"^nodes:\s*", ""), r"^-\s*", "")
    parts = F.explode(F.split(F.regexp_replace(item, r"[\[\]\"']", ""), ","))
    return (
        spark.read.text(path)
        .select(parts.alias("node"))
        .select(F.trim("node").alias("node"))
        .filter("node <> ''")
        .distinct()
    )
