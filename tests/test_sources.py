"""Readers on files in the shapes the market reports come in."""

import datetime as dt
import json
import zipfile

import pytest

from pricepanel.operators import panel as op
from pricepanel.sources import reports, results, store
from test_panel import day_panel

FIELDS = ["DeliveryDate", "deliveryHour", "deliveryInterval", "settlementPoint", "settlementPointPrice"]


def document(rows, fields=FIELDS):
    return {
        "_meta": {"totalRecords": len(rows)},
        "report": {"reportName": "x"},
        "fields": [{"name": n, "cardinality": i} for i, n in enumerate(fields, 1)],
        "data": rows,
    }


def test_report_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(document([["2024-01-01", 1, 2, "A", 5.5], ["2024-01-01", 24, 4, "B", 7]]), indent=1))
    hourly = document([["2024-01-01", 3, "A", 9.25]], [f for f in FIELDS if f != "deliveryInterval"])
    (tmp_path / "b.json").write_text(json.dumps(hourly))
    got = reports.read_report_json(spark, str(tmp_path), with_order=True).orderBy("file", "pos").collect()
    assert [(r["node"], r["timestamp"], r["price"]) for r in got] == [
        ("A", dt.datetime(2024, 1, 1, 0, 15), 5.5),
        ("B", dt.datetime(2024, 1, 1, 23, 45), 7.0),
        ("A", dt.datetime(2024, 1, 1, 2), 9.25),
    ]
    assert reports.read_report_json(spark, str(tmp_path), ["A"]).count() == 2


def test_concat_skips_rows_of_wrong_length(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(document([["2024-01-01", 1, 2, "A", 5.5], ["short"]])))
    got = reports.concat_reports(spark, str(tmp_path))
    assert got.columns == FIELDS and got.count() == 1


def test_zone_csv_and_archives(spark, tmp_path):
    text = '"Time Stamp","Name","PTID","LBMP ($/MWHr)"\n"01/05/2024 00:00","WEST",1,20.5\n"1/5/2024 01:00","WEST",1,n/a\n'
    (tmp_path / "z.csv").write_text(text)
    got = reports.read_zone_csv(spark, str(tmp_path / "z.csv")).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["price"]) for r in got] == [
        (dt.datetime(2024, 1, 5), 20.5),
        (dt.datetime(2024, 1, 5, 1), None),
    ]
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("one.csv", text)
        z.writestr("notes.txt", "no")
        z.writestr("UPPER.CSV", 'Name,"Time Stamp",LBMP ($/MWHr)\n"WEST, 2",01/06/2024 00:00,7\n')
        z.writestr("other.csv", "a,b\n1,2\n3,4\n")
        z.writestr("empty.csv", "")
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    got = reports.read_zipped_csv(spark, str(tmp_path / "*.zip")).orderBy("timestamp").collect()
    assert [(r["node"], r["price"]) for r in got] == [("WEST", 20.5), ("WEST", None), ("WEST, 2", 7.0)]
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))
    bad = {(r["file"].rpartition("/")[2], r["member"]): (r["reason"], r["lines"]) for r in reports.rejected_members(files).collect()}
    assert bad == {
        ("broken.zip", None): ("damaged archive", 0),
        ("m.zip", "other.csv"): ("no column for timestamp, node or price", 2),
        ("m.zip", "empty.csv"): ("empty member", 0),
    }


def test_columns_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time Stamp,Name,LBMP ($/MWHr)\n2024-01-01 00:00,A,1\n")
    (tmp_path / "b.csv").write_text("Name,LBMP ($/MWHr),Time Stamp\nB,2,2024-01-02 00:00\n")
    for read in (reports.read_zone_csv, reports.read_tidy):
        got = read(spark, str(tmp_path)).orderBy("timestamp").collect()
        assert [(r["timestamp"].day, r["node"], r["price"]) for r in got] == [(1, "A", 1.0), (2, "B", 2.0)]


ODD_NAMES = ["a b.csv", "c+d.csv", "e%20f.csv", "g[1].csv", "h,i.csv", "{j}.csv"]


def test_any_file_name(spark, tmp_path):
    for i, name in enumerate(ODD_NAMES):
        head = "Time Stamp,Name,LBMP ($/MWHr)" if i % 2 else "Name,Time Stamp,LBMP ($/MWHr)"
        when, node = f"2024-01-01 0{i}:00:00", f"N{i}"
        (tmp_path / name).write_text(f"{head}\n{when},{node},{i}.5\n" if i % 2 else f"{head}\n{node},{when},{i}.5\n")
    got = reports.read_zone_csv(spark, str(tmp_path)).collect()
    assert sorted((r["node"], r["timestamp"].hour, r["price"]) for r in got) == [(f"N{i}", i, i + 0.5) for i in range(len(ODD_NAMES))]


def test_wide_and_quoted_archive_members(spark, tmp_path):
    extra = [f"x{i}" for i in range(300)]
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("a.csv", ",".join(["", *extra, "Name", '"Time Stamp"', "LBMP ($/MWHr)"]) + "\n" + ",".join(["", *"7" * 300, '"A, ""west"""', "2024-01-01 00:00:00", '"1.5"']) + "\n")
        z.writestr("b.csv", "Name,Time Stamp,LBMP ($/MWHr)\n,2024-01-01 01:00:00,\nB,2024-01-01 02:00:00\n")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))
    got = {(r["timestamp"].hour, r["node"], r["price"]) for r in reports.unzip_csv(files).collect()}
    assert got == {(0, 'A, "west"', 1.5), (1, None, None), (2, "B", None)}
    assert reports.rejected_members(files).count() == 0


@pytest.mark.parametrize("text", ["nodes:\n  - A\n  - B\n", "A\nB\n", "A,B\n", "nodes: [A, 'B']\n# note\n"])
def test_node_lists(spark, tmp_path, text):
    (tmp_path / "nodes.txt").write_text(text)
    nodes = reports.read_node_list(spark, str(tmp_path / "nodes.txt"))
    assert {r["node"] for r in nodes.collect()} == {"A", "B"}
    assert op.with_node_list(day_panel(spark, ("A", "C")), nodes).count() == 96


def test_load_prices_prunes_years(spark, tmp_path):
    root = str(tmp_path)
    p = day_panel(spark, ("A", "B"), days=800)
    store.write_tidy(p, root, "ERCOT", store.REAL_TIME)
    got = store.load_prices(spark, root, "ERCOT", "2025-01-01", "2025-01-02", ["A"], native="15T")
    assert got.count() == 97
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan and "PushedFilters: [" in plan
    hourly = store.load_prices(spark, root, "ERCOT", "2025-01-01", "2025-01-01 23:45:00", ["A"], "30T")
    assert hourly.count() == 48
    with pytest.raises(FileNotFoundError, match="2031"):
        store.load_prices(spark, root, "ERCOT", "2031-01-01", "2031-01-02")
    assert store.load_prices(spark, root, "ERCOT", "2031-01-01", "2031-01-02", missing="ignore").count() == 0
    before = spark.read.parquet(f"{root}/tidy").count()
    store.write_tidy(p.filter("year(timestamp) = 2025"), root, "ERCOT", store.REAL_TIME)  # a rerun doubles nothing
    assert spark.read.parquet(f"{root}/tidy").count() == before
    assert store.market_for("NYISO", "1H") == store.REAL_TIME and store.market_for("ERCOT", "1H") == store.DAY_AHEAD


def test_result_documents(spark, tmp_path):
    one = {"model": "oracle_LP", "revenue": 5.0, "runtime_seconds": 1.0, "dispatch_summary": {"timestamps": 3}}
    two = {"model": "online_mpc_ridge", "forecast_model": "ridge", "horizon": 32, "revenue": 4.0, "runtime_seconds": 2.0}
    (tmp_path / "ercot").mkdir()
    (tmp_path / "ercot" / "combined_results.json").write_text(json.dumps({"N1": [one, two], "N2": [one]}, indent=2))
    (tmp_path / "nyiso").mkdir()
    (tmp_path / "nyiso" / "W_X_results.json").write_text(json.dumps([two]))
    got = {(r["iso"], r["node"], r["model"]): r["horizon"] for r in results.read_results(spark, str(tmp_path), "BOTH").collect()}
    assert got == {
        ("ERCOT", "N1", "oracle_LP"): None,
        ("ERCOT", "N1", "online_mpc_ridge"): 32,
        ("ERCOT", "N2", "oracle_LP"): None,
        ("NYISO", "W_X", "online_mpc_ridge"): 32,
    }
