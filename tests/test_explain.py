"""Physical plans: what reaches the scan, what is shared, what must not appear."""

from conftest import SMALL
from pricepanel.operators import dispatch, metrics as mt, panel as op
from pricepanel.plans import fixtures as fx
from pricepanel.operators import forecast as fc


def plan(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(op.between(fx.ship_ticks(spark, SMALL), "1996-01-01", "1996-02-01").select("node", "price"))
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThanOrEqual(l_shipda" in p
    schema = p.split("ReadSchema: ")[1].splitlines()[0]
    assert "l_discount" not in schema and "l_quantity" not in schema


def test_duplicates_are_reduced_before_the_shuffle(spark):
    p = plan(op.dedup(fx.ship_ticks(spark, SMALL), "seq"))
    assert "partial_max_by" in p and "Window" not in p and p.count("Exchange") == 1


def test_ledger_shares_the_signal_exchange(spark):
    df = dispatch.threshold_dispatch(fx.events_panel(spark, SMALL), pcts=(10,))
    p = plan(df, run=True)
    assert "ReusedExchange" in p
    assert "BatchEvalPython" not in p  # Python only sees Arrow batches


def test_no_cartesian_products_of_data(spark):
    det = mt.mean_results(fx.results(spark, SMALL, "c_custkey"))
    for df in (mt.vs_oracle(det, "1-URGENT"), mt.relative_summary(det, "1-URGENT"), op.regular_grid(fx.events_panel(spark, SMALL))):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_walk_forward_scans_the_panel_once(spark):
    e = fc.walk_forward(fx.events_panel(spark, SMALL), ("last_value", "previous_day", "ewma", "ridge"))
    assert "events.parquet" not in e._jdf.queryExecution().executedPlan().toString()


def test_no_array_passes_a_node_window(spark):
    from pricepanel.operators import features as ft

    plan = ft.context_features(fx.events_panel(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "_day" in line:
            assert "_x" not in line and "_rows" not in line
