"""Nothing that grows with the panel is broadcast, however small Spark takes it to be."""

import os

import pytest

from panelforge.catalog import forecasting

SF = "/root/testdata/sf0.001"


def inner(node):
    """The nodes below one of an executed plan."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return [node.executedPlan()]
    return [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]


def broadcast_generators(df):
    """How many broadcasts of the run of `df` send what a generator makes, not aggregated."""
    df.collect()
    found, todo = 0, [(df._jdf.queryExecution().executedPlan(), False)]
    while todo:
        node, sent = todo.pop()
        name = node.nodeName()
        found += sent and name == "Generate"
        sent = (sent or name == "BroadcastExchange") and "Aggregate" not in name
        todo += [(x, sent) for x in inner(node)]
    return found


QUERIES = {
    "q1_method_comparison": forecasting.q1,
    "q3_error_distribution": forecasting.q3,
    "q4_error_ecdf": forecasting._errors,
    "q8_best_and_worst": forecasting.q8,
    "q9_win_rate": forecasting.q9,
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_panel_is_broadcast(spark, name):
    assert broadcast_generators(QUERIES[name](spark, SF)) == 0
