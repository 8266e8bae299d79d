"""How often queries on investigations move rows: those of an investigation once, however many windows and groupings follow."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import dated_rows
from tracewell.operators import chronology
from tracewell.plans import catalog, views

#: Shuffles of each query where the orders go to the items by broadcast; two more where they don't.
MOVES = {
    "alternate_fact_checks": 1,
    "deep_read_plan": 1,
    "claim_status_with_divergence": 1,
    "divergence_edges": 1,
    "expansion_decision": 1,
    "timeline_rows": 1,
    "graph_nodes": 1,
    "claim_comparisons": 1,
    "claim_status": 1,
    "policy_gates": 1,
    "resolved_dates": 1,
    "sampled_divergences": 1,
    "selected_occurrences": 1,
}


def shuffles(frame) -> int:
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", MOVES)
def test_rows_of_an_investigation_move_once(spark, small, name):
    assert shuffles(catalog.QUERIES[name](spark, small)) == MOVES[name]


def test_gathered_parts_grow_with_the_items(spark, small, monkeypatch):
    """A task's memory is bounded by the items of its part, not by what is merged into it."""
    items = views.table(spark, small, "lineitem").count()
    monkeypatch.setattr(views, "ITEMS_A_PART", items // 40)
    rows = views.candidates(spark, small, gathered=True)
    spread = rows.select("inv", F.spark_partition_id().alias("part")).distinct()
    assert rows.rdd.getNumPartitions() >= 40
    assert spread.count() == spread.select("inv").distinct().count()


def test_selection_sorts_few_times(spark, small):
    """Peak memory of a task is the sum of its sorts; each round of the selection had two before."""
    plan = catalog.QUERIES["selected_occurrences"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 6


def test_selection_among_many_domains_and_groups(spark):
    """More domains and groups than can be picked, some missing, against the greedy walk."""
    rng = random.Random(9)
    for n, kinds in ((40, 3), (150, 12), (300, 60)):
        name = lambda k: None if rng.random() < 0.05 else f"{k}{int(kinds * rng.random() ** 3)}"  # noqa: B023, E731
        rows = [(f"r{i:03d}", f"20{20 + i // 336}-{1 + i // 28 % 12:02d}-{1 + i % 28:02d}", name("d"), name("g")) for i in range(n)]
        picked = [0, n - 1]
        while len(picked) < 8:
            domains, groups = {rows[i][2] for i in picked} - {None}, {rows[i][3] for i in picked} - {None}
            novelty = {i: (rows[i][2] not in domains) + (rows[i][3] not in groups) for i in range(1, n - 1) if i not in picked}
            picked.append(min(novelty, key=lambda i: (-novelty[i], i)))
        got = chronology.select_occurrences(dated_rows(spark, rows)).collect()
        assert sorted(r["cand_id"] for r in got) == sorted(rows[i][0] for i in picked)
