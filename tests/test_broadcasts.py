"""Company-month tables, small as files and large in memory, are never broadcast by Spark's own sizes."""

import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Findings of round 4: queries that failed by the driver's memory on sixty-fold tables.
FAILED = {
    "F3": "anomalies",
    "F4": "confidence_score",
    "F5": "error_summary",
    "F6": "evidence",
    "F7": "evidence_all",
    "F8": "evidence_tree",
    "F9": "review_queue",
    "F10": "run_outcome",
    "F11": "scoreboard",
    "F12": "suppressed_series",
    "F13": "accuracy_buckets",
    "F14": "comparison_totals",
    "F15": "estimate_refreshed",
    "F16": "estimates_stored",
    "F17": "growth_latest",
    "F18": "growth_windows",
    "F19": "benchmark_disagreement",
    "F20": "band_histogram",
    "F21": "benchmark_comparison",
    "F22": "company_growth_report",
    "F23": "comparison_rows",
    "F24": "evaluation_snapshot",
    "F25": "evidence_items",
    "F26": "export_monthly_series",
}


def broadcast_scans(plan: str) -> list[str]:
    """Scans of stored tables by month or segment below the BroadcastExchanges of a plan; a join in between counts as the product of its sides, which is never too low."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    lines, found = plan.split("\n"), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((k for k in range(i + 1, len(lines)) if depth(lines[k]) <= depth(line)), len(lines))
            below = lines[i + 1 : end]
            if not any("Join" in x for x in below):
                found += [x.strip() for x in below if "/testdata/" not in x and re.search(r"FileScan parquet \[[^]]*(month|segment)", x)]
    return found


@pytest.mark.parametrize("name", FAILED.values(), ids=FAILED)
def test_no_company_months_are_broadcast(spark, monkeypatch, name):
    plans = []
    write = DataFrameWriter.parquet

    def recorded(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    rows = entry.queries()[name](spark, SF + "/." * (1 + list(FAILED.values()).index(name)))  # a path, and so a store, of its own
    plans.append(rows._jdf.queryExecution().executedPlan().toString())
    assert rows.count() > 0
    assert any("BroadcastExchange" in p or "SortMergeJoin" in p for p in plans)
    assert [scan for p in plans for scan in broadcast_scans(p)] == []
