"""Plans of the series and layout queries: how often stored tables are scanned by the plan that a query returns."""
import pytest

import __spark_entry__ as entry

NAMES = ["win_quiet_bands", "win_safe_cut", "win_protected_regions", "win_merge_fragments", "lay_safe_valley", "win_content_runs", "win_best_cut", "win_smooth_box", "lay_gap_cut",
         "lay_safe_cut_shrink", "lay_split_points", "lay_split_oversized", "lay_page_pack", "lay_overlap_trim"]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


@pytest.mark.parametrize("name", NAMES)
def test_scans(spark, sf_dir, name):
    assert scans(entry.queries()[name](spark, sf_dir)) <= 4


def test_documents_are_read_once(spark, sf_dir):
    """The series queries read the written rows, not the texts."""
    for name in ("win_quiet_bands", "win_smooth_box", "win_content_runs"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan and "FileScan" in plan
