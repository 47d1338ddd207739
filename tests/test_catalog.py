"""Registered queries against their SQL, and plan checks."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import compare  # noqa: E402

from fieldloom.catalog import all_oracles, all_queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
QUICK = [
    "load_keys", "merge_extra_keys", "assemble_pages", "split_pages", "page_of_position", "fallback_section_map",
    "grid_cells", "stitch_cross_page", "detect_format", "route_key_to_section", "keyword_search", "vector_topk_cells",
    "alias_research", "definition_candidates", "format_check", "registry_upsert", "progress", "status_stream",
    "extract_fields", "value_cascade", "result_row", "embed_snippets", "dedup_uploads", "step_timings", "result_response", "persist_index",
]
NATIVE = [
    "split_pages", "grid_cells", "stitch_cross_page", "definition_candidates", "route_key_to_section", "keyword_search",
    "build_snippet_index", "extract_fields",
]


@pytest.mark.skipif(not Path(DATA).exists(), reason="tables not present")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    message, good = compare.compare(spark, compare.connect(DATA), name, all_queries()[name], all_oracles()[name], DATA)
    assert good, message


@pytest.mark.skipif(not Path(DATA).exists(), reason="tables not present")
@pytest.mark.parametrize("name", NATIVE)
def test_plans_stay_native(spark, name):
    plan = all_queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in plan


def test_every_sql_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
