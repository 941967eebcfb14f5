"""Registered queries against their SQL twins on the smallest tables.

By default a query of each kind; ITEMLOOM_ALL=1 runs them all, as check_queries.py does.
"""

import os

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck

SF = "/root/testdata/sf0.001"
CORE = """
facets_filtered scope_filter_for_absence page_of_every_row mark_history toggle_fold marks_import question_verification
current_answer_key attempt_score first_exposure_response seen_ordinal answer_log_fold exam_rows question_rows reference_rows
question_detail table_plan verify_summary corpus_problems corpus_fingerprint study_index exam_profiles coverage_matrix
citation_index distinctive_terms graded_attempts blueprint_cross_check draw_weighted draw_share_report search_terms
search_bm25 search_snippets outline_nodes outline_problems markdown_violations stream_current_mark
stream_answer_log outline_refused guessing_calibration table_changes apply_unchanged shard_scan stripped_markdown projection_state draw_ids
""".split()
NAMES = sorted(entry.queries() if os.environ.get("ITEMLOOM_ALL") else CORE)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_twin(spark, con, name):
    note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert note.startswith(("ok", "rows-only")) and "EMPTY" not in note, note


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
