"""Registered queries against SQL on the smallest tables. ``GALLEY_ALL=1`` runs every query."""

import os

import pytest

import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
ALWAYS = [
    "remove_repeated_lines", "repeated_lines_table", "remove_page_furniture", "extract_best_doi", "parse_pages", "assemble_references",
    "normalize_references", "carry_sections", "dedupe_references", "issue_config", "match_source_files", "match_requests", "best_candidate",
    "issue_page_range", "lines_from_words", "char_gap_stats", "words_in_boxes", "average_bbox", "apply_form", "article_errors", "html_blocks",
    "jats_metadata", "progress_stream", "list_runs", "order_articles", "order_events", "write_issue_xml", "xsd_errors", "renumber",
    "page_metadata", "locate_article", "distinct_in_order", "template_summary",
    "scan_articles", "ingest_stream", "scan_source_files", "scan_requests", "scan_journals", "decode_text", "write_articles", "fix_intra_word_breaks",
]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(QUERIES) if os.environ.get("GALLEY_ALL") else ALWAYS

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status, note, _ = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    # A query without SQL has a test of its own and is only run here.
    assert status == ("ok" if name in ORACLES else "rows-only"), note


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_registry():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 180
