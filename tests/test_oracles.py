"""Registered queries against their DuckDB twins, on the smallest tables; one of each subject is enough here, the
driver compares all of them."""

import os
import subprocess
import sys

import pytest

from strand import registry
from tests.oracle import check

NAMES = [
    "thread_flagship", "JOIN04_similarity_join", "AGG02_evaluation", "FLT01_passage_length", "JOIN02_semi_join", "WIN01_line_islands", "JOIN09_interval_join", "SRC08_jsonl",
    "SRC09_dict_dump", "SRC11_key_value", "STR02_tokenizers", "DAT05_relative_weekday", "DAT06_relative_unit", "DAT11_fractional_days", "VEC04_entity_weight", "VEC10_box_area",
    "TXT01_tf_idf", "TXT06_thread_keywords", "GRF03_bounded_paths", "GRF09_merged_threads", "JOIN10_candidate_pairs", "COR06_clusters", "AGG17_muc", "WIN07_entity_runs", "STM01_ledger_stream",
]


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.001")


def test_every_twin_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_queries_are_read_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
