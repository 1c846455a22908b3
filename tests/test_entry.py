import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = (
    "vector_neighbours_cells", "eval_per_item", "validated_parts", "order_snapshot_diff", "search_views", "value_quantiles", "facet_counts", "entity_coverage", "text_features",
    "phrase_hits", "changes_upserted", "review_feed", "reminder_items", "badge_announcements", "page_glossary", "log_metrics_stream",
)


def plain(rows):
    return sorted(tuple("∅" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()[-1]) > 150


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    got = entry.queries()[name](spark, DIR).select(*columns).collect()
    assert plain(got) == plain(expected)
