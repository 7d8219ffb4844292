import duckdb
import pytest

import __spark_entry__ as entry
from checks.run import VIEWS, compare

FOLDER = "/root/testdata/sf0.001"


def test_entry_has_rows_and_a_stable_schema(spark):
    a, b = entry.entry(spark), entry.entry(spark)
    assert a.schema == b.schema and a.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name",
    ["monthly_feature_table", "fact_children_join_salted", "business_kpis", "clean_panel", "psi_selection",
     "correlation_matrix", "rolling_baselines", "shap_linear", "stream_panel_refresh"],
)
def test_queries_match_their_oracles(spark, name):
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM '{FOLDER}/{v}.parquet'")
    verdict = compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
