"""The catalogue against its SQL on the smallest tables."""

import os

import pandas as pd
import pytest

from flowhunt.plans.catalog import QUERIES
from flowhunt.plans.forest_oracle import FOREST_ORACLE
from flowhunt.plans.model_oracle import MODEL_ORACLE
from flowhunt.plans.oracle import ORACLE as BASE_ORACLE
from flowhunt.plans.stream_oracle import STREAM_ORACLE

ORACLE = {**BASE_ORACLE, **MODEL_ORACLE, **FOREST_ORACLE, **STREAM_ORACLE}

SF_DIR = "/root/testdata/sf0.001"
TABLES = "events pages".split()
# One query per stage of the pipeline; the rest share these stages.
CHECKED = [
    "flow_features", "session_flows", "beacon_intervals", "describe_flows", "capture_decode", "apply_rules", "alerts",
    "timelines", "detection_metrics", "metrics_by_type", "label_wildcard_join", "label_masks", "stream_counters",
    "stream_alerts", "stream_incidents", "shapley_values", "explain_alerts", "narratives", "bootstrap_ci", "score_fusion",
    "isolation_forest_scores", "forest_score_fusion", "capture_files", "stream_flush", "packet_stats_json", "live_flow_files",
    "cross_validate_fitted", "evaluation_report", "stream_alerts_kept",
]



def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    return sorted(
        tuple("" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
        for r in frame.astype(object).itertuples(index=False)
    )


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    got, expected = QUERIES[name](spark, SF_DIR).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
