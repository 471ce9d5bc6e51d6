"""Tasks run where only the driver can import the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from flowhunt.llm.queries import QUERIES
from flowhunt.session import build_session

spark = build_session("alone", master="local[2]", settings={
    "spark.ui.enabled": "false", "spark.checkpoint.dir": sys.argv[2], "spark.sql.shuffle.partitions": "4"})
for name, query in QUERIES.items():
    print(name, query(spark, "/root/testdata/sf0.001").count())
"""


def test_tasks_are_shipped_by_value(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, REPO, str(tmp_path)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-2000:]
    assert len(run.stdout.splitlines()) == 13
