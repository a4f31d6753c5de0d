"""Grouped operators run when neither the driver nor the workers start in the repository."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {path!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from salespark.session import build_session
spark = build_session("elsewhere", "4", 4)
for name in ("order_anomalies", "revenue_forecast"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_package_reaches_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(path=str(ROOT / "__spark_entry__.py"))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "order_anomalies" in done.stdout and "revenue_forecast" in done.stdout
