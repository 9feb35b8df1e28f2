import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
from tarn.plans.session import local_session
from tarn.sources.pages import HttpSource
spark = local_session("2", 2, "1g")
df = spark.createDataFrame([("nonsense",)], "url string")
print("OK", HttpSource(retries=0)(df).collect()[0].ok)
import __spark_entry__ as entry
if "p2_found" in entry.queries():
    print("ROWS", entry.queries()["p2_found"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_get_the_package(tmp_path):
    """From another folder, without PYTHONPATH: workers can't find the package by themselves."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "OK False" in done.stdout, done.stderr[-2000:]
    assert "ROWS" in done.stdout or not (ROOT / "tarn" / "llm").exists(), done.stderr[-2000:]
