import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import tessera.operators.ingest as probe
from tessera.scratch import Scratch

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
Scratch(spark)

def task(batches):
    import tessera.operators.ingest as there
    for batch in batches:
        assert there.CELL == probe.CELL
        yield batch

print("rows", spark.range(3).mapInArrow(task, "id long").count())
"""


def test_tasks_import_the_package_from_another_folder(tmp_path):
    """Only the driver's own path has the repository, and the session starts elsewhere."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180
    )
    assert "rows 3" in run.stdout, run.stderr[-2000:]
