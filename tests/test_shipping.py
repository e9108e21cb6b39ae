"""The package reaches Python workers that cannot import it: a driver started in another folder."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.sql.shuffle.partitions", "2").config(
    "spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
print("rows", entry.queries()["correlation_prune"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    home = tmp_path / "home"  # executors of a local cluster work below Spark's home
    home.mkdir()
    import pyspark

    for p in Path(pyspark.__file__).parent.iterdir():
        (home / p.name).symlink_to(p) if p.name != "work" else None
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(REPO), str(tmp_path / "shared")], cwd=tmp_path, env=env | {"SPARK_HOME": str(home)},
        capture_output=True, text=True, timeout=240)
    assert "rows " in done.stdout, done.stderr[-3000:]
