"""What a session leaves behind."""

import os
import subprocess
import sys

RUN = """
import sys
from pyspark.sql import SparkSession
from corpusloom.session import checkpoint_folder, delete_at_exit, durable
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
named = "file://" + sys.argv[1]
spark.sparkContext._conf.set("spark.checkpoint.dir", named)
assert checkpoint_folder(spark).rstrip("/").endswith("/shared"), checkpoint_folder(spark)
kept = durable(spark.range(5))
folder = checkpoint_folder(spark) + "/stage"
delete_at_exit(spark, folder)
spark.range(3).write.parquet(folder + "/0")
assert spark.read.parquet(folder + "/0").count() == 3 and kept.count() == 5
print("done")
spark.stop()
"""


def test_folders_go_when_the_application_ends(tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    (shared / "other").write_text("of somebody else")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", RUN, str(shared)], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("done"), done.stderr[-2000:]
    assert [p.name for p in shared.iterdir()] == ["other"]
