"""What operators write goes when the driver ends, and is never put where executors cannot see it."""

import os
import subprocess
import sys

import pytest

from docaudit.sources.shared import shared_dir

RUN = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{at}").getOrCreate()
for name in ("op5_line_dedup", "op9_ngram_jaccard", "op11_sharding", "op13_centroids", "a13_stage_funnel"):
    e.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
import os
assert os.listdir("{at}")
spark.stop()
"""


def test_the_shared_folder_is_empty_in_the_end(tmp_path):
    said = subprocess.run([sys.executable, "-c", RUN.format(at=tmp_path)], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert said.returncode == 0, said.stderr[-2000:]
    # Spark's own folder for checkpoints stays, without a file.
    assert not [f for _, _, files in os.walk(tmp_path) for f in files]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, other):
            return None

    class Spark:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})()

    with pytest.raises(ValueError, match="share"):
        shared_dir(Spark())
