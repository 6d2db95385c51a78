"""Operators where workers cannot import the package: the driver alone has it on its path."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
DRIVER = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate())
docs = spark.createDataFrame([(i, ("the cat sat on the mat " if i % 2 else "der Hund lag auf dem Sofa ") * 3, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
from cadenza.llm import langid, quality
if sys.argv[3] == "language":
    out = langid.identify(docs).where("lang = lang_pred")
else:
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    out = quality.classify(docs, labels).where("score between 0 and 1")
assert len(out.collect()) == 60
spark.stop()
"""


@pytest.mark.parametrize("operator", ["language", "quality"])
def test_workers_without_the_package(operator, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", DRIVER, str(REPO), str(tmp_path / "shared"), operator], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-3000:]
