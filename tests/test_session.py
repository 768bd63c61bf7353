import subprocess
import sys
from pathlib import Path

import pytest

from tidemark.session import run_folder, shared_folder

ROOT = str(Path(__file__).resolve().parents[1])


class Session:
    """Stands for a session: only what is asked of one here."""

    def __init__(self, named, checkpoint=None, master="local[2]"):
        self.conf = self
        self.sparkContext = self
        self.master = master
        self.named, self.checkpoint = named, checkpoint

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.named or default

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, folder):
        self.checkpoint = folder


def test_the_folder_the_cluster_names_is_used():
    assert shared_folder(Session("hdfs://name/shared/")) == "hdfs://name/shared"
    assert shared_folder(Session(None, "s3a://bucket/run")) == "s3a://bucket/run"


def test_a_folder_of_its_own_is_set_only_where_none_is_named():
    session = Session(None)
    assert shared_folder(session) == session.checkpoint == shared_folder(session)


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://x"])
def test_a_cluster_must_name_its_shared_folder(master):
    session = Session(None, master=master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
    assert session.checkpoint is None
    assert shared_folder(Session("hdfs://name/shared", master=master)) == "hdfs://name/shared"


def test_two_runs_never_share_a_folder():
    session = Session("/shared")
    assert run_folder(session, "a") != run_folder(session, "a")


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The driver alone can import it; worker processes get the code with their task."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from tidemark.operators import vector_topk, vector_topk_batch
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.createDataFrame([(1, [1.0]), (2, [3.0])], "id long, vector array<double>")
asked = rows.toDF("query_id", "query_vector")
print("one", [r["id"] for r in vector_topk(rows, [2.9], 1).collect()])
print("many", sorted((r["query_id"], r["id"]) for r in vector_topk_batch(rows, asked, 1).collect()))
"""
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "one [2]" in done.stdout and "many [(1, 1), (2, 2)]" in done.stdout, done.stderr
