import os
import subprocess
import sys

import pytest

from panelforge import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: A session without ``spark.checkpoint.dir``, in a folder from which workers cannot import the package.
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from panelforge.session import build_session, shared_dir
spark = build_session(master="local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
assert spark.conf.get("spark.checkpoint.dir", None) is None
rows = entry.queries()["pacf"](spark, "/root/testdata/sf0.001").count()
assert shared_dir(spark) == shared_dir(spark)
print("rows", rows)
"""


def test_local_session_without_a_folder_and_without_python_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")}
    env["SPARK_CONF_DIR"] = str(tmp_path)
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-3000:]
    assert int(out.stdout.split("rows")[1]) > 0


class Cluster:
    """As much of a cluster's session as is asked."""

    def __init__(self, master, **conf):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": lambda _, k, d=None: conf.get(k, d)})()


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]", "spark://host:7077"])
def test_cluster_must_name_its_folder(master):
    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster(master))
    assert session.shared_dir(Cluster(master, **{"spark.checkpoint.dir": "/shared/x/"})) == "/shared/x"
