import os
import subprocess
import sys

import pytest

from siftwell import store


def test_session_without_a_shared_folder(tmp_path):
    """The README's first lines, on a Spark that sets nothing by itself."""
    code = """
from siftwell.session import build_session
from siftwell.plans.catalogue import QUERIES
from siftwell import store
s = build_session("local[2]", 2)
assert s.conf.get("spark.checkpoint.dir", None) is None
assert QUERIES["bm25_topk"](s, "/root/testdata/sf0.001").count() > 0
assert store.shared_dir(s) == store.shared_dir(s)
store.clear(s)
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(__file__))}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_versions(spark, tmp_path):
    v = store.Versions(spark, str(tmp_path / "state"), "name string, n long")
    assert v.latest() == 0 and v.read().count() == 0
    one = spark.createDataFrame([("a", 1)], "name string, n long")
    assert v.commit(one, 0) == 1 and v.commit(one.union(one), 1) == 2
    assert v.read().count() == 2 and v.read(1).count() == 1
    with pytest.raises(RuntimeError):
        v.commit(one, 1)
    (tmp_path / "state" / "v000000003").mkdir()  # what a crashed job leaves
    assert v.latest() == 2
    # A folder that a crash left is in the way of the next commit; it may be removed, as it never counted.
    (tmp_path / "state" / "v000000003").rmdir()
    assert v.commit(one, 2) == 3
