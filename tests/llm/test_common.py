from types import SimpleNamespace

import pytest

from rasterflow.llm import common


def fake(master, where=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: where or default), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    assert common.shared_dir(fake("spark://host:7077", "hdfs://store/tmp")) == "hdfs://store/tmp"
    assert common.shared_dir(fake("local[4]", "file:///shared")) == "file:///shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(fake(master))
    assert common.shared_dir(fake("local[2]")) == common.shared_dir(fake("local"))
